"""Exact tests, intervals and agreement measures as column expressions, and their grouped forms."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p of k successes (k <= n / 2) in n fair trials, summed in logarithms."""
    n = n.cast("double")
    start = F.struct(F.lit(0.0).alias("sum"), (-n * F.log(F.lit(2.0))).alias("log"))
    tail = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        start,
        lambda a, i: F.struct((a["sum"] + F.exp(a["log"])).alias("sum"), (a["log"] + F.coalesce(F.log((n - i) / (i + 1)), F.lit(0.0))).alias("log")),
        lambda a: F.least(F.lit(1.0), 2 * a["sum"]),
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(tail)


def mcnemar_exact(b: Column, c: Column) -> Column:
    return binomial_two_sided(F.least(b, c), b + c)


def sign_counts(diff: Column, tolerance: float = TOLERANCE) -> list[Column]:
    """Aggregates n, pos, neg and tie of paired differences."""
    return [
        F.count(diff).alias("n"),
        F.count_if(diff > tolerance).alias("pos"),
        F.count_if(diff < -tolerance).alias("neg"),
        F.count_if(F.abs(diff) <= tolerance).alias("tie"),
    ]


def sign_test(paired: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """keys, n, pos, neg, tie, p, the mean difference and its normal 95 % interval."""
    d = F.col(diff)
    out = paired.groupBy(*keys).agg(*sign_counts(d), F.avg(d).alias("mean_diff"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    out = out.withColumn("p", mcnemar_exact(F.col("pos"), F.col("neg")))
    return out.withColumn("ci_low", F.col("mean_diff") - half).withColumn("ci_high", F.col("mean_diff") + half).drop("sd")


def paired_rate_interval(b: Column, c: Column, n: Column) -> tuple[Column, Column, Column]:
    """Difference of two paired rates from their discordant counts, with its Wald 95 % interval."""
    diff = (b - c) / n
    variance = (b + c - (b - c) * (b - c) / n) / (n * n)
    half = 1.96 * F.sqrt(F.greatest(variance, F.lit(0.0)))
    return diff, diff - half, diff + half


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion; (0, 0) without trials."""
    p, n = F.try_divide(k, n), n.cast("double")
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return (
        F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0),
        F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0),
    )


def cohen_kappa(a: Column, b: Column) -> Column:
    """Aggregate: kappa of two boolean raters; 1 where chance agreement is certain."""
    x, y = F.avg(a.cast("double")), F.avg(b.cast("double"))
    po = F.avg((a == b).cast("double"))
    pe = x * y + (1 - x) * (1 - y)
    return F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe))


def precision_recall(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """P, R and accuracy are 1 and F1 is 0 where their denominator is 0."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0))
    f = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return {"precision": p, "recall": r, "f1": f, "accuracy": F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), F.lit(1.0))}


def majority_vote(vote: Column) -> Column:
    """Aggregate: more than half say yes; ties are no."""
    return F.sum(vote.cast("int")) * 2 > F.count(vote)


def majority_label(rows: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """keys and the most frequent label; of equally frequent ones the first in order."""
    first = F.min(F.struct(*order)).alias("_first")
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"), first)
    best = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), F.col("_first"))
    return counts.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*keys, label)


def holm(tests: DataFrame, p: str = "p", order: str = "test") -> DataFrame:
    """Adds p_holm and survives; the windows run over one row per test of the family."""
    rank = Window.orderBy(p, order)
    m = F.count("*").over(Window.partitionBy())
    adjusted = F.least(F.lit(1.0), (m - F.row_number().over(rank) + 1) * F.col(p))
    running = F.max("_adjusted").over(rank.rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("_adjusted", adjusted).withColumn("p_holm", running).withColumn("survives", F.col("p_holm") < 0.05).drop("_adjusted")


def min_significant_gap(pairs: Column, alpha: float = 0.05) -> Column:
    """The smallest |b - c| of the same parity as b + c = pairs that is significant, null if none is."""
    gaps = F.filter(F.sequence(F.lit(0), pairs.cast("int")), lambda g: (pairs.cast("int") - g) % 2 == 0)
    found = F.filter(gaps, lambda g: binomial_two_sided(((pairs - g) / 2).cast("int"), pairs) < alpha)
    return F.array_min(found)


def exact_tail(k: int, n: int) -> float:
    """Plain form of binomial_two_sided, for callers outside a plan."""
    return 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def significance(p: Column) -> Column:
    """Stars, or ns where there are none."""
    return F.coalesce(F.nullif(stars(p), F.lit("")), F.lit("ns"))


def format_p(p: Column) -> Column:
    """Four decimals, or <0.001; null stays null."""
    return F.when(p < 0.001, "<0.001").when(p.isNotNull(), F.format_string("%.4f", p))
