"""Paired comparison of experiment arms over the artifacts that both have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets, stats


def majority_regimes(metrics: DataFrame, order: str = "run_id") -> DataFrame:
    """artifact_id, arm and the most frequent regime of its replicates (ties: the first run's)."""
    return stats.majority_label(metrics, ["artifact_id", "arm"], "regime", [order])


def paired_means(metrics: DataFrame, a: str, b: str, scores: tuple[str, ...]) -> DataFrame:
    """metric, artifact_id, a, b, diff: replicate means of each arm, where the artifact has both."""
    by_arm = [F.avg(F.when(F.col("arm") == arm, F.col(s).cast("double"))).alias(f"{side}_{s}") for s in scores for side, arm in (("a", a), ("b", b))]
    wide = metrics.where(F.col("arm").isin(a, b)).groupBy("artifact_id").agg(*by_arm)
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("metric"), F.col(f"a_{s}").alias("a"), F.col(f"b_{s}").alias("b")) for s in scores]))
    long = wide.select("artifact_id", rows.alias("r")).select("r.metric", "artifact_id", "r.a", "r.b")
    return long.where("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))


def mcnemar(metrics: DataFrame, a: str, b: str, labels: tuple[str, ...]) -> DataFrame:
    """Per label: discordant artifacts by majority regime, exact p, rates, and the Wald interval of their difference."""
    majority = majority_regimes(metrics)
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("regime")))
    both = majority.groupBy("artifact_id").agg(pick(a).alias("ra"), pick(b).alias("rb")).where("ra is not null and rb is not null")
    long = both.select("ra", "rb", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    in_a, in_b = F.col("ra") == F.col("label"), F.col("rb") == F.col("label")
    counts = long.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(in_a & ~in_b).alias("a_only"), F.count_if(in_b & ~in_a).alias("b_only"),
        F.avg(in_a.cast("double")).alias("rate_a"), F.avg(in_b.cast("double")).alias("rate_b"),
    )
    diff, low, high = stats.paired_rate_interval(F.col("a_only"), F.col("b_only"), F.col("n"))
    p = stats.mcnemar_exact(F.col("a_only"), F.col("b_only"))
    return counts.select("*", p.alias("p"), diff.alias("diff"), low.alias("ci_low"), high.alias("ci_high"))


def diagnostics(metrics: DataFrame) -> DataFrame:
    """Per arm: late discoveries by opportunity, distinct true elements found, recall of round 0."""
    r = F.col("rounds")
    per = metrics.select(
        "arm", "stabilized_round", "n_defects", F.size(sets.late_true(r)).alias("late"), F.size(sets.distinct_true(r)).alias("found"), sets.round0_recall(r, F.col("n_defects")).alias("r0")
    )
    out = per.groupBy("arm").agg(
        F.sum("late").alias("late_defects"), F.sum("stabilized_round").alias("opportunity"), F.sum("found").alias("found"), F.sum("n_defects").alias("total"), F.avg("r0").alias("round0_recall")
    )
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    return out.withColumn("per_opportunity", ratio("late_defects", "opportunity")).withColumn("found_rate", ratio("found", "total"))


def arm_values(rows: DataFrame, value: Column, a: str, b: str) -> DataFrame:
    """artifact_id with sums and counts of a value in both arms (sa, na, sb, nb), where it has both."""
    v = rows.withColumn("_v", value)
    side = lambda arm, x: F.when(F.col("arm") == arm, x)
    out = v.groupBy("artifact_id").agg(
        F.sum(side(a, F.col("_v"))).alias("sa"), F.count(side(a, F.col("_v"))).alias("na"), F.sum(side(b, F.col("_v"))).alias("sb"), F.count(side(b, F.col("_v"))).alias("nb")
    )
    return out.where("na > 0 and nb > 0")


def defect_projected(metrics: DataFrame) -> DataFrame:
    """Adds the regime under settling of the true elements alone (settled runs keep theirs)."""
    last, before = F.try_element_at("rounds", F.lit(-1)), F.try_element_at("rounds", F.lit(-2))
    settled = F.coalesce(sets.same_set(sets.true_elements(last), sets.true_elements(before)), F.lit(False))
    correct = sets.terminal_correct(F.col("terminal_recall"), F.col("terminal_false_fraction"))
    label = F.when(F.col("converged") | ~settled, F.col("regime")).when(correct, sets.REGIMES[0]).otherwise(sets.REGIMES[1])
    return metrics.withColumn("settled_projection", settled).withColumn("projected", label)
