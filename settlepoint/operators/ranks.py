"""Ranks, running sums and exact quantiles of keys of any size: sorted ranges and their offsets, no key in one task.

Values are counted per key first, so equal values are one row and no tie spans two ranges. The counts are sorted by range,
summed up inside each range as they stream by, and written once; a range's offset within a key is one row a key and range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path


def key_text(keys: list[str]) -> Column:
    """The keys as one string that is equal for equal keys, nulls included."""
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def cumulative(df: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """df with _key, _index (smaller rows of the key) and _before (the sum of their weights); weights are longs.

    df has one row per key and order value, none of them null.
    """
    spark, columns = df.sparkSession, df.columns
    ranged = df.withColumn("_key", key_text(keys)).repartitionByRange("_key", order).sortWithinPartitions("_key", order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_index", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, total = None, 0, 0  # of the key that the batches before ended in
        for b in batches:
            by = b.groupby("_key", sort=False)
            index, before = by.cumcount(), by[weight].cumsum() - b[weight]
            went_on = b["_key"] == key
            b["_index"], b["_before"] = index + went_on * count, before + went_on * total
            if len(b):
                key = b["_key"].iloc[-1]
                count, total = int(b["_index"].iloc[-1]) + 1, int(b["_before"].iloc[-1] + b[weight].iloc[-1])
            yield b

    path = shared_path(spark, "ranks")
    ranged.mapInPandas(sums, ranged.schema).write.parquet(path)
    rows = spark.read.parquet(path)
    ranges = rows.groupBy("_part", "_key").agg(F.count("*").alias("_rows"), F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_part", "_key", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_o1"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_o2"))
    out = rows.join(offsets, ["_part", "_key"])
    return out.select(*columns, "_key", (F.col("_index") + F.col("_o1")).alias("_index"), (F.col("_before") + F.col("_o2")).alias("_before"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each named share (0.5: the median) of the key's values, linearly interpolated.

    Nulls and NaN take no part; a key without values has no row.
    """
    v = F.col(value).cast("double")
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
    placed = cumulative(counted, keys, "_v", "_n")
    totals = placed.groupBy("_key").agg(F.sum("_n").alias("_total"))
    placed = placed.join(totals, "_key")
    firsts, out = [F.first(k).alias(k) for k in keys], []
    for name, share in shares.items():
        at = (F.col("_total") - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)
        holds = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_n"))
        a, b = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v")))
        out.append((a + (b - a) * F.max(at - low)).alias(name))
    return placed.groupBy("_key").agg(*firsts, *out).drop("_key")


@cache
def _subset_sums(n: int) -> list[int]:
    """The number of subsets of 1..n with each sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return ways


def signed_rank_p(n: int, plus: float, tie_sum: float, zeros: bool) -> float:
    """Two-sided p of the rank sum `plus` of n non-zero differences: exact without ties and zeros up to 50, else the
    normal approximation with its tie correction (tie_sum: the sum of t ** 3 - t over groups of equals)."""
    if n == 0:
        return 1.0
    low = min(plus, n * (n + 1) / 2 - plus)
    if n > 50 or tie_sum > 0 or zeros:
        from statistics import NormalDist

        variance = n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48
        return min(1.0, 2 * NormalDist().cdf((low - n * (n + 1) / 4) / variance**0.5)) if variance > 0 else 1.0
    return min(1.0, 2 * sum(_subset_sums(n)[: int(low) + 1]) / 2**n)


def rank_sums(paired: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """keys, n (all differences), n_used (the non-zero), rank_sum of the positive ones by size (average ranks for ties)
    and tie_sum; nulls and NaN take no part."""
    d = F.col(diff).cast("double")
    sizes = paired.where(d.isNotNull() & ~F.isnan(d)).groupBy(*keys, F.abs(d).alias("_size"))
    counted = sizes.agg(F.count_if(d > 0).alias("_pos"), F.count("*").alias("_n"))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("n")).withColumn("_key", key_text(keys))
    placed = cumulative(counted.where("_size > 0"), keys, "_size", "_n")
    n = F.col("_n").cast("double")
    twice = F.col("_pos").cast("decimal(19,0)") * (2 * F.col("_before") + F.col("_n") + 1).cast("decimal(19,0)")
    per = placed.groupBy("_key").agg(F.sum("_n").alias("n_used"), (F.sum(twice).cast("double") / 2).alias("rank_sum"), F.sum(n * n * n - n).alias("tie_sum"))
    none = F.lit(0.0)
    return totals.join(per, "_key", "left").select(
        *keys, "n", F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("rank_sum", none).alias("rank_sum"), F.coalesce("tie_sum", none).alias("tie_sum")
    )


def wilcoxon(paired: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """keys, n and the two-sided signed-rank p of the differences of each key."""

    @F.pandas_udf("double")
    def p(n: pd.Series, used: pd.Series, plus: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(u, w, t, u < m) for m, u, w, t in zip(n, used, plus, ties)], dtype="float64")

    return rank_sums(paired, keys, diff).select(*keys, "n", p("n", "n_used", "rank_sum", "tie_sum").alias("p"))
