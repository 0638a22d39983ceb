"""Trailing windows over timestamped values: keep ts > latest - width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def rolling_stats(df: DataFrame, keys: list[str], ts: str, value: str, width: int, max_samples: int | None = None) -> DataFrame:
    """df with n, total, mean, low, high, span and variance (population) of the window that ends at each row.

    ts is an integer column (say microseconds), so the half-open window is an exact range frame. With
    max_samples only that many last rows of the window count.
    """
    w = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-width + 1, 0)
    if max_samples is None:
        v = F.col(value)
        aggregates = [F.count(v), F.sum(v), F.avg(v), F.min(v), F.max(v), F.var_pop(v)]
        n, total, mean, low, high, variance = (a.over(w) for a in aggregates)
        out = df.select("*", n.alias("n"), total.alias("total"), mean.alias("mean"), low.alias("low"), high.alias("high"), variance.alias("variance"))
        return out.withColumn("span", F.col("high") - F.col("low"))
    last = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-max_samples + 1, 0)
    near = F.filter(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))).over(last), lambda x: x["t"] > F.col(ts) - width)
    out = df.withColumn("_v", F.transform(near, lambda x: x["v"]))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("n", F.size("_v").cast("long")).withColumn("total", total).withColumn("mean", total / F.size("_v"))
    out = out.withColumn("low", F.array_min("_v")).withColumn("high", F.array_max("_v")).withColumn("span", F.col("high") - F.col("low"))
    mean = F.col("mean")
    return out.withColumn("variance", F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size("_v")).drop("_v")


def rolling_percentiles(df: DataFrame, keys: list[str], ts: str, value: str, width: int, shares: dict[str, float]) -> DataFrame:
    """df with a column for each named share (0.5: the median), interpolated, of the window that ends at each row."""
    w = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-width + 1, 0)
    return df.select("*", *[F.percentile(F.col(value), F.lit(p)).over(w).alias(name) for name, p in shares.items()])


def snapshot(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, min, max, p50 and p95 (linear interpolation) per key; the percentiles by ranks, however large the key."""
    v = F.col(value)
    plain = df.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    shares = ranks.quantiles(df, keys, value, {"p50": 0.5, "p95": 0.95}).withColumn("_of", ranks.key_text(keys)).select("_of", "p50", "p95")
    out = plain.withColumn("_key", ranks.key_text(keys))
    return out.join(shares, F.col("_key") == F.col("_of"), "left").drop("_key", "_of")
