"""Half-open intervals [lo, hi) of a key: merging, coverage, conflicts, greedy selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import key_text


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Empty intervals overlap nothing."""
    return (a_lo < a_hi) & (b_lo < b_hi) & (a_lo < b_hi) & (b_lo < a_hi)


def overlap_amount(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def merge_intervals(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """keys, lo, hi of the union of each key's intervals; touching ones fuse."""
    before = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(lo) < F.col(hi)).withColumn("_reach", F.max(hi).over(before))
    rows = rows.withColumn("_new", (F.col("_reach").isNull() | (F.col(lo) > F.col("_reach"))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(upto))
    return rows.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def total_covered(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    return merge_intervals(df, keys, lo, hi).groupBy(*keys).agg(F.sum(F.col(hi) - F.col(lo)).alias("covered"))


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def dyadic_cover(lo: Column, hi: Column, levels: Column) -> Column:
    """[lo, hi) of whole numbers as disjoint dyadic buckets (level, bucket): [bucket * 2 ** level, (bucket + 1) * 2 ** level).

    At most two a level, so an interval has no more buckets than twice the logarithm of its length.
    """
    lo, hi = lo.cast("long"), hi.cast("long")

    def at(k: Column) -> Column:
        first, last = -_shifted(-lo, k), _shifted(hi, k)
        left = F.when((first < last) & (first.bitwiseAND(1) == 1), F.struct(k.alias("level"), first.alias("bucket")))
        right = F.when((first < last) & (last.bitwiseAND(1) == 1), F.struct(k.alias("level"), (last - 1).alias("bucket")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), levels), at)), lambda x: x.isNotNull())


def dyadic_point(at: Column, levels: Column) -> Column:
    """The bucket of each level that holds a point."""
    at = at.cast("long")
    return F.transform(F.sequence(F.lit(0), levels), lambda k: F.struct(k.alias("level"), _shifted(at, k).alias("bucket")))


def conflicts(df: DataFrame, keys: list[str], item: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """keys, a, b of overlapping pairs (a < b) of whole-numbered intervals; empty ones overlap nothing.

    Of two that overlap, the later start lies in the other: the buckets that cover an interval meet the buckets of starts
    in an equi-join, where every row is a pair, found once. An interval has O(log length) rows, whatever its length.
    """
    rows = df.where(F.col(lo) < F.col(hi)).select(*keys, F.col(item).alias("i"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    longest = rows.agg(F.coalesce(F.max(F.floor(F.log2((F.col("hi") - F.col("lo")).cast("double")))), F.lit(0)).cast("int").alias("levels"))
    rows = rows.crossJoin(F.broadcast(longest))  # one row
    cover = rows.select(*keys, "i", "lo", F.explode(dyadic_cover(F.col("lo"), F.col("hi"), F.col("levels"))).alias("at"))
    starts = rows.select(*keys, F.col("i").alias("j"), F.col("lo").alias("lo2"), F.explode(dyadic_point(F.col("lo"), F.col("levels"))).alias("at"))
    met = cover.select(*keys, "i", "lo", "at.*").join(starts.select(*keys, "j", "lo2", "at.*"), [*keys, "level", "bucket"])
    met = met.where("lo < lo2 or (lo = lo2 and i < j)").where("i <> j")
    return met.select(*keys, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def select_non_overlapping(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """keys, lo, hi of the most intervals of each key that do not overlap, by earliest end (ties: earliest start).

    A key's intervals stream by in order of their end (an external sort), and only the end of its last pick is held, so a
    key of any size takes a constant amount of memory.
    """
    rows = df.where(F.col(lo) < F.col(hi)).select(*keys, lo, hi)
    rows = (rows.repartition(*keys) if keys else rows.coalesce(1)).sortWithinPartitions(*keys, hi, lo).withColumn("_key", key_text(keys))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, reach = None, None
        for b in batches:
            taken = []
            for k, start, end in zip(b["_key"].tolist(), b[lo].tolist(), b[hi].tolist()):
                if k != key:
                    key, reach = k, None
                taken.append(reach is None or start >= reach)
                if taken[-1]:
                    reach = end
            yield b[np.array(taken, dtype=bool)].drop(columns="_key")

    return rows.mapInPandas(pick, rows.drop("_key").schema)
