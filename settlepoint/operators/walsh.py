"""Hodges-Lehmann estimates: order statistics of all Walsh averages (x + y) / 2, with no list of pairs and no key in one task.

A key's distinct values, in order, are cut into blocks of equal size, about the square root of their number. Counts of
blocks bound how many averages lie up to a bound, which brackets each wanted rank; a key with few values is done then.
Otherwise each pass counts exactly at bounds inside the brackets: a block of x meets only the blocks of y in which
2 * bound - x can fall, a few of them, and whole blocks below are counted by their running sum. Once a bracket holds few
pairs, these are listed (equal ones counted) and ranked like any values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from .ranks import cumulative, key_text

BLOCKS = 4096  # blocks of a key at least, if it has as many values
BOUNDS = 32  # counted a pass and bracket
LISTED = 4_000_000  # ordered pairs in a bracket that are listed

_HISTOGRAM = ["_key", "block", "low", "high", "n", "before"]
_BRACKET = "_key string, rank int, target double, above double, upto double, n_above double, n_upto double"


def ordinal(x: float) -> int:
    """Doubles in order, as integers."""
    (bits,) = struct.unpack("<q", struct.pack("<d", x))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def double(n: int) -> float:
    return struct.unpack("<d", struct.pack("<Q", n if n >= 0 else (1 << 63) | -n))[0]


def _least(reaches, low: float, high: float) -> float:
    """The least double in [low, high] for which reaches holds; it holds for high."""
    a, b = ordinal(low), ordinal(high)
    while a < b:
        middle = (a + b) // 2
        a, b = (a, middle) if reaches(double(middle)) else (middle + 1, b)
    return double(a)


def wanted_ranks(n: int) -> list[int]:
    """1-based ranks of the two middle averages and of the ends of the 95 % interval, of n values."""
    m = n * (n + 1) // 2
    k = max(1, min(round(m / 2 - 1.959964 * (n * (n + 1) * (2 * n + 1) / 24) ** 0.5), m // 2))
    return [(m + 1) // 2, m // 2 + 1, k, m + 1 - k]


def first_brackets(blocks: pd.DataFrame) -> pd.DataFrame:
    """Brackets (above, upto] of a key's wanted ranks out of its block counts.

    Pairs are counted as ordered, with each value's pair with itself once more: twice the averages.
    """
    blocks = blocks.sort_values("block")
    low, high, n = (blocks[c].to_numpy() for c in ("low", "high", "n"))
    cum = np.concatenate([[0.0], np.cumsum(n, dtype=np.float64)])

    def count(ends: np.ndarray, bound: float) -> float:
        return float((n * cum[np.searchsorted(ends, 2 * bound - ends, side="right")]).sum() + cum[np.searchsorted(ends, bound, side="right")])

    out = []
    total = int(n.sum())
    for i, rank in enumerate(wanted_ranks(total)):
        # Counts are sums of doubles, exact up to 2 ** 25 values; beyond, a slack keeps the bracket on the safe side.
        slack = 1e-9 * rank if total > 1 << 25 else 0.0
        at_least = _least(lambda b, n=2 * rank - slack: count(low, b) >= n, low[0], high[-1])
        at_most = high[-1]
        if count(high, high[-1]) >= 2 * rank + slack:
            at_most = _least(lambda b, n=2 * rank + slack: count(high, b) >= n, low[0], high[-1])
        out.append((blocks["_key"].iloc[0], i, float(2 * rank), double(ordinal(at_least) - 1), float(at_most), None, None))
    return pd.DataFrame(out, columns=["_key", "rank", "target", "above", "upto", "n_above", "n_upto"])


@lru_cache(maxsize=1024)
def bounds_in(above: float, upto: float) -> np.ndarray:
    """The ends of a bracket and doubles between them, half even in value and half even in their order."""
    a, b = ordinal(above), ordinal(upto)
    inner = {double(a + (b - a) * i // (BOUNDS // 2)) for i in range(1, BOUNDS // 2)}
    inner |= {float(x) for x in above + (upto - above) * np.arange(1, BOUNDS // 2) / (BOUNDS // 2)}
    return np.array(sorted({above, upto} | {x for x in inner if above < x < upto}))


def meetings(key: tuple, blocks: pd.DataFrame, brackets: pd.DataFrame) -> pd.DataFrame:
    """Which blocks of y a block of x meets in each bracket, and how many values lie in the blocks before them."""
    blocks = blocks.sort_values("block")
    low, high, before, ids = (blocks[c].to_numpy() for c in ("low", "high", "before", "block"))
    out = []
    for r in brackets.itertuples():
        first = np.searchsorted(high, 2 * r.above - high, side="left")
        last = np.searchsorted(low, 2 * r.upto - low, side="right")
        for p in range(len(ids)):
            if first[p] == len(ids):  # all of y lies below
                out.append((key[0], r.rank, r.above, r.upto, ids[p], -1, float(before[-1] + blocks["n"].iloc[-1]), True))
                continue
            out.append((key[0], r.rank, r.above, r.upto, ids[p], ids[first[p]] if first[p] < last[p] else -1, float(before[first[p]]), True))
            out += [(key[0], r.rank, r.above, r.upto, ids[p], q, 0.0, False) for q in ids[first[p] + 1 : max(last[p], first[p] + 1)]]
    return pd.DataFrame(out, columns=["_key", "rank", "above", "upto", "block", "other", "base", "own"])


_MEETINGS = "_key string, rank int, above double, upto double, block long, other long, base double, own boolean"
_COUNTS = "_key string, rank int, bound double, n decimal(38,0)"


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ordered pairs up to each bound of the bracket, summed over the meetings of a batch."""
    for batch in batches:
        sums: dict[tuple, int] = {}
        for r in batch.itertuples():
            bounds = bounds_in(r.above, r.upto)
            x, nx = np.asarray(r.xs), np.asarray(r.nx, dtype=np.int64)
            got = np.zeros(len(bounds), dtype=np.int64)
            if r.other >= 0:
                cum = np.concatenate([[0], np.cumsum(np.asarray(r.ny, dtype=np.int64))])
                at = np.searchsorted(np.asarray(r.ys), 2 * bounds[:, None] - x[None, :], side="right")
                got += (cum[at] * nx).sum(axis=1)
            if r.own:
                got += int(nx.sum()) * int(r.base)
                got += np.concatenate([[0], np.cumsum(nx)])[np.searchsorted(x, bounds, side="right")]
            for bound, n in zip(bounds, got):
                at = (r.Key, r.rank, float(bound))
                sums[at] = sums.get(at, 0) + int(n)
        from decimal import Decimal

        yield pd.DataFrame([(*k, Decimal(n)) for k, n in sums.items()], columns=["_key", "rank", "bound", "n"])


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The averages inside a bracket with their number of ordered pairs, twice for a value with itself."""
    for batch in batches:
        for r in batch.itertuples():
            x, nx = np.asarray(r.xs), np.asarray(r.nx, dtype=np.int64)
            found = []
            if r.other >= 0:
                y, ny = np.asarray(r.ys), np.asarray(r.ny, dtype=np.int64)
                start, stop = np.searchsorted(y, 2 * r.above - x, side="right"), np.searchsorted(y, 2 * r.upto - x, side="right")
                sizes = stop - start
                at = np.repeat(np.arange(len(x)), sizes)
                other = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)
                found.append(pd.DataFrame({"mean": (x[at] + y[other]) / 2, "n": nx[at] * ny[other]}))
            if r.own:
                mine = (x > r.above) & (x <= r.upto)
                found.append(pd.DataFrame({"mean": x[mine], "n": nx[mine]}))
            if found:
                per = pd.concat(found).groupby("mean", as_index=False)["n"].sum()
                yield pd.DataFrame({"_key": r.Key, "rank": r.rank, "mean": per["mean"], "n": per["n"]})


def hodges_lehmann(paired: DataFrame, keys: list[str], diff: str, blocks: int = BLOCKS, listed: int = LISTED) -> DataFrame:
    """keys, estimate (the median Walsh average of the non-zero differences) and its order-statistic 95 % interval.

    Nulls and NaN take no part; a key without non-zero differences has no row.
    """
    spark = paired.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    d = F.col(diff).cast("double")
    counted = paired.where((F.abs(d) > 0) & ~F.isnan(d)).groupBy(*keys, d.alias("_d")).agg(F.count("*").alias("_n"))
    placed = cumulative(counted, keys, "_d", "_n")
    totals = placed.groupBy("_key").agg(F.count("*").alias("_distinct"), *[F.first(k).alias(k) for k in keys])
    width = F.ceil(F.col("_distinct") / F.greatest(F.lit(blocks), F.ceil(F.sqrt("_distinct"))))
    placed = placed.join(totals.select("_key", "_distinct"), "_key").withColumn("block", F.floor(F.col("_index") / width))
    values = F.sort_array(F.collect_list(F.struct("_d", "_n")))
    cut = placed.groupBy("_key", "block").agg(F.min("_d").alias("low"), F.max("_d").alias("high"), F.sum("_n").alias("n"), F.min("_before").alias("before"), values.alias("v"))
    cut = kept(cut.select(*_HISTOGRAM, F.col("v._d").alias("xs"), F.col("v._n").alias("nx")), "walsh-blocks")
    histogram = cut.select(*_HISTOGRAM)
    done, brackets = None, kept(histogram.groupBy("_key").applyInPandas(first_brackets, _BRACKET), "walsh-brackets")
    while True:
        # Done where no double lies inside; listed where the counts at both ends are known and close.
        single = F.udf(lambda a, b: ordinal(b) - ordinal(a) <= 1, "boolean")("above", "upto")
        state = kept(brackets.withColumn("single", single), "walsh-state")
        found = state.where("single").select("_key", "rank", F.col("upto").alias("value"))
        few = state.where(f"NOT single AND n_upto - n_above <= {listed}")
        if not few.isEmpty():
            found = found.unionByName(_select(_met(histogram, few, cut).mapInPandas(_listed, "_key string, rank int, mean double, n long"), few))
        found = kept(found, "walsh-found")
        done = found if done is None else done.unionByName(found)
        rest = state.where(f"NOT single AND NOT coalesce(n_upto - n_above <= {listed}, false)")
        if rest.isEmpty():
            break
        counts = _met(histogram, rest, cut).mapInPandas(_counts, _COUNTS).groupBy("_key", "rank", "bound").agg(F.sum("n").cast("double").alias("n"))
        inside = counts.join(rest.select("_key", "rank", "target"), ["_key", "rank"])
        below, reached = F.col("n") < F.col("target"), F.col("n") >= F.col("target")
        brackets = inside.groupBy("_key", "rank").agg(
            F.first("target").alias("target"), F.max(F.when(below, F.col("bound"))).alias("above"), F.min(F.when(reached, F.col("bound"))).alias("upto"),
            F.max(F.when(below, F.col("n"))).alias("n_above"), F.min(F.when(reached, F.col("n"))).alias("n_upto"),
        )
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("value")))
    per = done.groupBy("_key").agg(((at(0) + at(1)) / 2).alias("estimate"), at(2).alias("ci_low"), at(3).alias("ci_high"))
    return totals.join(per, "_key").select(*keys, "estimate", "ci_low", "ci_high")


def _met(histogram: DataFrame, brackets: DataFrame, cut: DataFrame) -> DataFrame:
    """Meetings of blocks with the values of both."""
    asked = brackets.select("_key", "rank", "above", "upto")
    met = histogram.groupBy("_key").cogroup(asked.groupBy("_key")).applyInPandas(meetings, _MEETINGS)
    met = met.join(cut.select("_key", "block", "xs", "nx"), ["_key", "block"])
    other = cut.select("_key", F.col("block").alias("other"), F.col("xs").alias("ys"), F.col("nx").alias("ny"))
    met = met.join(other, ["_key", "other"], "left")
    return met.select(F.col("_key").alias("Key"), "rank", "above", "upto", "other", "base", "own", "xs", "nx", "ys", "ny")


def _select(means: DataFrame, brackets: DataFrame) -> DataFrame:
    """The listed average at which the count reaches the bracket's target."""
    counted = means.groupBy("_key", "rank", "mean").agg(F.sum("n").alias("n"))
    placed = cumulative(counted.withColumnRenamed("_key", "of"), ["of", "rank"], "mean", "n")
    placed = placed.select(F.col("of").alias("_key"), "rank", "mean", "n", "_before")
    reached = placed.join(brackets.select("_key", "rank", "target", "n_above"), ["_key", "rank"])
    reached = reached.where(F.col("n_above") + F.col("_before") + F.col("n") >= F.col("target"))
    return reached.groupBy("_key", "rank").agg(F.min("mean").alias("value"))
