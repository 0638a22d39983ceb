"""Cluster bootstrap over artifacts. Draws are integer arithmetic, so any engine reproduces them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path

PRIME = 2147483647


def draw(sample: Column, position: Column) -> Column:
    """Pseudo-random non-negative integer of a sample number and a position in it."""
    a = (sample.cast("long") * F.lit(48271).cast("long") + position.cast("long") * F.lit(69621).cast("long") + 12345) % PRIME
    b = (a * (a + sample.cast("long") + 77)) % PRIME
    return F.shiftright((b * F.lit(16807).cast("long") + a) % PRIME, 7)


def draw_sql(sample: str, position: str) -> str:
    a = f"((CAST({sample} AS BIGINT) * 48271 + CAST({position} AS BIGINT) * 69621 + 12345) % {PRIME})"
    b = f"(({a} * ({a} + CAST({sample} AS BIGINT) + 77)) % {PRIME})"
    return f"((({b} * 16807 + {a}) % {PRIME}) // 128)"


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with the position (from 0) of each row in order, without one task that sees all rows.

    The rows are sorted by range and written once with their partition and place in it; the offsets of the partitions
    are one row each.
    """
    path = shared_path(df.sparkSession, "numbered")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df.orderBy(order).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(offsets), "_part")  # one row a partition
    return out.select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


SAMPLE_BLOCK, ARTIFACT_BLOCK, DRAWS = 512, 1 << 18, 1 << 20
_COUNTED = ("sa", "na", "sb", "nb")


def drawn(samples: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """draw() of every sample (rows) at every position (columns)."""
    s, p = samples.astype(np.int64)[:, None], positions.astype(np.int64)[None, :]
    a = (s * 48271 + p * 69621 + 12345) % PRIME
    b = (a * (a + s + 77)) % PRIME
    return ((b * 16807 + a) % PRIME) >> 7


def _block_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a block of samples over what they draw from a block of artifacts, a few draws at a time."""
    for batch in batches:
        for r in batch.itertuples():
            values = np.array([np.asarray(r.sa, float), np.asarray(r.na, float), np.asarray(r.sb, float), np.asarray(r.nb, float)])
            size = values.shape[1]
            samples = np.arange(r.first, r.last)
            sums = np.zeros((len(samples), 4))
            step = max(1, DRAWS // max(1, len(samples)))
            for start in range(0, r.n, step):
                at = drawn(samples, np.arange(start, min(r.n, start + step))) % r.n - r.offset
                if size < r.n:
                    for i, row in enumerate(at):
                        row = row[(row >= 0) & (row < size)]
                        sums[i] += values[:, row].sum(axis=1)
                else:
                    sums += values[:, at].sum(axis=2).T
            yield pd.DataFrame({"b": samples, **dict(zip(_COUNTED, sums.T))})


def bootstrap_difference(per: DataFrame, samples: int, sample_block: int = SAMPLE_BLOCK, artifact_block: int = ARTIFACT_BLOCK) -> DataFrame:
    """b, diff: of each sample of artifacts (with replacement) the difference of the two arms' means.

    per has one row per artifact (sa, na, sb, nb) and is numbered once. Blocks of artifacts (arrays, 8 MB each) meet
    blocks of samples; a task draws in batches and hands on a sum a sample, so what is shuffled is the artifacts once for
    each block of samples and samples x blocks of artifacts, never a row a draw.
    """
    spark = per.sparkSession
    artifacts = numbered(per, "artifact_id", "i")
    n = artifacts.agg(F.count("*").alias("n"))
    held = F.sort_array(F.collect_list(F.struct("i", *[F.col(c).cast("double").alias(c) for c in _COUNTED])))
    blocks = artifacts.groupBy(F.floor(F.col("i") / artifact_block).alias("block")).agg(held.alias("v"))
    blocks = blocks.select((F.col("block") * artifact_block).alias("offset"), *[F.col(f"v.{c}").alias(c) for c in _COUNTED])
    chunks = -(-samples // sample_block)
    first = F.col("id") * sample_block
    asked = spark.range(0, chunks, 1, chunks).select(first.alias("first"), F.least(first + sample_block, F.lit(samples)).alias("last"))
    # A row for each block of samples (a constant number) and of artifacts, dealt out one by one.
    met = blocks.crossJoin(F.broadcast(asked)).crossJoin(F.broadcast(n)).repartition(chunks, "first", "offset")
    sums = met.mapInPandas(_block_sums, "b long, sa double, na double, sb double, nb double")
    sums = sums.groupBy("b").agg(*[F.sum(c).alias(c) for c in _COUNTED])
    return sums.select("b", (F.try_divide("sa", "na") - F.try_divide("sb", "nb")).alias("diff"))


def summary(boots: DataFrame, margins: tuple[float, ...] = ()) -> DataFrame:
    """Percentile intervals, two-sided p, and for each equivalence margin the larger tail share."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    d = F.col("diff")
    q = lambda x: F.percentile(d, F.lit(x))
    return boots.agg(
        F.count("*").alias("samples"),
        q(0.025).alias("ci95_low"), q(0.975).alias("ci95_high"), q(0.05).alias("ci90_low"), q(0.95).alias("ci90_high"),
        F.least(F.lit(1.0), 2 * F.least(share(d <= 0), share(d >= 0))).alias("p"),
        *[F.greatest(share(d >= m), share(d <= -m)).alias(f"tost_{round(m * 100)}") for m in margins],
    )
