"""Exact deduplication through counting quotient filters.

Every partition counts the 64-bit fingerprints of its texts in one counting quotient filter per
shard (a shard is a range of quotients). A filter keeps, for each quotient, its sorted remainders and
their counts, so filters of a shard merge without loss by merging sorted remainders. Fingerprints whose
merged count exceeds one route their documents to byte verification: a grouping by the text itself,
with map-side combining, so that a group of any size crosses the network once per partition.

Defined cases: a null text counts as empty; of equal texts the row with the largest doc_id stays;
rows that repeat a doc_id and its text are one document and carry the same verdict; a row with a null
doc_id stays only if no equal text has an id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spare, written


class CountingQuotientFilter:
    """Sorted remainders by quotient: occupied-quotient bits, run-end bits, remainders and counters."""

    def __init__(self, quotient_bits: int, occupied: np.ndarray, run_end: np.ndarray, remainder: np.ndarray, count: np.ndarray):
        self.quotient_bits = quotient_bits
        self.occupied = occupied
        self.run_end = run_end
        self.remainder = remainder
        self.count = count

    @classmethod
    def of_sorted(cls, prints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From distinct ascending fingerprints (uint64) and their counts."""
        bits = max(3, int(len(prints)).bit_length())
        shift = np.uint64(64 - bits)
        quotient = (prints >> shift).astype(np.int64)
        occupied = np.zeros(1 << bits, bool)
        occupied[quotient] = True
        run_end = np.ones(len(prints), bool)
        run_end[:-1] = quotient[1:] != quotient[:-1]
        remainder = prints & np.uint64((1 << (64 - bits)) - 1)
        return cls(bits, occupied, run_end, remainder, counts.astype(np.int64))

    @classmethod
    def of(cls, prints: np.ndarray) -> CountingQuotientFilter:
        return cls.of_sorted(*np.unique(prints, return_counts=True))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending fingerprints and counts: the k-th run belongs to the k-th occupied quotient."""
        run = np.zeros(len(self.remainder), np.int64)
        run[1:] = np.cumsum(self.run_end)[:-1]
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return quotient << np.uint64(64 - self.quotient_bits) | self.remainder, self.count

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        (a, m), (b, n) = self.entries(), other.entries()
        prints = np.concatenate([a, b])
        order = np.argsort(prints, kind="stable")  # two ascending runs: a linear merge
        prints, counts = prints[order], np.concatenate([m, n])[order]
        first = np.ones(len(prints), bool)
        first[1:] = prints[1:] != prints[:-1]
        at = np.flatnonzero(first)
        return self.of_sorted(prints[at], np.add.reduceat(counts, at) if len(at) else counts)

    def to_bytes(self) -> bytes:
        """Remainders take as many bytes as they need; counters are kept only where they exceed one."""
        width = (64 - self.quotient_bits + 7) // 8
        many = self.count > 1
        return b"".join(
            (
                np.array([self.quotient_bits, len(self.remainder), int(many.sum())], "<i8").tobytes(),
                np.packbits(self.occupied).tobytes(),
                np.packbits(self.run_end).tobytes(),
                self.remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(),
                np.packbits(many).tobytes(),
                self.count[many].astype("<i8").tobytes(),
            )
        )

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, n, n_many = np.frombuffer(data, "<i8", 3).tolist()
        at, width, packed = 24, (64 - bits + 7) // 8, (n + 7) // 8

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.unpackbits(take((1 << bits) // 8)).astype(bool)
        run_end = np.unpackbits(take(packed))[:n].astype(bool)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = take(n * width).reshape(n, width)
        many = np.unpackbits(take(packed))[:n].astype(bool)
        count = np.ones(n, np.int64)
        count[many] = take(8 * n_many).view("<i8")
        return cls(bits, occupied, run_end, wide.reshape(-1).view("<u8").astype(np.uint64), count)


def repeated_fingerprints(prints: DataFrame, shards: int, filter_items: int = 1 << 20) -> DataFrame:
    """Fingerprints (column fp, bigint) that occur more than once, with their counts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            shard = (found >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            ids, blobs = [], []
            for s in np.flatnonzero(edges[1:] > edges[:-1]):
                part = slice(edges[s], edges[s + 1])
                ids.append(int(s))
                blobs.append(CountingQuotientFilter.of_sorted(found[part], counts[part]).to_bytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "filter"])

        held = 0
        for b in batches:
            waiting.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += b.num_rows
            if held >= filter_items:
                yield flush()
                held = 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(stack: list[CountingQuotientFilter]) -> pa.RecordBatch:
            while len(stack) > 1:
                stack[-2:] = [stack[-2].merge(stack[-1])]
            found, counts = stack[0].entries()
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(counts[many])], ["fp", "n"])

        shard, stack = None, []
        for b in batches:
            for s, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != shard and stack:
                    yield emit(stack)
                    stack = []
                shard = s
                stack.append(CountingQuotientFilter.from_bytes(data))
                while len(stack) > 1 and len(stack[-2].remainder) <= 2 * len(stack[-1].remainder):
                    stack[-2:] = [stack[-2].merge(stack[-1])]
        if stack:
            yield emit(stack)

    filters = prints.select("fp").mapInArrow(build, "shard int, filter binary")
    dealt = filters.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, "fp bigint, n bigint")


#: Rows that a shard counts on average, at most.
SHARD_ROWS = 1 << 21
#: Buckets of fingerprints by which rows that may be repeated are told from the others: so many rows at most.
BUCKETS = 1 << 20


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _repeated(docs: DataFrame) -> DataFrame:
    """Fingerprints that the merged filters count more than once (written)."""
    spark = docs.sparkSession
    small_batches(spark, 65_536)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD_ROWS))
    prints = docs.select(F.xxhash64(_text()).alias("fp"))
    return written(repeated_fingerprints(prints, shards).select("fp"), "repeated")


def dedup_groups(docs: DataFrame) -> DataFrame:
    """Byte-verified groups of two rows or more: text_sha256, keep_id, group_size."""
    routed = docs.select("doc_id", _text().alias("text"), F.xxhash64(_text()).alias("fp")).join(_repeated(docs), "fp")
    groups = routed.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")


def dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256 (columns of these names are replaced)."""
    own = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*own)
    groups = dedup_groups(docs.select("doc_id", "text"))
    hashed = docs.withColumn("text_sha256", F.sha2(_text(), 256))
    joined = hashed.join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return (
        joined.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with its columns: of equal texts one row, that with the largest doc_id.

    Rows outside the buckets of repeated fingerprints pass without a shuffle. The others are grouped by text
    with map-side combining, which takes the whole row of the largest id along, so that a group of any size
    crosses the network once per partition and is never gathered.
    """
    fp, bucket, row, key = spare(docs.columns, "fp", "bucket", "row", "key")
    repeated = _repeated(docs.select("text"))
    marks = F.broadcast(repeated.select(F.pmod("fp", F.lit(BUCKETS)).alias(bucket)).distinct())
    here = F.pmod(F.xxhash64(_text()), F.lit(BUCKETS)) == F.col(bucket)
    alone = docs.join(marks, here, "left_anti")
    routed = docs.join(marks, here, "left_semi")
    packed = routed.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), _text().alias(key), F.struct("doc_id").alias(fp))
    grouped = packed.groupBy(key).agg(F.max_by(row, fp).alias(row))
    return alone.unionByName(grouped.select(*[F.col(f"`{row}`.`{c}`") for c in docs.columns]))
