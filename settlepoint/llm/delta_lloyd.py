"""Centroid clustering in exact integers by delta Lloyd: each round does only what the last round's moves ask for.

The vectors are written once, in buckets by row. A round's assignments (row, cluster, distance: a few bytes) are written
to a table with the same buckets, and joined to the vectors bucket by bucket, without a shuffle or a sort. A vector
whose owner stood still keeps its distance and is compared with the changed centroids only; one whose owner moved is
compared with all. What changed hands is summed in the task as signed integers (taken from the old owner, given to the
new), a few rows a task, which Spark adds up; the driver keeps k global sums and counts. If no centroid changes, the
rounds left would change nothing and are skipped.

Every round is a written table, so a lost executor repeats tasks of one round only; the tables of earlier rounds are
deleted.

Defined cases. Vectors that are null, of another length, or hold null or non-finite components take no part. Components
of any finite size are computed exactly (Python integers beyond 2 ** 27); distances and inertias that exceed a long are
null. Rows that repeat a vec_id are vectors of their own. A null vec_id is clustered, but never starts a centroid. Fewer
vectors (with ids) than k: as many centroids as vectors. None: no rows. Equal seeds (repeated ids): in the order of
their components. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, fresh_path

NARROW = 1 << 27  # below it a squared distance of up to 64 components fits a long, whatever the centroid
LIMB = 40  # bits of a digit in which sums travel; digits of a million tasks still add up within a long
STATE = "row long, vec_id long, cluster int, distance long, limb int, sums array<long>, n long, is_sum boolean"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 50_000


def valid_vectors(df: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size("embedding") == dims) & whole).select("vec_id", "embedding")


def scaled(x: float, scale: int) -> int:
    """floor(scale * x), exact for finite x and a scale that is a power of two."""
    return math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Rows of integer components: long where all are narrow, else Python integers."""
    vectors = vectors.astype(np.float64)
    if np.abs(vectors).max(initial=0) < NARROW / scale - 1:
        return np.floor(vectors * scale).astype(np.int64)
    return np.array([[scaled(float(x), scale) for x in row] for row in vectors], dtype=object).reshape(vectors.shape)


def squared(vectors: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances to one centroid."""
    wide = vectors.dtype == object or max(map(abs, centroid), default=0) >= NARROW or vectors.shape[1] > 64
    gap = vectors.astype(object if wide else np.int64) - np.array(centroid, dtype=object if wide else np.int64)
    return (gap * gap).sum(axis=1)


def nearest_of(vectors: np.ndarray, centroids: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest centroid, ties to the smaller number."""
    best = np.full(len(vectors), -1, dtype=np.int64)
    least = None
    for j in sorted(centroids):
        d = squared(vectors, centroids[j])
        if least is None:
            best[:], least = j, d
        else:
            closer = (d < least).astype(bool)
            best[closer] = j
            least = np.where(closer, d, least)
    return best, least


def assign(centroids: list[list[int]], changed: set[int], scale: int):
    """The task of one round: (row, vec_id, embedding, cluster, distance) in, assignments and what changed hands out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everything = dict(enumerate(centroids))
        moved = {j: centroids[j] for j in changed}
        sums: dict[int, list[int]] = {}
        counts: dict[int, int] = {}
        any_row = None
        for batch in batches:
            if not len(batch):
                continue
            any_row = int(batch["row"].iloc[0]) if any_row is None else any_row
            rows = np.stack(batch["embedding"].to_numpy())
            was = batch["cluster"].fillna(-1).astype(np.int64).to_numpy()
            # A distance that no long holds is compared anew, like one to an owner that moved.
            stale = np.isin(was, [-1, *changed]) | batch["distance"].isna().to_numpy()
            owner, far = was.copy(), batch["distance"].astype(object).to_numpy()
            vectors = integers(rows, scale)
            if stale.any():
                owner[stale], far[stale] = nearest_of(vectors[stale], everything)
            if moved and not stale.all():
                rival, d = nearest_of(vectors[~stale], moved)
                kept, have = owner[~stale], far[~stale]
                wins = ((d < have) | ((d == have) & (rival < kept))).astype(bool)
                owner[~stale], far[~stale] = np.where(wins, rival, kept), np.where(wins, d, have)
            for j in np.unique(np.concatenate([was[owner != was], owner[owner != was]])):
                if j >= 0:
                    gained, lost = (owner == j) & (was != j), (was == j) & (owner != j)
                    total = vectors[gained].sum(axis=0) - vectors[lost].sum(axis=0)
                    sums[j] = [a + int(b) for a, b in zip(sums.get(j, [0] * vectors.shape[1]), total)]
                    counts[j] = counts.get(j, 0) + int(gained.sum()) - int(lost.sum())
            yield pd.DataFrame({
                "row": batch["row"], "vec_id": batch["vec_id"], "cluster": owner.astype(np.int32),
                "distance": pd.array([int(d) if d < 1 << 63 else None for d in far], dtype="Int64"),
                "limb": pd.array([None] * len(batch), dtype="Int32"), "sums": None, "n": pd.array([None] * len(batch), dtype="Int64"), "is_sum": False,
            })
        out = [(j, limb, digits, counts[j] if limb == 0 else 0) for j, total in sums.items() for limb, digits in enumerate(to_limbs(total))]
        if out:
            yield pd.DataFrame({
                "row": any_row, "vec_id": pd.array([None] * len(out), dtype="Int64"), "cluster": np.array([o[0] for o in out], dtype=np.int32),
                "distance": pd.array([None] * len(out), dtype="Int64"), "limb": pd.array([o[1] for o in out], dtype="Int32"),
                "sums": [o[2] for o in out], "n": pd.array([o[3] for o in out], dtype="Int64"), "is_sum": True,
            })

    return run


def to_limbs(values: list[int]) -> list[list[int]]:
    """Signed integers as rows of signed digits of LIMB bits, the lowest first."""
    signs, left, out = [-1 if v < 0 else 1 for v in values], [abs(v) for v in values], []
    while any(left) or not out:
        out.append([s * (v & ((1 << LIMB) - 1)) for s, v in zip(signs, left)])
        left = [v >> LIMB for v in left]
    return out


class Buckets:
    """Tables in the shared folder with the same buckets of rows."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.name = spark, n, f"delta_lloyd_{uuid.uuid4().hex}"

    def write(self, df: DataFrame, part: str, partition: list[str] = ()) -> DataFrame:
        writer = df.write.format("parquet").option("path", fresh_path(self.spark, "lloyd-" + part)).bucketBy(self.n, "row")
        (writer.partitionBy(*partition) if partition else writer).saveAsTable(f"{self.name}_{part}")
        return self.spark.table(f"{self.name}_{part}")

    def drop(self, part: str) -> None:
        table = f"{self.name}_{part}"
        where = self.spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {table}")
        delete_path(self.spark, where)


def seeds(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id IS NOT NULL").select(digest.alias("digest"), "embedding").orderBy("digest", "embedding").limit(k)
    return [[scaled(float(x), scale) for x in r.embedding] for r in first.collect()]


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Each vector's cluster and squared distance after `rounds` updates of the centroids, with the inertias."""
    spark = df.sparkSession
    valid = valid_vectors(df, dims)
    size = valid.count()
    centroids = seeds(valid, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    tables = Buckets(spark, min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, size // ROWS_PER_BUCKET + 1)))
    # Row numbers are drawn before the shuffle from a scan, and so are the same if a task is repeated.
    numbered = valid.withColumn("row", F.monotonically_increasing_id()).repartition(tables.n, "row")
    vectors = tables.write(numbered, "vectors")
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    changed, state, last = set(range(len(centroids))), None, ""
    for step in range(rounds + 1):
        if state is None:
            joined = vectors.select("row", "vec_id", "embedding", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        else:
            before = state.where("NOT is_sum").select("row", "cluster", "distance")
            joined = vectors.join(before.hint("shuffle_hash"), "row").select("row", "vec_id", "embedding", "cluster", "distance")
        state = tables.write(joined.mapInPandas(assign(centroids, changed, scale), STATE), f"round{step}", ["is_sum"])
        if last:
            tables.drop(last)
        last = f"round{step}"
        if step == rounds:
            break
        add_transfers(state, sums, counts)
        moved = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids)]
        changed = {j for j, (a, b) in enumerate(zip(centroids, moved)) if a != b}
        centroids = moved
        if not changed:
            break
    tables.drop("vectors")
    return _result(state.where("NOT is_sum"), centroids)


def add_transfers(state: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Add what changed hands in a round to the global sums: a row a cluster and digit reaches the driver."""
    dims = len(sums[0])
    digits = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    for r in state.where("is_sum").groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *digits).collect():
        counts[r.cluster] += r.n
        for i in range(dims):
            sums[r.cluster][i] += r[f"s{i}"] << (LIMB * r.limb)


def _result(owned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = owned.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), whole).alias("cluster_sum"))
    per = {r.cluster: r.cluster_sum for r in per.collect()}
    total = None if None in per.values() else sum(map(int, per.values()))

    def long_or_null(v):
        return int(v) if v is not None and v < 1 << 63 else None

    named = [
        (j, long_or_null(per[j]), long_or_null(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for j, c in enumerate(centroids) if j in per
    ]
    of = owned.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return owned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
