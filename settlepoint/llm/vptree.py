"""Nearest neighbours by cosine through vantage-point trees, one tree per shard of vectors.

On unit vectors the cosine order is the order of Euclidean distances, a metric. A tree node holds a
vantage point, the median distance of its points to it, and the two halves. A search keeps the
distance tau of its k-th best so far and skips a half whose points the triangle inequality puts farther
than tau / relax away: relax = 1 prunes only what cannot matter (exact search), larger values prune more.
Queries descend together in blocks, so distances are matrix products over leaves and vantage points.

Vectors are dealt to shards of bounded bytes by their length and a hash of their ids; queries go, in blocks,
to every shard of vectors of their length (a stated query set against all rows). One shuffle brings a
shard's pieces and then its query blocks to a task, which builds the tree once and gives at most k rows a
query, which a window by query ranks. A shard of identical vectors keeps, for each distinct vector, as many
of its smallest ids as a result can hold.

Scores are sums in the order of the components, so that any engine that adds in that order gets the same.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components take no part,
neither as queries nor as candidates; vectors whose squares would under- or overflow take part like any
others, scaled by a power of two for their cosines; there is no angle between vectors of different lengths, so a query's
candidates are the vectors of its own length; null ids take no part; ties go to the smaller id; repeated
ids are candidates of their own except for a query of the same id; fewer candidates than k give fewer rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Slack for rounding when bounds are compared (unit vectors, double precision).
SLACK = 1e-9
#: Squared distances that differ by less may be ties: the rounding of 2 - 2 cos, many times over.
TIE = 1e-12


class VPTree:
    """Array-backed tree over unit vectors; leaves hold up to leaf_size points."""

    def __init__(self, unit: np.ndarray, leaf_size: int = 512, seed: int = 1):
        self.unit, self.leaf_size = unit, leaf_size
        self.order = np.arange(len(unit))
        self.nodes: list[tuple] = []
        self._rng = np.random.default_rng(seed)
        if len(unit):
            self._build(0, len(unit))

    def _build(self, lo: int, hi: int) -> int:
        """Nodes are (lo, hi) for a leaf, else (vantage row, inner bounds, outer bounds, inner, outer)."""
        at = len(self.nodes)
        if hi - lo <= self.leaf_size:
            self.nodes.append((lo, hi))
            return at
        rows = self.order[lo:hi]
        vantage = int(rows[self._rng.integers(len(rows))])
        d = np.linalg.norm(self.unit[rows] - self.unit[vantage], axis=1)
        mid = len(rows) // 2
        by = np.argpartition(d, mid)
        self.order[lo:hi] = rows[by]
        d = d[by]
        self.nodes.append(())
        bounds = [(float(d[:mid].min()), float(d[:mid].max())), (float(d[mid:].min()), float(d[mid:].max()))]
        inner = self._build(lo, lo + mid)
        outer = self._build(lo + mid, hi)
        self.nodes[at] = (vantage, *bounds, inner, outer)
        return at

    def search(self, queries: np.ndarray, keep: int, relax: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """For each unit query, the rows of the nearest points and their distances (keep columns, -1 and inf to fill)."""
        rows = np.full((len(queries), keep), -1, np.int64)
        dist = np.full((len(queries), keep), np.inf)
        if self.nodes:
            self._visit(0, queries, np.arange(len(queries)), rows, dist, relax)
        return rows, dist

    def within(self, query: np.ndarray, squared: float) -> np.ndarray:
        """The rows of all points at most so far, squared, from a unit query."""
        return np.flatnonzero(2 - 2 * (self.unit @ query) <= squared)

    def _visit(self, node: int, q: np.ndarray, active: np.ndarray, rows: np.ndarray, dist: np.ndarray, relax: float) -> None:
        n = self.nodes[node]
        if len(n) == 2:
            points = self.order[n[0] : n[1]]
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (q[active] @ self.unit[points].T)))
            every = np.concatenate([dist[active], d], 1)
            ids = np.concatenate([rows[active], np.broadcast_to(points, d.shape)], 1)
            k = dist.shape[1]
            best = np.argpartition(every, k - 1, axis=1)[:, :k]
            dist[active] = np.take_along_axis(every, best, 1)
            rows[active] = np.take_along_axis(ids, best, 1)
            return
        vantage, *bounds, inner, outer = n
        d = np.linalg.norm(q[active] - self.unit[vantage], axis=1)
        gaps = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi in bounds]
        near_inner = gaps[0] <= gaps[1]
        for first in (True, False):  # each query takes its nearer half first, for a small tau in the other
            for side, child in ((0, inner), (1, outer)):
                mine = near_inner == ((side == 0) == first)
                tau = dist[active].max(1)
                go = mine & (gaps[side] <= tau / relax + SLACK)
                if go.any():
                    self._visit(child, q, active[go], rows, dist, relax)


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def in_range(rows: np.ndarray) -> np.ndarray:
    """Rows whose squares would under- or overflow, scaled by a power of two (exactly, and so is their cosine)."""
    most = np.abs(rows).max(axis=1, initial=0.0)
    odd = (most < 2.0**-300) | (most > 2.0**300)
    if odd.any():
        rows = rows.copy()
        rows[odd] = np.ldexp(rows[odd], -np.frexp(most[odd])[1][:, None])
    return rows


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums of rows, added in the order of the components (numpy's own sums are pairwise)."""
    return np.add.accumulate(rows, axis=1)[:, -1]


class Shard:
    """The distinct vectors of a shard, their ids and tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.vectors, of = np.unique(vectors, axis=0, return_inverse=True)
        by = np.lexsort((ids, of.reshape(-1)))
        self.ids = ids[by]
        self.starts = np.searchsorted(of.reshape(-1)[by], np.arange(len(self.vectors) + 1))
        self.norms = np.sqrt(_sums(self.vectors * self.vectors))
        self.tree = VPTree(self.vectors / self.norms[:, None])

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, ids and scores of the k nearest of each query, best first."""
        norms = np.sqrt(_sums(vectors * vectors))
        unit = vectors / norms[:, None]
        # One more than k: the query itself may be among them; its copies share its distinct vector.
        rows, dist = self.tree.search(unit, min(k + 1, len(self.vectors)) + 4, relax)
        out: list[tuple] = []
        for a, i in enumerate(ids):
            near = rows[a][rows[a] >= 0]
            # Where all kept ones tie with the last that counts, others may too.
            if len(self.vectors) > rows.shape[1] and dist[a].max() ** 2 <= (last := np.partition(dist[a], k)[k] ** 2 + TIE):
                near = self.tree.within(unit[a], last)
            scores = _sums(vectors[a] * self.vectors[near]) / (norms[a] * self.norms[near])
            kept = np.minimum(self.starts[near + 1] - self.starts[near], k + 1)
            at = np.repeat(self.starts[near] - np.cumsum(kept) + kept, kept) + np.arange(kept.sum())
            found, score = self.ids[at], np.repeat(scores, kept)
            best = np.lexsort((found, -score))
            best = best[found[best] != i][:k]
            out.append((np.full(len(best), i), found[best], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(
    vectors: DataFrame, query_filter, k: int = 5, relax: float = 1.0, shard_bytes: int = 4 << 20, block_rows: int = 2_048,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row that query_filter selects."""
    usable = _usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "v")
    usable = written(usable.where("id is not null").select("id", F.size("v").cast("long").alias("dim"), "v"), "vectors")
    shards = usable.groupBy("dim").agg(F.ceil(F.count("*") * 8 * F.col("dim") / shard_bytes).alias("shards"))
    shards = written(shards, "shards")
    n_shards = shards.agg(F.sum("shards")).first()[0] or 1
    sized = usable.join(shards, "dim")
    dealt = sized.select(F.lit(0).alias("kind"), "dim", F.pmod(F.xxhash64("id"), F.col("shards")).alias("part"), "id", "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("part")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one part that follow each other, as binary (at most an Arrow batch of them)."""
        for b in batches:
            kind, dim, part = (b.column(c).to_numpy() for c in range(3))
            new = (kind[1:] != kind[:-1]) | (dim[1:] != dim[:-1]) | (part[1:] != part[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            spans = [(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False) if hi > lo]
            ids, flat = b.column(3).to_numpy(), b.column(4)
            cells = [[x[lo] for lo, _ in spans] for x in (kind, dim, part)]
            cells += [[ids[lo:hi].tobytes() for lo, hi in spans], [flat.slice(lo, hi - lo).flatten().to_numpy().tobytes() for lo, hi in spans]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["kind", "dim", "part", "ids", "vecs"])

    small_batches(usable.sparkSession, block_rows)
    pieces = "kind int, dim bigint, part bigint, ids binary, vecs binary"
    candidates = dealt.sortWithinPartitions("dim", "part").mapInArrow(packed, pieces)
    asked = sized.where(query_filter(F.col("id")))
    blocks = asked.select(F.lit(1).alias("kind"), "dim", F.lit(-1).cast("long").alias("part"), "id", "v").sortWithinPartitions("dim").mapInArrow(packed, pieces)
    blocks = written(blocks, "blocks").join(shards, "dim").select("kind", "dim", every, "ids", "vecs")
    work = candidates.unionByName(blocks).repartition(max(1, int(n_shards)), "dim", "part").sortWithinPartitions("dim", "part", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for b in batches:
            for kind, dim, part, ids, vecs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (dim, part) != now:
                    now, held, shard = (dim, part), [], None
                piece = np.frombuffer(ids, np.int64), in_range(np.frombuffer(vecs, np.float64).reshape(-1, dim))
                if not kind:
                    held.append(piece)
                    continue
                if shard is None and held:
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if shard is not None:
                    found = shard.nearest(*piece, k, relax)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = work.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
