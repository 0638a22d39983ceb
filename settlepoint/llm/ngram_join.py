"""Jaccard self-join on word n-grams with Bayesian candidate pruning.

A document's set is that of its five-word shingles over lower-cased words (a text of one to four words
is one shingle). Documents with equal sets form a class, represented by the text of its smallest id;
only representatives are compared, so copies never multiply.

Candidates share at least one of 25 bands of five MinHash values (a pair at similarity 0.8 is missed
with probability 5e-5, above that less). Their MinHash values are then compared a band length at a
time: after n values with m equal, the posterior of the similarity under a uniform prior is
Beta(m + 1, n - m + 1), and the pair is dropped once its probability of reaching the threshold falls
below a tolerance. What remains is verified exactly on the shingle sets.

Every representative has a pivot: of those that come first in one of its bands (by the sum of their
bands' sizes, so that a pivot lies amid its group), the first. Links are found in three steps, each of
which settles pairs of its own, and none emits a row per pair:

* Stars: each representative is compared with its pivot. Let R be its symmetric difference with the
  pivot's set A, and slack = (q + p) |R| - (q - p) |A| for a threshold p / q.
* Certain links: two sets of one pivot differ in |R| + |R'| shingles at most, so they are linked whenever
  their slacks add up to 0 or less. Such links are counted from the histogram of a pivot's slacks.
* Units: members of a pivot whose slacks add up to more, and members of different pivots that meet in a
  band, are compared in memory, block against block; a block against itself or another is a unit, units
  of certain pairs only are left out, and a unit returns a row per linked member: its links there and the
  first of its linked members. Members of different pivots count in the first band that they share.

A block holds members of bounded weight (shingles), so that a unit fits a worker; a tight group of any
size costs rows in proportion to its members.

Defined cases: a null text counts as empty; texts without any word are linked to nothing; a null id
sorts last and is a document like any other (the id 2^63 - 1 stands for it); rows that repeat an id and a
text are copies of each other, rows that repeat an id with another text are documents of their own; an
empty table gives no rows; extra columns are ignored; a text of any length is used whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .components import components

BANDS, ROWS = 25, 5
N_HASHES = BANDS * ROWS
BUCKETS = 1 << 20
#: Shingles that weigh as much as a member does by itself.
SHINGLES = 1000
#: Stands for a null id inside the join, after all others.
NO_ID = (1 << 63) - 1
NODE, PIVOT = ["id", "hash"], ["pivot_id", "pivot_hash"]
_WORDS = re.compile(r"\w+")
_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 1 << 31, N_HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, N_HASHES, dtype=np.int64).astype(np.uint32)[:, None]
_MIX = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(0, 1 << 62, 64, dtype=np.int64)]


class WordHashes(dict):
    """Text between white space -> 64-bit hashes (bytes) of the lower-cased words in it."""

    LIMIT = 400_000

    def __missing__(self, chunk: str) -> bytes:
        import xxhash

        words = _WORDS.findall(chunk.lower())
        packed = b"".join(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")).to_bytes(8, "little") for w in words)
        if len(self) < self.LIMIT:
            self[chunk] = packed
        return packed


def shingles(text: str, known: WordHashes, n: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the word n-grams of a whole text."""
    w = np.frombuffer(b"".join(map(known.__getitem__, text.split())), np.uint64)
    if not len(w):
        return w
    width = min(n, len(w))
    h = np.full(len(w) - width + 1, np.uint64(width))
    for k in range(width):
        h = (h ^ w[k : len(w) - width + 1 + k]) * _MIX[k]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minhashes(s: np.ndarray) -> np.ndarray:
    """N_HASHES minima of a non-empty set, a bounded slice of it at a time."""
    x = (s ^ s >> np.uint64(32)).astype(np.uint32)
    out = np.full(N_HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 2048):
        np.minimum(out, (_MULTIPLY * x[None, at : at + 2048] + _ADD).min(1), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of one signature or of a row of them each; keys of different bands differ."""
    rows = signatures.reshape(*signatures.shape[:-1], BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[40]
    for k in range(ROWS):
        h = (h ^ rows[..., k]) * _MIX[41 + k]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For 0 to N_HASHES compared values, the fewest equal ones that keep a pair.

    P(similarity >= t | m of n) for a Beta(m + 1, n - m + 1) posterior is the chance of at most m
    successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(N_HASHES + 1):
        p, m = 0.0, -1
        while p < tolerance and m < n:
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survives(equal: np.ndarray, fewest: list[int]) -> np.ndarray:
    """Of rows of equal MinHash values (booleans), those that no check of the posterior drops."""
    keep = np.arange(len(equal))
    count = np.zeros(len(equal), np.int64)
    for at in range(0, N_HASHES, ROWS):
        count = count + equal[keep, at : at + ROWS].sum(1)
        fine = count >= fewest[at + ROWS]
        keep, count = keep[fine], count[fine]
    return keep


def sketches(docs: DataFrame, n: int = 5) -> DataFrame:
    """id, hash, set_key (null for texts without words) and band keys of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            keys, bands = [], []
            for t in b.column(2):
                s = shingles(t.as_py() or "", known, n)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(minhashes(s)) if len(s) else None)
            arrays = [*b.columns[:2], pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "hash", "set_key", "bands"])

    return docs.select("id", "hash", "text").mapInArrow(run, "id bigint, hash bigint, set_key binary, bands array<bigint>")


def _payloads(members: DataFrame, n: int) -> DataFrame:
    """The members with size, signature and shingles (binary) of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sets = [shingles(t.as_py() or "", known, n) for t in b.column(5)]
            arrays = [pa.array([len(s) for s in sets], pa.int64())]
            arrays += [pa.array([minhashes(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *arrays], [*NODE, *PIVOT, "copies", "size", "signature", "shingles"])

    found = members.select(*NODE, *PIVOT, "copies", "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in (*NODE, *PIVOT, "copies", "size")) + ", signature binary, shingles binary")
    return found.withColumn("weight", F.lit(1) + F.floor(F.col("size") / SHINGLES))


def _stars(payloads: DataFrame, pivots: DataFrame, threshold: Fraction, tolerance: float) -> DataFrame:
    """Every member but those that are their own pivots, with its slack and whether it is linked to its pivot."""
    p, q = threshold.numerator, threshold.denominator
    fewest = fewest_matches(float(threshold), tolerance)
    others = payloads.where("id <> pivot_id or hash <> pivot_hash")
    one = payloads.join(pivots, [F.col("id") == F.col("p_id"), F.col("hash") == F.col("p_hash")], "left_semi")
    one = one.select(F.col("id").alias("pivot_id"), F.col("hash").alias("pivot_hash"), F.col("copies").alias("pivot_copies"), F.col("signature").alias("pivot_signature"), F.col("shingles").alias("pivot_shingles"))
    names = [*NODE, *PIVOT, "copies", "weight", "pivot_copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine, pivot = (np.stack([np.frombuffer(x, np.uint32) for x in b.column(c).to_pylist()]) if b.num_rows else np.zeros((0, N_HASHES), np.uint32) for c in ("signature", "pivot_signature"))
            near = np.zeros(b.num_rows, bool)
            near[survives(mine == pivot, fewest)] = True
            slacks, linked = [], []
            for r in range(b.num_rows):
                a, c = (np.frombuffer(b.column(x)[r].as_buffer(), np.uint64) for x in ("shingles", "pivot_shingles"))
                inner = 0  # a pruned pair counts as disjoint, so that its slack is a bound from above
                if near[r]:
                    at = np.minimum(np.searchsorted(c, a), len(c) - 1)
                    inner = int((c[at] == a).sum())
                apart = len(a) + len(c) - 2 * inner
                slacks.append((q + p) * apart - (q - p) * len(a))
                linked.append(q * inner >= p * (len(a) + len(c) - inner))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(slacks, pa.int64()), pa.array(linked, pa.bool_())], [*names, "slack", "linked"])

    met = others.join(one, PIVOT).select(*names, "signature", "shingles", "pivot_signature", "pivot_shingles")
    return met.mapInArrow(run, ", ".join(f"{c} bigint" for c in (*names, "slack")) + ", linked boolean")


def _certain(stars: DataFrame) -> DataFrame:
    """id, hash, links: the copies of other members of the same pivot whose slack is at most minus the own one."""
    slacks = stars.groupBy(*PIVOT, "slack").agg(F.sum("copies").alias("n"))
    counted = slacks.select(*PIVOT, F.col("slack").alias("at"), F.lit(0).alias("asks"), "n", F.col("slack"))
    asking = slacks.select(*PIVOT, -F.col("slack"), F.lit(1), F.lit(0).cast("long"), "slack")
    so_far = Window.partitionBy(*PIVOT).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = counted.union(asking).withColumn("reached", F.sum("n").over(so_far)).where("asks = 1 and reached > 0").select(*PIVOT, "slack", "reached")
    links = F.col("reached") - F.when(F.col("slack") <= 0, F.col("copies")).otherwise(0)
    return stars.join(found, [*PIVOT, "slack"]).select(*NODE, links.alias("links")).where("links > 0")


def _blocks(groups: DataFrame, key: list[str], order: list[str], block: int) -> DataFrame:
    """groups (key, order, weight) with the first of their blocks and the number of them.

    The groups of a key are laid end to end in their order and cut at multiples of block; the members of a
    group that a cut divides are dealt by hash. The window runs over groups, not members.
    """
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    laid = groups.withColumn("_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    first = F.floor(F.col("_before") / block)
    last = F.floor((F.col("_before") + F.col("weight") - 1) / block)
    return laid.withColumn("first", first).withColumn("blocks", last - first + 1).drop("_before")


def _in_block() -> Column:
    return F.col("first") + F.pmod(F.xxhash64("id", "hash", F.lit(1)), F.col("blocks"))


def _sides(units: DataFrame) -> DataFrame:
    """The blocks that a unit (key_a, key_b, i, j) takes: key_a, key_b, block, i, j, side."""
    sides = F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    dealt = units.select("key_a", "key_b", "i", "j", F.explode(sides).alias("side"))
    return dealt.select("*", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")).alias("block"))


def _within(stars: DataFrame, block: int) -> DataFrame:
    """Members asked for by the units of one pivot: key_a and key_b name the pivot."""
    groups = stars.groupBy(*PIVOT, "slack").agg(F.sum("weight").alias("weight"))
    laid = written(_blocks(groups, PIVOT, ["slack"], block), "slacks")
    each = laid.select(*PIVOT, "slack", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block"))
    tops = each.groupBy(F.col("pivot_id").alias("key_a"), F.col("pivot_hash").alias("key_b"), "block").agg(F.max("slack").alias("top"))
    other = tops.select("key_a", "key_b", F.col("block").alias("j"), F.col("top").alias("other_top"))
    units = tops.withColumnRenamed("block", "i").join(other, ["key_a", "key_b"]).where("i <= j and top + other_top > 0")
    placed = stars.join(laid.select(*PIVOT, "slack", "first", "blocks"), [*PIVOT, "slack"])
    placed = placed.select(F.col("pivot_id").alias("key_a"), F.col("pivot_hash").alias("key_b"), _in_block().alias("block"), *NODE, "slack")
    return placed.join(_sides(units), ["key_a", "key_b", "block"]).select("key_a", "key_b", "i", "j", "side", *NODE, "slack")


def _across(meeting: DataFrame, block: int) -> DataFrame:
    """Members asked for by the units of a band in which pivots meet: key_a is the band, key_b null."""
    groups = meeting.groupBy("band", *PIVOT).agg(F.sum("weight").alias("weight"))
    laid = written(_blocks(groups, ["band"], PIVOT, block), "bands")
    pivot = F.struct(*PIVOT)
    each = laid.select("band", pivot.alias("pivot"), F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block"))
    ends = each.groupBy("band", "block").agg(F.min("pivot").alias("lo"), F.max("pivot").alias("hi"))
    other = ends.select("band", F.col("block").alias("j"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"))
    units = ends.withColumnRenamed("block", "i").join(other, "band").where("i <= j and not (lo = hi and other_lo = other_hi and lo = other_lo)")
    sides = _sides(units.select(F.col("band").alias("key_a"), F.lit(None).cast("long").alias("key_b"), "i", "j")).drop("key_b").withColumnRenamed("key_a", "band")
    placed = meeting.join(laid.select("band", *PIVOT, "first", "blocks"), ["band", *PIVOT]).select("band", _in_block().alias("block"), *NODE)
    return placed.join(sides, ["band", "block"]).select(F.col("band").alias("key_a"), F.lit(None).cast("long").alias("key_b"), "i", "j", "side", *NODE, F.lit(0).cast("long").alias("slack"))


def candidates(side: np.ndarray, pivots: np.ndarray, nodes: np.ndarray, slack: np.ndarray, signatures: np.ndarray, band: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit's members that it has to settle (see the module's text): positions of either one."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one_block = not len(b)
    if one_block:
        b = a
    keys = band_keys(signatures)
    if band is None:
        open_pairs = slack[a][:, None] + slack[b][None, :] > 0
        shared = np.zeros_like(open_pairs)
        for k in range(BANDS):
            shared |= keys[a, k][:, None] == keys[b, k][None, :]
        open_pairs &= shared
    else:
        same = lambda x, y: (x[a][:, None, :] == y[b][None, :, :]).all(2)
        open_pairs = ~(same(pivots, pivots) | same(pivots, nodes) | same(nodes, pivots))
        for k in range(int(np.flatnonzero(keys[a[0]] == band)[0])):
            open_pairs &= keys[a, k][:, None] != keys[b, k][None, :]
    ia, ib = np.nonzero(np.triu(open_pairs, 1) if one_block else open_pairs)
    return a[ia], b[ib]


def verified(ia: np.ndarray, ib: np.ndarray, sets: list[np.ndarray], threshold: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of ia (ascending), those paired with it whose sets are similar enough, exactly."""
    if not len(ia):
        return
    p, q = threshold.numerator, threshold.denominator
    sizes = np.array([len(s) for s in sets])
    used = np.unique(ib)
    vocabulary, local = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    mark = np.zeros(len(vocabulary), np.int32)
    edges = np.flatnonzero(np.concatenate([[True], ia[1:] != ia[:-1]]))
    for lo, hi in zip(edges, [*edges[1:], len(ia)], strict=True):
        x, others = ia[lo], ib[lo:hi]
        at = np.minimum(np.searchsorted(vocabulary, sets[x]), len(vocabulary) - 1)
        at = at[vocabulary[at] == sets[x]]
        mark[at] = 1
        if sizes[others].sum() * 2 < len(local):
            inner = np.array([mark[local[starts[k] : starts[k] + sizes[used[k]]]].sum() for k in place[others]])
        else:
            inner = np.add.reduceat(mark[local], starts)[place[others]]
        mark[at] = 0
        yield x, others[q * inner >= p * (sizes[x] + sizes[others] - inner)]


def compare(
    nodes: np.ndarray, pivots: np.ndarray, copies: np.ndarray, side: np.ndarray, slack: np.ndarray, signatures: np.ndarray,
    sets: list[np.ndarray], band: int | None, threshold: Fraction, fewest: list[int],
) -> tuple[np.ndarray, np.ndarray]:
    """Links of a unit's members: weighted link counts, and the position of the first linked one, transitively."""
    ia, ib = candidates(side, pivots, nodes, slack, signatures, band)
    links, parent = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    rank = np.empty(len(nodes), np.int64)
    rank[np.lexsort((nodes[:, 1], nodes[:, 0]))] = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = [lo + survives(signatures[ia[lo : lo + 65_536]] == signatures[ib[lo : lo + 65_536]], fewest) for lo in range(0, len(ia), 65_536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
    for x, linked in verified(ia[keep], ib[keep], sets, threshold):
        links[x] += copies[linked].sum()
        links[linked] += copies[x]
        for y in linked:
            a, b = root(x), root(y)
            if a != b:
                if rank[a] > rank[b]:
                    a, b = b, a
                parent[b] = a
    return links, np.array([root(k) for k in range(len(nodes))], np.int64)


def _compared(shipped: DataFrame, threshold: Fraction, tolerance: float) -> DataFrame:
    """id, hash, links, root_id, root_hash for the linked members of each unit."""
    fewest = fewest_matches(float(threshold), tolerance)
    unit = ["key_a", "key_b", "i", "j"]
    dealt = shipped.select(*unit, "side", *NODE, *PIVOT, "copies", "slack", "signature", "shingles")
    dealt = dealt.repartition(*unit).sortWithinPartitions(*unit, "side", *NODE)
    names = [*NODE, "links", "root_id", "root_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now: tuple | None = None
        out: tuple[list, ...] = tuple([] for _ in names)

        def finish() -> None:
            if len(held) > 1:
                side, *numbers = (np.array([h[k] for h in held], np.int64) for k in range(7))
                nodes, pivots, copies, slack = np.stack(numbers[:2], 1), np.stack(numbers[2:4], 1), numbers[4], numbers[5]
                signatures = np.stack([np.frombuffer(h[7], np.uint32) for h in held])
                sets = [np.frombuffer(h[8], np.uint64) for h in held]
                links, roots = compare(nodes, pivots, copies, side, slack, signatures, sets, now[0] if now[1] is None else None, threshold, fewest)
                some = np.flatnonzero(links)
                for o, v in zip(out, (nodes[some, 0], nodes[some, 1], links[some], nodes[roots[some], 0], nodes[roots[some], 1]), strict=True):
                    o.extend(v.tolist())
            held.clear()

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names)
            for o in out:
                o.clear()
            return rows

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:4] != now:
                    finish()
                    now = r[:4]
                held.append(r[4:])
            if len(out[0]) > 4096:
                yield batch()
        finish()
        yield batch()

    return dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, block: int = 512) -> DataFrame:
    """Per document: doc_id, class_id, n_links, copy_id, text_hash, first.

    class_id is the smallest id that the document reaches over links (similarity >= threshold), n_links
    the number of other documents it is linked to, copy_id the smallest id with the same set, text_hash
    the xxhash64 of its text. first marks the rows of the text that heads its class: those of class_id and,
    should that id be repeated, of one of its texts (a text without words heads a class of its own).
    """
    exact = Fraction(str(threshold))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")
    sketched = written(sketches(docs, n), "sketches")
    sets = sketched.where("set_key is not null").groupBy("set_key")
    classes = sets.agg(F.min(F.struct("id", "hash")).alias("node"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes.select("set_key", "node.id", "node.hash", "copies", "bands"), "classes")

    banded = classes.select(*NODE, F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("crowd")).where("crowd > 1")
    shared = written(banded.join(crowded, "band"), "shared")
    degrees = shared.groupBy(*NODE).agg((-F.sum("crowd")).alias("rank"))
    ranked = written(shared.join(degrees, NODE).select("band", *NODE, F.struct("rank", *NODE).alias("rank")), "ranked")
    leads = ranked.groupBy("band").agg(F.min("rank").alias("lead"))
    pivots = ranked.join(leads, "band").groupBy(*NODE).agg(F.min("lead").alias("lead"))
    pivots = written(pivots.select(*NODE, F.col("lead.id").alias("pivot_id"), F.col("lead.hash").alias("pivot_hash")), "pivots")

    # Texts that no member's bucket asks for stay where they are; the buckets are BUCKETS rows at most.
    members = pivots.join(classes.select(*NODE, "copies"), NODE)
    buckets = F.broadcast(pivots.select(F.pmod(F.xxhash64(*NODE), F.lit(BUCKETS)).alias("_bucket")).distinct())
    asked = docs.join(buckets, F.pmod(F.xxhash64(*NODE), F.lit(BUCKETS)) == F.col("_bucket"), "left_semi")
    texts = members.join(asked.groupBy(*NODE).agg(F.first("text").alias("text")), NODE)
    payloads = written(_payloads(texts, n), "members")

    named = pivots.select(F.col("pivot_id").alias("p_id"), F.col("pivot_hash").alias("p_hash")).distinct()
    stars = written(_stars(payloads, named, exact, tolerance), "stars")
    by_band = ranked.select("band", *NODE).join(payloads.select(*NODE, *PIVOT, "weight"), NODE)
    ends = by_band.groupBy("band").agg(F.min(F.struct(*PIVOT)).alias("lo"), F.max(F.struct(*PIVOT)).alias("hi"))
    meeting = written(by_band.join(ends.where("lo < hi").select("band"), "band"), "meeting")
    units = _within(stars, block).unionByName(_across(meeting, block))
    found = written(_compared(units.join(payloads, NODE), exact, tolerance), "links")

    linked = stars.where("linked")
    root = [F.col("root_id"), F.col("root_hash")]
    links = found.select(*NODE, "links").union(linked.select(*NODE, "pivot_copies")).union(_certain(stars))
    links = links.union(linked.groupBy(*PIVOT).agg(F.sum("copies"))).groupBy(*NODE).agg(F.sum("links").alias("links"))
    edges = found.select(F.struct(*NODE).alias("a"), F.struct(*[c.alias(x) for c, x in zip(root, NODE, strict=True)]).alias("b"))
    edges = edges.union(linked.select(F.struct(*NODE), F.struct(F.col("pivot_id").alias("id"), F.col("pivot_hash").alias("hash"))))
    roots = components(edges, "a", "b").select("node.id", "node.hash", "root")

    verdicts = classes.select("set_key", *NODE, "copies").join(links, NODE, "left").join(roots, NODE, "left")
    verdicts = verdicts.select("set_key", F.col("id").alias("class_first"), F.col("hash").alias("class_hash"), "copies", "links", "root")
    joined = sketched.select("id", "hash", "set_key").join(verdicts, "set_key", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return joined.select(
        real(F.col("id")).alias("doc_id"),
        real(F.coalesce("root.id", "class_first", "id")).alias("class_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        real(F.coalesce("class_first", "id")).alias("copy_id"),
        F.col("hash").alias("text_hash"),
        ((F.col("id") == F.coalesce("root.id", "class_first", "id")) & (F.col("hash") == F.coalesce("root.hash", "class_hash", "hash"))).alias("first"),
    )
