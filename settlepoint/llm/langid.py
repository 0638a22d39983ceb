"""Language identification by prediction with partial matching (PPM).

For each language a variable-order context tree over bytes is learned (orders 0 to 3, escape method C:
in a context seen T times with q distinct successors, a successor seen n times has probability
n / (T + q), and the escape to the next shorter context q / (T + q)). The statistics are then frozen,
so a byte's exact code length is a function of the byte and its three predecessors; the trees are
flattened into tables from byte strings to code lengths per language, and a document's score is the sum
over its whole text, looked up a batch at a time.

The trees are learned from at most ``per_language`` documents and ``max_bytes`` of each language, the first by
a hash of their ids (a documented bound on what the driver holds), and broadcast; prediction covers every row
and whole texts in one pass without a shuffle.

Defined cases: a null text or one without any letter is ``und`` with score 0.0; ties go to the first
language by name; with no training rows all predictions are ``und``; repeated rows score alike; an
empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, spare, written

START = b"\n\n\n"
#: Bytes that are looked up at a time; a worker's tables of code lengths hold some 60 bytes for each.
PART = 1 << 18


class ContextTrees:
    """Frozen code lengths (bits) of a byte after up to three predecessors, a column per language."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        n_lang = len(self.languages)
        grams = []
        for x in self.languages:  # a text at a time: no string spans two texts
            each = [self._grams(np.frombuffer(START + t, np.uint8).astype(np.uint32)) for t in samples[x]]
            grams.append(tuple(np.concatenate(g) for g in zip(*each, strict=True)))
        self.cost0 = np.empty((256, n_lang), np.float32)
        self.cost1 = np.empty((1 << 16, n_lang), np.float32)
        self.escape2 = np.zeros((1 << 16, n_lang), np.float32)
        # Three-byte strings serve as strings and as contexts (the start marks are a context only).
        # Zero is always among them, so that trees of empty texts have tables to look into.
        zero = np.zeros(1, np.uint32)
        self.keys3 = np.unique(np.concatenate([zero, *(x for g in grams for x in (g[2], g[3] >> np.uint32(8)))]))
        self.keys4 = np.unique(np.concatenate([zero, *(g[3] for g in grams)]))
        self.cost2 = np.empty((len(self.keys3), n_lang), np.float32)
        self.escape3 = np.zeros((len(self.keys3) + 1, n_lang), np.float32)
        self.cost3 = np.empty((len(self.keys4), n_lang), np.float32)
        for k, (g1, g2, g3, g4) in enumerate(grams):
            seen, keys, n, total, kinds = self._contexts(g1, 8)
            c = np.full(256, 8.0)
            if len(g1):
                c += self._bits(kinds[0], total[0] + kinds[0])
                c[keys] = self._bits(n, (total + kinds)[keys >> 8])
            self.cost0[:, k] = c
            c = np.tile(c, 256)
            esc, own, keys = self._order(g2, 16)
            c += np.repeat(esc, 256)
            c[keys] = own
            self.cost1[:, k] = c
            esc, own, keys = self._order(g3, 24)
            self.escape2[:, k] = esc
            c2 = esc[self.keys3 >> 8] + c[self.keys3 & 0xFFFF]
            c2[np.searchsorted(self.keys3, keys)] = own
            self.cost2[:, k] = c2
            contexts, at, n = *np.unique(g4 >> 8, return_inverse=True), None
            keys, n = np.unique(g4, return_counts=True)
            of = np.searchsorted(contexts, keys >> 8)
            total, kinds = np.bincount(at, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
            esc3 = self._bits(kinds, total + kinds)
            held = np.searchsorted(self.keys3, contexts)
            held[(held >= len(self.keys3)) | (self.keys3[np.minimum(held, len(self.keys3) - 1)] != contexts)] = len(self.keys3)
            self.escape3[held, k] = esc3
            self.escape3[-1, k] = 0
            c3 = self._lower(c2)
            if len(contexts):
                at3 = np.minimum(np.searchsorted(contexts, self.keys4 >> 8), len(contexts) - 1)
                c3 = c3 + np.where(contexts[at3] == self.keys4 >> 8, esc3[at3], 0.0)
            c3[np.searchsorted(self.keys4, keys)] = self._bits(n, (total + kinds)[of])
            self.cost3[:, k] = c3

    def _lower(self, c2: np.ndarray) -> np.ndarray:
        """Code lengths after two predecessors, for the four-byte strings (whose last three bytes are among keys3)."""
        return c2[np.searchsorted(self.keys3, self.keys4 & 0xFFFFFF)]

    @staticmethod
    def _grams(b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Byte strings of 1 to 4 bytes that end at each byte from the fourth on."""
        one = b[3:]
        two = b[2:-1] << np.uint32(8) | one
        three = b[1:-2] << np.uint32(16) | two
        return one, two, three, b[:-3] << np.uint32(24) | three

    @staticmethod
    def _bits(n: np.ndarray, of: np.ndarray) -> np.ndarray:
        return -np.log2(n / of)

    @staticmethod
    def _contexts(grams: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
        keys, n = np.unique(grams, return_counts=True)
        size = 1 if bits == 8 else 1 << (bits - 8)
        total = np.bincount(keys >> 8, weights=n, minlength=size)
        kinds = np.bincount(keys >> 8, minlength=size)
        return total > 0, keys, n, total, kinds

    def _order(self, grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Escape bits by context (0 where unseen), code lengths of the seen strings, those strings."""
        seen, keys, n, total, kinds = self._contexts(grams, bits)
        esc = np.zeros(len(total))
        esc[seen] = self._bits(kinds[seen], (total + kinds)[seen])
        return esc, self._bits(n, (total + kinds)[keys >> 8]), keys


class CodeLengths:
    """Looks code lengths up; built once in each worker from the frozen trees."""

    BITS = 22

    def __init__(self, trees: ContextTrees):
        self.t = trees
        self.index3 = np.full(1 << 24, len(trees.keys3), np.int32)
        self.index3[trees.keys3] = np.arange(len(trees.keys3), dtype=np.int32)
        self.slots = np.zeros(1 << self.BITS, np.int32)
        slot = self._slot(trees.keys4)
        self.slots[slot] = np.arange(len(trees.keys4), dtype=np.int32)  # the last of a slot is held there
        lost = np.flatnonzero(self.slots[slot] != np.arange(len(trees.keys4)))
        self.lost_keys, self.lost_at = trees.keys4[lost], lost.astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)

    def totals(self, texts: list[bytes], heads: list[bytes] | None = None) -> np.ndarray:
        """Code length in bits of each text under each language; heads are the three bytes before each."""
        t = self.t
        heads = heads or [START] * len(texts)
        b = np.frombuffer(b"".join(h + x for h, x in zip(heads, texts, strict=True)), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(START) + len(x) for x in texts])
        _, _, three, four = t._grams(b)
        at = self.slots[self._slot(four)]
        cost = t.cost3[at]
        missed = np.flatnonzero(t.keys4[at] != four)
        if len(missed):
            g4, g3 = four[missed], three[missed]
            at3 = self.index3[g3]
            known = at3 < len(t.keys3)
            low = t.escape2[g3 >> 8] + t.cost1[g3 & 0xFFFF]
            low[known] = t.cost2[at3[known]]
            value = t.escape3[self.index3[g4 >> 8]] + low
            if len(self.lost_keys):
                j = np.minimum(np.searchsorted(self.lost_keys, g4), len(self.lost_keys) - 1)
                held = self.lost_keys[j] == g4
                value[held] = t.cost3[self.lost_at[j[held]]]
            cost[missed] = value
        # Sums per text over the bytes after its start marks (cost[i] belongs to byte i + 3).
        out = np.zeros((len(texts), len(t.languages)))
        starts = np.concatenate([[0], ends[:-1]])
        full = np.flatnonzero(ends - starts > len(START))
        if len(full):
            bounds = np.stack([starts[full], ends[full] - len(START)], 1).reshape(-1)
            padded = np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)])
            out[full] = np.add.reduceat(padded, bounds, axis=0, dtype=np.float64)[::2]
        return out


def fit(train: DataFrame, per_language: int = 300, max_bytes: int = 8 << 20) -> ContextTrees | None:
    """Trees from the text and lang of a table of doc_id, text, lang (null langs and texts are ignored).

    They are learned from the first per_language rows of a language by a hash of their ids, as far as these
    rows together have max_bytes; a row that is repeated is learned from once.
    """
    text = F.xxhash64("text")
    train = train.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    first = Window.partitionBy("lang").orderBy("_order", "doc_id", "_text")
    ids = train.select("doc_id", "lang", text.alias("_text"), F.octet_length("text").cast("long").alias("_bytes"), F.xxhash64("doc_id").alias("_order"))
    ids = ids.where(F.col("_bytes") <= max_bytes).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language)
    ids = written(ids.withColumn("_sum", F.sum("_bytes").over(first)).where(F.col("_sum") <= max_bytes), "sample")
    # At most per_language rows for each language: bounded, so broadcast.
    chosen = F.broadcast(ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "_text").distinct())
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (text == F.col("_text"))
    rows = train.join(chosen, here).dropDuplicates(["doc_id", "lang", "_text"]).select("lang", "text", "doc_id").collect()
    if not rows:
        return None
    samples: dict[str, list[bytes]] = {}
    for lang, text, _ in sorted(rows, key=lambda r: (r[0], r[2] is None, r[2] or 0, r[1])):
        samples.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
    return ContextTrees(samples)


def predict(docs: DataFrame, trees: ContextTrees | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added."""
    docs = docs.drop("lang_pred", "score")
    if trees is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    small_batches(docs.sparkSession, 256)
    (letter_name,) = spare(docs.columns, "_letter")
    lettered = docs.withColumn(letter_name, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        lengths = CodeLengths(trees)
        for b in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(at)]
            letter = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            bits = np.zeros((len(texts), len(trees.languages)))
            parts: list[bytes] = []
            heads: list[bytes] = []
            of: list[int] = []
            size = 0
            for k, x in enumerate(texts):  # a quarter of a megabyte at a time; longer texts go in parts
                for at0 in range(0, len(x), PART):
                    parts.append(x[at0 : at0 + PART])
                    heads.append(x[at0 - 3 : at0] if at0 else START)
                    of.append(k)
                    size += len(parts[-1])
                    if size >= PART:
                        np.add.at(bits, of, lengths.totals(parts, heads))
                        parts, heads, of, size = [], [], [], 0
            if parts:
                np.add.at(bits, of, lengths.totals(parts, heads))
            best = bits.argmin(1)
            n = np.sqrt(np.array([max(1, len(x)) for x in texts]))[:, None]
            score = 1 / np.exp2(np.clip((bits.min(1, keepdims=True) - bits) / n, -60, 0)).sum(1)
            pred = [trees.languages[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
            new = [pa.array(pred, pa.string()), pa.array(np.where(letter, score, 0.0), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], "lang_pred", "score"])

    out = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return lettered.mapInArrow(run, T.StructType(out))
