"""Bradley-Terry quality ranking.

Each document has a utility, linear in features of its whole text. The utilities are learned from
preference pairs (a document labelled 1 is preferred to one labelled 0) by logistic loss on the
difference of the two feature vectors, with ridge regularisation. The score is a logistic map of the
utility, placed so that the score threshold falls on a quantile of the training utilities; the
quantile is the one that separates the labelled classes best.

Learning uses at most ``max_labelled`` labelled rows, the first by a hash of their ids (a documented
bound, so the driver holds a fixed amount); scoring reads every row and whole texts in one pass
without a shuffle.

Defined cases: null and empty texts get the features of an empty text and a score; repeated rows score
alike; with labels of one class or none there is nothing to prefer, and every document scores 1.0 if no
label is 0, else 0.0; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Byte classes: each byte of the text counts in one of these.
CLASS_NAMES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "bar", "mark", "high", "other")


def _byte_classes() -> np.ndarray:
    out = np.full(256, CLASS_NAMES.index("other"))
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind = "high"
        elif c.islower():
            kind = "lower"
        elif c.isupper():
            kind = "upper"
        elif c.isdigit():
            kind = "digit"
        elif c == "\n":
            kind = "newline"
        elif c.isspace():
            kind = "space"
        elif c in ".!?":
            kind = "stop"
        elif c in ",;:'\"-()":
            kind = "comma"
        elif c in "|/\\<>{}[]":
            kind = "bar"
        elif c in "*&$%#@^~_+=":
            kind = "mark"
        else:
            continue
        out[b] = CLASS_NAMES.index(kind)
    return out


CLASSES = _byte_classes()
#: Buckets that the byte trigrams of a text are hashed to (a power of two).
TRIGRAMS = 1 << 10
N_RATES = len(CLASS_NAMES) + 9
N_FEATURES = N_RATES + TRIGRAMS
#: Bytes whose trigrams are hashed at a time.
PART = 1 << 20


def trigram_counts(raw: np.ndarray) -> np.ndarray:
    """Counts of the byte trigrams of a whole text by a hash of TRIGRAMS values."""
    out = np.zeros(TRIGRAMS, np.int64)
    for at in range(0, len(raw) - 2, PART):
        b = raw[at : at + PART + 2].astype(np.uint32)
        code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        hashed = code * np.uint32(2654435761) >> np.uint32(32 - (TRIGRAMS.bit_length() - 1))
        out += np.bincount(hashed, minlength=TRIGRAMS)
    return out


class Featurizer:
    """Features of a whole text, all of them rates or logarithms, so that length alone does not decide:
    shares of byte classes and of hashed byte trigrams, word and line lengths, and how much repeats."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 400_000:
            known.clear()
        return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        out = np.zeros(N_FEATURES, np.float32)
        k = len(CLASS_NAMES)
        if len(raw):
            out[:k] = np.sqrt(np.bincount(CLASSES[raw], minlength=k) / len(raw))
        if len(raw) > 2:
            out[N_RATES:] = np.sqrt(trigram_counts(raw) / (len(raw) - 2))
        words = text.split()
        n = len(words)
        if not n:
            return out
        codes = self._codes(words)
        lengths = len(text) / n
        lines = [x for x in text.split("\n") if x.strip()]
        out[k] = 1.0
        out[k + 1] = math.log1p(n) / 10
        out[k + 2] = math.log1p(lengths) / 3
        out[k + 3] = np.mean(codes[1:] == codes[:-1]) if n > 1 else 0.0
        out[k + 4] = len(np.unique(codes)) / n
        if n > 3:
            pairs = codes[1:] * 1_000_003 + codes[:-1]
            triples = pairs[1:] * 1_000_003 + codes[:-2]
            out[k + 5] = 1 - len(np.unique(pairs)) / len(pairs)
            out[k + 6] = 1 - len(np.unique(triples)) / len(triples)
        out[k + 7] = 1 - len(set(lines)) / max(1, len(lines))
        out[k + 8] = math.log1p(len(lines)) / 10
        return out


def fit_preferences(
    x: np.ndarray, y: np.ndarray, pairs_per_step: int = 1024, steps: int = 800, ridge: float = 1e-3, seed: int = 7
) -> np.ndarray:
    """Weights w: loss is log(1 + exp(-(w . (x_preferred - x_other)))) over sampled preference pairs."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)  # places, not copies of the rows
    w, m, v = (np.zeros(x.shape[1], x.dtype) for _ in range(3))
    for step in range(1, steps + 1):
        d = x[good[rng.integers(len(good), size=pairs_per_step)]]
        d -= x[bad[rng.integers(len(bad), size=pairs_per_step)]]
        lost = (1 / (1 + np.exp(np.clip(d @ w, -40, 40)))).astype(x.dtype)
        gradient = ridge * w - d.T @ lost / len(d)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        rate = 0.02 * (1 - step / (steps + 1))
        w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)).astype(x.dtype)
    return w


def quantile_threshold(utility: np.ndarray, y: np.ndarray) -> float:
    """The utility at the quantile of all training utilities with the best balanced accuracy."""
    order = np.argsort(utility, kind="stable")
    u, good = utility[order], y[order] == 1
    kept_good = 1 - np.concatenate([[0], np.cumsum(good)]) / max(1, good.sum())
    cut_bad = np.concatenate([[0], np.cumsum(~good)]) / max(1, (~good).sum())
    k = int(np.argmax(kept_good + cut_bad))
    if k == 0:
        return u[0] - 1.0
    if k == len(u):
        return u[-1] + 1.0
    # A gap between the classes is cut nearer to the rejected side: an accepted document is not lost.
    return u[k - 1] + 0.35 * (u[k] - u[k - 1])


def fit(train: DataFrame, max_labelled: int = 8192, label: str = "quality", at: float = 0.7) -> dict:
    """Model from a table of doc_id, text and the label (rows without a 0 or 1 label are ignored).

    It learns from the first max_labelled pairs of id and label by a hash of the id; of rows that repeat
    such a pair the one whose text has the smallest hash counts.
    """
    small_batches(train.sparkSession)
    rows = train.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"), "text")
    chosen = rows.select(F.col("doc_id").alias("id"), F.col("y").alias("its")).distinct()
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id", "its").limit(max_labelled))
    rows = rows.join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("y") == F.col("its")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer()
        for b in batches:
            values = [features(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(values, pa.list_(pa.float32()))], ["doc_id", "y", "hash", "x"])

    featured = rows.select("doc_id", "y", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id bigint, y int, hash bigint, x array<float>")
    one = featured.groupBy("doc_id", "y").agg(F.min_by("x", "hash").alias("x"))
    x, y = _matrix(one.toArrow())
    if not (y == 1).any() or not (y == 0).any():
        return {"constant": 0.0 if (y == 0).any() else 1.0}
    mean = x.mean(0, dtype=np.float64)
    std = np.concatenate([x[:, c : c + BLOCK].std(0, dtype=np.float64) for c in range(0, x.shape[1], BLOCK)]) + 1e-3
    for i in range(0, len(x), BLOCK):  # in place, a block at a time: the driver holds the matrix once
        x[i : i + BLOCK] = (x[i : i + BLOCK] - mean) / std
    w = fit_preferences(x, y).astype(np.float64)
    utility = np.concatenate([x[i : i + BLOCK] @ w for i in range(0, len(x), BLOCK)])
    cut = quantile_threshold(utility, y)
    spread = max(1e-6, float(np.std(utility)))
    return {"weights": w / std, "offset": float(mean / std @ w) + cut, "scale": 3.0 / spread, "at": at}


#: Rows or columns of the matrix that are worked out at a time.
BLOCK = 256


def _matrix(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of rows (doc_id, y, x) by doc_id and label, copied out of Arrow once."""
    order = pc.sort_indices(found.select(["doc_id", "y"]), [("doc_id", "ascending"), ("y", "ascending")]).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    x, at = np.empty((len(order), N_FEATURES), np.float32), 0
    for chunk in found.column("x").chunks:
        x[place[at : at + len(chunk)]] = chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
        at += len(chunk)
    return x, found.column("y").to_numpy()[order]


def labelled_sample(labels: DataFrame, usable: Column, max_labelled: int = 8192, label: str = "quality") -> DataFrame:
    """At most max_labelled pairs of label_id and label, the first by a hash of the id: bounded, so broadcast."""
    rows = labels.where(usable & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias(label)).distinct()
    return F.broadcast(rows.orderBy(F.xxhash64("label_id"), "label_id", label).limit(max_labelled))


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score column added; every row, whole texts, one pass."""
    if "constant" in model:
        return docs.withColumn(name, F.lit(model["constant"]))
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index(text)
    odds = math.log(model["at"] / (1 - model["at"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer()
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)]).reshape(-1, N_FEATURES)
            z = model["scale"] * (x @ model["weights"] - model["offset"]) + odds
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
