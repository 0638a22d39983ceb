"""The five-stage pipeline against a plain version, and its defined cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from settlepoint.llm import mixing, quality
from test_operators import brute_links, near_copies, prose, water_fill

CLASHES = ("quality", "label_id", "score", "kept", "keep_id", "group_size", "text_sha256", "fp", "_mix_source", "mix_source", "copies", "_copies", "_copy", "gone", "text_hash", "id", "hash")


def corpus():
    rng, rows = random.Random(31), []
    for k in range(60):
        rows.append((k, prose(rng, rng.randrange(5, 90)), "abc"[k % 3]))
    rows += [(100 + k, t, "a") for k, (_, t, _) in enumerate(rows[:8])]
    rows += [(k, t, rng.choice(["b", None])) for k, t in near_copies(rng, 250, 9, 4, 200)]
    rows += [(300 + k, prose(rng, 20).upper().replace(" ", "!! "), "b") for k in range(25)]
    rows += [(400, None, "a"), (401, "", "c"), (402, "...", None), (403, prose(rng, 3000), "c"), (100, prose(rng, 30), "c"), (None, prose(rng, 25), None), (3, rows[3][1], "a")]
    return rows


@pytest.fixture()
def folder(spark, tmp_path):
    rows = corpus()
    documents = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("!!" not in t), 0) for i, t, _ in rows if i is not None and t and i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def plain_scores(spark, rows, folder):
    """The score of each row by the model's formula, learned from the labelled rows as the stage does."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    train = [(i, t, labels[i]) for i, t, _ in rows if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    model = quality.fit(spark.createDataFrame(train, "doc_id bigint, text string, quality int"))
    features = quality.Featurizer()
    z = [model["scale"] * (features(t).astype(float) @ model["weights"] - model["offset"]) + np.log(0.7 / 0.3) for _, t, _ in rows]
    return 1 / (1 + np.exp(-np.array(z)))


def plain_mixture(rows):
    """Copies of each row."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)})

    def draw(i, seed):
        p = mixing.PRIME
        a = ((-1 if i is None else i) % p * 48271 + seed * 69621 + 12345) % p
        b = a * (a + seed * 2 + 1) % p
        return (b * 16807 + a) % p

    copies = [0] * len(rows)
    for s in order:
        rate = min(3.0, target[s] / sizes[s]) if sizes[s] else 0.0
        part = rate - int(rate)
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        off = lambda seed: round(abs(sum(len((rows[k][1] or "").split()) for k in mine if draw(rows[k][0], seed) < part * mixing.PRIME) - part * sizes[s]), 3)
        seed = min(mixing.SEEDS, key=lambda x: (off(x), x))
        for k in mine:
            copies[k] = int(rate) + (draw(rows[k][0], seed) < part * mixing.PRIME)
    return copies


def key(row):
    return row[0] is None, row[0] or 0, row[1] or ""


def test_every_stage_and_the_run_equal_a_plain_version(spark, folder):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    stages = dict(corpus_pipeline.STAGES)
    rows = corpus()
    names = ["doc_id", "text", "source"]
    take = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    accepted = [r for r, s in zip(rows, plain_scores(spark, rows, folder), strict=True) if s >= 0.7]
    docs = stages["quality classifier"](spark, docs, folder)
    assert take(docs) == sorted(accepted, key=key) and 60 < len(accepted) < len(rows) - 20

    best = {}
    for r in accepted:
        text = r[1] or ""
        if text not in best or (r[0] is not None, r[0] or 0) > (best[text][0] is not None, best[text][0] or 0):
            best[text] = r
    docs = stages["exact dedup"](spark, docs, folder)
    single = sorted(best.values(), key=key)
    assert [r[:2] for r in take(docs)] == [r[:2] for r in single]
    single = take(docs)

    links = brute_links([r[:2] for r in single])
    seen, far = set(), []
    for r, (head, n) in zip(single, links, strict=True):
        if n == 0 or (r[0] == head and head not in seen):
            far.append(r)
            seen.add(head)
    docs = stages["n-gram Jaccard join"](spark, docs, folder)
    assert take(docs) == far and len(far) < len(single) - 4

    copies = plain_mixture(far)
    docs = stages["mixing sources to target weights"](spark, docs, folder)
    assert take(docs) == sorted((r for r, n in zip(far, copies, strict=True) for _ in range(n)), key=key)

    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {}
    for (i, t, _), n in zip(far, copies, strict=True):
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.setdefault(i, []).extend([len(ids)] * n)
    got, sequences = {}, {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r.doc_id, []).append(r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sum(x) for i, x in got.items()} == {i: sum(x) for i, x in want.items() if x}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_stages_keep_columns_with_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("clash"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        assert docs.where(" or ".join(f"`{c}` <> 'clash' or `{c}` is null" for c in CLASHES)).count() == 0
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[4][1](spark, docs, folder).count() > 0


def test_stages_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
