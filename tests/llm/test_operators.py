"""Each training-data operator against brute force, round trips and its defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from settlepoint.llm import chat, exact_dedup, langid, line_dedup, mixing, ngram_join, packing, quality, queries, vptree, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


# packing ------------------------------------------------------------------------------------------


def test_text_ids_equal_the_tokenizers_own():
    from tokenizers import Tokenizer

    path = tokenizer()
    own = Tokenizer.from_file(path)
    texts = ["", " a  b \n\n c", "it's I'LL we've", "x\ty z\u00a0w\u0085v \x1c q", "日本語 テスト。🙂", "end \n", "a\nb c\n", "<|endoftext|>", " lead", "a\n b"]
    ids = packing.TextIds(path)
    for t in texts:
        assert np.frombuffer(ids(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_control_strings_are_single_ids():
    from tokenizers import Tokenizer

    path = tokenizer()
    own, ids = Tokenizer.from_file(path), packing.TextIds(path)
    mark = "<|endoftext|>"
    for t in (mark, f"a {mark} b", f"{mark}{mark}", f"a{mark}\n\n{mark} b ", f"x  {mark}  y", "<|endoftext", f"é{mark[:-1]}{mark}"):
        got = np.frombuffer(ids(t), "<u4").tolist()
        assert got == own.encode(t, add_special_tokens=False).ids, t
        assert got.count(50256) == t.count(mark)


def test_every_entry_of_the_vocabulary_encodes_as_the_library_does():
    from tokenizers import Tokenizer

    path = tokenizer()
    own, ids = Tokenizer.from_file(path), packing.TextIds(path)
    assert ids.pieces.encode is not None
    words = [own.decode([i]) for i in range(50_256)]
    rng = random.Random(21)
    texts = words + ["".join(rng.choices(words, k=6)) for _ in range(4000)]
    for t, e in zip(texts, own.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids(t), "<u4").tolist() == e.ids, t


def test_assignment_is_the_plain_lowest_cost_loop():
    rng = random.Random(22)
    for linear, quadratic in ((1.0, 1 / 64), (0.0, 1.0), (1.0, 0.0)):
        lengths = [rng.randrange(1, 64) for _ in range(150)]
        total = sum(lengths)
        sizes = [64] * (total // 64) + packing.power_of_two_parts(total % 64)
        cost, used, want = [0.0] * len(sizes), [0] * len(sizes), []
        for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            at = 0
            while at < lengths[item]:
                k = min((k for k in range(len(sizes)) if used[k] < sizes[k]), key=lambda k: (cost[k], k))
                take = min(lengths[item] - at, sizes[k] - used[k])
                want.append((item, at, take, k, used[k]))
                used[k] += take
                cost[k] += linear * take + quadratic * take * take
                at += take
        assert packing.assign(lengths, 64, linear, quadratic) == want


def test_assign_fills_every_sequence():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 64) for _ in range(200)]
    placed = packing.assign(lengths, 64)
    by_item, by_sequence = {}, {}
    for item, start, length, k, offset in placed:
        by_item.setdefault(item, []).append((start, length))
        by_sequence.setdefault(k, []).append((offset, length))
    for item, parts in by_item.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == lengths[item]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 64


def test_costs_are_balanced():
    lengths = [60] * 5 + [4] * 75
    cost = {}
    for _, _, n, k, _ in packing.assign(lengths, 100, 1.0, 0.05):
        cost[k] = cost.get(k, 0) + n + 0.05 * n * n
    full = list(cost.values())[:5]
    assert max(full) < 1.6 * min(full)


def test_pack_keeps_every_id(spark, docs):
    from tokenizers import Tokenizer

    path, rng = tokenizer(), random.Random(2)
    rows = [(1, None), (2, ""), (3, prose(rng, 5000)), (4, "x"), (4, "x")] + [(10 + k, prose(rng, rng.randrange(1, 400))) for k in range(40)]
    got = packing.pack(docs(rows), path, 256).collect()
    own = Tokenizer.from_file(path)
    parts, sequences = {}, {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for i, t in rows:
        if i != 4:
            ids = np.frombuffer(b"".join(p for _, p in sorted(parts[i])), "<u4").tolist()
            assert ids == own.encode(t or "", add_special_tokens=False).ids + [0]
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(docs([]), path).count() == 0


# quality ------------------------------------------------------------------------------------------


def labelled(spark, n=200, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        t = prose(rng, rng.randrange(5, 200))
        rows.append((k, t if k % 3 else t.upper().replace(" ", "!! "), int(k % 3 > 0)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, quality int")


def test_ranking_separates_held_out_rows(spark):
    data = labelled(spark)
    model = quality.fit(data.where("doc_id < 120"))
    scored = quality.score(data, model).where("doc_id >= 120").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in scored]) > 0.95
    assert all(0 <= r.score <= 1 for r in scored)


def test_quality_defined_cases(spark, docs):
    model = quality.fit(labelled(spark))
    got = quality.score(docs([(1, None), (2, ""), (3, "x" * 100_000), (None, "a"), (None, "a")]), model).collect()
    assert len(got) == 5 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert quality.score(docs([]), model).count() == 0
    none = quality.fit(labelled(spark).where("quality = 1"))
    assert [r.score for r in quality.score(docs([(1, "a")]), none).collect()] == [1.0]
    assert quality.fit(labelled(spark).where("quality = 0")) == {"constant": 0.0}


def test_ranking_does_not_depend_on_the_order_of_rows(spark):
    data = labelled(spark, 60)
    twice = data.union(data.withColumn("text", F.concat("text", F.lit(" more")))).withColumn("label_id", F.lit(1))
    one, other = (quality.fit(d, max_labelled=40) for d in (twice.repartition(3), twice.orderBy(F.desc("text")).coalesce(1)))
    assert (one["weights"] == other["weights"]).all() and one["offset"] == other["offset"]


def test_preferences_learn_the_direction():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) > 0).astype(int)
    w = quality.fit_preferences(x, y)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.5 * w[0]


# WARC ---------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(k, f"https://www{k % 3}.Example.com:443/a/{k % 5}?q={k}#x", f"<p>{k % 7}</p>é") for k in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "not a url", "WARC/1.1\r\n\r\nx"), (103, "http://h", None), (104, "http://h/", "y" * 200_000)]
    pages = warc.pages_as_payloads(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit("clash")))
    folder = warc.new_folder(spark)
    archives = warc.write_archives(pages, folder)
    requests = pages.select("page_id", warc.reversed_host_key(F.col("url")).alias("key"))
    got = {r.page_id: r for r in warc.read_captures(requests, folder, archives).collect()}
    keep = {}
    for i, _, html in rows:
        keep[html or ""] = max(i, keep.get(html or "", -1))
    assert len(got) == len(rows)
    for i, url, html in rows:
        body, r = (html or "").encode(), got[i]
        assert r.payload_bytes == len(body)
        assert r.url == (url or "")
        if keep[html or ""] == i:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, body)
        else:
            assert (r.record_type, r.refers_to) == ("revisit", keep[html or ""])
    missing = spark.createDataFrame([("com,nowhere)/", 1), ("", 5)], "key string, page_id bigint")
    assert warc.read_captures(missing, folder, archives).count() == 0
    index = warc.CaptureIndex(folder, [tuple(r) for r in archives.orderBy("first_key", "first_page").select("first_key", "first_page", "archive", "index", "directory_at", "directory_length").collect()])
    assert sorted(e[0] for _, e in index.lookup("com,example,www0)/a/0?q=0")) == [0]
    assert [e for _, e in index.lookup("zzz")] == []
    assert warc.read_captures(requests, warc.new_folder(spark), warc.write_archives(pages.limit(0), warc.new_folder(spark))).count() == 0


def test_warc_keeps_every_row_of_a_repeated_page(spark):
    rows = [(1, "http://h/", "one"), (1, "http://h/", "two"), (1, "http://h/", "two"), (2, "http://h/", "two")]
    rows += [(None, "http://n/", "x"), (None, "http://n/", "x"), (None, "http://n/", "one")]
    pages = warc.pages_as_payloads(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    folder = warc.new_folder(spark)
    archives = warc.write_archives(pages, folder)
    requests = pages.select("page_id", warc.reversed_host_key(F.col("url")).alias("key"))
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to or 0, bytes(r.payload)) for r in warc.read_captures(requests, folder, archives).collect()))
    assert got == sorted(
        [(1, "response", 0, b"one"), (1, "revisit", 2, b""), (1, "revisit", 2, b""), (2, "response", 0, b"two")]
        + [(0, "response", 0, b"x"), (0, "response", 0, b"x"), (0, "revisit", 1, b"")]
    )


def test_reversed_host_key(spark):
    cases = {"http://WWW.Example.com/a?b#c": "com,example,www)/a?b", "https://u@h.org:8080": "org,h:8080)/", "http://h.org:80?x": "org,h)/?x", "plain": "plain"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.k for r in df.select("u", warc.reversed_host_key(F.col("u")).alias("k")).collect()} == cases


# n-gram join --------------------------------------------------------------------------------------


def brute_links(rows, t=0.8, n=5):
    """A (class id, links) for each row; a null id sorts last."""
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at, a in enumerate(order):
        for b in order[at + 1 :]:
            inner = len(sets[a] & sets[b])
            if inner and 5 * inner >= 5 * t * (len(sets[a]) + len(sets[b]) - inner):
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)), key=order.index)
                root[q] = p
    return [(rows[find(k)][0], links[k]) for k in range(len(rows))]


def near_copies(rng, size, copies, edits, first=0):
    base = prose(rng, size).split()
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randrange(0, edits)):
            w[rng.randrange(len(w))] = "Edit" + str(rng.randrange(9))
        out.append((first + k, " ".join(w)))
    return out


def joined(df):
    return sorted(((r.doc_id, r.text_hash, r.class_id, r.n_links) for r in df.collect()), key=str)


def wanted(spark, rows):
    hashes = spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "k bigint, t string").select("k", F.xxhash64("t").alias("h")).collect()
    hashes = {r.k: r.h for r in hashes}
    return sorted(((i, hashes[k], *found) for k, ((i, _), found) in enumerate(zip(rows, brute_links(rows), strict=True))), key=str)


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_join_equals_brute_force(spark, docs, block):
    rng, rows = random.Random(11), []
    for _ in range(6):
        rows += near_copies(rng, 120, 12, 4, len(rows))
    rows += near_copies(rng, 100, 60, 9, 300)  # two groups that meet and do not link throughout
    rows += [(400 + k, t.replace("e", "é", 1) + " " + prose(rng, 3)) for k, (_, t) in enumerate(rows[-20:])]
    rows += [(200, rows[0][1]), (201, rows[0][1].upper()), (202, None), (203, ""), (204, "one two"), (205, "One, two!"), (206, "..."), (207, prose(rng, 30_000))]
    got = ngram_join.jaccard_join(docs(rows), block=block)
    assert joined(got) == wanted(spark, rows)


def test_jaccard_join_of_a_large_group(spark, docs):
    """Two thousand near copies, of which most links are certain, equal rows and a repeated id among them."""
    rng = random.Random(12)
    rows = near_copies(rng, 60, 700, 4) + near_copies(rng, 150, 1300, 4, 700)
    rows += rows[5:9] + [(6, rows[900][1]), (6, prose(rng, 40)), (None, rows[10][1]), (None, rows[10][1] + " and more")]
    got = ngram_join.jaccard_join(docs(rows, extra=False))
    assert joined(got) == wanted(spark, rows)
    heads = {(r.doc_id, r.text_hash) for r in got.where("first").collect()}
    classes = {r.class_id for r in got.select("class_id").distinct().collect()}
    assert {i for i, _ in heads} == classes


def test_tight_groups_ask_for_few_rows(spark, docs):
    """Where all links of a pivot are certain, no unit holds its members."""
    rng = random.Random(13)
    payloads = ngram_join._payloads(docs(near_copies(rng, 400, 300, 3), extra=False).selectExpr("doc_id id", "0L hash", "0L pivot_id", "0L pivot_hash", "1L copies", "text"), 5)
    pivot = spark.createDataFrame([(0, 0)], "p_id bigint, p_hash bigint")
    stars = ngram_join._stars(payloads, pivot, ngram_join.Fraction(4, 5), 1e-6).cache()
    assert stars.where("linked").count() == 299
    assert ngram_join._within(stars, 16).count() == 0
    assert {r.links for r in ngram_join._certain(stars).collect()} == {298}


def test_jaccard_join_defined_cases(spark, docs):
    text = "a b c d e f g"
    other = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (3, text), (3, text), (None, None), (3, other), (4, other + " x"), (None, "q r s t u v"), (None, "q r s t u v")]
    got = ngram_join.jaccard_join(docs(rows))
    assert joined(got) == wanted(spark, rows)
    assert ngram_join.jaccard_join(docs([])).count() == 0


def test_pruning_bound_is_the_beta_posterior():
    fewest = ngram_join.fewest_matches(0.8, 1e-4)
    rng = np.random.default_rng(0)
    for n in (10, 50, 125):
        m = fewest[n]
        for k, above in ((m, True), (m - 1, False)):
            if 0 <= k:
                p = (rng.beta(k + 1, n - k + 1, 2_000_000) >= 0.8).mean()
                assert (p >= 0.5e-4) if above else (p <= 2e-4)


# exact dedup --------------------------------------------------------------------------------------


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 40, n, dtype=np.int64).astype(np.uint64) << np.uint64(24) for n in (500, 80))
    a, b = np.concatenate([a, a[:50], b[:20]]), np.concatenate([b, b[:5], b[:5]])
    read = exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.of(a).to_bytes())
    prints, counts = read.merge(exact_dedup.CountingQuotientFilter.of(b)).entries()
    want, n = np.unique(np.concatenate([a, b]), return_counts=True)
    assert (prints == want).all() and (counts == n).all()


def test_exact_dedup(spark, docs):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "x" * 50_000), (7, "x" * 50_000), (8, "b"), (8, "b"), (None, "a"), (None, "z")]
    got = exact_dedup.dedup(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    text = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    for r in got:
        group = by[text[r.text_sha256]]
        best = max((i for i in group if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(group), r.doc_id == best)
    assert exact_dedup.dedup(docs([])).count() == 0


def test_keep_one(spark, docs):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (8, "b"), (8, "b"), (None, "a"), (None, "z"), (None, "y"), (None, "y")]
    for extra in (True, False):
        table = docs(rows, extra=extra).withColumn("row", F.lit("clash"))
        got = exact_dedup.keep_one(table)
        assert got.columns == table.columns
        kept = got.collect()
        assert sorted((r.text or "", r.doc_id or 0) for r in kept) == [("", 5), ("A", 3), ("a", 2), ("b", 8), ("y", 0), ("z", 0)]
        assert all(r.row == "clash" for r in kept)
    assert exact_dedup.keep_one(docs([])).count() == 0


def test_all_checks_together_seldom_prune_a_link():
    import inspect
    from math import comb

    fewest = ngram_join.fewest_matches(0.8, inspect.signature(ngram_join.jaccard_join).parameters["tolerance"].default)
    for similarity in (0.8, 0.85, 0.9):
        chance = [comb(ngram_join.ROWS, x) * similarity**x * (1 - similarity) ** (ngram_join.ROWS - x) for x in range(ngram_join.ROWS + 1)]
        alive, lost = {0: 1.0}, 0.0
        for at in range(ngram_join.ROWS, ngram_join.N_HASHES + 1, ngram_join.ROWS):
            after: dict = {}
            for equal, p in alive.items():
                for x, q in enumerate(chance):
                    after[equal + x] = after.get(equal + x, 0.0) + p * q
            alive = {equal: p for equal, p in after.items() if equal >= fewest[at]}
            lost += sum(p for equal, p in after.items() if equal < fewest[at])
        assert lost < 1e-4


# line dedup ---------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited_pairs(n=150):
    rng, out = random.Random(4), []
    for _ in range(n):
        a = [rng.choice("abé") for _ in range(rng.randrange(0, 14))]
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(b) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                b.insert(at, rng.choice("abé"))
            elif at < len(b):
                b[at : at + 1] = [] if kind == 1 else [rng.choice("abé")]
        out.append(("".join(a), "".join(b)))
    return [(a, b, edits(a, b)) for a, b in out]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_automaton_and_keys(spark, k):
    df = spark.createDataFrame(edited_pairs(400), "a string, b string, d int")
    found = line_dedup.edits(F.col("a"), F.col("b"), k)
    assert df.where(~found.eqNullSafe(F.when(F.col("d") <= k, F.col("d")))).count() == 0
    lines = sorted({x for a, b, _ in edited_pairs(400) for x in (a, b)})
    single = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line", F.char_length("line").alias("n"))
    for crowd in (1, 1000):
        met = {(r.ha, r.hb) for r in line_dedup.candidate_pairs(single, k, crowd).collect()}
        of = {r.line: r.h for r in single.collect()}
        for at, x in enumerate(lines):
            for y in lines[at + 1 :]:
                if abs(len(x) - len(y)) <= k and edits(x, y) <= k:
                    assert tuple(sorted((of[x], of[y]))) in met, (x, y)


def brute_line_links(rows, k, chars_per_edit):
    places = {(i, j): x for i, t in rows for j, x in enumerate((t or "").split("\n")) if x.strip()}
    root, links = {p: p for p in places}, dict.fromkeys(places, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = {}
    for p, x in places.items():
        for q, y in places.items():
            most = min(k, min(len(x), len(y)) // chars_per_edit)
            pair = min(x, y), max(x, y)
            if pair not in near:
                near[pair] = x == y or most and abs(len(x) - len(y)) <= most and edits(x, y) <= most
            if p < q and near[pair]:
                links[p] += 1
                links[q] += 1
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: (find(p), links[p]) for p in places}


def edited_documents():
    """Short and long lines at up to three edits from each other, in digits, with shifts and shared parts."""
    rng, rows = random.Random(16), []
    base = [prose(rng, n) for n in (2, 4, 20, 45)] + ["é" * 9 + " on page 17 of the second volume, " + prose(rng, 12), "chapter 12 of 3", "see page 4"]
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 3)):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[], ["7"], [x[at], "3"]])
            lines.append("".join(x))
        rows.append((i, "\n".join([*lines, "", "\t", "short" + str(i % 3)])))
    return [*rows, (90, None), (91, ""), (92, rows[0][1])]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_line_join_equals_brute_force(spark, docs, k):
    rows = edited_documents()
    got = {(r.doc_id, r.line_no): r for r in line_dedup.line_join(docs(rows), k=k, chars_per_edit=5, crowd=4).collect()}
    want = brute_line_links(rows, k, 5)
    assert {p: ((r.class_doc_id, r.class_line_no), r.n_links, r.kept) for p, r in got.items()} == {p: (c, n, c == p) for p, (c, n) in want.items()}
    assert line_dedup.line_join(docs([])).count() == 0


def test_registered_line_join_equals_brute_force(spark, docs, tmp_path):
    rows = edited_documents()
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): ((r.class_doc_id, r.class_line_no), r.n_links) for r in queries.op6_segment_line_dedup(spark, str(tmp_path)).collect()}
    want = brute_line_links(rows, 2, 10)
    assert got == want and sum(n for _, n in want.values()) > 300


def test_line_join_is_native(spark, docs):
    plan = line_dedup.line_join(docs([(1, "a line of some length, yes")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# mixing -------------------------------------------------------------------------------------------


def water_fill(sizes, weights, most=3.0):
    capped, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    rng, rows = random.Random(8), []
    for k in range(600):
        source = rng.choice(["a", "b", "b", "b", "B", "é", None])
        rows.append((k, " ".join(["w"] * rng.randrange(0, 60)), source))
    rows += [(None, "x y", "a"), (601, None, "tiny"), (602, "only one", "small"), (603, "\x1f \x0b z", "small")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("rate", F.lit(1))
    got = mixing.plan_copies(df).collect()
    again = mixing.plan_copies(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target = water_fill(sizes, weights)
    taken = {}
    for r in got:
        assert r.copies <= 3 and r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, n in sizes.items():
        if n > 500:
            assert abs(taken[s] - target[s]) < 0.03 * target[s]
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.plan_copies(df.limit(0)).count() == 0


# neighbours ---------------------------------------------------------------------------------------


def test_vp_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows, dist = vptree.VPTree(x, 32).search(x[:50], 7)
    d = np.sqrt(np.maximum(0, 2 - 2 * x[:50] @ x.T))
    assert np.allclose(np.sort(dist, 1), np.sort(d, 1)[:, :7], atol=1e-7)
    loose, _ = vptree.VPTree(x, 32).search(x[:50], 7, relax=1.5)
    found = np.mean([len(set(a) & set(b)) / 7 for a, b in zip(rows.tolist(), loose.tolist(), strict=True)])
    assert 0.5 < found <= 1


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = [rng.normal(size=4).tolist() for _ in range(300)]
    v[10] = v[20] = v[30] = v[40] = v[50] = v[60] = v[70] = v[0]
    v[5], v[15], v[25], v[35], v[45] = None, [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, float("nan"), 0.0, 0.0], [1.0, 2.0]
    rows = list(enumerate(v)) + [(None, v[1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in vptree.nearest(df, lambda i: i % 50 == 0, shard_bytes=70 * 32, block_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    bad = {5, 15, 25, 35, 45}
    for q in range(0, 300, 50):
        a = np.array(v[q])
        every = []
        for i in set(range(300)) - bad - {q}:
            b = np.array(v[i])
            every.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), i))
        want = sorted(every)[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in want])
    assert vptree.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0
    two = df.where("vec_id in (0, 1)")
    assert [(r.query_id, r.rank, r.vec_id) for r in vptree.nearest(two, lambda i: i % 50 == 0).collect()] == [(0, 1, 1)]


def test_ties_go_to_smaller_ids(spark):
    """One-hot vectors: every candidate but the copies scores 0; two lengths, which never meet."""
    rows = [(i, [float(i % 30 == k) for k in range(30)]) for i in range(60)] + [(100 + i, [1.0, float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for shard_bytes in (1 << 20, 2_000):
        got: dict = {}
        for r in vptree.nearest(df, lambda i: i % 50 == 0, shard_bytes=shard_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got[0] == [(30, 1.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]
        assert got[50] == [(20, 1.0), (0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]
        assert got[100] == [(100 + i, 1 / np.sqrt(1.0 + i * i)) for i in range(1, 4)]


def test_neighbours_of_scaled_copies_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 16))
    scaled = [(base[0] * 2.0**e) for e in range(-10, 10)] + [base[1] * (i + 1) for i in range(20)] + list(rng.normal(size=(60, 16)))
    ids = rng.permutation(len(scaled))
    vectors = {int(i): v for i, v in zip(ids, scaled, strict=True)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    score = lambda x, y: float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))
    for shard_rows in (1_000, 30):
        got: dict = {}
        for r in vptree.nearest(df, lambda i: i >= 0, shard_bytes=shard_rows * 128).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        copies = [int(i) for i in ids[:20]]
        for q, found in got.items():
            want = sorted((x for x in vectors if x != q), key=lambda x: (-score(vectors[q], vectors[x]), x))[:5]
            assert found == want or q not in copies and [score(vectors[q], vectors[x]) for x in found] == pytest.approx([score(vectors[q], vectors[x]) for x in want], abs=1e-12)
        assert len(got) == len(vectors)


# language -----------------------------------------------------------------------------------------


def ppm_bits(train, text):
    """Straightforward PPM, escape method C, orders 3 to 0, then uniform."""
    counts = {}
    for t in train:
        s = b"\n\n\n" + t
        for i in range(3, len(s)):
            for o in range(4):
                c = counts.setdefault(s[i - o : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    bits, s = 0.0, b"\n\n\n" + text
    for i in range(3, len(s)):
        for o in (3, 2, 1, 0, -1):
            if o < 0:
                bits += 8
                break
            c = counts.get(s[i - o : i])
            if c:
                total, kinds = sum(c.values()), len(c)
                if s[i] in c:
                    bits -= np.log2(c[s[i]] / (total + kinds))
                    break
                bits -= np.log2(kinds / (total + kinds))
    return bits


def test_code_lengths_equal_plain_ppm():
    rng = random.Random(9)
    train = {"en": [prose(rng, 40).encode(), b"the quick brown fox"], "xx": ["größe über straße ñandú".encode() * 3], "yy": [b"q"]}
    lengths = langid.CodeLengths(langid.ContextTrees(train))
    texts = [b"", b"a", "über the quick größe!".encode(), prose(rng, 30).encode(), bytes(range(1, 200))]
    got = lengths.totals(texts)
    for k, t in enumerate(texts):
        for j, lang in enumerate(["en", "xx", "yy"]):
            assert got[k, j] == pytest.approx(ppm_bits(train[lang], t), rel=1e-4, abs=1e-3)


def test_language_prediction(spark, docs):
    rows = [(k, ("the house and the garden " if k % 2 else "das haus und der garten ") * (1 + k % 5), "en" if k % 2 else "de") for k in range(60)]
    train = spark.createDataFrame([*rows, (99, None, "fr"), (98, "x", None)], "doc_id bigint, text string, lang string")
    trees = langid.fit(train)
    got = {r.doc_id: r for r in langid.predict(docs([(1, "the garden"), (2, "der garten und"), (3, None), (4, "123 !!"), (5, ""), (6, "the and " * 300_000)]), trees).collect()}
    assert [got[k].lang_pred for k in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs([]), trees).count() == 0
    assert langid.fit(train.limit(0)) is None
    assert [r.lang_pred for r in langid.predict(docs([(1, "a")]), None).collect()] == ["und"]


def test_languages_without_bytes():
    for train in ({"en": [b""], "de": [b"hallo welt"]}, {"en": [b""], "de": [b""]}, {"en": [b"a"], "de": [b"ab"]}):
        got = langid.CodeLengths(langid.ContextTrees(train)).totals([b"", b"hallo", b"\n\n\n\n", b"ab"])
        for k, t in enumerate([b"", b"hallo", b"\n\n\n\n", b"ab"]):
            for j, lang in enumerate(sorted(train)):
                assert got[k, j] == pytest.approx(ppm_bits(train[lang], t), rel=1e-4, abs=1e-3)


def test_language_sample_is_bounded_in_bytes(spark):
    rows = [(k, "x" * 1000, "en") for k in range(50)] + [(5, "y" * 5000, "de"), (None, "zz", "fr"), (None, "zz", "fr")]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert langid.fit(train, max_bytes=4000).languages == ["en", "fr"]
    assert langid.fit(train).languages == ["de", "en", "fr"]


def test_registered_language_query_learns_from_its_split(spark, tmp_path):
    rng = random.Random(23)
    rows = []
    for k in range(90):
        lang = ("en", "de")[k % 2]
        learnable = zlib.crc32(str(k).encode()) % 3 != 1
        rows.append((k, ("the quick fox " if k % 2 == 0 else "der alte baum ") * rng.randrange(1, 9), lang if learnable else "wrong"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_ppm_language_id(spark, str(tmp_path)).collect()}
    train = {x: [t.encode() for k, t, y in rows if y == x] for x in ("de", "en")}
    for k, t, _ in rows:
        bits = {x: ppm_bits(train[x], t.encode()) for x in train}
        assert got[k].lang_pred == min(bits, key=bits.get) == ("en", "de")[k % 2]
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)


# chat ---------------------------------------------------------------------------------------------


def test_every_turn_parses_back():
    nasty = ["", "\\", "a\\b", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "<|role|>", "\\</s>", "<</s>", "[INST][/INST]\\", "<s>[/INST", "\n", "<|end|>\\\\"]
    for role in ["user", "assistant", "system", "tool", "", "</s>", "a\\<|body|>"]:
        for t in nasty:
            out, lo, hi = chat.render_turn(role, t)
            assert chat.parse(out) == [(role, t)]
    joined = [("user", a) for a in nasty] + [("assistant", a) for a in nasty] + [("odd|", "x")]
    assert chat.parse("".join(chat.render_turn(*t)[0] for t in joined)) == joined
    assert chat.parse("plain") is None and chat.parse("<s>[INST]open") is None
    assert chat.render_turn("user", "clean")[0] == "<s>[INST]clean[/INST]"


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, None, "x\\"), (None, 0, "assistant", "é🙂"), (3, None, "system", "s")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(5000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("rendered", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert len(got) == 5
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.render_turn(r, x)[0]) for _, _, r, x in turns)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_crc_digest_of_ids(spark):
    ids = np.array([5, 70_000], "<u4").tobytes()
    df = spark.createDataFrame([(bytearray(ids),)], "ids binary")
    assert df.select(F.crc32("ids")).first()[0] == zlib.crc32(ids)


def test_captures_of_one_url_take_few_block_reads(spark, monkeypatch):
    """Many captures of one URL, and of null URLs, over many blocks and files; the repeated ids span two blocks."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    n = 4_000
    pages = spark.range(2 * n).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://h/a").alias("url"), F.lit("x").alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(10, "http://h/a", str(i)) for i in range(40)] + [(None, None, "none"), (-3, None, "less")], "page_id bigint, url string, html string"))
    folder = warc.new_folder(spark)
    payloads = warc.pages_as_payloads(pages)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        archives = warc.write_archives(payloads, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = archives.orderBy("first_key", "first_page", "archive").select("first_key", "first_page", "archive", "index", "directory_at", "directory_length").collect()
    assert len(files) > 1
    reads = []
    for key, ids in (("h)/a", [0, 2, n, 2 * n - 2]), ("", [1, n + 1, 2 * n - 1, None, -3]), ("h)/a", [10]), ("", [0]), ("h)/a", [-1, 3])):
        for page_id in ids:
            index = warc.CaptureIndex(folder, [tuple(r) for r in files])
            plain = index._range
            index._range = lambda *a, p=plain: reads.append(a) or p(*a)
            reads.clear()
            got = [e[0] for _, e in index.seek(key, page_id)]
            assert got == [page_id] * (41 if page_id == 10 else 0 if (key, page_id) in (("", 0), ("h)/a", -1), ("h)/a", 3)) else 1)
            assert len(reads) <= (8 if page_id == 10 else 5)  # directories and blocks
    index = warc.CaptureIndex(folder, [tuple(r) for r in files])
    assert [e[0] for _, e in index.lookup("")] == [None, -3, *range(1, 2 * n, 2)]
    requests = payloads.select("page_id", warc.reversed_host_key(F.col("url")).alias("key"))
    assert warc.read_captures(requests, folder, archives).count() == pages.count()


def test_neighbours_of_vectors_whose_squares_leave_the_range(spark):
    rng = np.random.default_rng(4)
    plain = rng.normal(size=(40, 3))
    scale = np.array([0, 0, -660, 660, -1060, 1020] * 7)[:40]
    rows = [(i, [float(x) for x in np.ldexp(v, s)]) for i, (v, s) in enumerate(zip(plain, scale))]
    rows += [(50, [1e-200, 0.0, 0.0]), (51, [1e200, 1e200, 0.0]), (52, [5e-324, 0.0, 0.0]), (53, [1.7e308, -1.7e308, 1.7e308]), (54, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in vptree.nearest(df, lambda i: i >= 0, shard_bytes=20 * 24).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))

    def unit(v):
        v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
        return v / np.sqrt((v * v).sum())

    units = {i: unit(np.array(v)) for i, v in rows if any(v)}
    assert set(got) == set(units)
    for q, near in got.items():
        want = sorted(((-float(units[q] @ u), i) for i, u in units.items() if i != q))[:5]
        assert np.allclose([s for _, s in near], [-s for s, _ in want])


def test_numbered_lines_are_candidates_only_where_they_are_near(spark):
    """Lines that differ in a number alone: about as many candidates as links, and all links."""
    n = 1200
    lines = [f"page number {i * 7919 % 100000:05d} of the archive of old letters" for i in range(n)]
    lines += [f"{'1234567890' * 2}{i:03d} has more digits than are compared" for i in range(40)]
    single = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line", F.char_length("line").alias("n"))
    names = {r.h: r.line for r in single.select("h", "line").collect()}
    pairs = {frozenset((names[r.ha], names[r.hb])) for r in line_dedup.candidate_pairs(single, 2).collect()}
    apart = lambda a, b: sum(x != y for x, y in zip(a, b))  # noqa: E731  (five digits each: no two within two edits but by substitution, or by shifting)
    near = {frozenset((a, b)) for i, a in enumerate(lines[:n]) for b in lines[:i] if apart(a, b) <= 2}
    assert near <= pairs and len([p for p in pairs if all(x.startswith("page") for x in p)]) < 2 * len(near)
    assert {frozenset((a, b)) for a in lines[n:] for b in lines[n:] if a < b and apart(a, b) <= 2} <= pairs


def test_quality_fit_holds_its_matrix_once(spark):
    """Beyond the matrix the driver takes blocks, not copies of it in double precision."""
    import tracemalloc

    n = 3000
    docs = spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "if(id % 2 = 0, concat('x#', id, ' zz zz'), concat('A good line of text, number ', id, '.')) as text")
    tracemalloc.start()
    try:
        assert "weights" in quality.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * n * quality.N_FEATURES * 4
