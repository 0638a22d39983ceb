"""Filter replay, URL rules and delta Lloyd against plain versions, and their defined cases."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

LABELS = "doc_id bigint, quality int, toxic int"


# filter interaction audit ------------------------------------------------------------------------------


def plain_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        w = words(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            whole = list(left)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                stay = [r for r in left if not r[1][f]]
                failing = [r for r in whole if r[1][f]]
                out[part, order, step] = [
                    len(stay), len(gone), len(failing) - len(gone), sum(1 for r in failing if sum(r[1].values()) == 1),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_replay_equals_a_plain_replay(spark):
    from settlepoint.llm import filter_audit

    rng = random.Random(5)
    long = lambda n, k: " ".join(rng.choice(["a", "bc", "Déf", "GHI"]) + str(rng.randrange(k)) for _ in range(n))
    texts = [None, "", "one | two", "ABC", "\u00a0x\u2003y" * 90, "wörd\x0bnext\x0cthird"] + [long(rng.choice([10, 199, 200, 201, 400]), rng.choice([3, 60, 5000])) for _ in range(20)]
    texts += [t + "#" for t in texts[8:12]]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(90)]
    docs += [docs[0]] * 2
    labels = [(rng.randrange(60), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    for name in ("part", "mask", "gone", "digest", "A", "good", "step"):
        df = df.withColumn(name, F.lit("clash"))
    got = audited(filter_audit.audit(df, spark.createDataFrame(labels, LABELS)))
    assert got == plain_audit(docs, labels)


def test_replay_of_nothing_and_of_other_filters(spark):
    from settlepoint.llm import filter_audit

    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert filter_audit.audit(docs, spark.createDataFrame([], LABELS)).count() == 0
    flags = spark.createDataFrame([("p", True, False, True, None), ("p", False, False, False, True)], "part string, good boolean, toxic boolean, X boolean, Y boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed) for r in filter_audit.replay(flags, "XY").collect()}
    assert got == {("XY", 1): (1, 1), ("XY", 2): (0, 1), ("YX", 1): (1, 1), ("YX", 2): (0, 1)}
    with pytest.raises(ValueError):
        filter_audit.orders(spark, "AA")


def test_replay_combines_before_it_shuffles(spark):
    from settlepoint.llm import filter_audit

    flags = spark.range(2000).select((F.col("id") % 3).cast("string").alias("part"), F.lit(True).alias("good"), F.lit(False).alias("toxic"), *[(F.col("id") % (i + 2) == 0).alias(f) for i, f in enumerate("ABCDE")])
    plan = filter_audit.replay(flags)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(part[^\n]*\n[^\n]*HashAggregate\([^\n]*partial_count", plan) and "Python" not in plan


# URL filters -------------------------------------------------------------------------------------------


def test_policies_and_parts_of_urls(spark):
    from settlepoint.llm import queries, url_rules

    cases = {
        "http://WWW.Example.com/en/1?x=1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://net/es/1": ("net", "/es/1", "net/es/", "block"),
        "x://com": ("com", "", None, None),
        "x://com#/": ("com", "", None, None),
        "x://b.com?q://z/": ("b.com", "", None, None),
        "a://b://c/": ("b:", "//c/", None, None),
        "no scheme": ("", "", None, None),
        "x://É.NET/fr/a#b?c": ("É.net", "/fr/a", "net/fr/", "block"),
        "://net/de": ("net", "/de", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    got = df.select("url", host.alias("h"), path.alias("p"), url_rules.policy_of(host, path, queries.POLICIES).alias("r")).collect()
    assert {r.url: (r.h, r.p, r.r and r.r.rule, r.r and r.r.verdict) for r in got} == cases


def plain_tokens(url):
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query = re.match(r"[^?#]*\?([^#]*)", rest)
    low = host.translate({c: c + 32 for c in range(65, 91)})
    digits = lambda w: re.sub("[0-9]+", "0", w)
    out = {"h:" + digits(w) for w in low.split(".") if w} | {"p:" + digits(w) for w in path.split("/") if w}
    return out | {"q:" + digits(w.split("=")[0]) for w in (query[1].split("&") if query else []) if digits(w.split("=")[0])}


def plain_rules(labelled, min_support, min_confidence, vocabulary, max_items):
    seen = sorted(set(labelled))
    n, sets = len(seen), [(plain_tokens(u), y) for u, y in seen]
    gap = {}
    for t in set().union(*(s for s, _ in sets)):
        held = [y for s, y in sets if t in s]
        if len(held) >= math.ceil(min_support * n):
            gap[t] = max(abs(held.count(y) * n - len(held) * sum(z == y for _, z in sets)) for y in {y for _, y in sets})
    words = [t for t in sorted(gap, key=lambda t: (-gap[t], t)) if gap[t] > 0][:vocabulary]
    items = lambda s: [t for t in words if t in s][:max_items]
    counts = {}
    for s, y in sets:
        for k in range(1, max_items + 1):
            for c in itertools.combinations(sorted(items(s)), k):
                counts.setdefault(c, {}).setdefault(y, 0)
                counts[c][y] += 1
    rules = []
    for c, by in counts.items():
        for y, k in by.items():
            if k >= math.ceil(min_support * n) and k / sum(by.values()) >= min_confidence:
                rules.append((-k / sum(by.values()), -k / n, len(c), c, y))
    return items, sorted(rules)


@pytest.fixture(scope="module")
def labelled_urls():
    rng = random.Random(3)
    host = lambda: rng.choice(["", "www.", "m."]) + rng.choice(["shop", "casino-win", "news", "blog7"]) + "." + rng.choice(["com", "net", "org"])
    tail = lambda: rng.choice(["en", "fr", "es"]) + "/" + rng.choice(["buy", "read", str(rng.randrange(99))]) + rng.choice(["", "?page=2&ref=x", "#top", "?utm=1"])
    urls = [f"http://{host()}/{tail()}" for _ in range(400)]
    bad = lambda u: "casino" in u or ("net" in u and "/es/" in u) or rng.random() < 0.03
    return [(u, "block" if bad(u) else "allow") for u in urls] + [("http://shop.com/en/hot", "allow")] * 300


def test_mined_rules_equal_brute_force(spark, labelled_urls):
    from settlepoint.llm import url_rules

    params = {"min_support": 0.02, "min_confidence": 0.8, "vocabulary": 12, "max_items": 5}
    model = url_rules.mine(spark.createDataFrame(labelled_urls, "url string, label string"), **params)
    items, rules = plain_rules(labelled_urls, **params)
    mined = {(tuple(r.tokens), r.label): (r.confidence, r.support) for r in model.rules.collect()}
    every = {(c, y): (-conf, -sup) for conf, sup, _, c, y in rules}
    assert mined and mined.items() <= every.items() and len(mined) < len(every)
    other = [("http://www.casino-win.org/de/1",), ("x://news.net/es/7",), ("x://q.net/",), (None,), ("plain",), ("http://m.shop.com/en/buy?page=3&ref=1",)]
    rows = [(u,) for u, _ in labelled_urls] + other
    frame = spark.createDataFrame(rows, "url string").withColumn("items", F.lit("clash")).withColumn("token", F.lit(1)).withColumn("best", F.lit(2))
    got = url_rules.predict(frame, model).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = items(plain_tokens(r.url)) if r.url and "://" in r.url else []
        hit = next((x for x in rules if set(x[3]) <= set(mine)), None)
        assert (r.mined_verdict, r.mined_rule, r.mined_confidence) == ((hit[4], " ".join(hit[3]), -hit[0]) if hit else ("allow", None, None))


def test_each_rule_is_filed_once(spark, labelled_urls):
    from settlepoint.llm import url_rules

    model = url_rules.mine(spark.createDataFrame(labelled_urls, "url string, label string"), min_support=0.02, min_confidence=0.8)
    index = url_rules.inverted_index(model).collect()
    assert len(index) == model.rules.count() and all(r.token in r.rule_tokens for r in index)


def test_urls_without_labels_or_with_one_label(spark):
    from settlepoint.llm import queries, url_rules

    def judged(urls):
        df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("rule", F.lit("clash"))
        return {r["page_id"]: r["verdict"] for r in url_rules.judge(df, queries.POLICIES).drop("rule").collect()}

    assert judged([]) == {}
    assert judged([None, "x", "http://a.org/en/1"]) == {0: "allow", 1: "allow", 2: "allow"}
    assert judged(["http://a.com/x", "http://a.org/x", "http://a.com/x"]) == {0: "allow", 1: "allow", 2: "allow"}
    with pytest.raises(ValueError):
        url_rules.mine(spark.range(70).select(F.lit("http://a/b").alias("url"), F.col("id").cast("string").alias("label")))


def test_url_filter_is_native(spark, tmp_path):
    from settlepoint.llm import queries

    df = spark.createDataFrame([(i, f"http://www.{'ab'[i % 2]}.{['com', 'net', 'org'][i % 3]}/{['en', 'es'][i % 5 % 2]}/{i}") for i in range(200)], "page_id bigint, url string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    out = queries.op12_association_rule_urls(spark, str(tmp_path))
    assert out.count() == 200
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", out._jdf.queryExecution().toString())


# centroid clustering -----------------------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, dims, scale=1024, seed=3):
    from fractions import Fraction

    ok = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in ok if i is not None)[:k]
    centroids = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        owned = {}
        for _, v in ok:
            owned.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(owned[j]) for x in zip(*owned[j])] if j in owned else c for j, c in enumerate(centroids)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in ok]
    per = {j: sum(d for _, c, d in out if c == j) for _, j, _ in out}
    total = sum(per.values())
    long = lambda x: x if x < 1 << 63 else None
    sure = all(d < 1 << 63 for _, _, d in out)
    of = {j: all(d < 1 << 63 for _, c, d in out if c == j) for j in per}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, j, long(d), long(per[j]) if of[j] else None, long(total) if sure else None, digest(centroids[j])) for i, j, d in out]
    return sorted(rows, key=str)


def clustered(spark, rows, kind="double", **params):
    from settlepoint.llm import delta_lloyd

    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    for name in ("row", "cluster", "distance", "is_sum"):
        df = df.withColumn(name, F.lit("clash"))
    return sorted(map(tuple, delta_lloyd.cluster(df.repartition(3), **params).collect()), key=str)


@pytest.mark.parametrize("rounds", [0, 1, 2, 7])
def test_lloyd_equals_a_plain_lloyd(spark, rounds):
    rng = random.Random(rounds)
    rows = [(i, [rng.gauss(3 * (i % 4), 1.5), rng.gauss(0, 1), rng.choice([-0.5, 0.0, 0.25])]) for i in range(150)]
    rows += [(None, [1.0, 2.0, 0.0]), (7, rows[7][1]), (8, [0.0, 0.0, 0.0]), (200, None), (201, [1.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0])]
    assert clustered(spark, rows, k=5, rounds=rounds, dims=3) == plain_lloyd(rows, 5, rounds, 3)


def test_lloyd_with_wide_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 1, 3, 6, 15, 300, 305]) for _ in range(2)]) for i in range(40)]
    assert clustered(spark, rows, k=6, rounds=4, dims=2) == plain_lloyd(rows, 6, 4, 2)


def test_lloyd_of_few_none_and_equal_vectors(spark):
    assert clustered(spark, [], k=3, dims=2) == []
    assert clustered(spark, [(1, [1.0]), (2, None)], k=3, dims=2) == []
    two = [(1, [1.5, 0.0]), (2, [0.0, -3.25])]
    assert clustered(spark, two, "float", k=8, rounds=3, dims=2) == plain_lloyd(two, 8, 3, 2)
    same = [(i, [0.5, -0.1]) for i in range(30)]
    assert clustered(spark, same, k=4, rounds=3, dims=2) == plain_lloyd(same, 4, 3, 2)


def test_rounds_compare_only_what_can_change(spark):
    import numpy as np
    import pandas as pd

    from settlepoint.llm import delta_lloyd

    compared = []
    plain = delta_lloyd.nearest_of
    delta_lloyd.nearest_of = lambda v, c: compared.append((len(v), sorted(c))) or plain(v, c)
    try:
        task = delta_lloyd.assign([[0, 0], [100, 0], [0, 100]], {2}, 1)
        batch = pd.DataFrame({"row": range(4), "vec_id": range(4), "embedding": [np.array(v) for v in ([1.0, 1.0], [99.0, 0.0], [0.0, 60.0], [0.0, 90.0])], "cluster": [0, 1, 0, 2], "distance": [2, 1, 3600, 400]})
        out = pd.concat(task(iter([batch])))
    finally:
        delta_lloyd.nearest_of = plain
    assert compared == [(1, [0, 1, 2]), (3, [2])]
    owned, moved = out[~out["is_sum"].astype(bool)], out[out["is_sum"].astype(bool)]
    assert owned["cluster"].tolist() == [0, 1, 2, 2]
    assert sorted((r.cluster, list(r.sums), r.n) for r in moved.itertuples()) == [(0, [0, -60], -1), (2, [0, 60], 1)]


def test_limbs_of_sums():
    from settlepoint.llm.delta_lloyd import LIMB, to_limbs

    values = [0, -5, 1 << 200, -(1 << 41) - 3, 7]
    assert [sum(row[i] << (LIMB * k) for k, row in enumerate(to_limbs(values))) for i in range(5)] == values
