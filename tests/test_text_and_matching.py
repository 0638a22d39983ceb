import json
import random

import pytest
from pyspark.sql import functions as F

from settlepoint.functions import location, text
from settlepoint.operators import judging, loop, matching


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def place(unit, start=None, end=None):
    return F.struct(F.lit(unit).alias("unit"), F.lit(start).cast("int").alias("start"), F.lit(end).cast("int").alias("end"))


def nowhere():
    return F.lit(None).cast("struct<unit:string,start:int,end:int>")


def test_normalize(spark):
    t = F.lit("Off-by-one: n <= LEN, the end!")
    row = one(spark, text.normalize(t), text.normalize(t, True), text.content_tokens(t))
    assert row[0] == "off by one n len the end" and row[1] == "off - by - one n <= len the end" and row[2] == ["off", "one", "n", "len", "end"]


def test_similarities(spark):
    a, b = F.lit("null pointer in parser loop"), F.lit("parser loop")
    row = one(spark, text.text_similarity(a, b), text.symmetric_similarity(a, b), text.text_similarity(F.lit(""), b))
    assert row[0] == pytest.approx(0.85) and row[1] < 0.6 and row[2] == 0.0


def test_identities(spark):
    import hashlib

    row = one(spark, text.fingerprint(F.lit("A b!"), F.lit(" Main ")), text.fingerprint(F.lit("A b"), F.lit(None), F.lit("S")), text.pair_key(F.lit("b"), F.lit("a")))
    assert row[0] == hashlib.sha1("a b␟main".encode()).hexdigest()[:16]
    assert row[1] == hashlib.sha1("s␟a b␟".encode()).hexdigest()[:16] and row[2] == "a:b"


def test_location(spark):
    c = location.compatibility
    row = one(spark, c(place("u", 1, 5), place("u", 5, 9)), c(place("u", 1, 2), place("u", 3, 4)), c(place("u"), place("v")), c(nowhere(), place("u")), c(place("u"), place("u", 3, 4)))
    assert tuple(row) == ("same", "disjoint", "disjoint", "unknown", "same")


def test_gray_zones(spark):
    zone = F.array(F.struct(place("u", 10, 12).alias("location"), F.lit("style of names").alias("note")))
    sims = lambda x: F.array(F.lit(x))
    row = one(
        spark,
        location.in_gray_zone(place("u", 11, 11), zone), location.in_gray_zone(place("u", 1, 2), zone), location.in_gray_zone(place("u", 3), zone), location.in_gray_zone(nowhere(), zone),
        location.gray_by_note(place("u", 11), zone, sims(0.5)), location.gray_by_note(place("u", 3), zone, sims(0.5)), location.gray_by_note(nowhere(), zone, sims(0.5)), location.gray_by_note(place("u", 11), zone, sims(0.1)),
    )
    assert tuple(row) == (True, False, True, False, True, False, True, False)


def test_verdicts(spark):
    cases = {"- **DIFFERENT**\nsame": False, "The answer is SAME.": True, "same": True, "SAME or DIFFERENT": True, "it is SAME not DIFFERENT": None, "": None, "unsure": None}
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    assert {r.r: r.v for r in df.select("r", text.parse_verdict(F.col("r")).alias("v")).collect()} == cases


def test_findings_json(spark):
    body = json.dumps([{"claim": " a ", "unit": "m", "start": "3", "severity": "Major"}, {"claim": ""}, {"claim": "b", "unit": "", "start": "x", "severity": "odd", "evidence": "e"}])
    for reply in (body, f"```json\n{body}\n```", f"Here: {body} done"):
        got = one(spark, text.parse_findings(F.lit(reply), F.lit(2)))[0]
        assert [(f.id, f.claim, f.severity, f.evidence) for f in got] == [("r2-f0", "a", "major", None), ("r2-f2", "b", "minor", "e")]
        assert (got[0].location.unit, got[0].location.start, got[0].location.end) == ("m", 3, None) and got[1].location is None
    for reply in ("[]", "no json", "[1, 2", ""):
        assert one(spark, text.parse_findings(F.lit(reply), F.lit(0)))[0] == []


def test_sections_and_retirements(spark):
    review = "intro\n## NEW ISSUES\nx\n**RETIRE**\n1: already fixed upstream\n2:\n3. no\n9: not in the ledger"
    s = one(spark, text.split_sections(F.lit(review)))[0]
    assert s.new == "x" and s.retire.startswith("1: already")
    assert one(spark, text.parse_retirements(F.lit(s.retire), F.lit(4)))[0] == [0]
    assert one(spark, text.parse_retirements(F.lit(s.retire), F.lit(4), 0))[0] == [0, 1, 2]
    plain = one(spark, text.split_sections(F.lit("just text")))[0]
    assert (plain.retire, plain.new) == ("", "just text")


def test_families(spark):
    row = one(spark, *[text.model_family(F.lit(m)) for m in ("claude-x", "gpt-5", "o3", "DeepSeek-v4", "gemma", "llama")], text.spec_family(F.lit("deepseek:unknown-x")), text.spec_family(F.lit("anthropic")), text.rotated_judge(F.lit("deepseek-r")))
    assert tuple(row) == ("anthropic", "openai", "openai", "deepseek", "google", "unknown", "deepseek", "anthropic", "anthropic")
    models = spark.createDataFrame([("claude-1",), ("gpt-1",)], "model_id string")
    assert judging.clashes("anthropic:claude-9", models).count() == 1 and judging.clashes("who:knows", models).count() == 0


def test_diff_and_listing(spark):
    diff = "--- a\n+++ b\n@@ -1,2 +10,3 @@\n ctx\n-old\n+new\n\\ No newline\n@@ -9 +40 @@\n+far\n"
    got = one(spark, text.diff_postimage(F.lit(diff)))[0]
    assert [(r.no, r.line) for r in got] == [(10, "ctx"), (11, "new"), (40, "far")]
    assert one(spark, text.numbered_listing(F.lit("a\nb")))[0] == "   1 | a\n   2 | b"
    assert one(spark, text.new_file_diff(F.lit("f"), F.lit("a\nb")))[0].endswith("@@ -0,0 +1,2 @@\n+a\n+b")


def decided(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text_a string, text_b string, loc string")
    out = matching.decide(matching.with_similarity(df, full=True), **kw)
    return [(r.same, r.method) for r in out.collect()]


def test_staged_decisions(spark):
    rows = [("alpha beta gamma delta", "alpha beta gamma delta", "same"), ("alpha beta", "omega psi", "disjoint"), ("one two three four", "one two", "unknown"), ("a1 b1 c1 d1", "a1 b1 x1 y1", "same")]
    assert decided(spark, rows) == [(True, "lexical-high"), (False, "anchor-disjoint"), (True, "judge"), (False, "judge")] or decided(spark, rows)[3][1] == "judge"
    assert [m for _, m in decided(spark, rows, judge=False)] == ["lexical-high", "anchor-disjoint", "lexical-fallback" if decided(spark, rows)[2][1] == "judge" else "lexical-high", "lexical-fallback"]


def test_cache_comes_first_and_keeps_the_first_verdict(spark):
    df = spark.createDataFrame([("k1", "alpha beta", "alpha beta", "same", 1), ("k2", "x1", "y1", "same", 2), ("k2", "y1", "y1", "same", 3)], "pair_key string, text_a string, text_b string, loc string, i int")
    pairs = matching.with_similarity(df)
    cache = spark.createDataFrame([("k1", False)], "pair_key string, same boolean")
    out = {(r.pair_key, r.i): (r.same, r.method) for r in matching.decide(pairs, cache=cache).collect()}
    assert out["k1", 1] == (False, "cache") and out["k2", 3][1] == "lexical-high"
    new = matching.new_verdicts(matching.decide(pairs, cache=cache), cache, ["i"]).collect()
    assert [(r.pair_key, r.same) for r in new] == [("k2", False)]


def test_matching_is_maximum():
    assert matching.maximum_matching({0: [0, 1], 1: [0]}, [0, 1]) == {0: 1, 1: 0}
    rng = random.Random(5)

    def largest(pref):  # brute force over assignments
        lefts = sorted(pref)

        def go(k, used):
            if k == len(lefts):
                return 0
            return max([go(k + 1, used)] + [1 + go(k + 1, used | {r}) for r in pref[lefts[k]] if r not in used])

        return go(0, frozenset())

    for _ in range(200):
        pref = {i: rng.sample(range(4), rng.randrange(0, 4)) for i in range(rng.randrange(1, 5))}
        got = matching.maximum_matching(pref, sorted(pref))
        assert len(set(got.values())) == len(got) == largest(pref)
        assert all(r in pref[i] for r, i in got.items())


def test_dispositions(spark):
    edges = spark.createDataFrame([(1, 0, 0, 0.9), (1, 1, 0, 0.8)], "run int, finding int, defect int, score double")
    found = spark.createDataFrame([(1, 0, False), (1, 1, False), (1, 2, True), (1, 3, False)], "run int, finding int, gray boolean")
    got = {r.finding: r.disposition for r in matching.dispositions(found, edges, ["run"]).collect()}
    assert got == {0: "tp", 1: "dup", 2: "gray", 3: "false"}
    defects = spark.createDataFrame([(1, 0), (1, 1)], "run int, defect int")
    assert [r.defect for r in matching.missed(defects, matching.dispositions(found, edges, ["run"]), ["run"]).collect()] == [1]
    both = {r.finding: r.defect for r in matching.dispositions(found, edges, ["run"], bijective=False).collect()}
    assert both[0] == both[1] == 0


def test_canonical_runs_and_clusters(spark):
    assert matching.greedy_clusters([1, 5, 2, 6, 9], lambda a, b: abs(a - b) <= 1) == [0, 1, 0, 1, 4]
    rows = [("r", 0, 0, "d1", "tp", "x"), ("r", 0, 1, None, "false", "loop never ends here"), ("r", 0, 2, None, "false", "loop never ends here"), ("r", 0, 3, None, "gray", "g"), ("r", 2, 0, None, "false", "the loop never ends here"), ("r", 2, 1, None, "false", "quite another thing")]
    df = spark.createDataFrame(rows, "run_id string, round int, finding int, defect_id string, disposition string, claim string").withColumn("location", nowhere())
    assert matching.canonical_runs(df).first().rounds == [["def:d1", "false:0"], [], ["false:0", "false:1"]]


def test_ledger(spark):
    claims = lambda *c: [(x, None) for x in c]
    rows = [("r", 0, [], claims("alpha beta gamma", "delta epsilon zeta")), ("r", 1, [0], claims("delta epsilon zeta", "brand new words"))]
    df = spark.createDataFrame(rows, "run_id string, round int, retired array<int>, claims array<struct<claim:string,location:struct<unit:string,start:int,end:int>>>")
    got = matching.ledger_rounds(df).orderBy("round").collect()
    assert got[0].ledger == ["alpha beta gamma", "delta epsilon zeta"] and got[1].ledger == ["delta epsilon zeta", "brand new words"] and (got[1].retired, got[1].added) == (1, 1)


def test_prejudge_is_resumable(spark):
    band = spark.createDataFrame([(f"k{i % 3}", "alpha beta", "alpha beta" if i % 3 else "x y", None, None) for i in range(9)], "pair_key string, text_a string, text_b string, location_a struct<unit:string>, location_b struct<unit:string>")
    cache = spark.createDataFrame([("k1", True)], "pair_key string, same boolean")
    new = judging.prejudge(band, cache, judging.rule_judge, votes=3)
    assert sorted((r.pair_key, r.same) for r in new.collect()) == [("k0", False), ("k2", True)]
    assert judging.prejudge(band, cache.union(new), judging.rule_judge).count() == 0
    assert judging.prejudge(band, cache, judging.rule_judge, max_new=1).count() == 1

    def down(*_):
        raise judging.JudgeUnavailable("down", 0.0)

    assert judging.prejudge(band, cache, down).count() == 0


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise judging.JudgeUnavailable("busy", 7.0 if len(calls) == 1 else None)
        return "ok"

    assert judging.with_retries(call, 3, sleep=waits.append) == "ok" and waits == [7.0, 1.0]


def test_loop(spark):
    items = spark.createDataFrame([("a", "line one\nline two")], "id string, artifact string")

    def client(prompt):
        n = prompt.count("seen before")
        new = json.dumps([{"claim": f"seen before {['one', 'two', 'three', 'four'][n]} entirely different {n * 'q'}"}])
        return new if "Ledger" not in prompt else f"RETIRE\n1: it was wrong indeed\nNEW\n{new}"

    got = loop.run_loop(items, client, loop.LoopConfig("l", rounds=3, memory=True, ledger=True)).orderBy("round").collect()
    assert [len(r.findings) for r in got] == [1, 1, 1] and got[2].findings[0].id == "r2-f0"
    panel = loop.run_loop(items, lambda p: '[{"claim": "c"}]', loop.LoopConfig("p", rounds=2, panel_size=3)).collect()
    assert all(len(r.findings) == 3 for r in panel)
    for bad in ({"rounds": 9}, {"panel_size": 0}, {"ledger": True}):
        with pytest.raises(ValueError):
            loop.LoopConfig("x", **bad)


def test_assign_takes_groups_and_ignores_incomplete_edges(spark):
    rows = [("a", 1, 1, 0.9), ("a", 1, 2, 0.8), ("a", 2, 1, 0.7), ("b", 1, None, 0.9), ("b", None, 3, 0.9), ("b", 4, 3, None), ("b", 4, 3, None), (None, 5, 6, 0.5)]
    edges = spark.createDataFrame(rows, "run string, finding int, defect int, score double")
    got = {tuple(r) for r in matching.assign(edges, ["run"]).collect()}
    assert got == {("a", 1, 2), ("a", 2, 1), ("b", 4, 3), (None, 5, 6)}
    assert matching.assign(edges.where("false"), ["run"]).collect() == []


def test_claim_queries_use_the_word_ratio(spark, tmp_path):
    from difflib import SequenceMatcher

    from settlepoint.plans import identity

    said = ["the loop and the index run over it", "it and the loop run over an array", "the index of it is over the loop and it", "a cache leaks", "the loop and the index run over an it", "it leaks and the cache is over it"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(said)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def similarity(a, b):
        x, y = ({w for w in t.split() if w not in text.STOP_WORDS} for t in (a, b))
        both = len(x & y)
        sets = max(both / len(x | y), 0.85 * both / min(len(x), len(y))) if x and y else 0.0
        return max(sets, SequenceMatcher(None, a.split(), b.split()).ratio()), sets

    plain = {(i, j): similarity(said[i], said[j]) for i in (1, 3, 5) for j in (0, 2, 4)}
    assert any(whole > sets for whole, sets in plain.values())
    run = lambda name: identity.QUERIES[name](spark, str(tmp_path)).collect()
    whole, sets = ({(r.turn_a, r.turn_b): r.sim for r in run(name)} for name in ("claim_pairs", "claim_pairs_by_sets"))
    assert whole == {k: round(v[0], 9) for k, v in plain.items()}
    assert sets == {k: round(v[1], 9) for k, v in plain.items()}
    nearest = {r.finding: r.nearest for r in run("nearest_defect")}
    assert nearest == {i: max((0, 2, 4), key=lambda j: (plain[i, j][0], -j)) for i in (1, 3, 5)}


def test_decided_edges_of_sentences_and_passages(spark, tmp_path):
    """Sentences of documents against passages and their sentences, by the plain staged decision."""
    from difflib import SequenceMatcher

    from settlepoint.plans import identity

    texts = [(1, "en", "the loop and the index run over it. a cache leaks\nit and the loop run over an array"), (2, None, "a cache leaks badly. nothing here"), (3, "de", "a cache leaks. the index of it is over the loop and it"), (4, "en", None), (5, "en", "a cache leaks. a cache leaks. leaks cache a")]
    items = [(7, "a cache leaks. the loop and an index run over it"), (8, "it and the loop run over an array\nthe index of it is over the loop"), (9, "unrelated words")]
    spark.createDataFrame(texts, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sentences = lambda t: t.replace("\n", ". ").split(". ")
    edges = {}
    for doc, lang, body in texts:
        for i, claim in enumerate(sentences(body) if body else []):
            for item, passage in items:
                for wording in [passage, *sentences(passage)]:
                    x, y = ({w for w in t.replace(".", " ").split() if w not in text.STOP_WORDS} for t in (claim, wording))
                    jac = len(x & y) / len(x | y) if x and y else 0.0
                    over = 0.85 * len(x & y) / min(len(x), len(y)) if x and y else 0.0
                    ratio = SequenceMatcher(None, claim.split(), wording.replace(".", " ").split()).ratio()
                    if jac >= 0.34 or (lang in ("en", None) and ratio >= 0.6):
                        edges[doc, i, item] = max(jac, over, ratio, edges.get((doc, i, item), 0.0))
    run = lambda name: identity.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(edges) > 6 and {(r.doc_id, r.finding, r.defect): r.score for r in run("decided_edges")} == pytest.approx({k: round(v, 9) for k, v in edges.items()})
    best = {(r.doc_id, r.finding): r.defect for r in run("many_to_one_matches")}
    assert best == {(d, i): max((k[2] for k in edges if k[:2] == (d, i)), key=lambda j: (edges[d, i, j], j)) for d, i, _ in edges}
    kinds = {(r.doc_id, r.finding): (r.defect, r.disposition) for r in run("ground_truth_dispositions")}
    assert len(kinds) == sum(len(sentences(t)) for _, _, t in texts if t)
    taken = [(d, v[0]) for (d, _), v in kinds.items() if v[1] == "tp"]
    assert len(taken) == len(set(taken)) and all((d, i, v[0]) in edges for (d, i), v in kinds.items() if v[1] == "tp")
    assert all((v[1] in ("tp", "dup")) == any(k[:2] == at for k in edges) for at, v in kinds.items())
    assert {r.defect for r in run("missed_defects")} == {7, 8, 9} - {j for _, j in taken}
    assert {r.run_id for r in run("canonical_trajectories")} == {1, 2, 3, 5}


def test_loop_ledger_compares_places_and_the_whole_similarity(spark):
    items = spark.createDataFrame([("a", "line one\nline two")], "id string, artifact string")
    at = lambda claim, unit=None, start=None, end=None: {"claim": claim, "unit": unit, "start": start, "end": end}
    first = [at("unused import", "a.py", 1, 1), at("buffer read after release inside parser", "c.py", 3, 4)]
    new = [
        at("unused import", "b.py", 1, 1),  # another unit
        at("unused import", "a.py", 9, 9),  # other lines
        at("unused import", "a.py", 1, 2),  # the same place: stated
        at("buffer release parser", "c.py", 4, 5),  # contained wording: 0.85 similar by overlap
        at("unused import"),  # not located: compatible with any place
        at("socket left open"),
        at("socket left open", "d.py", 1, 1),  # stated by an earlier new claim
    ]

    def client(prompt):
        return f"RETIRE\nNEW\n{json.dumps(new)}" if "Ledger" in prompt else json.dumps(first)

    got = loop.run_loop(items, client, loop.LoopConfig("l", rounds=2, memory=True, ledger=True)).where("round = 1").first().findings
    shown = [(f.claim, f.location and (f.location.unit, f.location.start)) for f in got]
    assert shown == [
        ("unused import", ("a.py", 1)), ("buffer read after release inside parser", ("c.py", 3)), ("unused import", ("b.py", 1)), ("unused import", ("a.py", 9)), ("socket left open", None),
    ]
    assert [f.id for f in got] == [f"r1-f{i}" for i in range(5)]


def test_delays_that_servers_suggest(spark):
    cases = [("3", None, 3.0), (" 1.5 ", "{}", 1.5), ("Wed, 21 Oct", '{"retryDelay": "38s"}', 38.0), (None, '{"retryDelay" :"0.5s"}', 0.5), (None, None, None), ("", "{}", None)]
    df = spark.createDataFrame(cases, "h string, b string, want double")
    for r in df.withColumn("got", text.suggested_delay(F.col("h"), F.col("b"))).collect():
        assert r.got == r.want == judging.suggested_delay({"Retry-After": r.h} if r.h else {}, r.b)
    with pytest.raises(judging.JudgeUnavailable) as e:
        judging.check_response(429, {"Retry-After": "7"})
    assert e.value.delay == 7.0 and judging.check_response(200) is None
    with pytest.raises(RuntimeError, match="401"):
        judging.check_response(401)


def test_review_view_and_prompts(spark):
    diff = "diff --git a/x b/old.py\n--- a/x\n+++ b/src/new.py\n@@ -1,1 +7,2 @@\n a\n-b\n+c"
    view = one(spark, text.review_view(F.lit("code"), F.lit(diff)))[0]
    assert view == "File under review: old.py\n(line numbers are shown at the left; cite them in your findings)\n\n   7 | a\n   8 | c"
    assert one(spark, text.review_view(F.lit("paper"), F.lit("p")))[0] == "p"
    assert one(spark, text.diff_file_name(F.lit("no diff")))[0] == "file"
    assert one(spark, text.prompt_location_text(*[F.lit(None).cast(t) for t in ("string", "int", "int")]))[0] == "unlocalized"
    assert one(spark, text.sheet_location_text(F.lit("u"), F.lit(3), F.lit(3)))[0] == "u:3-3"


def test_self_agreement_and_counts(spark):
    v = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", None)], "pair_key string, same boolean")
    assert tuple(judging.self_agreement(v).first()) == (2, 1, 0.5)
    j = spark.createDataFrame([(2, 3), (0, 1), (0, 0)], "yes int, cast int")
    assert tuple(judging.judge_counts(j, 3).first()) == (3, 9, 5, 2)


def random_claims(draw, n):
    words = ["the", "loop", "index", "cache", "of", "leaks", "never", "ends", "price", "unit", "x1", "x2", "x3"]
    claims = [" ".join(draw.choices(words, k=draw.randrange(0, 9))) for _ in range(n)]
    return [draw.choice([c, c, c.upper() + "!", None if draw.random() < 0.2 else c]) for c in claims]


def test_indexed_pairs_equal_all_pairs(spark):
    """The rare-word index and the ratio bound change neither which pairs are the same nor their similarity."""
    import random

    from settlepoint.functions import location
    from settlepoint.operators import ratio_join

    draw = random.Random(12)
    place = "struct<unit: string, start: int, end: int>"
    def side(n):
        return [(draw.choice(["m", "n"]), i, t, draw.choice([None, ("u", s := draw.randrange(9), s + 2), ("v", 1, 1)])) for i, t in enumerate(random_claims(draw, n))]

    a = spark.createDataFrame(side(60), f"k string, i int, text string, location {place}")
    b = spark.createDataFrame(side(60), f"k string, j int, text string, location {place}")
    pairs = a.selectExpr("k", "i", "text as text_a", "location as location_a").join(b.selectExpr("k", "j", "text as text_b", "location as location_b"), "k")
    pairs = pairs.withColumn("text_a", F.coalesce("text_a", F.lit(""))).withColumn("text_b", F.coalesce("text_b", F.lit("")))
    pairs = pairs.withColumn("loc", location.compatibility(F.col("location_a"), F.col("location_b")))
    plain = matching.decide(matching.with_similarity(pairs, full=True)).select("k", "i", "j", "jac", "sim", "symmetric", "method", "same").collect()
    for full in (True, False):
        got = {(r.i, r.j): (r.sim, r.method) for r in ratio_join.same_pairs(a, b, ["k"], ["i"], ["j"], full).collect()}
        if full:
            assert got == {(r.i, r.j): (r.sim, r.method) for r in plain if r.same} and len(got) > 20
        else:
            sets = matching.decide(matching.with_similarity(pairs, full=False)).where("same").collect()
            assert got == {(r.i, r.j): (r.sim, r.method) for r in sets}
    profiled = ratio_join.with_profile(ratio_join.with_profile(pairs, "text_a", "a"), "text_b", "b")
    decided = {(r.i, r.j): (r.same, r.method) for r in matching.decide(ratio_join.settle(profiled, ratio_join.for_decision)).collect()}
    assert decided == {(r.i, r.j): (r.same, r.method) for r in plain}
    for need, field in ((ratio_join.for_similarity, "sim"), (ratio_join.for_both_similarities, "symmetric")):
        assert {(r.i, r.j): r[field] for r in ratio_join.settle(profiled, need).collect()} == {(r.i, r.j): r[field] for r in plain}
    taus = (0.1, 0.3, 0.5)
    sided = {(r.i, r.j): [r.sim >= t for t in taus] for r in ratio_join.settle(profiled, ratio_join.for_thresholds(*taus)).collect()}
    assert sided == {(r.i, r.j): [r.sim >= t for t in taus] for r in plain}


def test_rows_that_repeat_an_id_are_indexed_each(spark):
    """The words of two texts of one id are no text of their own."""
    from settlepoint.operators import ratio_join

    place = "struct<unit: string, start: int, end: int>"
    long = " ".join(f"w{i}" for i in range(30))
    a = spark.createDataFrame([(1, "cache leaks memory", None), (1, long, None), (2, "cache leaks never", None)], f"i int, text string, location {place}")
    b = spark.createDataFrame([(7, "cache leaks memory", None), (8, long + " w30", None)], f"j int, text string, location {place}")
    for full in (True, False):
        assert sorted((r.i, r.j) for r in ratio_join.same_pairs(a, b, [], ["i"], ["j"], full).collect()) == [(1, 7), (1, 8), (2, 7)]


def test_a_text_is_indexed_by_what_it_needs(spark):
    """Two long words in common of ten leave too little behind them, so such texts don't meet."""
    from settlepoint.operators import ratio_join

    side = lambda s, n: ratio_join.with_profile(spark.createDataFrame([(i, "extraordinary particularly " + " ".join(f"{s}{i}x{k}" for k in range(8))) for i in range(n)], f"{s} int, text string"), "text", s).drop("text")
    assert ratio_join.candidates(side("a", 9), side("b", 9), [], ["a"], ["b"]).count() == 0


def test_canonical_runs_with_a_claim_that_is_missing(spark):
    place = "struct<unit: string, start: int, end: int>"
    rows = [(1, 0, 0, None, "false", None, None), (1, 0, 1, "d", "tp", "x", None), (1, 2, 2, None, "dup", "y", None)]
    df = spark.createDataFrame(rows, f"run_id int, round int, finding int, defect_id string, disposition string, claim string, location {place}")
    assert matching.canonical_runs(df).first().rounds == [["def:d", "false:0"], [], []]


def test_ratio_bound_is_never_below_the_ratio(spark):
    import random
    from collections import Counter

    from settlepoint.operators import ratio_join

    draw = random.Random(1)
    texts = [" ".join(draw.choices("abcde", k=draw.randrange(0, 8))) for _ in range(40)] + ["a " * 300, "b a " * 150]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    df = ratio_join.with_profile(ratio_join.with_profile(df, "a", "a"), "b", "b")
    for r in df.select("a", "b", ratio_join.ratio_bound(F.col("bag_a"), F.col("bag_b")).alias("bound"), text.word_ratio(F.col("norm_a"), F.col("norm_b")).alias("ratio")).collect():
        x, y = r.a.split(), r.b.split()
        assert r.bound == (2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y)) if x or y else 1.0)
        assert r.ratio <= r.bound


def test_runs_are_rebuilt_under_each_gray_policy(spark):
    """A finding in the zone, one that says what the zone's note says, a true one, and another round with the true one alone."""
    from settlepoint.operators import reports

    zone = [((("u", 1, 3)), "price unit wrong")]
    data = [(1, 0, 0, "cache leaks memory", ("u", 2, 2), zone), (1, 0, 1, "price unit wrong", None, zone), (1, 0, 2, "loop never ends", ("u", 8, 9), zone), (1, 1, 3, "loop never ends", ("u", 8, 9), zone)]
    place = "struct<unit: string, start: int, end: int>"
    found = spark.createDataFrame(data, f"run_id int, round int, finding int, claim string, location {place}, zones array<struct<location: {place}, note: string>>")
    edges = spark.createDataFrame([(1, 0, 2, 7, 0.9), (1, 1, 3, 7, 0.8)], "run_id int, round int, finding int, defect int, score double")
    rounds = {p: reports.policy_runs(found, edges, ["run_id", "round"], p).first().rounds for p in reports.POLICIES}
    assert rounds["none"] == [["def:7", "false:0", "false:1"], ["def:7"]]
    assert rounds["positional"] == rounds["semantic"] == [["def:7", "false:0"], ["def:7"]]
    runs = spark.createDataFrame([(1, "mem", 1)], "run_id int, arm string, n_defects int")
    table = {r.policy: (r.arm, r.n, r.cc, r.mean_churn) for r in reports.policy_table(found, edges, ["run_id", "round"], runs).collect()}
    assert table == {"none": ("mem", 1, 0.0, pytest.approx(2 / 3)), "positional": ("mem", 1, 0.0, 0.5), "semantic": ("mem", 1, 0.0, 0.5)}


def test_pairs_apart_in_place_need_no_ratio_to_be_told_the_same(spark):
    """One that shares too few words is not the same whatever its ratio; one that shares enough is, and its score is asked."""
    from settlepoint.operators import ratio_join

    rows = [(0.2, 0.24, 0.5, "disjoint", False), (0.4, 0.4, 0.5, "disjoint", True), (0.2, 0.24, 0.7, "same", True), (0.2, 0.24, 0.5, "same", False), (0.2, 0.24, 0.7, "unknown", True)]
    df = spark.createDataFrame(rows, "jac double, over double, bound double, loc string, want boolean")
    got = df.select("want", ratio_join.for_same_scores(*[F.col(c) for c in ("jac", "over", "bound", "loc")]).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def canonical_by_pairs(found, n_rounds):
    """Every finding meets the leaders one by one."""
    ready, leaders, out = [matching.prepared({**f, "tokens": set(f["norm"].split()) - matching.STOP_WORDS}) for f in found], [], []
    for r in range(n_rounds):
        here = [i for i, f in enumerate(found) if f["round"] == r]
        elements = set()
        for i in sorted({here[k] for k in matching.greedy_clusters([ready[i] for i in here], matching.same_claim)}):
            k = next((k for k, j in enumerate(leaders) if matching.same_claim(ready[i], ready[j])), len(leaders))
            leaders += [i] if k == len(leaders) else []
            elements.add(f"false:{k}")
        out.append(sorted(elements))
    return out


def test_clusters_by_index_are_those_of_all_pairs():
    import random

    for seed in range(300):
        draw = random.Random(seed)
        places = [(None, None, None)] + [(u, *b) for u in "uv" for b in ((None, None), (1, None), (1, 2), (2, 4), (5, 3), (9, 9))]
        said = [" ".join(draw.choices(["the", "of", "a", *"bcdefgh"], k=draw.randrange(0, 7))) for _ in range(30)]
        found = [{"round": k // 6, "finding": k, "norm": c, **dict(zip(("unit", "start", "end"), draw.choice(places)))} for k, c in enumerate(said)]
        found = [{**f, "defect_id": None} for f in found]
        assert matching._canonical(found, 5, range(30), matching._Compared(found)) == canonical_by_pairs(found, 5)


def test_unlike_findings_of_a_run_are_not_compared_pair_by_pair(monkeypatch):
    calls = []
    decide = matching.same_claim
    monkeypatch.setattr(matching, "same_claim", lambda a, b: calls.append(1) or decide(a, b))
    found = [{"round": k // 100, "finding": k, "defect_id": None, "norm": f"word{k} and other{k}", "variants": ["x"], "unit": "u", "start": k, "end": k + 1} for k in range(600)]
    rounds = matching._canonical(found, 6, range(600), matching._Compared(found))
    assert [len(r) for r in rounds] == [100] * 6 and len(calls) < 1500  # all pairs: 179,700


def test_a_note_is_compared_with_the_findings_of_its_region_only(spark):
    from settlepoint.functions import location

    place = "struct<unit: string, start: int, end: int>"
    rows = [(None, "n", True), (("u", 1, 1), "n", True), (("u", 3, None), "n", True), (("u", 4, 5), "n", False), (("v", 1, 1), "n", False), (("u", 1, 1), "", False), (None, None, False), (("v", None, None), "n", True)]
    df = spark.createDataFrame([(p, (("u", 0, 3), n), want) for p, n, want in rows], f"location {place}, zone struct<location: {place}, note: string>, want boolean")
    got = df.select("want", F.coalesce(location.note_applies(F.col("location"), F.col("zone")), F.lit(False)).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_reproduced_lines_count_repeats(spark):
    from settlepoint.operators import reports

    body = "\n".join(["First  LINE here", "second line", "third line x", "short", "first line here", " first line HERE ", "never before", "second line"])
    df = spark.createDataFrame([(1, body), (1, body), (2, "a\nb\nc"), (3, "\n".join("abcdefg")), (4, None)], "doc_id int, text string")
    got = sorted((r.doc_id, r.n, r.hits, r.verbatim) for r in reports.reproduced_lines(df, ["doc_id"]).collect())
    # Of eight lines the first four are the beginning; 'abcdefg' has no later line that is long enough.
    assert [g for g in got if g[0] == 1] == [(1, 4, 3, 0.75)] * 2 and [g for g in got if g[0] != 1] == [(3, 0, 0, None)]
