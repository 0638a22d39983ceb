import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from settlepoint.functions import schedule, versions
from settlepoint.operators import corpus, graphs, intervals, limiters, paging, rolling, sampling
from settlepoint.sources import readers, writers
from settlepoint.streaming import stateful


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_intervals(spark):
    df = spark.createDataFrame([("k", 1, 3), ("k", 2, 5), ("k", 7, 10), ("k", 10, 12), ("k", 4, 4)], "k string, lo int, hi int")
    assert rows(intervals.merge_intervals(df, ["k"]), "lo") == [("k", 1, 5), ("k", 7, 12)]
    assert intervals.total_covered(df, ["k"]).first().covered == 9
    s = spark.createDataFrame([("k", 1, 3), ("k", 2, 5), ("k", 4, 7), ("k", 6, 9), ("k", 8, 10)], "k string, lo int, hi int")
    assert rows(intervals.select_non_overlapping(s, ["k"]), "lo") == [("k", 1, 3), ("k", 4, 7), ("k", 8, 10)]
    n = s.withColumn("i", F.col("lo"))
    want = [("k", a, b) for a, b in ((1, 2), (2, 4), (4, 6), (6, 8))]
    assert rows(intervals.conflicts(n, ["k"], "i"), "a") == want


def test_conflicts_through_dyadic_buckets(spark):
    """Equal to comparing all pairs; a very long interval costs rows by the logarithm of its length."""
    import random

    draw = random.Random(6)
    spans = [(draw.choice(["x", "y", None]), i, lo := draw.randrange(-500, 500), lo + draw.choice([0, 1, 2, 7, 64, 300])) for i, _ in enumerate(range(150))]
    spans += [("x", 900, -(10**12), 10**12), ("x", 901, -500, -499), ("y", 902, 5, 3)]
    df = spark.createDataFrame(spans, "k string, i int, lo bigint, hi bigint")
    want = sorted((a[0], a[1], b[1]) for a in spans for b in spans if a[0] is not None and a[0] == b[0] and a[1] < b[1] and max(a[2], b[2]) < min(a[3], b[3]))
    assert rows(intervals.conflicts(df, ["k"], "i"), "k", "a", "b") == want
    cover = intervals.dyadic_cover(F.col("lo"), F.col("hi"), F.lit(41))
    for r in df.where("lo < hi").select("lo", "hi", cover.alias("c")).collect():
        assert len(r.c) <= 2 * (r.hi - r.lo).bit_length()
        parts = sorted((b << k, (b + 1) << k) for k, b in r.c)
        assert parts[0][0] == r.lo and parts[-1][1] == r.hi and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))


def test_selection_of_a_large_key_streams(spark):
    """A key whose intervals come in many batches, against the plain greedy loop; nulls are a key of their own."""
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 7 > 0, "k").alias("k"), (F.col("id") * 7919 % n).alias("lo"), (F.col("id") * 7919 % n + F.col("id") % 50).alias("hi"))
    got = [tuple(r) for r in intervals.select_non_overlapping(df, ["k"]).collect()]
    for key in ("k", None):
        reach, plain = None, []
        for hi, lo in sorted((r.hi, r.lo) for r in df.collect() if r.k == key and r.lo < r.hi):
            if reach is None or lo >= reach:
                plain.append((lo, hi))
                reach = hi
        assert sorted((lo, hi) for k, lo, hi in got if k == key) == plain


def test_rolling(spark):
    df = spark.createDataFrame([("k", t, float(t)) for t in range(11)], "k string, ts bigint, v double")
    last = rolling.rolling_stats(df, ["k"], "ts", "v", 10).orderBy("ts").collect()[-1]
    assert (last.n, last.low, last.high, last.mean, last.span) == (10, 1.0, 10.0, 5.5, 9.0)
    capped = rolling.rolling_stats(df, ["k"], "ts", "v", 10, max_samples=3).orderBy("ts").collect()[-1]
    assert (capped.n, capped.total, capped.variance) == (3, 27.0, pytest.approx(2 / 3))
    snap = rolling.snapshot(df, ["k"], "v").first()
    assert (snap.p50, snap.p95) == (5.0, 9.5)


def test_graphs(spark):
    edges = [("db", "config"), ("auth", "db"), ("app", "auth"), ("app", "config"), ("app", "app")]
    assert graphs.topological_order(edges, ["alone"]) == ["alone", "config", "db", "auth", "app"]
    e = spark.createDataFrame(edges, "node string, dep string")
    n = spark.createDataFrame([(x,) for x in ("config", "db", "auth", "app", "alone")], "node string")
    assert dict(rows(graphs.levels(n, e), "node")) == {"alone": 0, "app": 3, "auth": 2, "config": 0, "db": 1}
    loop = [("a", "b"), ("b", "c"), ("c", "a")]
    assert graphs.find_cycle(loop) == ["a", "b", "c", "a"] and graphs.find_cycle(edges) is None
    with pytest.raises(ValueError):
        graphs.topological_order(loop)
    with pytest.raises(ValueError):
        graphs.levels(spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), spark.createDataFrame(loop, "node string, dep string"))
    every = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    tangled = spark.createDataFrame([*loop, ("d", "a"), ("e", "d"), ("c", "f"), ("f", "g"), ("a", "a")], "node string, dep string")
    assert rows(graphs.cycle_core(every, tangled), "node") == [("a", "b"), ("b", "c"), ("c", "a")]
    assert graphs.cycle_core(n, e).count() == 0


def test_levels_of_a_deep_graph_keep_a_small_plan(spark):
    deep = spark.range(41).select(F.col("id").alias("node"))
    out = graphs.levels(deep, spark.range(1, 41).select(F.col("id").alias("node"), (F.col("id") - 1).alias("dep")))
    assert all(r.node == r.level for r in out.collect())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("\n") < 6


def test_paging(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (2, "a"), (3, "z"), (2, "c")], "k int, t string")
    seen, after = [], None
    while True:
        page = paging.page(df, "k", "t", 2, after).orderBy("position").collect()
        seen += [(r.k, r.t) for r in page]
        assert page[0].total == 5
        if not page[0].has_more:
            break
        after = seen[-1]
    assert seen == [(1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "z")]
    token = df.select(paging.encode_cursor(F.col("k"), F.col("t"))).first()[0]
    one = spark.createDataFrame([(token,), (token[:-6] + "AAAAAA",), ("junk!",)], "c string")
    got = [r[0] for r in one.select(paging.decode_cursor(F.col("c"), "struct<k:int,t:string>")).collect()]
    assert (got[0].k, got[0].t) == (2, "b") and got[1] is None and got[2] is None


def test_cron(spark):
    assert schedule.field_values("50-10/5", "minute", 0, 59) == [0, 5, 10, 50, 55]
    assert schedule.field_values("mon-fri,7", "dow", 0, 6) == [0, 1, 2, 3, 4, 5]
    for bad in ("60 * * * *", "* * *", "*/0 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            schedule.Cron.parse(bad)
    cases = {("0 9 * * 1", "2024-01-01 09:00:00"): "2024-01-08 09:00:00", ("*/20 * * * *", "2024-01-01 23:41:10"): "2024-01-02 00:00:00", ("30 6 13 * 5", "2024-01-01 00:00:00"): "2024-01-05 06:30:00", ("0 0 29 2 *", "2024-03-01 00:00:00"): None}
    for (spec, at), want in cases.items():
        t = F.lit(at).cast("timestamp_ntz")
        got, = spark.range(1).select(schedule.Cron.parse(spec).next_after(t, 366)).first()
        assert got == (want and datetime.fromisoformat(want))


def test_versions(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.3", "2.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(versions.parse(F.col("v"))).collect()] == order
    row = spark.range(1).select(versions.parse(F.lit("1.2")), versions.parse(F.lit("01.2.3"))).first()
    assert row[0] is None and row[1] is None
    cases = [("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.4", "^0.0.3", False), ("1.2.9", "~1.2", True), ("1.3.0", "~1.2", False), ("1.9.9", "1.x", True), ("3.0.0", "<2 || >=3.0.0", None), ("1.0.0-rc.1", ">=1.0.0-rc.0 <2.0.0", True), ("1.1.0-rc.1", ">=1.0.0-rc.0 <2.0.0", False), ("1.0.0+b", "=1.0.0", True)]
    for v, spec, want in cases:
        if want is not None:
            assert spark.range(1).select(versions.satisfies(versions.parse(F.lit(v)), spec)).first()[0] is want, (v, spec)
    assert df.agg(versions.max_satisfying(F.col("v"), "^1.0.0")).first()[0] == "1.2.3"


def test_limits(spark):
    e = spark.createDataFrame([("a", t) for t in (0.0, 0.0, 0.0, 1.0, 5.0)], "k string, ts double")
    got = [(r.allowed, r.remaining) for r in limiters.rate_limit(e, "k", "ts", 2.0, 1.0).collect()]
    assert got == [(True, 1.0), (True, 0.0), (False, 0.0), (True, 0.0), (True, 1.0)]
    assert limiters.Bucket(1.0, 0.0).allow(0.0, 5.0) == (False, 1.0, float("inf"))
    c = limiters.LruTtl(2, 10.0)
    assert [c.access(k, t) for k, t in (("x", 0), ("y", 1), ("x", 2), ("z", 3), ("y", 4), ("z", 20))] == [False, False, True, False, False, False]
    assert (c.hits, c.misses, c.evictions, c.expirations) == (1, 5, 2, 1)
    a = spark.createDataFrame([("k", 1, True), ("k", 2, False), ("k", 3, True), ("j", 1, True), ("j", 2, True), ("j", 3, True), ("j", 4, True)], "k string, i int, failed boolean")
    tries = rows(limiters.retry_schedule(a, "failed", "k", "i").select("k", "i", "delay"), "k", "i")
    assert tries == [("j", 1, 0.0), ("j", 2, 0.1), ("j", 3, 0.2), ("k", 1, 0.0), ("k", 2, 0.1)]


def test_sampling(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("s"))
    a, b = (rows(sampling.stratified(x, ["s"], "id", 5, 1), "id") for x in (df, df.repartition(7)))
    assert a == b and len(a) == 15
    assert [r.id for r in sampling.systematic(df, "id", 10, 3).orderBy("id").collect()] == [0, 10, 20]
    turns = [r.s for r in sampling.round_robin(df, "s", "id", 7, 1).orderBy("turn", "s").collect()]
    assert turns == [0, 1, 2, 0, 1, 2, 0]
    dup = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 3, "c")], "k string, pos int, v string")
    assert rows(sampling.keep_first(dup, "k", ["pos"]), "k") == [("x", 1, "a"), ("y", 3, "c")]


def test_drift_and_upsert(spark):
    m = lambda *r: spark.createDataFrame(list(r), "path string, digest string")
    assert rows(corpus.drift(m(("a", "1"), ("b", "1"), ("c", "1")), m(("b", "2"), ("c", "1"), ("d", "1"))), "path") == [("a", "removed"), ("b", "changed"), ("d", "added")]
    once = corpus.upsert_defects(m(("a", "1"), ("b", "1")), m(("b", "2"), ("c", "3")), ["path"])
    assert rows(once, "path") == [("a", "1"), ("b", "2"), ("c", "3")] == rows(corpus.upsert_defects(once, m(("b", "2"), ("c", "3")), ["path"]), "path")


@pytest.fixture()
def corpus_dir(tmp_path):
    def item(kind, name, artifact, meta, defects, file="a.md"):
        d = tmp_path / "corpus" / kind / name
        d.mkdir(parents=True)
        (d / file).write_text(artifact)
        (d / "meta.json").write_text(json.dumps({"id": name, "type": kind, "artifact_file": file, **meta}))
        (d / "defects.json").write_text(json.dumps({"artifact_id": name, "defects": defects}))

    good = {"source": {"origin": "synthetic"}, "clean_regions": [{"unit": "u"}], "defect_count": 3}
    defect = lambda n, k, line, anchor: {"id": f"{n}-d{k}", "category": "c", "severity": "major", "description": f"wrong {k}", "location": {"unit": "u", "start": line}, "anchor": anchor, "paraphrases": [f"p{k}", f"q{k}"], "confirmed": True}
    item("code", "code-1", "@@ -0,0 +1,3 @@\n+one\n+two\n+three\n", good, [defect("code-1", k, k + 1, w) for k, w in enumerate(("one", "two", "three"))], "a.diff")
    bad = defect("spec-1", 0, 1, "absent") | {"paraphrases": ["wrong 0"], "confirmed": False}
    item("spec", "spec-1", "first\nsecond\n", {"source": {"origin": "derived", "license": "GPL-3.0"}, "defect_count": 2, "known_gray_zone": [{"location": {"unit": "u"}, "note": ""}]}, [bad, bad])
    return tmp_path / "corpus"


def test_anchors_meet_lines_without_their_defects(spark, corpus_dir, tmp_path):
    """Whole defects are in no join: anchors meet the lines once, and ids their owners."""
    readers.items(spark, str(corpus_dir)).write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    found = corpus.validate(items, readers.line_map(items))
    assert sorted(r.detail for r in found.where("code = 'anchor-mismatch'").collect()) == ["spec-1-d0", "spec-1-d0"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_corpus_reader_rules_and_freeze(spark, corpus_dir, tmp_path):
    items = readers.items(spark, str(corpus_dir))
    assert [r.id for r in items.collect()] == ["code-1", "spec-1"]
    lines = readers.line_map(items)
    assert rows(lines.where("id = 'code-1'").select("no", "line"), "no") == [(1, "one"), (2, "two"), (3, "three")]
    found = [(r.item_id, r.code) for r in corpus.validate(items, lines).collect()]
    assert not [f for f in found if f[0] == "code-1"]
    want = ["anchor-mismatch", "anchor-mismatch", "defect-count-band", "duplicate-defect-id", "empty-gray-zone-note", "license-not-allowed", "missing-attribution", "missing-provenance", "missing-provenance", "missing-retrieved", "no-clean-regions", "paraphrase-count", "paraphrase-count", "paraphrase-echoes-description", "paraphrase-echoes-description"]
    assert sorted(c for _, c in found) == want
    assert corpus.unconfirmed(items).count() == 2
    digests = readers.file_digests(spark, str(corpus_dir))
    assert digests.count() == 6
    with pytest.raises(writers.GateError):
        writers.write_manifest(digests, str(tmp_path / "m1"), corpus.freeze_blockers(items, lines))
    writers.write_manifest(digests, str(tmp_path / "m2"))
    back = readers.manifest(spark, str(tmp_path / "m2"))
    assert corpus.drift(back, digests).count() == 0
    (corpus_dir / "code" / "code-1" / "a.diff").write_text("tampered")
    assert rows(corpus.drift(back, readers.file_digests(spark, str(corpus_dir))), "path") == [("code/code-1/a.diff", "changed")]
    anchors = spark.createDataFrame([("spec-1", "second"), ("spec-1", "s"), ("spec-1", "zzz")], "id string, anchor string")
    assert rows(corpus.resolve_anchors(anchors, lines), "anchor") == [("spec-1", "s", -2), ("spec-1", "second", 2), ("spec-1", "zzz", 0)]


def test_trajectories_and_scored_runs(spark, tmp_path):
    run = {"trajectory": {"run_id": "r", "artifact_id": "a", "config_id": "mem", "rounds": [{"round_index": 0, "findings": [{"id": "x", "claim": "c"}]}, {"round_index": 1, "findings": []}]}, "transcripts": [["ab", "c"], ["d"]]}
    (tmp_path / "t" / "deep").mkdir(parents=True)
    (tmp_path / "t" / "deep" / "a__mem__1.json").write_text(json.dumps(run))
    (tmp_path / "t" / "metrics.json").write_text("{}")
    t = readers.trajectories(spark, str(tmp_path / "t"))
    assert rows(readers.round_findings(t).select("run_id", "round", "finding", "severity"), "round") == [("r", 0, 0, "minor")]
    assert rows(readers.transcript_lengths(t), "round") == [("a", "mem", 0, 4), ("a", "mem", 1, 1)]
    (tmp_path / "s.json").write_text(json.dumps({"n_runs": 2, "runs": [{"run_id": "b", "churn": [0.5]}, {"run_id": "a"}]}))
    assert [(r.pos, r.run_id) for r in readers.scored_runs(spark, str(tmp_path / "s.json")).orderBy("pos").collect()] == [(0, "b"), (1, "a")]


def test_sheets_caches_and_reports(spark, tmp_path):
    gold = spark.createDataFrame([("p1", 'a "q", x\ny', "b", True, "positive")], "pair_id string, a_text string, b_text string, label boolean, source string")
    writers.write_gold(gold, str(tmp_path / "g"))
    assert readers.gold_pairs(spark, str(tmp_path / "g")).first().a_text == 'a "q", x\ny'
    writers.write_worksheet(gold, str(tmp_path / "sheet"), str(tmp_path / "key"))
    assert readers.csv_records(spark, str(tmp_path / "sheet")).first().finding_a == 'a "q", x\ny'
    (tmp_path / "w.csv").write_text("id,pair_id,label\nx,,Same\n,y,no\nz,,maybe\n")
    assert rows(readers.worksheet(spark, str(tmp_path / "w.csv")), "id") == [("x", True), ("y", False)]
    (tmp_path / "c.json").write_text('{"verdicts": {"a:b": true}}')
    assert rows(readers.verdict_cache(spark, str(tmp_path / "c.json")), "pair_key") == [("a:b", True)]
    assert readers.verdict_cache(spark, str(tmp_path / "none.json")).count() == 0
    assert writers.write_report(gold, str(tmp_path / "r"), undecided=2, most_undecided=1).endswith(".partial")
    with pytest.raises(writers.GateError):
        writers.write_report(gold, str(tmp_path / "r"), expected=5)
    assert [r.value for r in writers.markdown(gold, ["pair_id", "label"]).collect()] == ["| pair_id | label |", "|---|---|", "| p1 | true |"]
    assert readers.settings("export A='x y'\n# c\nB=1 # n\nC=\"z\"", {"B": "env"}) == {"A": "x y", "B": "env", "C": "z"}


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, k % 24), float(k)) for k in range(24)], "k string, ts timestamp_ntz, v double")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = stateful.collected(stateful.windowed(stream, ["k"], "v", "12 minutes"), "complete", "w_test")
    assert rows(got.select("n", "total"), "total") == [(12, 66.0), (12, 210.0)]
    s = stateful.collected(stateful.sessions(stream, ["k"], "5 minutes"), "complete", "s_test")
    assert s.first().n == 24
    limited = stateful.rate_limited(stream.withColumn("seconds", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")), "k", "seconds", 2.0, 1 / 600)
    out = stateful.collected(limited, "append", "b_test")
    assert out.count() == 24 and 2 < out.where("allowed").count() < 8
    pairs = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], "pair_key string, t string")
    pairs.write.parquet(str(tmp_path / "p"))
    judged = lambda df: df.withColumn("same", F.col("t") == "a")
    for _ in range(2):
        stateful.judge_stream(spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "p")), str(tmp_path / "cache"), judged, str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "cache")), "pair_key") == [("k1", True), ("k2", False)]


def test_gold_classes_are_balanced(spark, tmp_path):
    from settlepoint.plans import utilities

    rows = [(i, ". ".join(f"w{i} v{j}" for j in range(6 + i % 3))) for i in range(41)]
    spark.createDataFrame(rows, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = utilities.gold_pairs(spark, str(tmp_path)).collect()
    count = lambda source: sum(r.source == source for r in got)
    assert count("positive") == sum(len(t.split(". ")) * (len(t.split(". ")) - 1) // 2 for _, t in rows)
    assert count("same-artifact") == 60
    easy = [tuple(int(x[1:]) for x in r.pair_id.split("~xneg~")) for r in got if r.source == "cross-artifact"]
    possible = 41 * 40 // 2 - 60
    assert 120 < len(easy) == len(set(easy)) == min(possible, count("positive") - 60)
    assert all(a // 4 != b // 4 for a, b in easy)
    assert {r.source: r.n for r in utilities.gold_tallies(spark, str(tmp_path)).collect()} == {s: count(s) for s in ("positive", "same-artifact", "cross-artifact")}
    single = spark.createDataFrame([(i, "one") for i in range(8)], "item_id bigint, text string")
    single.write.parquet(f"{tmp_path}/few/benchmark.parquet")
    assert {r.source for r in utilities.gold_pairs(spark, f"{tmp_path}/few").collect()} == {"same-artifact"}


def test_cron_finds_the_next_29_february(spark):
    import datetime as dt

    spec = schedule.Cron.parse("30 6 29 2 *")
    for after, want in (((2024, 3, 1), 2028), ((2096, 3, 1), 2104), ((2027, 6, 1), 2028)):
        t = F.lit(dt.datetime(*after)).cast("timestamp_ntz")
        got, = spark.range(1).select(spec.next_after(t)).first()
        assert got == dt.datetime(want, 2, 29, 6, 30)
    t = F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz")
    assert spark.range(1).select(spec.next_after(t, 366)).first()[0] is None
    assert spark.range(1).select(schedule.Cron.parse("0 0 30 2 *").next_after(t)).first()[0] is None


def test_rolling_percentiles(spark):
    import numpy as np

    rows = [(k, t, float((t * 7 + len(k)) % 11)) for k in ("a", "bb") for t in (0, 1, 4, 5, 6, 20, 21)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = rolling.rolling_percentiles(df, ["k"], "t", "v", 5, {"median": 0.5, "p90": 0.9}).collect()
    for r in got:
        near = [v for k, t, v in rows if k == r.k and r.t - 5 < t <= r.t]
        assert (r.median, r.p90) == pytest.approx((np.median(near), np.percentile(near, 90)))
    assert len(got) == len(rows)


def test_cron_upcoming_and_describe(spark):
    e = spark.createDataFrame([(datetime(2024, 2, 28, 23, 59),), (datetime(2024, 3, 1, 0, 0),)], "ts timestamp_ntz")
    leap = schedule.Cron.parse("0 12 29 2 *")
    got = rows(e.select(leap.upcoming(F.col("ts"), 2).alias("u")), "u")
    assert [r[0] for r in got] == [[datetime(2024, 2, 29, 12), datetime(2028, 2, 29, 12)], [datetime(2028, 2, 29, 12), datetime(2032, 2, 29, 12)]]
    hourly = schedule.Cron.parse("0,30 * * * *")
    assert hourly.describe()["minutes"] == (0, 30) and hourly.describe()["days_of_week"] == (0, 1, 2, 3, 4, 5, 6)
    first = e.orderBy("ts").limit(1).select(hourly.upcoming(F.col("ts"), 3).alias("u"), hourly.next_after(F.col("ts")).alias("n")).first()
    assert first.u == [datetime(2024, 2, 29, 0), datetime(2024, 2, 29, 0, 30), datetime(2024, 2, 29, 1)] and first.n == first.u[0]


def test_cron_steps_of_a_star_do_not_restrict_days():
    assert not schedule.Cron.parse("0 0 */2 * 1").either_day and not schedule.Cron.parse("0 0 *,* * 1").either_day
    assert schedule.Cron.parse("0 0 1-31 * 1").either_day


def test_graph_tables(spark):
    e = spark.createDataFrame([("g", "app", "db"), ("g", "db", "config"), ("g", "app", "app"), ("g", "aux", None), ("h", "a", "b")], "graph string, node string, dep string")
    got = rows(graphs.topological_orders(e, "graph"), "graph", "position")
    assert got == [("g", "aux", 0), ("g", "config", 1), ("g", "db", 2), ("g", "app", 3), ("h", "b", 0), ("h", "a", 1)]
    assert graphs.cycles(e, "graph").collect() == []
    looped = e.unionByName(spark.createDataFrame([("h", "b", "c"), ("h", "c", "a")], "graph string, node string, dep string"))
    assert rows(graphs.cycles(looped, "graph"), "graph") == [("h", ["a", "b", "c", "a"])]
    with pytest.raises(Exception, match="cycle"):
        graphs.topological_orders(looped, "graph").collect()


def test_buckets_with_limits_of_their_own(spark):
    e = spark.createDataFrame([(k, t) for k in ("a", "b") for t in (0.0, 0.0, 0.0)], "k string, ts double")
    limits = spark.createDataFrame([("b", 1.0, None, None)], "key string, capacity double, refill double, burst double")
    decided = limiters.rate_limit(e, "k", "ts", 2.0, 1.0, limits=limits)
    assert [r.allowed for r in decided.orderBy("key", F.desc("remaining"), F.desc("allowed")).collect()].count(True) == 3
    assert rows(limiters.bucket_levels(decided, 1.0, 2.0, 1.0, limits=limits), "key") == [("a", 1.0, False), ("b", 1.0, True)]
    b = limiters.Bucket(2.0, 1.0, 4.0)
    assert b.remaining(5.0) == 2.0 and b.allow(5.0, 2.0)[0] and not b.full(6.0) and b.full(7.0)
    for wrong in ((0.0, 1.0), (1.0, -1.0), (2.0, 1.0, 1.0)):
        with pytest.raises(ValueError):
            limiters.Bucket(*wrong)
    with pytest.raises(ValueError):
        b.allow(8.0, -1.0)


def test_positions_are_gapless_in_order(spark):
    from settlepoint.operators.resampling import numbered

    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS k").repartition(7)
    assert rows(numbered(df, "k", "i"), "k") == [(k, k) for k in range(1000)]
    assert numbered(df.limit(0), "k", "i").count() == 0
