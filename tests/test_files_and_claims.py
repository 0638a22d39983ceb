"""Files written and read back, and operators over findings, against small cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from settlepoint.operators import claims
from settlepoint.sources import readers, writers

PLACE = "struct<unit:string,start:int,end:int>"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_cache_round_trip(spark, tmp_path):
    verdicts = spark.createDataFrame([("b:c", True), ("a:b", False), ('q"x', True)], "pair_key string, same boolean")
    writers.write_cache(verdicts, str(tmp_path / "cache"))
    assert rows(readers.verdict_cache(spark, str(tmp_path / "cache")), "pair_key") == [("a:b", False), ("b:c", True), ('q"x', True)]
    (tmp_path / "one.json").write_text(json.dumps({"verdicts": {"x:y": True, "a:b": False}}, indent=1))
    assert rows(readers.verdict_cache(spark, str(tmp_path / "one.json")), "pair_key") == [("a:b", False), ("x:y", True)]
    (tmp_path / "flat.json").write_text(json.dumps({"verdicts": {"x:y": True}}))
    assert rows(readers.verdict_cache(spark, str(tmp_path / "flat.json")), "pair_key") == [("x:y", True)]
    writers.write_cache(verdicts.limit(0), str(tmp_path / "empty"))
    assert readers.verdict_cache(spark, str(tmp_path / "empty")).count() == 0


def test_csv_null_tokens_and_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,NA,"two\nlines"\n,x\n-,"y ""q""",z\nbad,,w\n')
    got = readers.csv_records(spark, str(tmp_path / "x.csv"), ("", "NA", "-"), {"a": "int"}, fill={"c": "none"})
    assert [tuple(r) for r in got.collect()] == [(1, None, "two\nlines"), (None, "x", "none"), (None, 'y "q"', "z"), (None, None, "w")]


def test_files_and_reports(spark, tmp_path):
    files = spark.createDataFrame([("a/b.txt", bytearray(b"one")), ("c.bin", None), ("a/d/e", bytearray("é".encode()))], "path string, content binary")
    written = writers.write_files(files, f"file://{tmp_path}/out")
    assert rows(written.select("path", "n_bytes"), "path") == [("a/b.txt", 3), ("a/d/e", 2), ("c.bin", 0)]
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"one" and (tmp_path / "out/c.bin").read_bytes() == b""
    digests = readers.file_digests(spark, f"file://{tmp_path}/out")
    assert rows(digests.select("path", "digest"), "path") == rows(written.where("n_bytes > 0").select("path", "digest"), "path")
    with pytest.raises(Exception, match="outside"):
        writers.write_files(files.withColumn("path", F.lit("../x")), f"file://{tmp_path}/other")
    runs = spark.createDataFrame([("r1", "mem", "code", "divergent"), ("r2", "mem", "code", None)], "run_id string, config_id string, artifact_type string, regime string")
    s = writers.report_summary(runs, spark.createDataFrame([("x.json",)], "file string")).first()
    assert (s.n_runs, s.n_files, s.n_skipped, s.skipped_files) == (2, 3, 1, ["x.json"])
    assert s.by_config == {"mem": 2} and s.by_type == {"code": 2} and s.by_regime == {"divergent": 1, "none": 1}
    assert rows(readers.report_runs(spark, writers.write_report(runs, str(tmp_path / "r"), expected=2)).select("run_id", "regime"), "run_id") == [("r1", "divergent"), ("r2", None)]


def test_key_status():
    assert readers.key_status({"A_KEY": "secret-1234", "B_KEY": " "}, ("A_KEY", "B_KEY", "C_KEY")) == {"A_KEY": True, "B_KEY": False, "C_KEY": False}


def found(spark):
    data = [("m", 0, "the loop never ends", ("u", 1, 3)), ("m", 1, "loop never ends at all here", ("u", 2, 2)), ("m", 2, "wrong unit of the price", ("u", 9, 9)), ("n", 0, "other thing", None)]
    return spark.createDataFrame(data, f"module string, finding int, claim string, location {PLACE}")


def test_best_wording_of_a_defect(spark):
    data = [("m", 7, "infinite iteration", ["loop never ends", None], ("u", 1, 3)), ("m", 8, "price has a wrong unit", None, ("u", 9, 9)), ("n", 9, "unrelated", [], None)]
    defects = spark.createDataFrame(data, f"module string, defect int, description string, paraphrases array<string>, location {PLACE}")
    got = {(r.module, r.finding, r.defect): r.score for r in claims.finding_scores(found(spark), defects, ["module"]).collect()}
    assert set(got) == {("m", 0, 7), ("m", 1, 7), ("m", 2, 8)}
    assert got["m", 0, 7] >= got["m", 1, 7] > 0.3


def test_matching_names_what_is_left(spark):
    edges = spark.createDataFrame([("m", 0, 7, 0.9), ("m", 1, 7, 0.8)], "module string, finding int, defect int, score double")
    right = spark.createDataFrame([("m", 7), ("m", 8)], "module string, defect int")
    pairs, left, other = claims.matched(found(spark), right, edges, ["module"])
    assert rows(pairs, "finding") == [("m", 0, 7)]
    assert rows(left.select("module", "finding"), "module", "finding") == [("m", 1), ("m", 2), ("n", 0)] and rows(other, "defect") == [("m", 8)]


def test_weighted_clusters(spark):
    got = rows(claims.weighted_clusters(found(spark), ["module"]), "module", "leader")
    assert got == [("m", 0, 2, [0, 1]), ("m", 2, 1, [2]), ("n", 0, 1, [0])]


def test_selection_keeps_the_order_asked_for(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got, missing = claims.chosen(items, ["c", "x", "a", "c"])
    assert [r.id for r in got.collect()] == ["c", "a"] and missing == ["x"]
    got, missing = claims.chosen(items, limit=2)
    assert [r.id for r in got.collect()] == ["a", "b"] and missing == []


def test_rejudged_runs(spark):
    one = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 2, "x")], "run string, pos int, regime string")
    two = spark.createDataFrame([("a", 0, "y"), ("b", 0, None), ("c", 0, "z")], "run string, pos int, regime string")
    assert rows(claims.rejudged(one, two, ["run"]), "run") == [("a", "y", "y", True), ("b", "x", None, False)]


def test_csv_surplus_fields(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,2\n3\n4,"five, ""5""",6,"se\nven, ""7""",\n')
    got = rows(readers.csv_records(spark, str(path), types={"a": "int"}, fill={"b": "none"}, rest="more"), "a")
    assert got == [(1, "2", None), (3, "none", None), (4, 'five, "5"', ["6", 'se\nven, "7"', ""])]


def test_archives(spark, tmp_path):
    run = {"trajectory": {"run_id": "r", "artifact_id": "a", "config_id": "c", "rounds": []}}
    files = spark.createDataFrame([("k", "t/a__c__0.json", bytearray(json.dumps(run).encode())), ("k", "t/metrics.json", bytearray(b"{}")), ("k", "t/note.txt", bytearray())], "key string, path string, content binary")
    packed = writers.archives(files, "key").collect()
    assert packed == writers.archives(files.repartition(3), "key").collect()
    (tmp_path / "x.tar.gz").write_bytes(bytes(packed[0].content))
    where = str(tmp_path / "*.tar.gz")
    assert [r[1] for r in rows(readers.archived_files(spark, where), "path")] == ["t/a__c__0.json", "t/metrics.json", "t/note.txt"]
    assert rows(readers.archived_trajectories(spark, where).select("run_id", "artifact_id", "file"), "run_id") == [("r", "a", "a__c__0.json")]


def test_review_cards(spark, tmp_path):
    schema = "id string, arm string, module string, weight int, claim string, unit string, start int, end int, source string"
    items = spark.createDataFrame([("i1", "mem", "m", 2, "a < b", "f", 2, 2, "x\n'y' & \"z\"\n"), ("i2", "mem", "m", 1, None, None, None, None, None)], schema)
    one, two = (r.card for r in writers.review_cards(items).orderBy("id").collect())
    assert "a &lt; b" in one and "f:2-2 in 2 run(s)" in one
    assert "<pre><span>   1  x</span>\n<span class=zone>   2  &#x27;y&#x27; &amp; &quot;z&quot;</span></pre>" in one
    assert "(unlocalized)" in two and one.count("type=radio") == two.count("type=radio") == 3
    out = writers.write_review_pages(items, f"file://{tmp_path}/pages", "T", each=1)
    assert [r.path for r in out.orderBy("path").collect()] == ["mem/m-0.html", "mem/m-1.html"]


def test_report_gates_read_once_and_leave_nothing(spark, tmp_path):
    """Runs are counted as they are written; a failed gate leaves neither a report nor a staged folder."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    runs = spark.createDataFrame([(f"r{i}", i % 3) for i in range(20)], "run_id string, open int").withColumn("open", counted("open"))
    path = str(tmp_path / "report")
    assert writers.write_report(runs, path, expected=20) == path and seen.value == 20
    with pytest.raises(writers.GateError):
        writers.write_report(runs, str(tmp_path / "other"), expected=21)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["report"]
    assert writers.write_report(runs, path, undecided="open", most_undecided=18) == f"{path}.partial"
    assert writers.write_report(runs, path, undecided="open", most_undecided=19) == path and spark.read.json(path).count() == 20
    assert writers.write_report(runs.limit(0), path, undecided=1) == f"{path}.partial"


def test_bars_in_markdown_cells_and_many_surplus_fields(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None)], "x string, y string")
    assert [r.value for r in writers.markdown(df, ["x", "y"]).collect()][-1] == r"| a\|b |  |"
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4," + ",".join(map(str, range(3000))) + "\n")
    got = {r.a: r.more for r in readers.csv_records(spark, str(tmp_path / "t.csv"), rest="more").collect()}
    assert got["1"] is None and got["3"] == list(map(str, range(3000)))


def test_clean_up_deletes_what_was_written(spark):
    from settlepoint import session

    path = session.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    session.delete_path(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|exist"):
        spark.read.parquet(path)
