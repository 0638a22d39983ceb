"""Queries over sources and sinks: the driver's tables written as the engine's files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus
from ..session import shared_path, table
from ..sources import readers, writers

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _typed(item: str) -> str:
    return f"CASE {item} % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'paper' ELSE 'spec' END"


def corpus_root(spark: SparkSession, sf_dir: str) -> str:
    """Benchmark items as a corpus: <type>/i<item>/ with meta.json, defects.json and the artifact (a diff for code)."""
    items = table(spark, sf_dir, "benchmark").where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    items = items.withColumn("type", F.expr(_typed("item_id"))).withColumn("id", F.concat(F.lit("i"), "item_id"))
    code = F.col("type") == "code"
    name = F.when(code, "artifact.diff").otherwise("artifact.md")
    artifact = F.when(code, text.new_file_diff(F.lit("artifact.md"), F.col("text"))).otherwise(F.col("text"))
    place = F.struct(F.lit("text").alias("unit"), F.lit(1).alias("start"), F.lit(1).alias("end"))
    defect = F.struct(
        F.concat("id", F.lit("-d0")).alias("id"), F.lit("wording").alias("category"), F.lit("minor").alias("severity"), F.substring("text", 1, 20).alias("description"),
        place.alias("location"), F.array(F.lit("first"), F.lit("second")).alias("paraphrases"), F.lit(True).alias("confirmed"),
    )
    files = [
        F.struct(F.lit("meta.json").alias("name"), F.to_json(F.struct("id", "type", name.alias("artifact_file"), F.lit(1).alias("defect_count"))).alias("content")),
        F.struct(F.lit("defects.json").alias("name"), F.to_json(F.struct(F.col("id").alias("artifact_id"), F.array(defect).alias("defects"))).alias("content")),
        F.struct(name.alias("name"), artifact.alias("content")),
    ]
    rows = items.select("type", "id", F.explode(F.array(*files)).alias("f"))
    root = shared_path(spark, "corpus")
    writers.write_files(rows.select(F.concat_ws("/", "type", "id", "f.name").alias("path"), F.col("f.content").cast("binary").alias("content")), root).count()
    return root


_LINES_SQL = "CASE WHEN text IS NULL THEN [''] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END"


@query(
    f"""SELECT 'i' || item_id AS id, {_typed('item_id')} AS type, CASE WHEN item_id % 3 = 0 THEN 'artifact.diff' ELSE 'artifact.md' END AS artifact_file,
    CAST(1 AS INTEGER) AS n_defects, substr(coalesce(text, ''), 1, 20) AS description, 'minor' AS severity FROM benchmark WHERE item_id IS NOT NULL"""
)
def corpus_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = readers.items(spark, corpus_root(spark, sf_dir), strict=True)
    d = F.get("defects", F.lit(0))
    return items.select("id", "type", "artifact_file", F.size("defects").alias("n_defects"), d["description"].alias("description"), d["severity"].alias("severity"))


@query(
    """WITH t AS (SELECT item_id, coalesce(text, '') AS text FROM benchmark WHERE item_id IS NOT NULL),
    l AS (SELECT item_id, string_split(CASE WHEN item_id % 3 <> 0 AND text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS lines FROM t)
    SELECT 'i' || item_id AS id, len(lines) AS n_lines, CAST(len(array_to_string(lines, '')) AS BIGINT) AS n_chars FROM l"""
)
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole artifacts and of the diffs' new files."""
    lines = readers.line_map(readers.items(spark, corpus_root(spark, sf_dir)))
    return lines.groupBy("id").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


@query(
    f"""SELECT {_typed('item_id')} || '/i' || item_id || '/artifact.md' AS path, sha256(coalesce(text, '')) AS digest, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, 'unchanged' AS status
    FROM benchmark WHERE item_id % 3 <> 0"""
)
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a frozen corpus, its manifest written and read back, and the drift between the two."""
    root = corpus_root(spark, sf_dir)
    digests = readers.file_digests(spark, root)
    path = shared_path(spark, "manifest")
    writers.write_manifest(digests, path)
    recorded = readers.manifest(spark, path)
    drift = corpus.drift(recorded, digests).withColumnRenamed("status", "change")
    out = recorded.join(digests.select("path", "length"), "path").join(drift, "path", "left").where(F.endswith("path", F.lit(".md")))
    return out.select("path", "digest", F.col("length").alias("n_bytes"), F.coalesce("change", F.lit("unchanged")).alias("status"))


@query("SELECT CAST(doc_id AS VARCHAR) AS pair_key, quality = 1 AS same FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL")
def cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
    path = shared_path(spark, "cache")
    writers.write_cache(rows.select(F.col("doc_id").cast("string").alias("pair_key"), (F.col("quality") == 1).alias("same")), path)
    return readers.verdict_cache(spark, path)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    return d.select(
        F.concat(F.lit("p"), "doc_id").alias("pair_id"), F.col("text").alias("a_text"), F.concat(F.lit('"'), "source", F.lit('", '), "lang").alias("b_text"),
        (F.col("doc_id") % 2 == 0).alias("label"), F.col("source").alias("source"), F.lit("u").alias("a_unit"), F.lit(1).alias("a_start"), F.lit(2).alias("a_end"),
    )


@query("SELECT 'p' || doc_id AS pair_id, sha1(text) AS a_sha1, '\"' || source || '\", ' || lang AS b_text, doc_id % 2 = 0 AS label, 'u' AS a_unit, CAST(2 AS INTEGER) AS a_end FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def gold_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "gold")
    writers.write_gold(_gold(spark, sf_dir), path)
    return readers.gold_pairs(spark, path).select("pair_id", F.sha1("a_text").alias("a_sha1"), "b_text", "label", "a_unit", "a_end")


@query("SELECT 'p' || doc_id AS pair_id, sha1(text) AS a_sha1 FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def worksheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blinded sheet with whole texts (quotes and line ends among them) and the key that names its pairs."""
    sheet, key = shared_path(spark, "sheet"), shared_path(spark, "key")
    writers.write_worksheet(_gold(spark, sf_dir), sheet, key)
    found = readers.csv_records(spark, sheet).join(readers.csv_records(spark, key), "id")
    return found.select("pair_id", F.sha1("finding_a").alias("a_sha1"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'k' || doc_id ELSE 'p' || doc_id END AS id, quality = 1 AS label FROM labels WHERE quality IS NOT NULL AND doc_id % 5 <> 0")
def labelled_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled sheet: ids in either column, labels in several spellings, unreadable ones dropped."""
    l = table(spark, sf_dir, "labels").where("quality is not null")
    words = F.when(F.col("doc_id") % 5 == 0, "maybe").when(F.col("quality") == 1, F.when(F.col("doc_id") % 3 == 0, " Same ").otherwise("y")).otherwise(F.when(F.col("doc_id") % 3 == 0, "DIFF").otherwise("0"))
    even = F.col("doc_id") % 2 == 0
    rows = l.select(F.when(even, F.concat(F.lit("k"), "doc_id")).alias("id"), F.when(~even, F.concat(F.lit("p"), "doc_id")).alias("pair_id"), words.alias("label"))
    path = shared_path(spark, "labelled")
    rows.write.option("header", True).csv(path)
    return readers.worksheet(spark, path)


_ROUND = "CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER)"


def _trajectory_root(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as trajectory files <artifact>__<config>__<run>.json: a turn is a round with one finding."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null")
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    runs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    finding = lambda x: F.array(F.struct(x["text"].alias("claim"), F.struct(x["role"].alias("unit")).alias("location")))
    rounds = F.transform("t", lambda x, i: F.struct(i.alias("round_index"), finding(x).alias("findings")))
    trajectory = F.struct(F.concat(F.lit("r"), "conv_id").alias("run_id"), F.concat(F.lit("a"), "conv_id").alias("artifact_id"), F.lit("mem").alias("config_id"), rounds.alias("rounds"))
    content = F.to_json(F.struct(trajectory.alias("trajectory"), F.transform("t", lambda x: F.array(x["text"])).alias("transcripts")))
    root = shared_path(spark, "trajectories")
    path = F.concat(F.lit("part"), (F.col("conv_id") % 3).cast("string"), F.lit("/a"), "conv_id", F.lit("__mem__0.json"))
    writers.write_files(runs.select(path.alias("path"), content.cast("binary").alias("content")), root).count()
    return root


@query(f"SELECT 'r' || conv_id AS run_id, {_ROUND} AS round, role AS unit, sha1(coalesce(text, '')) AS claim_sha1, 'minor' AS severity FROM conversations WHERE conv_id IS NOT NULL")
def trajectory_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.round_findings(readers.trajectories(spark, _trajectory_root(spark, sf_dir)))
    return found.select("run_id", "round", F.col("location.unit").alias("unit"), F.sha1("claim").alias("claim_sha1"), "severity")


@query(f"SELECT 'a' || conv_id AS artifact, 'mem' AS config, {_ROUND} AS round, CAST(len(coalesce(text, '')) AS INTEGER) AS n_chars FROM conversations WHERE conv_id IS NOT NULL")
def transcript_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.transcript_lengths(readers.trajectories(spark, _trajectory_root(spark, sf_dir)))


_MODE = "CASE WHEN user_id % 2 = 0 THEN 'mem' ELSE 'nomem' END"


@query(f"SELECT {_MODE} AS config_id, 'r' || user_id AS run_id, CAST(count(*) AS INTEGER) AS n_rounds FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as a report with counts and distributions, read back as the union of its runs."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    runs = e.groupBy("user_id").agg(F.count("*").cast("int").alias("n_rounds"))
    runs = runs.select(F.concat(F.lit("r"), "user_id").alias("run_id"), F.expr(_MODE).alias("config_id"), F.lit("code").alias("artifact_type"), F.lit("divergent").alias("regime"), "n_rounds")
    path = writers.write_report(runs, shared_path(spark, "report"), expected=runs.count(), undecided=0)
    return readers.report_runs(spark, path).select("config_id", "run_id", "n_rounds")


@query(f"SELECT config_id, n, (SELECT count(DISTINCT user_id) FROM events) AS n_runs, CAST(2 AS BIGINT) AS n_skipped FROM (SELECT {_MODE} AS config_id, count(DISTINCT user_id) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1)")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null").select("user_id").distinct()
    runs = e.select(F.concat(F.lit("r"), "user_id").alias("run_id"), F.expr(_MODE).alias("config_id"), F.lit("code").alias("artifact_type"), F.lit("divergent").alias("regime"))
    skipped = spark.createDataFrame([("a.json",), ("b.json",)], "file string")
    s = writers.report_summary(runs, skipped)
    return s.select(F.explode("by_config").alias("config_id", "n"), "n_runs", "n_skipped")


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS value FROM nation UNION ALL SELECT '| n_nationkey | n_name |' UNION ALL SELECT '|---|---|'")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.markdown(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"])


@query("SELECT item_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS n_lines, sha1(coalesce(text, '')) AS text_sha1 FROM benchmark")
def diff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new-file diff of each text and the lines that it gives back."""
    lines = text.diff_postimage(text.new_file_diff(F.lit("f"), F.coalesce("text", F.lit(""))))
    back = table(spark, sf_dir, "benchmark").select("item_id", lines.alias("l"))
    return back.select("item_id", F.size("l").alias("n_lines"), F.sha1(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text_sha1"))


@query(
    """WITH w AS (SELECT source AS arm, 'd' || doc_id AS name, doc_id FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY name) AS k FROM w)
    SELECT 'runs/' || arm || '/' || name AS path, 'd' || doc_id AS name, sha256(CAST(doc_id AS VARCHAR)) AS digest, CAST(len(CAST(doc_id AS VARCHAR)) AS BIGINT) AS n_bytes FROM k WHERE k <= 2"""
)
def release_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two files of each arm by name, copied to a release and measured there."""
    w = table(spark, sf_dir, "documents").where("source is not null and doc_id is not null")
    files = w.select(F.col("source").alias("arm"), F.concat(F.lit("d"), "doc_id").alias("name"), F.col("doc_id").cast("string").cast("binary").alias("content"))
    arms = {r.arm: 2 for r in files.select("arm").distinct().collect()}  # one short row an arm
    first, _ = writers.release_listing(files, arms, files.select("name").limit(0))
    root = shared_path(spark, "release")
    copied = writers.write_files(first.select(F.concat_ws("/", F.lit("runs"), "arm", "name").alias("path"), "content"), root)
    back = readers.file_digests(spark, root).select("path", "digest", F.col("length").alias("n_bytes"))
    return back.join(copied.select("path", "digest"), ["path", "digest"]).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "digest", "n_bytes")


@query("SELECT 'd' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id IS NOT NULL")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in gzipped tar archives of at most 64 ids, written as files and read back."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    files = d.select(F.floor(F.col("doc_id") / 64).cast("string").alias("key"), F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    root = shared_path(spark, "archives")
    packed = writers.archives(files, "key").select(F.concat("key", F.lit(".tar.gz")).alias("path"), "content")
    writers.write_files(packed, root).count()
    return readers.archived_files(spark, f"{root}/*.tar.gz").select("path", F.sha2("content", 256).alias("digest"))


def _html_sql(c: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


@query(
    f"""WITH t AS (SELECT item_id, coalesce(text, '') AS text FROM benchmark WHERE item_id IS NOT NULL),
    l AS (SELECT item_id, list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x, i: (CASE WHEN i BETWEEN 1 AND 2 THEN '<span class=zone>' ELSE '<span>' END) || lpad(CAST(i AS VARCHAR), 4, ' ') || '  ' || {_html_sql('x')} || '</span>') AS lines FROM t)
    SELECT item_id, sha256('<pre>' || array_to_string(lines, chr(10)) || '</pre>') AS digest FROM l"""
)
def source_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered, escaped listings of the items with their first two lines as the zone."""
    b = table(spark, sf_dir, "benchmark").where("item_id is not null")
    return b.select("item_id", F.sha2(writers.source_listing(F.coalesce("text", F.lit("")), F.lit(1), F.lit(2)), 256).alias("digest"))


@query("SELECT CASE WHEN item_id % 2 = 0 THEN 'mem' ELSE 'nomem' END AS arm, 'm' || (item_id // 100) AS module, count(*) AS cards FROM benchmark WHERE item_id IS NOT NULL GROUP BY ALL")
def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the items on written pages, counted after reading the pages back."""
    b = table(spark, sf_dir, "benchmark").where("item_id is not null")
    items = b.select(
        F.concat(F.lit("i"), "item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "mem").otherwise("nomem").alias("arm"), F.concat(F.lit("m"), F.floor(F.col("item_id") / 100)).alias("module"),
        F.lit(1).alias("weight"), F.substring("text", 1, 40).alias("claim"), F.lit("text").alias("unit"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.col("text").alias("source"),
    )
    root = shared_path(spark, "pages")
    writers.write_review_pages(items, root, "Findings", 20).count()
    pages = spark.read.text(f"{root}/*/*.html", wholetext=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), F.col("value").alias("page"))
    module = F.regexp_replace(F.element_at("p", -1), r"-\d+\.html$", "")
    return pages.groupBy(F.element_at("p", -2).alias("arm"), module.alias("module")).agg(F.sum(F.regexp_count("page", F.lit("<div class=card "))).cast("long").alias("cards"))


@query("SELECT c_custkey, c_name AS name, c_custkey % 3 AS n_rest, CASE c_custkey % 3 WHEN 1 THEN 'x, \"' || c_mktsegment || '\"' WHEN 2 THEN 'y' END AS last_rest FROM customer")
def csv_surplus_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with up to two fields more than the header (quotes and commas in them), read into an array."""
    c = table(spark, sf_dir, "customer")
    quoted = F.concat(F.lit('"'), F.replace(F.concat(F.lit('x, "'), "c_mktsegment", F.lit('"')), F.lit('"'), F.lit('""')), F.lit('"'))
    extra = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(","), quoted)).when(F.col("c_custkey") % 3 == 2, F.concat(F.lit(","), quoted, F.lit(",y"))).otherwise("")
    # Each part of the table is one file with a header of its own.
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_name", extra)
    rows = c.select(F.floor(F.col("c_custkey") / 1000).alias("part"), "c_custkey", line.alias("line"))
    files = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("l"))
    content = F.concat(F.lit("c_custkey,name\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    root = shared_path(spark, "surplus")
    writers.write_files(files.select(F.concat(F.lit("p"), "part", F.lit(".csv")).alias("path"), F.encode(content, "UTF-8").alias("content")), root).count()
    back = readers.csv_records(spark, f"{root}/*.csv", types={"c_custkey": "bigint"}, rest="rest")
    n = F.coalesce(F.size("rest"), F.lit(0))
    return back.select("c_custkey", "name", F.when(F.col("rest").isNull(), 0).otherwise(n).cast("long").alias("n_rest"), F.try_element_at("rest", F.lit(-1)).alias("last_rest"))
