"""Queries of sampling, gold pairs, drift, rules, intervals, windows, paging, graphs, schedules, versions, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schedule, text, versions
from ..operators import corpus, graphs, intervals, judging, limiters, paging, rolling, sampling, walsh
from ..operators.resampling import draw_sql
from ..session import table
from ..streaming import stateful
from .convergence import rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# sampling --------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {draw_sql('7', 'doc_id')}, doc_id) AS k FROM labels) WHERE k <= 20")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "labels"), ["quality"], "doc_id", 20, 7).select("doc_id", "quality")


@query(f"SELECT doc_id, lang, CAST(k AS INTEGER) AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {draw_sql('11', 'doc_id')}, doc_id) AS k FROM documents) ORDER BY k, lang LIMIT 40")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 40, 11)


@query(f"SELECT doc_id, toxic FROM labels ORDER BY CAST(toxic = 1 AS INT) DESC, {draw_sql('3', 'doc_id')}, doc_id LIMIT 60")
def hard_first_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_by(table(spark, sf_dir, "labels"), F.col("toxic") == 1, "doc_id", 60, 3).select("doc_id", "toxic")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k % 7 = 0 AND k < 350")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.systematic(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 50)


@query("SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 2")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_per_group(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderkey"], 2).select("o_orderstatus", "o_orderkey")


@query("SELECT min(doc_id) AS doc_id, sha1(text) AS text_sha1 FROM documents GROUP BY text")
def first_of_equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("text_sha1"))
    return sampling.keep_first(d, "text_sha1", ["doc_id"])


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)


# gold pairs ------------------------------------------------------------------------------------------


def gold_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as defects: four an artifact, sentences as wordings."""
    b = table(spark, sf_dir, "benchmark")
    pos = (F.col("item_id") % 4).cast("int")
    return b.select(
        F.concat(F.lit("d"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("id"), F.floor(F.col("item_id") / 4).cast("long").alias("item"), pos.alias("pos"), F.split("text", r"\. ").alias("variants")
    )


_GOLD_SQL = "g AS (SELECT 'd' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS id, item_id // 4 AS item, CAST(item_id % 4 AS INTEGER) AS pos, string_split(text, '. ') AS variants FROM benchmark)"
_POSITIVE_SQL = "pos_ AS (SELECT a.id || '~pos~' || x.i || '-' || y.i AS pair_id, a.variants[x.i + 1] AS a_text, a.variants[y.i + 1] AS b_text, true AS label, 'positive' AS source FROM g a CROSS JOIN range(0, 1000) x(i) CROSS JOIN range(0, 1000) y(i) WHERE x.i < y.i AND y.i < len(a.variants))"
_HARD_SQL = "hard AS (SELECT a.id || '~neg~' || b.id AS pair_id, a.variants[1] AS a_text, b.variants[1] AS b_text, false AS label, 'same-artifact' AS source FROM g a JOIN g b ON a.item = b.item AND a.pos < b.pos)"
_EASY_N = 60
_EASY_SQL = f"""num AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, id, item, variants[1] AS t, count(*) OVER () AS total FROM g),
easy AS (SELECT a.id || '~xneg~' || b.id AS pair_id, a.t AS a_text, b.t AS b_text, false AS label, 'cross-artifact' AS source
  FROM (SELECT s, {draw_sql('5', 's')} % total AS k, {draw_sql('6', 's')} % total AS l FROM range(0, {2 * _EASY_N}) r(s) CROSS JOIN (SELECT max(total) AS total FROM num)) w
  JOIN num a ON a.k = w.k JOIN num b ON b.k = w.l WHERE a.item <> b.item AND a.id < b.id GROUP BY a.id, b.id, a.t, b.t ORDER BY min(s) LIMIT {_EASY_N})"""


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.gold(gold_defects(spark, sf_dir), 5)


def gold_of_sixty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With at most _EASY_N easy negatives of twice as many draws, which the oracles express."""
    g = gold_defects(spark, sf_dir)
    return sampling.gold_positives(g).unionByName(sampling.gold_hard_negatives(g)).unionByName(sampling.gold_easy_negatives(g, _EASY_N, 5))


def tallies(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source", "label").agg(F.count("*").alias("n"))


@query()
def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_of(spark, sf_dir)


@query()
def gold_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies(gold_of(spark, sf_dir))


@query(f"WITH {_GOLD_SQL}, {_POSITIVE_SQL}, {_HARD_SQL}, {_EASY_SQL} SELECT * FROM pos_ UNION ALL SELECT * FROM hard UNION ALL SELECT * FROM easy")
def gold_pairs_sixty_easy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_of_sixty(spark, sf_dir)


@query(f"WITH {_GOLD_SQL}, {_POSITIVE_SQL}, {_HARD_SQL}, {_EASY_SQL} SELECT source, label, count(*) AS n FROM (SELECT source, label FROM pos_ UNION ALL SELECT source, label FROM hard UNION ALL SELECT source, label FROM easy) GROUP BY ALL")
def gold_tallies_sixty_easy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies(gold_of_sixty(spark, sf_dir))


# contamination ---------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
    s AS (SELECT doc_id, lang, lines, greatest(2, CAST(floor(0.55 * len(lines)) AS INTEGER)) AS k FROM l WHERE len(lines) >= 6),
    p AS (SELECT doc_id, lang, list_filter(lines[k + 1:], lambda x: len(trim(x)) >= 8) AS suffix, lines[1:k] AS head FROM s),
    m AS (SELECT doc_id, lang, len(suffix) AS n, len(list_filter(suffix, lambda x: list_contains(head, x))) AS hits FROM p)
    SELECT doc_id, lang, CAST(n AS INTEGER) AS n, round(CASE WHEN n = 0 THEN NULL ELSE hits / CAST(n AS DOUBLE) END, 6) AS verbatim FROM m"""
)
def verbatim_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a text's later lines that its first 55 % already hold."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", lines.alias("lines")).where(F.size("lines") >= 6)
    d = d.withColumn("k", F.greatest(F.lit(2), F.floor(0.55 * F.size("lines")).cast("int")))
    head = F.slice("lines", F.lit(1), F.col("k"))
    suffix = F.filter(F.slice("lines", F.col("k") + 1, F.size("lines")), lambda x: F.char_length(F.trim(x)) >= 8)
    d = d.select("doc_id", "lang", head.alias("head"), suffix.alias("suffix"))
    hits = F.size(F.filter("suffix", lambda x: F.array_contains("head", x)))
    return rounded(d.select("doc_id", "lang", F.size("suffix").alias("n"), F.try_divide(hits, F.size("suffix")).alias("verbatim")))


_MEM_SQL = "m AS (SELECT lang, source, n_chars, ((doc_id * 37) % 101) / 100e0 AS ratio FROM documents)"


@query(f"WITH {_MEM_SQL} SELECT lang, count(*) AS n, round(avg(ratio), 6) AS mean_ratio, round(corr(ratio, n_chars), 6) AS r, count(*) FILTER (WHERE ratio >= 0.5) AS memorised FROM m GROUP BY GROUPING SETS ((lang), ())")
def contamination_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("lang", "n_chars", (((F.col("doc_id") * 37) % 101) / 100.0).alias("ratio"))
    return rounded(m.rollup("lang").agg(F.count("*").alias("n"), F.avg("ratio").alias("mean_ratio"), F.corr("ratio", F.col("n_chars").cast("double")).alias("r"), F.count_if(F.col("ratio") >= 0.5).alias("memorised")))


@query(
    """WITH a AS (SELECT CASE WHEN d.doc_id % 2 = 0 THEN 'mem' ELSE 'nomem' END AS arm, l.quality AS real, l.toxic AS unsure, 1 + d.doc_id % 3 AS w FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    g AS (SELECT arm, sum(w) AS weight, sum(w * CASE WHEN unsure = 1 THEN 0.5 WHEN real = 1 THEN 1e0 ELSE 0e0 END) AS credit FROM a GROUP BY arm)
    SELECT arm, CAST(weight AS BIGINT) AS weight, round(CAST(credit AS DOUBLE) / weight, 6) AS rho, CASE WHEN CAST(credit AS DOUBLE) / weight - 0.8 > 0.03 THEN 'above' WHEN CAST(credit AS DOUBLE) / weight - 0.8 < -0.03 THEN 'below' ELSE 'level' END AS verdict FROM g"""
)
def adjudicated_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted share of real findings per arm, half credit where unsure, with a verdict band of 0.03."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    a = table(spark, sf_dir, "labels").join(d, "doc_id")
    w = 1 + F.col("doc_id") % 3
    credit = F.when(F.col("toxic") == 1, 0.5).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    arm = F.when(F.col("doc_id") % 2 == 0, "mem").otherwise("nomem")
    g = a.groupBy(arm.alias("arm")).agg(F.sum(w).alias("weight"), F.sum(w * credit).alias("credit"))
    rho = F.col("credit") / F.col("weight")
    verdict = F.when(rho - 0.8 > 0.03, "above").when(rho - 0.8 < -0.03, "below").otherwise("level")
    return rounded(g.select("arm", "weight", rho.alias("rho"), verdict.alias("verdict")))


# drift and rules -------------------------------------------------------------------------------------


def _digest(price):
    return F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.round(price * 100).cast("long").cast("string")))


_DRIFT_SQL = """r AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)) AS old FROM orders WHERE o_orderkey % 97 <> 0),
c AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(CAST(round((o_totalprice + CASE WHEN o_orderkey % 83 = 0 THEN 1 ELSE 0 END) * 100) AS BIGINT) AS VARCHAR)) AS new FROM orders WHERE o_orderkey % 89 <> 0)"""


@query(f"WITH {_DRIFT_SQL} SELECT coalesce(r.path, c.path) AS path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS status FROM r FULL JOIN c ON r.path = c.path WHERE old IS NULL OR new IS NULL OR old <> new")
def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = F.col("o_orderkey").cast("string").alias("path")
    recorded = o.where("o_orderkey % 97 <> 0").select(path, _digest(F.col("o_totalprice")).alias("digest"))
    changed = F.col("o_totalprice") + F.when(F.col("o_orderkey") % 83 == 0, 1).otherwise(0)
    return corpus.drift(recorded, o.where("o_orderkey % 89 <> 0").select(path, _digest(changed).alias("digest")))


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as corpus items, with flaws that follow from their keys."""
    k, n = F.col("p_partkey"), (F.col("p_partkey") % 10).cast("int")
    item_id = F.concat(F.lit("code-"), F.lpad(k.cast("string"), 8, "0"))
    place = F.struct(F.lit("main").alias("unit"), F.lit(1).alias("start"), F.lit(1).alias("end"))

    def defect(i):
        return F.struct(
            F.concat(item_id, F.lit("-"), i.cast("string")).alias("id"), F.when(k % 4 == 0, F.lit("")).otherwise("logic").alias("category"), F.lit("minor").alias("severity"),
            F.concat(F.lit("defect "), i.cast("string")).alias("description"), place.alias("location"), F.col("p_brand").alias("anchor"),
            F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda j: F.concat(F.lit("wording "), j.cast("string"))).alias("paraphrases"), (k % 3 != 0).alias("confirmed"), F.lit("").alias("rationale"),
        )

    source = F.struct(
        F.when(k % 2 == 0, "derived").otherwise("synthetic").alias("origin"), F.when(k % 6 == 0, "GPL-3.0").otherwise("MIT").alias("license"), F.lit("http://x").alias("url"), F.lit("main").alias("source_ref"),
        F.when(k % 5 != 0, "2024-01-01").alias("retrieved"), F.lit("someone").alias("attribution"), F.lit("").alias("notes"),
    )
    zones = F.when(k % 9 == 0, F.array(F.struct(place.alias("location"), F.lit(" ").alias("note"))))
    return table(spark, sf_dir, "part").select(
        item_id.alias("id"), F.when(k % 11 == 0, "other").otherwise("code").alias("type"), item_id.alias("folder"), F.lit("code").alias("type_folder"), F.lit("a.md").alias("artifact_file"),
        F.concat(F.col("p_name"), F.lit("\n"), F.col("p_brand")).alias("artifact"), source.alias("source"), zones.alias("known_gray_zone"),
        F.array(F.struct(F.lit("main").alias("unit"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("").alias("note"))).alias("clean_regions"), (k % 9).cast("int").alias("defect_count"),
        F.when(n == 0, F.array().cast("array<" + _defect_type() + ">")).otherwise(F.transform(F.sequence(F.lit(1), n), defect)).alias("defects"),
    )


def _defect_type() -> str:
    from ..sources.schemas import DEFECT

    return DEFECT


@query(
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 10 AS n FROM part),
    i AS (SELECT 'bad-type' AS code, 'error' AS level, count(*) AS n FROM p WHERE k % 11 = 0
    UNION ALL SELECT 'no-defects', 'error', count(*) FROM p WHERE n = 0 UNION ALL SELECT 'defect-count-band', 'warning', count(*) FROM p WHERE n IN (1, 2, 9)
    UNION ALL SELECT 'defect-count-mismatch', 'error', count(*) FROM p WHERE k % 9 <> n UNION ALL SELECT 'empty-gray-zone-note', 'error', count(*) FROM p WHERE k % 9 = 0
    UNION ALL SELECT 'missing-retrieved', 'warning', count(*) FROM p WHERE k % 2 = 0 AND k % 5 = 0 UNION ALL SELECT 'license-not-allowed', 'error', count(*) FROM p WHERE k % 6 = 0
    UNION ALL SELECT 'missing-category', 'warning', sum(n) FROM p WHERE k % 4 = 0 UNION ALL SELECT 'paraphrase-count', 'warning', sum(n) FROM p WHERE k % 4 IN (0, 3)
    UNION ALL SELECT 'anchor-mismatch', 'error', sum(n) FROM p JOIN part ON p_partkey = k WHERE NOT contains(p_name, p_brand))
    SELECT code, level, CAST(n AS BIGINT) AS n FROM i WHERE n > 0"""
)
def corpus_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import line_map

    items = part_items(spark, sf_dir)
    return corpus.validate(items, line_map(items)).groupBy("code", "level").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS items, CAST(sum(p_partkey % 10) AS BIGINT) AS defects, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 10 ELSE 0 END) AS BIGINT) AS unconfirmed FROM part")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = part_items(spark, sf_dir)
    open_defects = F.size(F.filter("defects", lambda d: ~F.coalesce(d["confirmed"], F.lit(False))))
    return items.agg(F.count("*").alias("items"), F.sum(F.size("defects")).alias("defects"), F.sum(open_defects).alias("unconfirmed"))


@query("SELECT l_returnflag AS arm, CASE WHEN l_returnflag = 'A' THEN 'anthropic' WHEN l_returnflag = 'N' THEN 'openai' ELSE 'unknown' END AS family, CASE WHEN l_returnflag = 'A' THEN 'deepseek' ELSE 'deepseek' END AS judge, count(*) AS n FROM lineitem GROUP BY ALL")
def model_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("l_returnflag") == "A", "claude-x").when(F.col("l_returnflag") == "N", "gpt-y").otherwise("other")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), text.model_family(model).alias("family"), text.rotated_judge(model).alias("judge"))
    return rows.groupBy("arm", "family", "judge").agg(F.count("*").alias("n"))


# intervals and windows -------------------------------------------------------------------------------


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("item"), day.alias("lo"), (day + F.col("o_orderkey") % 60).cast("int").alias("hi"))


_SPAN_SQL = "s AS (SELECT o_custkey AS cust, o_orderkey AS item, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS lo, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 60 AS INTEGER) AS hi FROM orders)"
_MERGED_SQL = f"""{_SPAN_SQL}, b AS (SELECT *, max(hi) OVER (PARTITION BY cust ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE lo < hi),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cust ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM b),
merged AS (SELECT cust, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY cust, island)"""


@query(f"WITH {_MERGED_SQL} SELECT * FROM merged")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(order_spans(spark, sf_dir), ["cust"])


@query(f"WITH {_MERGED_SQL} SELECT cust, CAST(sum(hi - lo) AS BIGINT) AS covered FROM merged GROUP BY cust")
def covered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.total_covered(order_spans(spark, sf_dir), ["cust"])


@query(f"WITH {_SPAN_SQL} SELECT x.cust, x.item AS a, y.item AS b FROM s x JOIN s y ON x.cust = y.cust AND x.item < y.item AND x.lo < y.hi AND y.lo < x.hi AND x.lo < x.hi AND y.lo < y.hi")
def interval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.conflicts(order_spans(spark, sf_dir), ["cust"], "item")


@query(
    f"""WITH RECURSIVE {_SPAN_SQL}, t AS (SELECT cust, lo, hi, row_number() OVER (PARTITION BY cust ORDER BY hi, lo) AS k FROM s WHERE lo < hi),
    pick AS (SELECT cust, k, hi, 1 AS taken, hi AS reach, 1 AS n FROM t WHERE k = 1
      UNION ALL SELECT t.cust, t.k, t.hi, CASE WHEN t.lo >= p.reach THEN 1 ELSE 0 END, CASE WHEN t.lo >= p.reach THEN t.hi ELSE p.reach END, p.n + CASE WHEN t.lo >= p.reach THEN 1 ELSE 0 END FROM pick p JOIN t ON t.cust = p.cust AND t.k = p.k + 1)
    SELECT cust, max(n) AS n_picked FROM pick GROUP BY cust"""
)
def non_overlapping_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = intervals.select_non_overlapping(order_spans(spark, sf_dir), ["cust"])
    return picked.groupBy("cust").agg(F.count("*").cast("int").alias("n_picked"))


_DAY = 86_400_000_000
_ROLL = "OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, value FROM events), w AS (SELECT event_id, user_id, count(value) {_ROLL.format(_DAY - 1)} AS n, sum(value) {_ROLL.format(_DAY - 1)} AS total, avg(value) {_ROLL.format(_DAY - 1)} AS mean,
    min(value) {_ROLL.format(_DAY - 1)} AS low, max(value) {_ROLL.format(_DAY - 1)} AS high FROM e)
    SELECT event_id, user_id, n, round(total, 9) AS total, round(mean, 9) AS mean, low, high, round(high - low, 9) AS span FROM w"""
)
def rolling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling.rolling_stats(_events(spark, sf_dir), ["user_id"], "t", "value", _DAY)
    return out.select("event_id", "user_id", "n", F.round("total", 9).alias("total"), F.round("mean", 9).alias("mean"), "low", "high", F.round("span", 9).alias("span"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, value FROM events)
    SELECT event_id, round(quantile_cont(value, 0.5) {_ROLL.format(_DAY - 1)}, 6) AS median, round(quantile_cont(value, 0.95) {_ROLL.format(_DAY - 1)}, 6) AS p95 FROM e"""
)
def rolling_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling.rolling_percentiles(_events(spark, sf_dir), ["user_id"], "t", "value", _DAY, {"median": 0.5, "p95": 0.95})
    return rounded(out.select("event_id", "median", "p95"))


@query("SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def value_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.snapshot(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query(
    """WITH e AS (SELECT event_type, value - 50 AS d, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i FROM events WHERE value IS NOT NULL AND value <> 50),
    w AS (SELECT a.event_type, (a.d + b.d) / 2 AS walsh FROM e a JOIN e b ON a.event_type = b.event_type AND a.i <= b.i),
    r AS (SELECT event_type, walsh, row_number() OVER (PARTITION BY event_type ORDER BY walsh) AS r, CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE) AS m FROM w),
    n AS (SELECT *, (sqrt(8 * m + 1) - 1) / 2 AS n FROM r),
    k AS (SELECT *, greatest(1, least(round_even(m / 2 - 1.959964 * sqrt(n * (n + 1) * (2 * n + 1) / 24), 0), floor(m / 2))) AS k FROM n)
    SELECT event_type, round((max(CASE WHEN r = floor((m + 1) / 2) THEN walsh END) + max(CASE WHEN r = floor(m / 2) + 1 THEN walsh END)) / 2, 6) AS estimate,
           round(max(CASE WHEN r = k THEN walsh END), 6) AS ci_low, round(max(CASE WHEN r = m + 1 - k THEN walsh END), 6) AS ci_high FROM k GROUP BY event_type"""
)
def value_pseudo_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hodges-Lehmann shift of an event type's values from 50, with its interval: a few keys that hold all rows."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") - 50).alias("d"))
    return rounded(walsh.hodges_lehmann(e, ["event_type"], "d"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source if _is_folder(spark, source) else f"{sf_dir}/events*.parquet")
    out = stateful.collected(stateful.windowed(stream, ["event_type"], "value", "1 day", late="40 days"), "complete", f"windows_{uuid.uuid4().hex}")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# paging, graphs, files -------------------------------------------------------------------------------


@query("WITH r AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS position, count(*) OVER () AS n FROM part WHERE p_retailprice > 950 OR (p_retailprice = 950 AND p_partkey > 500)) SELECT p_partkey, p_retailprice, CAST(position AS INTEGER) AS position, n > 20 AS has_more, (SELECT count(*) FROM part) AS total FROM r WHERE position <= 20")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paging.page(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 20, (950.0, 500))
    return p.select("p_partkey", "p_retailprice", "position", "has_more", "total")


@query("SELECT p_partkey, p_retailprice AS k, p_partkey AS t FROM part")
def cursor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = paging.encode_cursor(F.col("p_retailprice"), F.col("p_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", paging.decode_cursor(token, "struct<k:double,t:bigint>").alias("c"))
    return p.select("p_partkey", "c.k", "c.t")


@query("WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 2 AS dep FROM part WHERE p_partkey // 2 > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey // 3 > 0), l AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT node FROM e) UNION SELECT e.node, l.level + 1 FROM l JOIN e ON e.dep = l.node) SELECT node, max(level) AS level FROM l GROUP BY node")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    half, third = (n.select("node", F.floor(F.col("node") / k).alias("dep")).where("dep > 0") for k in (2, 3))
    dep = half.unionByName(third)
    return graphs.levels(n, dep.join(n.withColumnRenamed("node", "dep"), "dep", "left_semi").select("node", "dep"))


@query("SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS label, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("label"), "c_acctbal")
    line = F.to_csv(F.struct("c_custkey", "label", "c_acctbal"), {"escape": '"', "quote": '"'})
    back = F.from_csv(line, F.lit("c_custkey bigint, label string, c_acctbal double"), {"escape": '"', "quote": '"'})
    return c.select(back.alias("r")).select("r.*")


_CRON = "*/15 8-17 * * 1-5"


@query("SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5")
def cron_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(schedule.Cron.parse(_CRON).matches(F.col("ts"))).select("event_id")


@query(
    """SELECT event_id, min(c) AS next_run FROM (SELECT event_id, ts, date_trunc('day', ts) + to_days(CAST(d AS INTEGER)) + to_minutes(h * 60 + q * 15) AS c FROM events CROSS JOIN range(0, 5) a(d) CROSS JOIN range(8, 18) b(h) CROSS JOIN range(0, 4) e(q))
    WHERE c > ts AND dayofweek(c) BETWEEN 1 AND 5 GROUP BY event_id"""
)
def cron_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", schedule.Cron.parse(_CRON).next_after(F.col("ts"), 14).alias("next_run"))


@query(
    """SELECT event_id, CAST(position - 1 AS INTEGER) AS position, c AS at FROM (SELECT event_id, c, row_number() OVER (PARTITION BY event_id ORDER BY c) AS position
    FROM (SELECT event_id, ts, date_trunc('day', ts) + to_days(CAST(d AS INTEGER)) + to_minutes(h * 60 + q * 15) AS c FROM events CROSS JOIN range(0, 5) a(d) CROSS JOIN range(8, 18) b(h) CROSS JOIN range(0, 4) e(q))
    WHERE c > ts AND dayofweek(c) BETWEEN 1 AND 5) WHERE position <= 5"""
)
def cron_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.posexplode(schedule.Cron.parse(_CRON).upcoming(F.col("ts"), 5, 14)).alias("position", "at"))


@query("SELECT p_partkey // 40 AS graph, p_partkey AS node, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS position FROM part")
def topological_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in many small graphs whose nodes depend on the halves and thirds of their offsets."""
    n = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 40).alias("graph"), F.col("p_partkey").alias("node"))
    low = F.greatest(F.col("graph") * 40, F.lit(1))  # keys start at 1
    half, third = (n.select("graph", "node", (low + F.floor((F.col("node") - low) / k)).alias("dep")).where("dep < node") for k in (2, 3))
    return graphs.topological_orders(n.withColumn("dep", F.lit(None).cast("bigint")).unionByName(half).unionByName(third), "graph")


@query(
    """WITH v AS (SELECT p_type, p_partkey, p_partkey % 4 AS a, p_partkey % 10 AS b, p_partkey % 7 AS c, CASE WHEN p_partkey % 5 = 0 THEN 'rc.' || (p_partkey % 3) END AS pre FROM part),
    s AS (SELECT *, pre IS NULL AND ((a = 1 AND (b > 2 OR b = 2 AND c >= 0)) OR (a = 2 AND b = 3)) AS ok FROM v)
    SELECT p_partkey, ok FROM s"""
)
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("p_partkey", versions.satisfies(versions.parse(F.col("version")), "^1.2.0 || ~2.3").alias("ok"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    core = F.concat_ws(".", *[(k % m).cast("string") for m in (4, 10, 7)])
    version = F.when(k % 5 == 0, F.concat(core, F.lit("-rc."), (k % 3).cast("string"))).otherwise(core)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", version.alias("version"))


@query("SELECT p_brand, (list(v ORDER BY a DESC, b DESC, c DESC))[1] AS best FROM (SELECT p_brand, p_partkey % 4 AS a, p_partkey % 10 AS b, p_partkey % 7 AS c, (p_partkey % 4) || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) AS v FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 4 >= 1) GROUP BY p_brand")
def best_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).groupBy("p_brand").agg(versions.max_satisfying(F.col("version"), ">=1.0.0").alias("best"))


# limits ----------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t, event_id FROM events), l AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) < 3600000000, false) AS hit FROM e) SELECT user_id, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM l GROUP BY user_id")
def ttl_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiters.ttl_hits(_events(spark, sf_dir), "user_id", "event_type", "t", 3_600_000_000)


@query()
def lru_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("seconds", F.col("t") / 1e6)
    return rounded(limiters.cache_replay(e, "user_id", "event_type", "seconds", 3, 86_400.0, ("event_id",)))


@query()
def token_bucket_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("seconds", F.col("t") / 1e6)
    out = limiters.rate_limit(e, "user_id", "seconds", 3.0, 1 / 43_200, 5.0, order=("event_id",))
    return out.groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


@query("SELECT i AS retry, round(least(30e0, 0.1e0 * pow(2e0, i - 1)), 6) AS delay FROM range(1, 13) t(i)")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.range(1, 13).select(F.col("id").alias("retry"), limiters.backoff(F.col("id")).alias("delay")))


@query(
    """WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS failed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt FROM orders),
    b AS (SELECT *, coalesce(min(CAST(failed AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS so_far FROM a)
    SELECT o_custkey, o_orderkey, CAST(attempt AS INTEGER) AS attempt, round(CASE attempt WHEN 1 THEN 0e0 WHEN 2 THEN 0.1e0 ELSE 0.2e0 END, 6) AS delay FROM b WHERE attempt <= 3 AND so_far = 1"""
)
def retried_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("failed"))
    return rounded(limiters.retry_schedule(a, "failed", "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "attempt", "delay"))


@query()
def token_bucket_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each user's bucket after all events, with other limits for every tenth user."""
    e = _events(spark, sf_dir).withColumn("seconds", F.col("t") / 1e6)
    users = e.select(F.col("user_id").alias("key")).distinct().where("key % 10 = 0")
    limits = users.select("key", F.lit(1.0).alias("capacity"), F.lit(None).cast("double").alias("refill"), F.lit(2.0).alias("burst"))
    decided = limiters.rate_limit(e, "user_id", "seconds", 3.0, 1 / 43_200, 5.0, order=("event_id",), limits=limits)
    return rounded(limiters.bucket_levels(decided, 1_800_000_000.0, 3.0, 1 / 43_200, 5.0, limits).withColumnRenamed("key", "user_id"))


# services --------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 90 WHEN 1 THEN (event_id % 70) + 0.5 END AS DOUBLE) AS delay FROM events"""
)
def suggested_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits that responses ask for: a header, a JSON body, a date (no number) or nothing."""
    kind = F.col("event_id") % 4
    header = F.when(kind == 0, F.concat(F.lit(" "), (F.col("event_id") % 90).cast("string"))).when(kind == 2, F.lit("Wed, 21 Oct 2015 07:28:00 GMT"))
    body = F.when(kind == 1, F.concat(F.lit('{"retryDelay" : "'), (F.col("event_id") % 70).cast("string"), F.lit('.5s"}'))).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", text.suggested_delay(header, body).alias("delay"))


@query("SELECT count(*) AS pairs, count(*) FILTER (WHERE lo <> hi) AS unstable, round(avg(CASE WHEN lo <> hi THEN 1e0 ELSE 0e0 END), 6) AS share FROM (SELECT user_id, min(value >= 50) AS lo, max(value >= 50) AS hi FROM events WHERE value IS NOT NULL GROUP BY user_id)")
def judge_self_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("pair_key"), (F.col("value") >= 50).alias("same"))
    return rounded(judging.self_agreement(v))


# prompts ---------------------------------------------------------------------------------------------

_PLACE_SQL = "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS unit, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 7 AS INTEGER) END AS s, CASE WHEN event_id % 3 = 2 THEN CAST(event_id % 7 + event_id % 2 AS INTEGER) END AS e FROM events"


@query(
    f"""WITH p AS ({_PLACE_SQL}), q AS (SELECT *, CASE WHEN s IS NULL THEN '' WHEN e IS NULL OR e = s THEN ':' || s ELSE ':' || s || '-' || e END AS span FROM p)
    SELECT event_id, CASE WHEN unit IS NULL THEN '' ELSE unit || span END AS place, coalesce(unit, '') || CASE WHEN s IS NULL THEN '' ELSE ':' || s || CASE WHEN e IS NULL THEN '' ELSE '-' || e END END AS sheet,
    CASE WHEN unit IS NULL AND s IS NULL THEN 'unlocalized' WHEN unit IS NULL THEN '' ELSE unit || span END AS prompt FROM q"""
)
def rendered_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    n = (e % 7).cast("int")
    unit, start, end = F.when(e % 5 > 0, F.col("event_type")), F.when(e % 3 > 0, n), F.when(e % 3 == 2, (n + e % 2).cast("int"))
    forms = (text.location_text(unit, start, end).alias("place"), text.sheet_location_text(unit, start, end).alias("sheet"), text.prompt_location_text(unit, start, end).alias("prompt"))
    return table(spark, sf_dir, "events").select("event_id", *forms)


@query(
    """WITH b AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark WHERE item_id IS NOT NULL),
    l AS (SELECT item_id, t, array_to_string(list_transform(string_split(t, chr(10)), lambda x, i: lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || x), chr(10)) AS body FROM b)
    SELECT item_id, sha1(CASE WHEN item_id % 2 = 0 THEN 'File under review: src/i' || item_id || '.py' || chr(10) || '(line numbers are shown at the left; cite them in your findings)' || chr(10) || chr(10) || body ELSE t END) AS view_sha1,
    sha1('--- ARTIFACT ---' || chr(10) || t || chr(10) || '--- END ARTIFACT ---' || chr(10) || chr(10) || '--- REVIEW ---' || chr(10) || 'ok' || chr(10) || '--- END REVIEW ---' || chr(10) || chr(10) || 'Return the JSON array of findings.') AS prompt_sha1 FROM l"""
)
def review_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as a reviewer sees them (even ones are code, shown from their diff) and the request to extract findings."""
    t = F.coalesce("text", F.lit(""))
    code = F.col("item_id") % 2 == 0
    diff = text.new_file_diff(F.concat(F.lit("src/i"), "item_id", F.lit(".py")), t)
    view = text.review_view(F.when(code, "code").otherwise("paper"), F.when(code, diff).otherwise(t))
    b = table(spark, sf_dir, "benchmark").where("item_id is not null")
    return b.select("item_id", F.sha1(view).alias("view_sha1"), F.sha1(text.extraction_prompt(t, F.lit("ok"))).alias("prompt_sha1"))
