"""Queries over texts: surface forms, identities, pair decisions, assignment, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import location, stats, text
from ..operators import claims, matching, ranks, ratio_join, reports
from ..session import table
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


def query_and_by_sets(oracle: str):
    """Registers f with the whole similarity, and as <name>_by_sets without the word ratio, which SQL lacks."""

    def register(f):
        def by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir, full=False)

        by_sets.__name__ = by_sets.__qualname__ = f"{f.__name__}_by_sets"
        by_sets.__doc__ = f.__doc__
        QUERIES[f.__name__] = f
        query(oracle)(by_sets)
        return f

    return register


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _content(column: str) -> str:
    return f"list_filter(list_distinct({_TOKENS.format(column)}), lambda x: NOT list_contains({_STOP}, x))"


@query(f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS INTEGER) AS n_tokens, CAST(len({_content('text')}) AS INTEGER) AS n_content, sha1(array_to_string({_TOKENS.format('text')}, ' ')) AS normalized_sha1 FROM documents")
def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"), F.size(text.content_tokens(F.col("text"))).alias("n_content"), F.sha1(text.normalize(F.col("text"))).alias("normalized_sha1"))


@query(
    f"""WITH f AS (SELECT doc_id, substr(sha1(array_to_string({_TOKENS.format('text')}, ' ') || '␟' || lower(trim(source))), 1, 16) AS fp FROM documents)
    SELECT doc_id, fp, least(fp, min(fp) OVER (PARTITION BY 1)) || ':' || greatest(fp, min(fp) OVER (PARTITION BY 1)) AS key_with_least, 'r' || substr(sha1(CAST(doc_id AS VARCHAR) || '|' || fp), 1, 10) AS row_id FROM f"""
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text"), F.col("source")).alias("fp"))
    least = d.agg(F.min("fp").alias("least"))  # one row
    d = d.crossJoin(F.broadcast(least))
    return d.select("doc_id", "fp", text.pair_key(F.col("fp"), F.col("least")).alias("key_with_least"), text.row_id(F.col("doc_id").cast("string"), F.col("fp")).alias("row_id"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as findings: unit is the turn's parity, its span [turn, turn + 1]."""
    c = table(spark, sf_dir, "conversations")
    place = F.struct(F.concat(F.lit("u"), (F.floor(F.col("turn") / 4) % 2).cast("string")).alias("unit"), F.col("turn").cast("int").alias("start"), (F.col("turn") + 1).cast("int").alias("end"))
    return c.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text", place.alias("location"))


def claim_pairs_of(spark: SparkSession, sf_dir: str, full: bool = True, need: ratio_join.Need = ratio_join.for_decision) -> DataFrame:
    """Assistant turns x user turns of a conversation (an equi-join on the conversation), similar as far as need asks."""
    t = turns(spark, sf_dir)

    def side(role: str, s: str) -> DataFrame:
        of = t.where(F.col("role") == role).select("conv_id", *[F.col(c).alias(f"{c}_{s}") for c in ("turn", "text", "location")])
        return ratio_join.with_profile(of, f"text_{s}", s)

    pairs = side("assistant", "a").join(side("user", "b"), "conv_id")
    pairs = pairs.withColumn("loc", location.compatibility(F.col("location_a"), F.col("location_b")))
    keys = [text.fingerprint(F.col(f"text_{s}"), F.col(f"location_{s}.unit")) for s in "ab"]
    pairs = pairs.withColumn("pair_key", text.pair_key(*keys)).withColumn("label", F.col("turn_a") == F.col("turn_b") + 1)
    return ratio_join.settle(pairs, need if full else None)


_PAIRS_SQL = f"""t AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text, 'u' || ((turn // 4) % 2) AS unit, {_content('text')} AS tok FROM conversations),
p AS (SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, len(a.tok) AS na, len(b.tok) AS nb, len(list_intersect(a.tok, b.tok)) AS both_,
             CASE WHEN a.unit <> b.unit THEN 'disjoint' WHEN a.turn <= b.turn + 1 AND b.turn <= a.turn + 1 THEN 'same' ELSE 'disjoint' END AS loc, a.turn = b.turn + 1 AS label
      FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.role = 'assistant' AND b.role = 'user'),
s AS (SELECT *, CASE WHEN na = 0 OR nb = 0 THEN 0e0 ELSE both_ / CAST(na + nb - both_ AS DOUBLE) END AS jac, CASE WHEN na = 0 OR nb = 0 THEN 0e0 ELSE 0.85e0 * (both_ / CAST(least(na, nb) AS DOUBLE)) END AS over_ FROM p),
q AS (SELECT *, greatest(jac, over_) AS sim FROM s)"""
_DECIDED_SQL = _PAIRS_SQL + """, decided AS (SELECT *, CASE WHEN loc = 'disjoint' AND sim <= 0.25 THEN 'anchor-disjoint' WHEN loc <> 'disjoint' AND sim >= 0.60 AND jac >= 0.60 THEN 'lexical-high' ELSE 'judge' END AS method FROM q),
verdicts AS (SELECT *, CASE method WHEN 'anchor-disjoint' THEN false WHEN 'lexical-high' THEN true ELSE jac >= 0.34 END AS same FROM decided)"""


@query_and_by_sets(f"WITH {_PAIRS_SQL} SELECT conv_id, turn_a, turn_b, loc, round(jac, 9) AS jac, round(sim, 9) AS sim FROM q")
def claim_pairs(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    return rounded(claim_pairs_of(spark, sf_dir, full, ratio_join.for_similarity).select("conv_id", "turn_a", "turn_b", "loc", "jac", "sim"), 9)


@query_and_by_sets(f"WITH {_DECIDED_SQL} SELECT conv_id, turn_a, turn_b, method, same FROM verdicts")
def staged_decisions(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    return matching.decide(claim_pairs_of(spark, sf_dir, full)).select("conv_id", "turn_a", "turn_b", "method", "same")


_KEYED_SQL = f"""{_DECIDED_SQL}, k AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, substr(sha1(array_to_string({_TOKENS.format('text')}, ' ') || '␟' || 'u' || ((turn // 4) % 2)), 1, 16) AS fp FROM conversations),
keyed AS (SELECT v.*, least(x.fp, y.fp) || ':' || greatest(x.fp, y.fp) AS pair_key FROM verdicts v JOIN k x ON x.conv_id = v.conv_id AND x.turn = v.turn_a JOIN k y ON y.conv_id = v.conv_id AND y.turn = v.turn_b)"""


@query_and_by_sets(f"WITH {_KEYED_SQL} SELECT conv_id, turn_a, turn_b, 'cache' AS method, first_value(same) OVER (PARTITION BY pair_key ORDER BY conv_id, turn_a, turn_b) AS same FROM keyed")
def cached_decisions(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    """A second pass over the same pairs with the first pass's verdicts as the cache: warm equals cold."""
    pairs = claim_pairs_of(spark, sf_dir, full)
    cold = matching.decide(pairs)
    empty = cold.select("pair_key", "same").limit(0)
    cache = matching.new_verdicts(cold, empty, ["conv_id", "turn_a", "turn_b"])
    return matching.decide(pairs, cache=cache).select("conv_id", "turn_a", "turn_b", "method", "same")


@query()
def full_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = claim_pairs_of(spark, sf_dir, need=ratio_join.for_both_similarities)
    return rounded(matching.decide(pairs).select("conv_id", "turn_a", "turn_b", "sim", "symmetric", "method", "same"))


_BAGS_SQL = f"""w AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, unnest({_TOKENS.format('text')}) AS tok FROM conversations),
c AS (SELECT conv_id, turn, tok, count(*) AS k FROM w GROUP BY ALL), m AS (SELECT conv_id, turn, sum(k) AS n FROM c GROUP BY ALL),
o AS (SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, sum(least(a.k, b.k)) AS shared FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.tok = b.tok GROUP BY ALL),
b AS (SELECT q.*, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 1e0 ELSE 2 * coalesce(shared, 0) / CAST(coalesce(x.n, 0) + coalesce(y.n, 0) AS DOUBLE) END AS bound, coalesce(shared, 0) AS shared, coalesce(x.n, 0) AS wa, coalesce(y.n, 0) AS wb
      FROM q LEFT JOIN m x ON x.conv_id = q.conv_id AND x.turn = q.turn_a LEFT JOIN m y ON y.conv_id = q.conv_id AND y.turn = q.turn_b LEFT JOIN o ON o.conv_id = q.conv_id AND o.turn_a = q.turn_a AND o.turn_b = q.turn_b),
s2 AS (SELECT *, NOT (bound = 0 OR (shared <= 1 AND wb < 200 AND wa > 0)) AND CASE WHEN loc = 'disjoint' THEN sim <= 0.25 AND bound > 0.25 ELSE jac < 0.60 AND bound >= 0.60 END AS asked FROM b)"""


@query(f"WITH {_PAIRS_SQL}, {_BAGS_SQL} SELECT count(*) AS pairs, count(*) FILTER (WHERE asked) AS asked FROM s2")
def ratio_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all claim pairs, those whose stage depends on the word ratio: the only ones that reach Python."""
    return claim_pairs_of(spark, sf_dir).agg(F.count("*").alias("pairs"), F.count_if("asked").alias("asked"))


_GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.42)
_GRID_SQL = ", ".join(f"({t})" for t in _GRID)
_PR_SQL = """round(p, 6) AS precision_, round(r, 6) AS recall_, round(CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(coalesce((tp + tn) / CAST(nullif(tp + fp + fn + tn, 0) AS DOUBLE), 1e0), 6) AS accuracy"""
_PR_PARTS = "coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 1e0) AS p, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 1e0) AS r"
_CONFUSION = "count(*) AS n, count(*) FILTER (WHERE {0} AND {1}) AS tp, count(*) FILTER (WHERE {0} AND NOT {1}) AS fp, count(*) FILTER (WHERE NOT {0} AND {1}) AS fn, count(*) FILTER (WHERE NOT {0} AND NOT {1}) AS tn"


def confusion(df: DataFrame, keys: list[str], said, truth) -> DataFrame:
    """keys with n, tp, fp, fn, tn, precision_, recall_, f1 and accuracy."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(said & truth).alias("tp"), F.count_if(said & ~truth).alias("fp"), F.count_if(~said & truth).alias("fn"), F.count_if(~said & ~truth).alias("tn")
    )
    return with_precision(out)


def with_precision(out: DataFrame) -> DataFrame:
    pr = stats.precision_recall(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return out.select("*", pr["precision"].alias("precision_"), pr["recall"].alias("recall_"), pr["f1"].alias("f1"), pr["accuracy"].alias("accuracy"))


@query_and_by_sets(f"WITH {_PAIRS_SQL}, c AS (SELECT tau, {_CONFUSION.format('(sim >= tau)', 'label')} FROM q CROSS JOIN (VALUES {_GRID_SQL}) g(tau_) CROSS JOIN LATERAL (SELECT CAST(tau_ AS DOUBLE) AS tau) GROUP BY tau), d AS (SELECT *, {_PR_PARTS} FROM c) SELECT tau, n, tp, fp, fn, tn, {_PR_SQL} FROM d")
def threshold_sensitivity(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    pairs = claim_pairs_of(spark, sf_dir, full, ratio_join.for_thresholds(*_GRID))
    said, truth = [F.col("sim") >= tau for tau in _GRID], F.col("label")
    counts = [
        F.struct(F.lit(tau).alias("tau"), F.count("*").alias("n"), F.count_if(yes & truth).alias("tp"), F.count_if(yes & ~truth).alias("fp"), F.count_if(~yes & truth).alias("fn"), F.count_if(~yes & ~truth).alias("tn"))
        for tau, yes in zip(_GRID, said)
    ]
    by_tau = pairs.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*").where("n > 0")
    return rounded(with_precision(by_tau))


@query_and_by_sets(f"WITH {_DECIDED_SQL}, c AS (SELECT method, {_CONFUSION.format('same', 'label')} FROM verdicts GROUP BY method), d AS (SELECT *, {_PR_PARTS} FROM c) SELECT method, n, tp, fp, fn, tn, {_PR_SQL} FROM d")
def matcher_report(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    return rounded(confusion(matching.decide(claim_pairs_of(spark, sf_dir, full)), ["method"], F.col("same"), F.col("label")))


_PLACE = "struct<unit: string, start: int, end: int>"


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document as findings of a run: its place is its number, in the unit of its language."""
    return zoned_findings(spark, sf_dir).drop("zones")


def zoned_findings(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Findings with one gray zone a run: its first sentences, noted by the first. Where dealt, documents are shuffled by
    their id before they are split, so that runs are spread over all tasks and need no shuffle of their findings."""
    d = table(spark, sf_dir, "documents")
    d = (d.repartition("doc_id") if dealt else d).select("doc_id", "lang", F.split(F.replace("text", F.lit("\n"), F.lit(". ")), r"\. ").alias("said"))
    zone = F.struct(F.lit("en").alias("unit"), F.lit(0).alias("start"), F.lit(2).alias("end")).cast(_PLACE)
    zones = F.array(F.struct(zone.alias("location"), F.get("said", F.lit(0)).alias("note"))).alias("zones")
    s = d.select("doc_id", "lang", F.size("said").alias("n"), zones, F.posexplode("said").alias("finding", "claim"))
    place = F.when(F.col("lang").isNotNull(), F.struct(F.col("lang").alias("unit"), F.col("finding").alias("start"), (F.col("finding") + 1).alias("end")))
    return s.select("doc_id", "finding", "claim", place.cast(_PLACE).alias("location"), F.floor(F.col("finding") * 6 / F.col("n")).cast("int").alias("round"), "zones")


def defects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as defects of all runs: a passage, and as paraphrases its sentences, anywhere in the unit en."""
    place = F.struct(F.lit("en").alias("unit"), F.lit(None).alias("start"), F.lit(None).alias("end")).cast(_PLACE)
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("int").alias("defect"), F.col("text").alias("description"), F.split(F.replace("text", F.lit("\n"), F.lit(". ")), r"\. ").alias("paraphrases"), place.alias("location"))


def edges_of(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    """Findings linked to defects that the staged decision calls the same, scored by the best wording."""
    return claims.finding_scores(findings_of(spark, sf_dir), defects_of(spark, sf_dir), [], full, run=("doc_id",))


_EDGES_SQL = f"""f0 AS (SELECT doc_id, lang, unnest(string_split(replace(text, chr(10), '. '), '. ')) AS claim, unnest(range(len(string_split(replace(text, chr(10), '. '), '. ')))) AS finding FROM documents),
f AS (SELECT doc_id, CAST(finding AS INTEGER) AS finding, lang, {_content('claim')} AS tok FROM f0),
d0 AS (SELECT CAST(item_id AS INTEGER) AS defect, unnest(list_concat([text], string_split(replace(text, chr(10), '. '), '. '))) AS wording, unnest(range(1 + len(string_split(replace(text, chr(10), '. '), '. ')))) AS w FROM benchmark),
d AS (SELECT defect, w, {_content('wording')} AS tok FROM d0 WHERE wording IS NOT NULL),
sh AS (SELECT x.doc_id, x.finding, y.defect, y.w, count(*) AS both_ FROM (SELECT doc_id, finding, unnest(tok) AS t FROM f) x JOIN (SELECT defect, w, unnest(tok) AS t FROM d) y USING (t) GROUP BY ALL),
s AS (SELECT sh.*, both_ / CAST(len(f.tok) + len(d.tok) - both_ AS DOUBLE) AS jac, 0.85e0 * (both_ / CAST(least(len(f.tok), len(d.tok)) AS DOUBLE)) AS over_, coalesce(lang <> 'en', false) AS apart FROM sh JOIN f USING (doc_id, finding) JOIN d USING (defect, w)),
e AS (SELECT doc_id, finding, defect, max(greatest(jac, over_)) AS score FROM s WHERE CASE WHEN apart AND greatest(jac, over_) <= 0.25 THEN false WHEN NOT apart AND greatest(jac, over_) >= 0.60 AND jac >= 0.60 THEN true ELSE jac >= 0.34 END GROUP BY ALL)"""


@query_and_by_sets(f"WITH {_EDGES_SQL} SELECT doc_id, finding, defect, round(score, 9) AS score FROM e")
def decided_edges(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    return rounded(edges_of(spark, sf_dir, full), 9)


@query_and_by_sets(f"WITH {_EDGES_SQL} SELECT doc_id, finding, round(score, 9) AS score, defect FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, finding ORDER BY score DESC, defect DESC) AS k FROM e) WHERE k = 1")
def many_to_one_matches(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    return rounded(matching.best_edges(edges_of(spark, sf_dir, full), ["doc_id"]), 9)


@query()
def one_to_one_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.assign(edges_of(spark, sf_dir), ["doc_id"])


def judged_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zoned_findings(spark, sf_dir)
    found = found.withColumn("gray", matching.gray_flag(found)).drop("zones")
    return matching.dispositions(found, edges_of(spark, sf_dir), ["doc_id"])


@query()
def ground_truth_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_of(spark, sf_dir).select("doc_id", "finding", "defect", "disposition")


@query(f"WITH {_EDGES_SQL} SELECT doc_id, count(DISTINCT finding) AS edged, count(DISTINCT defect) AS reached FROM e GROUP BY doc_id")
def reached_defects_by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run, the findings that are some defect and the defects that are found at all."""
    return edges_of(spark, sf_dir, full=False).groupBy("doc_id").agg(F.count_distinct("finding").alias("edged"), F.count_distinct("defect").alias("reached"))


@query()
def missed_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defects that no run's assignment takes."""
    return matching.missed(defects_of(spark, sf_dir).select("defect"), judged_of(spark, sf_dir), [])


@query()
def canonical_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged_of(spark, sf_dir).select(F.col("doc_id").alias("run_id"), "round", "finding", F.col("defect").cast("string").alias("defect_id"), "disposition", "claim", "location")
    return matching.canonical_runs(j)


@query()
def gray_policy_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamics per gray policy, each from dispositions and canonical runs of its own; a run's defects are those it reaches."""
    found = zoned_findings(spark, sf_dir, dealt=True).withColumn("run_id", F.col("doc_id"))
    edges = edges_of(spark, sf_dir)
    reached = edges.groupBy("doc_id").agg(F.count_distinct("defect").cast("int").alias("n"))
    runs = table(spark, sf_dir, "documents").select("doc_id", "source").join(reached, "doc_id", "left")
    runs = runs.select(F.col("doc_id").alias("run_id"), F.coalesce("source", F.lit("")).alias("arm"), F.coalesce("n", F.lit(0)).alias("n_defects"))
    return rounded(reports.policy_table(found, edges, ["doc_id"], runs))


@query()
def ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rounds: a turn's lines are new claims; odd turns retire the first ledger item."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    claims = F.transform(lines, lambda x: F.struct(x.alias("claim"), F.col("location").alias("location")))
    rounds = turns(spark, sf_dir).select(F.col("conv_id").alias("run_id"), F.col("turn").alias("round"), F.when(F.col("turn") % 2 == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("retired"), claims.alias("claims"))
    out = matching.ledger_rounds(rounds)
    return out.select("run_id", "round", F.size("ledger").alias("n_ledger"), "retired", "added")


@query("SELECT conv_id, CAST(turn AS INTEGER) AS turn, CASE WHEN role = 'user' THEN true WHEN role = 'assistant' THEN false END AS verdict, CAST(len(text) AS INTEGER) AS n_chars FROM conversations")
def parsed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made from turns: the verdict on the first line, in prose, or both named."""
    reply = F.when(F.col("role") == "user", F.concat(F.lit("- **same**\n"), "text")).when(F.col("role") == "assistant", F.concat(F.lit("1. Different."), F.lit("\n"), "text")).otherwise(F.lit("either SAME or DIFFERENT"))
    return turns(spark, sf_dir).select("conv_id", "turn", text.parse_verdict(reply).alias("verdict"), F.char_length("text").alias("n_chars"))


@query("SELECT conv_id, CAST(turn AS INTEGER) AS turn, 'r' || turn || '-f0' AS id, trim(text) AS claim, role AS unit, CAST(turn AS INTEGER) AS start_, 'minor' AS severity FROM conversations WHERE trim(text) <> ''")
def parsed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor replies made from turns: a fenced array of one record, with prose around it."""
    t = turns(spark, sf_dir)
    record = F.to_json(F.array(F.struct(F.trim("text").alias("claim"), F.col("role").alias("unit"), F.col("turn").cast("string").alias("start"), F.lit("Odd").alias("severity"))))
    reply = F.concat(F.lit("Found:\n```json\n"), record, F.lit("\n```"))
    f = t.select("conv_id", "turn", F.explode(text.parse_findings(reply, F.col("turn"))).alias("f"))
    return f.select("conv_id", "turn", "f.id", "f.claim", F.col("f.location.unit").alias("unit"), F.col("f.location.start").alias("start_"), "f.severity")


@query("SELECT role, count(*) AS n, round(avg(len(text)), 6) AS mean_chars, round(quantile_cont(len(text), 0.5), 6) AS median_chars, CAST(max(len(text)) AS INTEGER) AS max_chars, round(avg(CASE WHEN len(text) >= 0.95 * top THEN 1e0 ELSE 0e0 END), 6) AS share_near_max FROM (SELECT *, max(len(text)) OVER (PARTITION BY role) AS top FROM conversations) GROUP BY role")
def review_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select("role", F.char_length("text").alias("n"))
    top = t.groupBy("role").agg(F.max("n").alias("top"))
    t = t.join(top, "role")
    return rounded(t.groupBy("role").agg(F.count("*").alias("n"), F.avg("n").alias("mean_chars"), F.percentile("n", F.lit(0.5)).alias("median_chars"), F.max("n").alias("max_chars"), F.avg(F.when(F.col("n") >= 0.95 * F.col("top"), 1.0).otherwise(0.0)).alias("share_near_max")))


@query()
def review_length_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank p of the mean lengths of a conversation's two roles, for even and odd conversations."""
    n = F.char_length("text")
    mean = lambda role: F.avg(F.when(F.col("role") == role, n))
    per = turns(spark, sf_dir).groupBy("conv_id").agg((mean("user") - mean("assistant")).alias("diff"))
    half = F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")
    return rounded(ranks.wilcoxon(per.withColumn("half", half), ["half"], "diff"))


# agreement of two raters over labels -----------------------------------------------------------------

_RATED_SQL = "r AS (SELECT l.doc_id, d.lang, d.source, l.quality = 1 AS a, l.toxic = 0 AS b, d.n_chars > 1000 AS c FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return l.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"), (F.col("n_chars") > 1000).alias("c"))


@query(f"WITH {_RATED_SQL}, c AS (SELECT lang, {_CONFUSION.format('a', 'b')} FROM r GROUP BY lang), d AS (SELECT *, {_PR_PARTS} FROM c) SELECT lang, n, tp, fp, fn, tn, {_PR_SQL} FROM d")
def rater_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(confusion(rated(spark, sf_dir), ["lang"], F.col("a"), F.col("b")))


_KAPPA_SQL = "CASE WHEN x * y + (1 - x) * (1 - y) = 1 THEN 1e0 ELSE (po - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))) END"
_AVG = "avg(CASE WHEN {} THEN 1e0 ELSE 0e0 END)"


@query(f"WITH {_RATED_SQL}, g AS (SELECT lang, count(*) AS n, {_AVG.format('a')} AS x, {_AVG.format('b')} AS y, {_AVG.format('a = b')} AS po FROM r GROUP BY GROUPING SETS ((lang), ())) SELECT lang, n, round(po, 6) AS agreement, round({_KAPPA_SQL}, 6) AS kappa FROM g")
def rater_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rated(spark, sf_dir)
    return rounded(r.rollup("lang").agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"), stats.cohen_kappa(F.col("a"), F.col("b")).alias("kappa")))


_WILSON = "(p + 1.96 * 1.96 / (2 * n) {} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * CAST(n AS DOUBLE) * n))) / (1 + 1.96 * 1.96 / n)"


@query(f"WITH {_RATED_SQL}, g AS (SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE a = b) AS k, {_AVG.format('a = b')} AS p FROM r GROUP BY CUBE (lang, source)) SELECT lang, source, n, k, round(greatest(0e0, {_WILSON.format('-')}), 6) AS low, round(least(1e0, {_WILSON.format('+')}), 6) AS high FROM g")
def agreement_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rated(spark, sf_dir).cube("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rounded(g.select("lang", "source", "n", "k", low.alias("low"), high.alias("high")))


@query(
    f"""WITH {_RATED_SQL}, v AS (SELECT doc_id, a, b, c, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) > 1.5 AS m FROM r),
    p AS (SELECT 'a' AS judge, a AS said, m FROM v UNION ALL SELECT 'b', b, m FROM v UNION ALL SELECT 'c', c, m FROM v)
    SELECT judge, count(*) AS n, round(avg(CASE WHEN said = m THEN 1e0 ELSE 0e0 END), 6) AS with_majority, count(*) FILTER (WHERE m) AS majority_yes FROM p GROUP BY judge"""
)
def majority_of_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = rated(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.col(j).alias("said")) for j in "abc"])).alias("v")).select("doc_id", "v.*")
    vote = long.groupBy("doc_id").agg(stats.majority_vote(F.col("said")).alias("m"))
    g = long.join(vote, "doc_id").groupBy("judge")
    return rounded(g.agg(F.count("*").alias("n"), F.avg((F.col("said") == F.col("m")).cast("double")).alias("with_majority"), F.count_if("m").alias("majority_yes")))


@query(
    f"""WITH {_RATED_SQL}, p AS (SELECT 'a-b' AS pair, a AS x, b AS y FROM r UNION ALL SELECT 'a-c', a, c FROM r UNION ALL SELECT 'b-c', b, c FROM r),
    g AS (SELECT pair, count(*) AS n, count(*) FILTER (WHERE x <> y) AS flips, {_AVG.format('x')} AS x, {_AVG.format('y')} AS y, {_AVG.format('x = y')} AS po FROM p GROUP BY pair)
    SELECT pair, n, flips, round(po, 6) AS agreement, round({_KAPPA_SQL}, 6) AS kappa FROM g"""
)
def judge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rated(spark, sf_dir)
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{x}-{y}").alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ("ab", "ac", "bc")]))
    g = r.select(pairs.alias("p")).select("p.*").groupBy("pair")
    x, y = F.col("x"), F.col("y")
    return rounded(g.agg(F.count("*").alias("n"), F.count_if(x != y).alias("flips"), F.avg((x == y).cast("double")).alias("agreement"), stats.cohen_kappa(x, y).alias("kappa")))


# nearest, leave-and-return, re-judging ---------------------------------------------------------------


@query_and_by_sets(f"WITH {_PAIRS_SQL} SELECT conv_id, turn_a AS finding, turn_b AS nearest, round(sim, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn_a ORDER BY sim DESC, turn_b) AS k FROM q) WHERE k = 1")
def nearest_defect(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    """The most similar user turn of each assistant turn, the first of equals."""
    of = Window.partitionBy("conv_id", "turn_a")

    def could_be_nearest(jac, over, bound, loc):
        return (bound > F.greatest(jac, over)) & (bound >= F.max(F.greatest(jac, over)).over(of))

    pairs = claim_pairs_of(spark, sf_dir, full, could_be_nearest)
    best = F.max(F.struct(F.col("sim").alias("score"), (-F.col("turn_b")).alias("minus"))).alias("b")
    out = pairs.groupBy("conv_id", F.col("turn_a").alias("finding")).agg(best)
    return rounded(out.select("conv_id", "finding", (-F.col("b.minus")).alias("nearest"), F.col("b.score").alias("score")), 9)


@query_and_by_sets(f"WITH {_DECIDED_SQL}, u AS (SELECT *, sim >= 0.3 AS again FROM verdicts) SELECT method, count(*) AS n, round(avg(CASE WHEN same = again THEN 1e0 ELSE 0e0 END), 6) AS agreement, count(*) FILTER (WHERE same <> again) AS flips FROM u GROUP BY method")
def rejudged_agreement(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    """Verdicts of the staged decision against those of a second judge (a similarity threshold)."""
    second = ratio_join.for_thresholds(0.3)
    either = lambda *pair: ratio_join.for_decision(*pair) | second(*pair)
    d = matching.decide(claim_pairs_of(spark, sf_dir, full, either)).withColumn("again", F.col("sim") >= 0.3)
    same = F.col("same") == F.col("again")
    return rounded(d.groupBy("method").agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("agreement"), F.count_if(~same).alias("flips")))


@query_and_by_sets(f"WITH {_KEYED_SQL} SELECT DISTINCT pair_key, jac >= 0.34 AS same FROM keyed WHERE method = 'judge'")
def prejudged_pairs(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    """The band left by the deterministic stages, judged once per key into an empty cache."""
    from ..operators import judging

    decided = matching.decide(claim_pairs_of(spark, sf_dir, full))
    band = decided.where("method = 'judge'").select("pair_key", "text_a", "location_a", "text_b", "location_b")
    return judging.prejudge(band, spark.createDataFrame([], "pair_key string, same boolean"), judging.rule_judge, votes=3)


@query()
def review_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ledger rounds over benchmark items by a reviewer that reports the artifact's second line."""
    from ..operators import loop

    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), "item_id").alias("id"), F.col("text").alias("artifact"))

    def reviewer(prompt: str) -> str:
        import json

        claim = " ".join(prompt.split("|", 1)[-1].split()[:12])
        body = json.dumps([{"claim": claim, "unit": "text", "start": 1, "end": 1, "severity": "major"}])
        return f"RETIRE\n1: no longer holds here\nNEW\n{body}" if "Ledger" in prompt else body

    out = loop.run_loop(items, reviewer, loop.LoopConfig("ledger", rounds=3, memory=True, ledger=True))
    return out.select("id", "round", F.size("findings").alias("n_findings"), F.get("findings", F.lit(0))["claim"].alias("first_claim"))
