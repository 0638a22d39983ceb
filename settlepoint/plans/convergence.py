"""Queries over runs and metrics: set dynamics, regimes, arm comparisons and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sets, stats
from ..operators import arms, ranks, reports, resampling, walsh
from ..operators.trajectories import regime_distribution as distribution
from . import adapters
from .adapters import metrics, metrics_sql, runs, runs_sql

QUERIES: dict = {}
ORACLES: dict = {}
SCORES = ("mean_churn", "oscillation_degree", "stabilized_round", "terminal_precision", "terminal_recall")


def query(oracle: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def p_sql(b: str, c: str) -> str:
    """Exact two-sided p for DuckDB, by the log-gamma function."""
    n, k = f"({b} + {c})", f"least({b}, {c})"
    term = f"exp(lgamma({n} + 1e0) - lgamma(i + 1e0) - lgamma({n} - i + 1e0) - {n} * ln(2e0))"
    guarded = f"exp((CASE WHEN {n} = 0 THEN 0e0 ELSE lgamma({n} + 1e0) END) - (CASE WHEN i = 0 THEN 0e0 ELSE lgamma(i + 1e0) END) - lgamma({n} - i + 1e0) - {n} * ln(2e0))"
    del term
    return f"(CASE WHEN {n} = 0 THEN 1e0 ELSE least(1e0, 2 * list_sum(list_transform(range(0, CAST({k} + 1 AS BIGINT)), lambda i: {guarded}))) END)"


def report(name: str, text: str, prefix=metrics_sql, source=metrics, digits: int = 6) -> None:
    """A report whose SQL text is portable: it runs here over the operators' output, in the oracle over raw tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text.format(metrics="{metrics}", d="D"), metrics=source(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"WITH {prefix()} " + text.format(metrics="metrics", d="")


@query(
    f"""WITH {metrics_sql()} SELECT run_id, artifact_id, arm, replicate, n_rounds, round(mean_churn, 6) AS mean_churn, round(late_churn, 6) AS late_churn,
    round(terminal_false_fraction, 6) AS terminal_false_fraction, CAST(true_attrition_events AS INTEGER) AS true_attrition_events,
    CAST(oscillation_degree AS INTEGER) AS oscillation_degree, stabilized_round, converged, round(terminal_precision, 6) AS terminal_precision,
    round(terminal_recall, 6) AS terminal_recall, n_defects, regime FROM metrics"""
)
def trajectory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "run_id artifact_id arm replicate n_rounds mean_churn late_churn terminal_false_fraction true_attrition_events oscillation_degree stabilized_round converged terminal_precision terminal_recall n_defects regime"
    return rounded(metrics(spark, sf_dir).select(*columns.split()))


_SHARES = ", ".join(f"round(avg(CASE WHEN regime = '{g}' THEN 1e0 ELSE 0e0 END), 6) AS {g.replace('-', '_')}" for g in sets.REGIMES)


@query(f"WITH {metrics_sql()} SELECT arm, artifact_type, count(*) AS n_runs, {_SHARES} FROM metrics GROUP BY GROUPING SETS ((), (arm), (artifact_type))")
def regime_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution(metrics(spark, sf_dir), "arm", "artifact_type"))


@query(f"WITH {metrics_sql()} SELECT a.run_id, a.round, round(a.churn, 6) AS churn, z.size AS next_size, round(CASE WHEN z.size = 0 THEN 0e0 ELSE (z.size - z.n_true) / CAST(z.size AS DOUBLE) END, 6) AS next_false_fraction FROM steps a JOIN sizes z ON z.run_id = a.run_id AND z.round = a.round + 1")
def churn_per_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir).select("run_id", "set_sizes", "false_fraction", F.posexplode("churn").alias("round", "churn"))
    after = F.col("round") + 1
    return rounded(m.select("run_id", "round", "churn", F.get("set_sizes", after).cast("long").alias("next_size"), F.get("false_fraction", after).alias("next_false_fraction")))


@query(f"WITH {runs_sql()} SELECT run_id, element, list_reduce(list_sort(list(round)), lambda x, y: y) - min(round) + 1 > count(*) AS oscillates, min(round) AS first_round, max(round) AS last_round FROM cells GROUP BY ALL")
def element_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = runs(spark, sf_dir).select("run_id", F.posexplode("rounds").alias("round", "elements")).select("run_id", "round", F.explode("elements").alias("element"))
    g = long.groupBy("run_id", "element").agg(F.min("round").alias("first_round"), F.max("round").alias("last_round"), F.count("*").alias("n"))
    return g.select("run_id", "element", (F.col("last_round") - F.col("first_round") + 1 > F.col("n")).alias("oscillates"), "first_round", "last_round")


_MAJORITY_SQL = """majority AS (
  SELECT artifact_id, arm, regime FROM (SELECT artifact_id, arm, regime, row_number() OVER (PARTITION BY artifact_id, arm ORDER BY count(*) DESC, min(run_id)) AS k
  FROM metrics GROUP BY artifact_id, arm, regime) WHERE k = 1)"""


@query(f"WITH {metrics_sql()}, {_MAJORITY_SQL} SELECT * FROM majority")
def majority_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.majority_regimes(metrics(spark, sf_dir))


_MEANS = ", ".join(f"round(avg({s}), 6) AS {s}" for s in SCORES)
report("replicate_means", f"SELECT artifact_id, arm, count(*) AS n, {_MEANS} FROM {{metrics}} GROUP BY artifact_id, arm")

_PAIRED_SQL = "means AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS metric, artifact_id, avg(CAST({s} AS DOUBLE)) FILTER (WHERE arm = 'mem') AS a, avg(CAST({s} AS DOUBLE)) FILTER (WHERE arm = 'nomem') AS b FROM metrics GROUP BY artifact_id" for s in SCORES
) + "), paired AS (SELECT metric, artifact_id, a, b, a - b AS diff FROM means WHERE a IS NOT NULL AND b IS NOT NULL)"


@query(
    f"""WITH {metrics_sql()}, {_PAIRED_SQL}, s AS (
    SELECT metric, count(*) AS n, count(*) FILTER (WHERE diff > 1e-9) AS pos, count(*) FILTER (WHERE diff < -1e-9) AS neg, count(*) FILTER (WHERE abs(diff) <= 1e-9) AS tie,
           avg(diff) AS mean_diff, coalesce(stddev_samp(diff), 0) AS sd FROM paired GROUP BY metric)
    SELECT metric, n, pos, neg, tie, round(mean_diff, 6) AS mean_diff, round({p_sql('pos', 'neg')}, 6) AS p,
           round(mean_diff - 1.96 * sd / sqrt(n), 6) AS ci_low, round(mean_diff + 1.96 * sd / sqrt(n), 6) AS ci_high FROM s"""
)
def arm_sign_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.sign_test(arms.paired_means(metrics(spark, sf_dir), "mem", "nomem", SCORES), ["metric"], "diff"))


_LABELS = ("contractive-to-correct", "false-convergence")
_DISCORDANT_SQL = f"""{_MAJORITY_SQL}, both_arms AS (
  SELECT a.artifact_id, a.regime AS ra, b.regime AS rb FROM majority a JOIN majority b ON a.artifact_id = b.artifact_id AND a.arm = 'mem' AND b.arm = 'nomem'
), discordant AS (
  SELECT label, count(*) AS n, count(*) FILTER (WHERE ra = label AND rb <> label) AS a_only, count(*) FILTER (WHERE rb = label AND ra <> label) AS b_only,
         count(*) FILTER (WHERE ra = label) AS n_a, count(*) FILTER (WHERE rb = label) AS n_b
  FROM both_arms CROSS JOIN (VALUES ('{_LABELS[0]}'), ('{_LABELS[1]}')) t(label) GROUP BY label)"""


@query(
    f"""WITH {metrics_sql()}, {_DISCORDANT_SQL}, d AS (SELECT *, CAST(a_only - b_only AS DOUBLE) / n AS diff,
      1.96 * sqrt(greatest((a_only + b_only - CAST((a_only - b_only) * (a_only - b_only) AS DOUBLE) / n) / CAST(n * n AS DOUBLE), 0e0)) AS half FROM discordant)
    SELECT label, n, a_only, b_only, round(CAST(n_a AS DOUBLE) / n, 6) AS rate_a, round(CAST(n_b AS DOUBLE) / n, 6) AS rate_b, round({p_sql('a_only', 'b_only')}, 6) AS p,
           round(diff, 6) AS diff, round(diff - half, 6) AS ci_low, round(diff + half, 6) AS ci_high FROM d"""
)
def arm_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arms.mcnemar(metrics(spark, sf_dir), "mem", "nomem", _LABELS))


@query(
    f"""WITH {metrics_sql()}, first_rounds AS (SELECT run_id, element, min(round) AS r0 FROM cells WHERE element LIKE 'def:%' GROUP BY ALL),
    per AS (SELECT m.run_id, m.arm, m.stabilized_round, m.n_defects, count(f.element) AS found, count(f.element) FILTER (WHERE f.r0 > 0) AS late, count(f.element) FILTER (WHERE f.r0 = 0) AS r0
            FROM metrics m LEFT JOIN first_rounds f ON f.run_id = m.run_id GROUP BY ALL)
    SELECT arm, CAST(sum(late) AS BIGINT) AS late_defects, CAST(sum(stabilized_round) AS BIGINT) AS opportunity, round(CASE WHEN sum(stabilized_round) = 0 THEN 0e0 ELSE sum(late) / CAST(sum(stabilized_round) AS DOUBLE) END, 6) AS per_opportunity,
           CAST(sum(found) AS BIGINT) AS found, CAST(sum(n_defects) AS BIGINT) AS total, round(sum(found) / CAST(sum(n_defects) AS DOUBLE), 6) AS found_rate, round(avg(r0 / CAST(n_defects AS DOUBLE)), 6) AS round0_recall FROM per GROUP BY arm"""
)
def arm_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arms.diagnostics(metrics(spark, sf_dir)))


_FAMILY_SQL = f"""{_PAIRED_SQL}, {_DISCORDANT_SQL}, tests AS (
  SELECT 'sign ' || metric AS test, {p_sql('pos', 'neg')} AS p FROM (SELECT metric, count(*) FILTER (WHERE diff > 1e-9) AS pos, count(*) FILTER (WHERE diff < -1e-9) AS neg FROM paired GROUP BY metric)
  UNION ALL SELECT 'mcnemar ' || label, {p_sql('a_only', 'b_only')} FROM discordant
), ranked AS (SELECT test, p, least(1e0, (count(*) OVER () - row_number() OVER (ORDER BY round(p, 12), test) + 1) * p) AS adj, round(p, 12) AS key FROM tests)"""


@query(f"WITH {metrics_sql()}, {_FAMILY_SQL} SELECT test, round(p, 6) AS p, round(max(adj) OVER (ORDER BY key, test ROWS UNBOUNDED PRECEDING), 6) AS p_holm, max(adj) OVER (ORDER BY key, test ROWS UNBOUNDED PRECEDING) < 0.05 AS survives FROM ranked")
def holm_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    sign = stats.sign_test(arms.paired_means(m, "mem", "nomem", SCORES), ["metric"], "diff").select(F.concat(F.lit("sign "), "metric").alias("test"), "p")
    mcnemar = arms.mcnemar(m, "mem", "nomem", _LABELS).select(F.concat(F.lit("mcnemar "), "label").alias("test"), "p")
    tests = sign.unionByName(mcnemar).withColumn("_p", F.round("p", 12))
    return rounded(stats.holm(tests, "_p", "test").drop("_p"))


@query("SELECT d AS pairs, gap FROM (SELECT d, (SELECT min(g) FROM range(0, CAST(d + 1 AS BIGINT)) t(g) WHERE (d - g) % 2 = 0 AND " + p_sql("((d - g) // 2 + g)", "((d - g) // 2)") + " < 0.05) AS gap FROM range(0, 31) s(d))")
def min_significant_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(31).select(F.col("id").alias("pairs"), stats.min_significant_gap(F.col("id")).cast("long").alias("gap"))


@query(
    f"""WITH {metrics_sql()}, {_PAIRED_SQL}, d AS (SELECT metric, diff, row_number() OVER (PARTITION BY metric ORDER BY diff, artifact_id) AS i FROM paired WHERE diff <> 0),
    w AS (SELECT a.metric, (a.diff + b.diff) / 2 AS walsh FROM d a JOIN d b ON a.metric = b.metric AND a.i <= b.i),
    r AS (SELECT metric, walsh, row_number() OVER (PARTITION BY metric ORDER BY walsh) AS r, CAST(count(*) OVER (PARTITION BY metric) AS DOUBLE) AS m FROM w),
    n AS (SELECT *, (sqrt(8 * m + 1) - 1) / 2 AS n FROM r),
    k AS (SELECT *, greatest(1, least(round_even(m / 2 - 1.959964 * sqrt(n * (n + 1) * (2 * n + 1) / 24), 0), floor(m / 2))) AS k FROM n)
    SELECT metric, round(quantile_cont(walsh, 0.5), 6) AS estimate, round(max(CASE WHEN r = k THEN walsh END), 6) AS ci_low, round(max(CASE WHEN r = m + 1 - k THEN walsh END), 6) AS ci_high FROM k GROUP BY metric"""
)
def hodges_lehmann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(walsh.hodges_lehmann(arms.paired_means(metrics(spark, sf_dir), "mem", "nomem", SCORES), ["metric"], "diff"))


@query()
def wilcoxon_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.wilcoxon(arms.paired_means(metrics(spark, sf_dir), "mem", "nomem", SCORES), ["metric"], "diff"))


@query(
    f"""WITH {metrics_sql()}, {_PAIRED_SQL}, d AS (SELECT metric, diff, abs(diff) AS size FROM paired WHERE diff IS NOT NULL),
    r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY size) + (count(*) OVER (PARTITION BY metric, size) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY metric, size) AS t FROM d WHERE size > 0),
    s AS (SELECT metric, count(*) AS n_used, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS rank_sum, sum(t * t - 1) AS tie_sum FROM r GROUP BY metric)
    SELECT metric, a.n, CAST(coalesce(n_used, 0) AS BIGINT) AS n_used, coalesce(rank_sum, 0e0) AS rank_sum, CAST(coalesce(tie_sum, 0) AS DOUBLE) AS tie_sum
    FROM (SELECT metric, count(*) AS n FROM d GROUP BY metric) a LEFT JOIN s USING (metric)"""
)
def signed_rank_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the signed-rank p is made of: rank sums with average ranks, and the sum of t ** 3 - t over ties."""
    return ranks.rank_sums(arms.paired_means(metrics(spark, sf_dir), "mem", "nomem", SCORES), ["metric"], "diff")


_SCORED_SQL = f"""{_MAJORITY_SQL}, arts AS (
  SELECT artifact_id, avg(CASE WHEN regime = 'contractive-to-correct' THEN 1e0 ELSE 0e0 END) FILTER (WHERE arm = 'mem') AS ra, count(*) FILTER (WHERE arm = 'mem') AS na,
         avg(CASE WHEN regime = 'contractive-to-correct' THEN 1e0 ELSE 0e0 END) FILTER (WHERE arm = 'nomem') AS rb, count(*) FILTER (WHERE arm = 'nomem') AS nb
  FROM metrics GROUP BY artifact_id HAVING count(DISTINCT arm) = 2
), numbered AS (SELECT *, row_number() OVER (ORDER BY artifact_id) - 1 AS i, count(*) OVER () AS n FROM arts)"""


def _boot_sql(a: str, wa: str, b: str, wb: str, samples: int) -> str:
    return f"""boots AS (
      SELECT s.b, sum({a} * {wa}) / CAST(sum({wa}) AS DOUBLE) - sum({b} * {wb}) / CAST(sum({wb}) AS DOUBLE) AS diff
      FROM range({samples}) s(b) CROSS JOIN (SELECT i AS j, n FROM numbered) k JOIN numbered x ON x.i = {resampling.draw_sql("s.b", "k.j")} % k.n GROUP BY s.b)"""


def _summary_sql(margins: tuple[float, ...]) -> str:
    tests = "".join(f", round(greatest(avg(CASE WHEN diff >= {m} THEN 1e0 ELSE 0e0 END), avg(CASE WHEN diff <= -{m} THEN 1e0 ELSE 0e0 END)), 6) AS tost_{round(m * 100)}" for m in margins)
    return f"""SELECT count(*) AS samples, round(quantile_cont(diff, 0.025), 6) AS ci95_low, round(quantile_cont(diff, 0.975), 6) AS ci95_high,
      round(quantile_cont(diff, 0.05), 6) AS ci90_low, round(quantile_cont(diff, 0.95), 6) AS ci90_high,
      round(least(1e0, 2 * least(avg(CASE WHEN diff <= 0 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN diff >= 0 THEN 1e0 ELSE 0e0 END))), 6) AS p{tests} FROM boots"""


SAMPLES = 20_000


@query(f"WITH {metrics_sql()}, {_SCORED_SQL}, {_boot_sql('ra', 'na', 'rb', 'nb', SAMPLES)} {_summary_sql((0.15, 0.10))}")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    correct = F.when(F.col("regime") == sets.REGIMES[0], 1.0).otherwise(0.0)
    per = arms.arm_values(metrics(spark, sf_dir), correct, "mem", "nomem")
    return rounded(resampling.summary(resampling.bootstrap_difference(per, SAMPLES), (0.15, 0.10)))


@query(
    f"""WITH {metrics_sql()}, {_MAJORITY_SQL}, arts AS (
      SELECT artifact_id, max(CASE WHEN arm = 'mem' AND regime = 'contractive-to-correct' THEN 1e0 ELSE 0e0 END) AS ra, max(CASE WHEN arm = 'nomem' AND regime = 'contractive-to-correct' THEN 1e0 ELSE 0e0 END) AS rb
      FROM majority GROUP BY artifact_id HAVING count(*) = 2
    ), numbered AS (SELECT *, row_number() OVER (ORDER BY artifact_id) - 1 AS i, count(*) OVER () AS n FROM arts), {_boot_sql('ra', '1', 'rb', '1', SAMPLES)} {_summary_sql((0.15, 0.10, 0.05))}"""
)
def majority_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    majority = arms.majority_regimes(metrics(spark, sf_dir))
    per = arms.arm_values(majority, F.when(F.col("regime") == sets.REGIMES[0], 1.0).otherwise(0.0), "mem", "nomem")
    return rounded(resampling.summary(resampling.bootstrap_difference(per, SAMPLES), (0.15, 0.10, 0.05)))


@query(
    f"""WITH {metrics_sql()}, pr AS (SELECT r.arm, s.round, CASE WHEN s.size = 0 THEN 1e0 ELSE s.n_true / CAST(s.size AS DOUBLE) END AS p, s.n_true / CAST(r.n_defects AS DOUBLE) AS r FROM sizes s JOIN runs r ON r.run_id = s.run_id)
    SELECT arm, round, count(*) AS n, round(avg(p), 6) AS precision_, round(avg(r), 6) AS recall_, round(avg(CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END), 6) AS f1 FROM pr GROUP BY ALL"""
)
def round_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select("arm", "n_defects", F.posexplode("rounds").alias("round", "elements"))
    r = r.select("arm", "round", sets.precision(F.col("elements")).alias("p"), sets.recall(F.col("elements"), F.col("n_defects")).alias("r"))
    return rounded(r.groupBy("arm", "round").agg(F.count("*").alias("n"), F.avg("p").alias("precision_"), F.avg("r").alias("recall_"), F.avg(sets.f1(F.col("p"), F.col("r"))).alias("f1")))


@query(
    f"""WITH {metrics_sql()}, p AS (SELECT a.regime AS before, b.regime AS after FROM metrics a JOIN metrics b ON a.artifact_id = b.artifact_id AND a.arm = b.arm AND a.replicate = 0 AND b.replicate = 1),
    g AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in sets.REGIMES)}) t(label))
    SELECT x.label AS before, y.label AS after, count(p.before) AS n FROM g x CROSS JOIN g y LEFT JOIN p ON p.before = x.label AND p.after = y.label GROUP BY ALL"""
)
def replicate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    keys = ["artifact_id", "arm"]
    a = m.where("replicate = 0").select(*keys, F.col("regime").alias("before"))
    b = m.where("replicate = 1").select(*keys, F.col("regime").alias("after"))
    wide = a.join(b, keys).groupBy("before").pivot("after", list(sets.REGIMES)).count()
    labels = spark.createDataFrame([(x,) for x in sets.REGIMES], "before string")
    wide = labels.join(wide, "before", "left")
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("after"), F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("long").alias("n")) for x in sets.REGIMES]))
    return wide.select("before", pairs.alias("c")).select("before", "c.after", "c.n")


@query(
    f"""WITH {metrics_sql()}, p AS (SELECT a.regime AS before, b.regime AS after, count(*) AS n FROM metrics a JOIN metrics b ON a.artifact_id = b.artifact_id AND a.arm = b.arm AND a.replicate = 0 AND b.replicate = 1 WHERE a.regime <> b.regime GROUP BY ALL)
    SELECT * FROM p ORDER BY n DESC, before, after LIMIT 6"""
)
def top_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate_confusion(spark, sf_dir).where("before <> after and n > 0").orderBy(F.desc("n"), "before", "after").limit(6)


report(
    "terminal_size_distribution",
    "SELECT arm, count(*) AS n, round(avg(terminal_size), 6) AS mean_size, round(stddev_pop(terminal_size), 6) AS sd_size, round(avg(CASE WHEN terminal_size BETWEEN 3 AND 4 THEN 1e0 ELSE 0e0 END), 6) AS share_3_4 FROM {metrics} GROUP BY arm",
)
report("terminal_size_histogram", "SELECT arm, CAST(terminal_size AS BIGINT) AS size, count(*) AS n FROM {metrics} GROUP BY arm, terminal_size")


@query(
    f"""WITH {metrics_sql()}, stops AS (SELECT run_id, min(round) AS stop FROM steps WHERE a = inner_size AND b = inner_size GROUP BY 1),
    j AS (SELECT r.run_id, r.arm, s.stop, NOT (z.n_true / CAST(r.n_defects AS DOUBLE) >= 0.80 AND CASE WHEN z.size = 0 THEN 0e0 ELSE (z.size - z.n_true) / CAST(z.size AS DOUBLE) END <= 0.34) AS wrong
          FROM runs r LEFT JOIN stops s ON s.run_id = r.run_id LEFT JOIN sizes z ON z.run_id = r.run_id AND z.round = s.stop)
    SELECT arm, count(*) AS n, count(stop) AS stopped, round(count(stop) / CAST(count(*) AS DOUBLE), 6) AS stop_rate, round(count(*) FILTER (WHERE stop IS NOT NULL AND wrong) / CAST(nullif(count(stop), 0) AS DOUBLE), 6) AS p_wrong
    FROM j GROUP BY GROUPING SETS ((arm), ())"""
)
def stop_at_first_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("stop", sets.first_stable(F.col("rounds")))
    at = F.get("rounds", F.col("stop"))
    false = F.coalesce(F.try_divide(F.size(at) - F.size(sets.true_elements(at)), F.size(at)), F.lit(0.0))
    r = r.withColumn("wrong", F.col("stop").isNotNull() & ~sets.terminal_correct(sets.recall(at, F.col("n_defects")), false))
    return rounded(
        spark.sql(
            """SELECT arm, count(*) AS n, count(stop) AS stopped, count(stop) / count(*) AS stop_rate, try_divide(count_if(wrong), count(stop)) AS p_wrong
            FROM {r} GROUP BY GROUPING SETS ((arm), ())""",
            r=r,
        )
    )


report(
    "failure_modes",
    """SELECT arm, count(*) AS n, round(avg(CASE WHEN converged THEN 1e0 ELSE 0e0 END), 6) AS settle,
    round(avg(CASE WHEN regime = 'contractive-to-correct' THEN 1e0 ELSE 0e0 END), 6) AS cc, round(avg(CASE WHEN regime = 'false-convergence' THEN 1e0 ELSE 0e0 END), 6) AS fc,
    round(sum(CASE WHEN regime = 'false-convergence' THEN 1e0 ELSE 0e0 END) / nullif(sum(CASE WHEN converged THEN 1e0 ELSE 0e0 END), 0e0), 6) AS wrong_given_settled FROM {metrics} GROUP BY arm""",
)
_GRID = " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS most" for x in (0.1, 0.2, 0.3, 0.34, 0.5))
report(
    "false_threshold_sweep",
    f"""SELECT g.most, m.arm, count(*) AS n, round(avg(CASE WHEN converged AND terminal_recall >= 0.8 AND terminal_false_fraction <= g.most THEN 1e0 ELSE 0e0 END), 6) AS cc,
    round(avg(CASE WHEN terminal_recall >= 1 THEN 1e0 ELSE 0e0 END), 6) AS perfect_recall FROM {{metrics}} m CROSS JOIN ({_GRID}) g GROUP BY g.most, m.arm""",
)
report(
    "policy_dynamics",
    """SELECT p.policy, arm, count(*) AS n, round(avg(CASE WHEN converged AND terminal_recall >= 0.8 AND (p.policy = 'none' OR terminal_false_fraction <= 0.34) THEN 1e0 ELSE 0e0 END), 6) AS cc,
    round(avg(mean_churn), 6) AS mean_churn, round(avg(oscillation_degree), 6) AS oscillation, round(avg(stabilized_round), 6) AS stabilized
    FROM {metrics} CROSS JOIN (SELECT 'none' AS policy UNION ALL SELECT 'positional' AS policy) p GROUP BY p.policy, arm""",
)
report(
    "probe_summary",
    """SELECT artifact_type, max(CASE WHEN arm = 'mem' THEN r END) AS recall_mem, max(CASE WHEN arm = 'nomem' THEN r END) AS recall_nomem,
    max(CASE WHEN arm = 'mem' THEN c END) AS ceiling_mem, max(CASE WHEN arm = 'nomem' THEN c END) AS ceiling_nomem
    FROM (SELECT artifact_type, arm, round(avg(terminal_recall), 6) AS r, count(CASE WHEN terminal_recall >= 1 THEN 1 END) AS c FROM {metrics} GROUP BY artifact_type, arm) x GROUP BY artifact_type""",
)


@query(
    f"""WITH {metrics_sql()}, defs AS (SELECT run_id, bool_and(a_true = inner_true AND b_true = inner_true) AS settled FROM (
        SELECT a.run_id, a.n_true AS a_true, b.n_true AS b_true, coalesce(s.inner_true, 0) AS inner_true FROM sizes a JOIN sizes b ON a.run_id = b.run_id AND a.round = {adapters.N_ROUNDS - 2} AND b.round = {adapters.N_ROUNDS - 1} LEFT JOIN shared s ON s.run_id = a.run_id AND s.round = a.round) GROUP BY 1),
    proj AS (SELECT m.arm, m.regime, CASE WHEN m.converged THEN m.regime WHEN d.settled AND m.terminal_recall >= 0.80 AND m.terminal_false_fraction <= 0.34 THEN 'contractive-to-correct' WHEN d.settled THEN 'false-convergence' ELSE m.regime END AS projected FROM metrics m JOIN defs d ON d.run_id = m.run_id)
    SELECT arm, count(*) AS n, count(*) FILTER (WHERE regime <> projected) AS reclassified, round(avg(CASE WHEN regime = 'contractive-to-correct' THEN 1e0 ELSE 0e0 END), 6) AS cc, round(avg(CASE WHEN projected = 'contractive-to-correct' THEN 1e0 ELSE 0e0 END), 6) AS cc_projected FROM proj GROUP BY arm"""
)
def defect_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = arms.defect_projected(metrics(spark, sf_dir))
    share = lambda c: F.avg(F.when(F.col(c) == sets.REGIMES[0], 1.0).otherwise(0.0))
    return rounded(m.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("regime") != F.col("projected")).alias("reclassified"), share("regime").alias("cc"), share("projected").alias("cc_projected")))


@query(
    f"""WITH {runs_sql()}, g AS (SELECT run_id, element, round, lead(round) OVER (PARTITION BY run_id, element ORDER BY round) AS back FROM cells)
    SELECT run_id, element, min(round) AS left_after, min(back) AS returned_at, count(*) AS n_returns FROM g WHERE back > round + 1 GROUP BY ALL"""
)
def leave_and_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that leave a run and come back, with the first absence and return."""
    from pyspark.sql import Window

    long = runs(spark, sf_dir).select("run_id", F.posexplode("rounds").alias("round", "elements")).select("run_id", "round", F.explode("elements").alias("element"))
    back = F.lead("round").over(Window.partitionBy("run_id", "element").orderBy("round"))
    g = long.withColumn("back", back).where("back > round + 1").groupBy("run_id", "element")
    return g.agg(F.min("round").alias("left_after"), F.min("back").alias("returned_at"), F.count("*").alias("n_returns"))


_FIRST_LAST_SQL = f"""pr AS (SELECT r.artifact_id, r.arm, s.round, CASE WHEN s.size = 0 THEN 1e0 ELSE s.n_true / CAST(s.size AS DOUBLE) END AS p, s.n_true / CAST(r.n_defects AS DOUBLE) AS r FROM sizes s JOIN runs r ON r.run_id = s.run_id WHERE s.round IN (0, {adapters.N_ROUNDS - 1})),
  f AS (SELECT artifact_id, arm, round, CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr),
  arts AS (SELECT artifact_id, avg(f1) FILTER (WHERE round > 0) - avg(f1) FILTER (WHERE round = 0) AS d FROM f WHERE arm = 'mem' GROUP BY artifact_id),
  numbered AS (SELECT *, row_number() OVER (ORDER BY artifact_id) - 1 AS i, count(*) OVER () AS n FROM arts)"""


def _first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, arm, diff: mean F1 of the last round over an artifact's runs less that of the first."""
    r = runs(spark, sf_dir)
    f1 = lambda elements: sets.f1(sets.precision(elements), sets.recall(elements, F.col("n_defects")))
    change = F.avg(f1(F.element_at("rounds", -1))) - F.avg(f1(F.element_at("rounds", 1)))
    return r.groupBy("artifact_id", "arm").agg(change.alias("diff"))


@query(
    f"""WITH {metrics_sql()}, {_FIRST_LAST_SQL}, {_boot_sql('d', '1', '0e0', '1', SAMPLES)}, s AS ({_summary_sql((0.05,))})
    SELECT s.*, (SELECT round(avg(d), 6) FROM arts) AS mean_diff FROM s"""
)
def first_to_last_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap over artifacts of the change in F1 from the first to the last round of an arm."""
    per = _first_and_last(spark, sf_dir).where("arm = 'mem'")
    single = per.select("artifact_id", F.col("diff").alias("sa"), F.lit(1).alias("na"), F.lit(0.0).alias("sb"), F.lit(1).alias("nb"))
    boots = resampling.bootstrap_difference(single, SAMPLES)
    mean = per.agg(F.avg("diff").alias("mean_diff"))
    return rounded(resampling.summary(boots, (0.05,)).crossJoin(F.broadcast(mean)))  # one row each


@query()
def first_to_last_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.wilcoxon(_first_and_last(spark, sf_dir), ["arm"], "diff"))


# failure tests, settle rules, probes, contamination -----------------------------------------------------

_SHARE = "avg(CASE WHEN {} THEN 1e0 ELSE 0e0 END)"


@query(
    f"""WITH {metrics_sql()}, per AS (SELECT artifact_id, arm, {_SHARE.format("regime = 'false-convergence'")} AS share FROM metrics GROUP BY ALL),
    d AS (SELECT a.arm, a.share - b.share AS diff FROM per a JOIN per b ON a.artifact_id = b.artifact_id AND b.arm = 'mem' AND a.arm <> 'mem'),
    s AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE diff > 1e-9) AS pos, count(*) FILTER (WHERE diff < -1e-9) AS neg, count(*) FILTER (WHERE abs(diff) <= 1e-9) AS tie, avg(diff) AS mean_diff, coalesce(stddev_samp(diff), 0) AS sd FROM d GROUP BY arm)
    SELECT arm, n, pos, neg, tie, round(mean_diff, 6) AS mean_diff, round({p_sql('pos', 'neg')}, 6) AS p, round(mean_diff - 1.96 * sd / sqrt(n), 6) AS ci_low, round(mean_diff + 1.96 * sd / sqrt(n), 6) AS ci_high FROM s"""
)
def failure_mode_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.failure_tests(metrics(spark, sf_dir), "mem"))


_PROJECTED_SQL = f"""defs AS (SELECT run_id, bool_and(a_true = inner_true AND b_true = inner_true) AS settled FROM (
        SELECT a.run_id, a.n_true AS a_true, b.n_true AS b_true, coalesce(s.inner_true, 0) AS inner_true FROM sizes a JOIN sizes b ON a.run_id = b.run_id AND a.round = {adapters.N_ROUNDS - 2} AND b.round = {adapters.N_ROUNDS - 1} LEFT JOIN shared s ON s.run_id = a.run_id AND s.round = a.round) GROUP BY 1),
    proj AS (SELECT m.artifact_id, m.run_id, m.arm, m.regime, CASE WHEN m.converged THEN m.regime WHEN d.settled AND m.terminal_recall >= 0.80 AND m.terminal_false_fraction <= 0.34 THEN 'contractive-to-correct' WHEN d.settled THEN 'false-convergence' ELSE m.regime END AS projected FROM metrics m JOIN defs d ON d.run_id = m.run_id)"""
_IS_CC = "'contractive-to-correct'"


@query(
    f"""WITH {metrics_sql()}, {_PROJECTED_SQL}, l AS (SELECT 'full_set' AS rule, artifact_id, arm, run_id, regime AS r FROM proj UNION ALL SELECT 'defect_projection', artifact_id, arm, run_id, projected FROM proj),
    run AS (SELECT rule, avg(CASE WHEN r = {_IS_CC} THEN 1e0 ELSE 0e0 END) FILTER (WHERE arm = 'mem') AS run_a, avg(CASE WHEN r = {_IS_CC} THEN 1e0 ELSE 0e0 END) FILTER (WHERE arm = 'nomem') AS run_b FROM l GROUP BY rule),
    maj AS (SELECT rule, artifact_id, arm, r FROM (SELECT rule, artifact_id, arm, r, row_number() OVER (PARTITION BY rule, artifact_id, arm ORDER BY count(*) DESC, min(run_id)) AS k FROM l GROUP BY rule, artifact_id, arm, r) WHERE k = 1),
    w AS (SELECT a.rule, a.r = {_IS_CC} AS ra, b.r = {_IS_CC} AS rb FROM maj a JOIN maj b ON a.rule = b.rule AND a.artifact_id = b.artifact_id AND a.arm = 'mem' AND b.arm = 'nomem'),
    c AS (SELECT rule, count(*) AS n, {_SHARE.format('ra')} AS majority_a, {_SHARE.format('rb')} AS majority_b, count(*) FILTER (WHERE ra AND NOT rb) AS a_only, count(*) FILTER (WHERE rb AND NOT ra) AS b_only FROM w GROUP BY rule)
    SELECT rule, round(run_a, 6) AS run_a, round(run_b, 6) AS run_b, n, round(majority_a, 6) AS majority_a, round(majority_b, 6) AS majority_b, a_only, b_only,
           round(run_a - run_b, 6) AS run_gap, round(majority_a - majority_b, 6) AS majority_gap, round({p_sql('a_only', 'b_only')}, 6) AS p FROM run JOIN c USING (rule)"""
)
def settle_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correct convergence of both arms under settling of the whole set and of the defects alone."""
    return rounded(reports.settle_rules(metrics(spark, sf_dir), "mem", "nomem"))


@query(f"WITH {metrics_sql()}, {_PROJECTED_SQL} SELECT arm, regime, projected, count(*) AS n FROM proj WHERE regime <> projected GROUP BY ALL")
def reclassified_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reclassified(metrics(spark, sf_dir))


_PROBE_SQL = f"""{_MAJORITY_SQL}, per AS (SELECT artifact_id, arm, avg(terminal_recall) AS recall, {_SHARE.format('converged')} AS conv FROM metrics GROUP BY ALL),
    b AS (SELECT * FROM per JOIN majority USING (artifact_id, arm)),
    t AS (SELECT artifact_id, max(regime) FILTER (WHERE arm = 'mem') AS regime_a, max(regime) FILTER (WHERE arm = 'nomem') AS regime_b, max(recall) FILTER (WHERE arm = 'mem') AS recall_a, max(recall) FILTER (WHERE arm = 'nomem') AS recall_b,
                 max(conv) FILTER (WHERE arm = 'mem') AS conv_a, max(conv) FILTER (WHERE arm = 'nomem') AS conv_b FROM b GROUP BY artifact_id)"""


@query(f"WITH {metrics_sql()}, {_PROBE_SQL} SELECT artifact_id, regime_a, regime_b, round(recall_a, 6) AS recall_a, round(recall_b, 6) AS recall_b, round(conv_a, 6) AS conv_a, round(conv_b, 6) AS conv_b FROM t")
def probe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.probe_table(metrics(spark, sf_dir), "mem", "nomem"))


_CC_A, _CC_B = (f"coalesce(regime_{s} = {_IS_CC}, false)" for s in "ab")


@query(
    f"""WITH {metrics_sql()}, {_PROBE_SQL}, c AS (SELECT count(*) AS n, {_SHARE.format(_CC_A)} AS majority_a, {_SHARE.format(_CC_B)} AS majority_b, count(*) FILTER (WHERE {_CC_A} AND NOT {_CC_B}) AS a_only, count(*) FILTER (WHERE {_CC_B} AND NOT {_CC_A}) AS b_only,
      count(*) FILTER (WHERE recall_a >= 0.999) AS at_ceiling_a, count(*) FILTER (WHERE recall_b >= 0.999) AS at_ceiling_b, count(*) FILTER (WHERE recall_a < 0.999) AS below_ceiling_a, count(*) FILTER (WHERE recall_b < 0.999) AS below_ceiling_b FROM t),
    r AS (SELECT avg(CASE WHEN regime = {_IS_CC} THEN 1e0 ELSE 0e0 END) FILTER (WHERE arm = 'mem') AS run_a, avg(CASE WHEN regime = {_IS_CC} THEN 1e0 ELSE 0e0 END) FILTER (WHERE arm = 'nomem') AS run_b,
                 min(terminal_recall) FILTER (WHERE arm = 'mem') AS least_recall_a, min(terminal_recall) FILTER (WHERE arm = 'nomem') AS least_recall_b FROM metrics)
    SELECT round(run_a, 6) AS run_a, round(run_b, 6) AS run_b, round(least_recall_a, 6) AS least_recall_a, round(least_recall_b, 6) AS least_recall_b, n, round(majority_a, 6) AS majority_a, round(majority_b, 6) AS majority_b, a_only, b_only,
           at_ceiling_a, at_ceiling_b, below_ceiling_a, below_ceiling_b, round({p_sql('a_only', 'b_only')}, 6) AS p FROM r CROSS JOIN c"""
)
def probe_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.probe_rates(metrics(spark, sf_dir), "mem", "nomem"))


_LINES_SQL = """l AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(lower(x), ' '), '\\s+', ' ', 'g')), lambda x: x <> '') AS lines FROM documents),
    e AS (SELECT doc_id, lang, source, greatest(2, CAST(floor(0.55 * len(lines)) AS INTEGER)) AS k, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l WHERE len(lines) >= 6),
    g AS (SELECT doc_id, lang, source, line, count(*) FILTER (WHERE pos >= k AND len(line) >= 8) AS late, bool_or(pos < k) AS early FROM e GROUP BY ALL),
    v AS (SELECT doc_id, lang, source, CAST(sum(late) AS BIGINT) AS n, CAST(coalesce(sum(late) FILTER (WHERE early), 0) AS BIGINT) AS hits FROM g GROUP BY ALL),
    probe AS (SELECT doc_id AS artifact_id, lang, source, n, hits, CASE WHEN n = 0 THEN NULL ELSE hits / CAST(n AS DOUBLE) END AS verbatim FROM v)"""


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as artifacts: the share of a text's later lines that its beginning already gives away."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("artifact_id"), "lang", "source", "text")
    return reports.reproduced_lines(docs, ["artifact_id", "lang", "source"])


@query(f"WITH {_LINES_SQL} SELECT artifact_id, lang, source, n, hits, round(verbatim, 6) AS verbatim FROM probe")
def reproduced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_probe(spark, sf_dir))


@query(
    f"""WITH {metrics_sql()}, {_LINES_SQL}, rec AS (SELECT artifact_id, avg(terminal_recall) AS recall FROM metrics GROUP BY 1), j AS (SELECT p.*, recall FROM probe p LEFT JOIN rec USING (artifact_id))
    SELECT lang, source, count(*) AS n, round(avg(verbatim), 6) AS verbatim, count(*) FILTER (WHERE verbatim IS NOT NULL AND recall IS NOT NULL) AS n_correlated,
           CASE WHEN stddev_pop(verbatim) FILTER (WHERE recall IS NOT NULL) > 0 AND stddev_pop(recall) FILTER (WHERE verbatim IS NOT NULL) > 0 THEN round(corr(verbatim, recall), 6) END AS r
    FROM j GROUP BY GROUPING SETS ((), (lang), (source))"""
)
def measured_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    recall = metrics(spark, sf_dir).groupBy("artifact_id").agg(F.avg("terminal_recall").alias("recall"))
    return rounded(reports.contamination(_probe(spark, sf_dir), recall, ["lang", "source"]))


@query(
    f"""WITH {metrics_sql()}, {_MAJORITY_SQL}, {_LINES_SQL} SELECT arm, count(*) AS n, count(*) FILTER (WHERE regime = 'contractive-to-correct') AS cc
    FROM majority WHERE artifact_id NOT IN (SELECT artifact_id FROM probe WHERE verbatim >= 0.25 AND artifact_id IS NOT NULL) GROUP BY arm"""
)
def without_memorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority regimes per arm without the artifacts whose text gives away a quarter or more of its later lines."""
    given_away = _probe(spark, sf_dir).where("verbatim >= 0.25").select("artifact_id")
    kept = metrics(spark, sf_dir).join(given_away, "artifact_id", "left_anti")
    return arms.majority_regimes(kept).groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("regime") == sets.REGIMES[0]).alias("cc"))


@query(
    """SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS mark, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.4f', p) END AS shown
    FROM (SELECT event_id, CAST((event_id * 7919) % 10000 AS DOUBLE) / 10000 AS p FROM events)"""
)
def labelled_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ((F.col("event_id") * 7919) % 10000).cast("double") / 10000
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", stats.significance(p).alias("mark"), stats.format_p(p).alias("shown"))
