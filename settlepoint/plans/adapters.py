"""The driver's tables as inputs of the engine, and the same mappings as DuckDB SQL for the oracles."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trajectories import rounds_of, trajectory_metrics
from ..session import table

N_ROUNDS = 6


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from events: a user is a run, five days a round, an event type an element; users of even
    number keep what they have found (arm mem), odd ones do not (arm nomem); four users an artifact."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    event = table(spark, sf_dir, "events").where("value >= 20 and user_id is not null")
    presence = event.select(
        F.col("user_id").alias("run_id"),
        F.least(F.lit(N_ROUNDS - 1), F.floor(day / 5)).cast("int").alias("round"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("false:"), (F.col("event_id") % 3).cast("string")))
        .otherwise(F.concat(F.lit("def:"), "event_type"))
        .alias("element"),
    )
    out = rounds_of(presence, N_ROUNDS, ["run_id"], F.col("run_id") % 2 == 0)
    return out.select(
        "run_id",
        F.floor(F.col("run_id") / 4).cast("long").alias("artifact_id"),
        F.when(F.col("run_id") % 2 == 0, "mem").otherwise("nomem").alias("arm"),
        (F.floor(F.col("run_id") / 2) % 2).cast("int").alias("replicate"),
        F.concat(F.lit("type-"), (F.floor(F.col("run_id") / 4) % 3).cast("string")).alias("artifact_type"),
        "rounds",
        F.lit(4).alias("n_defects"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory_metrics(runs(spark, sf_dir)).withColumn("terminal_size", F.try_element_at("set_sizes", F.lit(-1)))


@cache
def runs_sql() -> str:
    """DuckDB CTEs up to runs(run_id, artifact_id, arm, replicate, artifact_type, n_defects) and cells(run_id, round, element)."""
    return f"""
    presence AS (
      SELECT DISTINCT user_id AS run_id,
             CAST(least({N_ROUNDS - 1}, floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5)) AS INTEGER) AS round,
             CASE WHEN event_type = 'error' THEN 'false:' || (event_id % 3) ELSE 'def:' || event_type END AS element
      FROM events WHERE value >= 20 AND user_id IS NOT NULL
    ), runs AS (
      SELECT run_id, run_id // 4 AS artifact_id, CASE WHEN run_id % 2 = 0 THEN 'mem' ELSE 'nomem' END AS arm,
             CAST((run_id // 2) % 2 AS INTEGER) AS replicate, 'type-' || ((run_id // 4) % 3) AS artifact_type, 4 AS n_defects
      FROM (SELECT DISTINCT run_id FROM presence)
    ), grid AS (
      SELECT run_id, arm, CAST(r AS INTEGER) AS round FROM runs CROSS JOIN range({N_ROUNDS}) t(r)
    ), cells AS (
      SELECT DISTINCT g.run_id, g.round, p.element FROM grid g JOIN presence p
      ON g.run_id = p.run_id AND (p.round = g.round OR (g.arm = 'mem' AND p.round <= g.round))
    )"""


@cache
def metrics_sql() -> str:
    """DuckDB CTEs up to metrics, in long form (windows and self-joins instead of array functions)."""
    last = N_ROUNDS - 1
    return f"""{runs_sql()}, sizes AS (
      SELECT g.run_id, g.round, count(c.element) AS size, count(c.element) FILTER (WHERE c.element LIKE 'def:%') AS n_true
      FROM grid g LEFT JOIN cells c ON g.run_id = c.run_id AND g.round = c.round GROUP BY ALL
    ), shared AS (
      SELECT a.run_id, a.round, count(*) AS inner_size, count(*) FILTER (WHERE a.element LIKE 'def:%') AS inner_true
      FROM cells a JOIN cells b ON a.run_id = b.run_id AND a.element = b.element AND b.round = a.round + 1 GROUP BY ALL
    ), steps AS (
      SELECT a.run_id, a.round, coalesce(s.inner_size, 0) AS inner_size, a.size AS a, b.size AS b,
             CASE WHEN a.size + b.size = 0 THEN 0e0 ELSE 1 - coalesce(s.inner_size, 0) / CAST(a.size + b.size - coalesce(s.inner_size, 0) AS DOUBLE) END AS churn,
             a.n_true - coalesce(s.inner_true, 0) AS lost
      FROM sizes a JOIN sizes b ON a.run_id = b.run_id AND b.round = a.round + 1
      LEFT JOIN shared s ON s.run_id = a.run_id AND s.round = a.round
    ), gaps AS (
      SELECT run_id, element, max(round) - min(round) + 1 > count(*) AS returns FROM cells GROUP BY ALL
    ), to_last AS (
      SELECT a.run_id, a.round, count(c.element) AS inner_size FROM sizes a
      LEFT JOIN (SELECT x.run_id, x.round, x.element FROM cells x JOIN cells y ON x.run_id = y.run_id AND x.element = y.element AND y.round = {last}) c
      ON a.run_id = c.run_id AND a.round = c.round GROUP BY ALL
    ), settled AS (
      SELECT a.run_id, max(CASE WHEN a.size <> t.inner_size OR z.size <> t.inner_size THEN a.round + 1 ELSE 0 END) AS stabilized_round
      FROM sizes a JOIN to_last t ON a.run_id = t.run_id AND a.round = t.round JOIN sizes z ON z.run_id = a.run_id AND z.round = {last} GROUP BY ALL
    ), bundle AS (
      SELECT r.*, {N_ROUNDS} AS n_rounds, m.mean_churn, m.late_churn, m.lost AS true_attrition_events,
             CASE WHEN z.size = 0 THEN 0e0 ELSE (z.size - z.n_true) / CAST(z.size AS DOUBLE) END AS terminal_false_fraction,
             coalesce(o.n, 0) AS oscillation_degree, CAST(s.stabilized_round AS INTEGER) AS stabilized_round, m.late_equal AS converged,
             CASE WHEN z.size = 0 THEN 1e0 ELSE z.n_true / CAST(z.size AS DOUBLE) END AS terminal_precision,
             z.n_true / CAST(r.n_defects AS DOUBLE) AS terminal_recall, z.size AS terminal_size,
             z.size > f.size AND z.size = x.top AS grew
      FROM runs r JOIN sizes z ON z.run_id = r.run_id AND z.round = {last} JOIN sizes f ON f.run_id = r.run_id AND f.round = 0
      JOIN (SELECT run_id, max(size) AS top FROM sizes GROUP BY 1) x ON x.run_id = r.run_id
      JOIN (SELECT run_id, avg(churn) AS mean_churn, max(churn) FILTER (WHERE round = {last - 1}) AS late_churn, sum(lost) AS lost,
                   bool_and(a = inner_size AND b = inner_size) FILTER (WHERE round = {last - 1}) AS late_equal FROM steps GROUP BY 1) m ON m.run_id = r.run_id
      JOIN settled s ON s.run_id = r.run_id
      LEFT JOIN (SELECT run_id, count(*) AS n FROM gaps WHERE returns GROUP BY 1) o ON o.run_id = r.run_id
    ), metrics AS (
      SELECT *, CASE WHEN converged AND terminal_recall >= 0.80 AND terminal_false_fraction <= 0.34 THEN 'contractive-to-correct'
                     WHEN converged THEN 'false-convergence' WHEN grew AND oscillation_degree = 0 THEN 'divergent'
                     ELSE 'oscillatory-churn' END AS regime FROM bundle
    )"""
