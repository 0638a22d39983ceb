"""From events to runs, and from runs to metrics and regime labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sets


def rounds_of(presence: DataFrame, n_rounds: int, keys: list[str], cumulative=None) -> DataFrame:
    """keys and rounds (array of sorted element arrays) from rows of keys, round, element.

    Rounds without elements are empty sets. With cumulative (a boolean column over the keys) a run's
    rounds hold everything seen so far. Elements per run are bounded by the element domain, and the
    grouping is by run, so a run is the only thing that meets in one task.
    """
    by_round = presence.groupBy(*keys, "round").agg(F.sort_array(F.collect_set("element")).alias("elements"))
    by_run = by_round.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("round", "elements"))).alias("seen"))
    empty = F.array().cast("array<string>")
    at = F.transform(F.sequence(F.lit(0), F.lit(n_rounds - 1)), lambda r: F.coalesce(F.try_element_at("seen", r), empty))
    out = by_run.withColumn("rounds", at)
    if cumulative is not None:
        so_far = F.transform(
            F.sequence(F.lit(1), F.lit(n_rounds)), lambda k: F.sort_array(F.array_distinct(F.flatten(F.slice("rounds", F.lit(1), k))))
        )
        out = out.withColumn("rounds", F.when(cumulative, so_far).otherwise(F.col("rounds")))
    return out.drop("seen")


def trajectory_metrics(runs: DataFrame) -> DataFrame:
    """The metric bundle and the regime of each run (columns rounds, n_defects and any keys)."""
    r, n = F.col("rounds"), F.col("n_defects")
    out = (
        runs.withColumn("n_rounds", F.size(r))
        .withColumn("set_sizes", sets.set_sizes(r))
        .withColumn("churn", sets.churn(r))
        .withColumn("mean_churn", sets.mean_of(F.col("churn")))
        .withColumn("late_churn", sets.last_or(F.col("churn")))
        .withColumn("false_fraction", sets.false_fraction(r))
        .withColumn("terminal_false_fraction", sets.last_or(F.col("false_fraction")))
        .withColumn("true_attrition_events", sets.attrition_events(r))
        .withColumn("oscillation_degree", sets.oscillation_degree(r))
        .withColumn("stabilized_round", sets.stabilized_round(r))
        .withColumn("converged", sets.converged(r))
        .withColumn("terminal_precision", sets.precision(F.try_element_at(r, F.lit(-1))))
        .withColumn("terminal_recall", sets.recall(F.try_element_at(r, F.lit(-1)), n))
    )
    correct = sets.terminal_correct(F.col("terminal_recall"), F.col("terminal_false_fraction"))
    return out.withColumn("regime", sets.regime(F.col("converged"), correct, F.col("set_sizes"), F.col("oscillation_degree")))


def regime_distribution(metrics: DataFrame, *levels: str) -> DataFrame:
    """Shares of the four regimes overall and by each level, zeros included (one pass of grouping sets)."""
    shares = ", ".join(f"avg(CASE WHEN regime = '{g}' THEN 1D ELSE 0D END) AS `{g.replace('-', '_')}`" for g in sets.REGIMES)
    wanted = ", ".join(["()"] + [f"({x})" for x in levels])
    return metrics.sparkSession.sql(
        f"SELECT {', '.join(levels)}, count(*) AS n_runs, {shares} FROM {{m}} GROUP BY GROUPING SETS ({wanted})", m=metrics
    )
