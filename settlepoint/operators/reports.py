"""Reports that compare arms: failure fractions, settle rules, per-artifact probes, measured contamination, gray policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import location, sets, stats, text
from . import arms, matching
from .trajectories import trajectory_metrics

CC, FC = sets.REGIMES[0], sets.REGIMES[1]
POLICIES = ("positional", "semantic", "none")


def _share(label: Column) -> Column:
    return F.avg(F.when(label, 1.0).otherwise(0.0))


def failure_tests(metrics: DataFrame, base: str, label: str = FC) -> DataFrame:
    """Per other arm: the sign test of its per-artifact share of a regime against the base arm's (pos: more than base)."""
    per = metrics.groupBy("artifact_id", "arm").agg(_share(F.col("regime") == label).alias("share"))
    of = per.where(F.col("arm") == base).select("artifact_id", F.col("share").alias("base_share"))
    paired = per.where(F.col("arm") != base).join(of, "artifact_id").withColumn("diff", F.col("share") - F.col("base_share"))
    return stats.sign_test(paired, ["arm"], "diff")


def settle_rules(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """rule (full_set or defect_projection) with run-level and majority rates of correct convergence of two arms, their
    gaps, and the exact McNemar test over artifacts that both have."""
    both = arms.defect_projected(metrics.where(F.col("arm").isin(a, b)))
    by_rule = F.explode(F.array(F.struct(F.lit("full_set").alias("rule"), F.col("regime").alias("r")), F.struct(F.lit("defect_projection").alias("rule"), F.col("projected").alias("r"))))
    long = both.select("artifact_id", "arm", "run_id", by_rule.alias("x")).select("artifact_id", "arm", "run_id", "x.rule", F.col("x.r").alias("regime"))
    run = long.groupBy("rule").agg(_share_of(a).alias("run_a"), _share_of(b).alias("run_b"))
    majority = stats.majority_label(long, ["rule", "artifact_id", "arm"], "regime", ["run_id"])
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, (F.col("regime") == CC).cast("int")))
    wide = majority.groupBy("rule", "artifact_id").agg(pick(a).alias("ra"), pick(b).alias("rb")).where("ra IS NOT NULL AND rb IS NOT NULL")
    counts = wide.groupBy("rule").agg(F.count("*").alias("n"), F.avg("ra").alias("majority_a"), F.avg("rb").alias("majority_b"), F.count_if(F.col("ra") > F.col("rb")).alias("a_only"), F.count_if(F.col("rb") > F.col("ra")).alias("b_only"))
    out = run.join(counts, "rule")
    return out.select(
        "*", (F.col("run_a") - F.col("run_b")).alias("run_gap"), (F.col("majority_a") - F.col("majority_b")).alias("majority_gap"),
        stats.mcnemar_exact(F.col("a_only"), F.col("b_only")).alias("p"),
    )


def _share_of(arm: str) -> Column:
    return F.avg(F.when(F.col("arm") == arm, F.when(F.col("regime") == CC, 1.0).otherwise(0.0)))


def reclassified(metrics: DataFrame) -> DataFrame:
    """arm, regime, projected and the number of runs that the projection moves between them."""
    moved = arms.defect_projected(metrics).where("regime <> projected")
    return moved.groupBy("arm", "regime", "projected").agg(F.count("*").alias("n"))


def probe_table(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """A row per artifact: the majority regime, mean terminal recall and converged share of both arms."""
    per = metrics.groupBy("artifact_id", "arm").agg(F.avg("terminal_recall").alias("recall"), _share(F.col("converged")).alias("conv"))
    both = per.join(arms.majority_regimes(metrics), ["artifact_id", "arm"])
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{c}_{'a' if arm == a else 'b'}")
    return both.groupBy("artifact_id").agg(*[of(arm, c) for c in ("regime", "recall", "conv") for arm in (a, b)])


def probe_rates(metrics: DataFrame, a: str, b: str, ceiling: float = 0.999) -> DataFrame:
    """One row: run-level and majority rates, the McNemar counts and p, and artifacts at and below the recall ceiling."""
    run = metrics.agg(_share_of(a).alias("run_a"), _share_of(b).alias("run_b"), *[F.min(F.when(F.col("arm") == arm, F.col("terminal_recall"))).alias(f"least_recall_{s}") for arm, s in ((a, "a"), (b, "b"))])
    cc = lambda s: F.coalesce(F.col(f"regime_{s}") == CC, F.lit(False))
    table = probe_table(metrics, a, b).agg(
        F.count("*").alias("n"), _share(cc("a")).alias("majority_a"), _share(cc("b")).alias("majority_b"),
        F.count_if(cc("a") & ~cc("b")).alias("a_only"), F.count_if(cc("b") & ~cc("a")).alias("b_only"),
        *[F.count_if(F.col(f"recall_{s}") >= ceiling).alias(f"at_ceiling_{s}") for s in "ab"],
        *[F.count_if(F.col(f"recall_{s}") < ceiling).alias(f"below_ceiling_{s}") for s in "ab"],
    )
    return run.crossJoin(F.broadcast(table)).withColumn("p", stats.mcnemar_exact(F.col("a_only"), F.col("b_only")))  # one row each


def reproduced_lines(texts: DataFrame, keys: list[str], share: float = 0.55, shortest: int = 8) -> DataFrame:
    """keys, n, hits, verbatim: of a text's later lines (normalised, of `shortest` characters or more) those that its first
    part holds; verbatim is null without such lines. Texts under six lines are left out.

    Lines meet by row and content in a grouped count, so a text of very many lines is no quadratic search.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.trim(F.lower(x)), r"\s+", " ")), lambda x: x != "")
    d = texts.select(*keys, lines.alias("lines")).where(F.size("lines") >= 6).withColumn("_row", F.monotonically_increasing_id())
    k = F.greatest(F.lit(2), F.floor(F.lit(share) * F.size("lines")).cast("int"))
    each = d.select("_row", *keys, k.alias("k"), F.posexplode("lines").alias("at", "line"))
    late = (F.col("at") >= F.col("k")) & (F.char_length("line") >= shortest)
    per = each.groupBy("_row", *keys, F.sha2("line", 256).alias("line")).agg(F.count_if(late).alias("late"), F.max(F.col("at") < F.col("k")).alias("early"))
    out = per.groupBy("_row", *keys).agg(F.sum("late").alias("n"), F.coalesce(F.sum(F.when(F.col("early"), F.col("late"))), F.lit(0)).alias("hits"))
    return out.select(*keys, "n", "hits", F.try_divide("hits", "n").alias("verbatim"))


def contamination(probe: DataFrame, recall: DataFrame, levels: list[str]) -> DataFrame:
    """Levels of grouping sets (overall and each level) with n, the mean verbatim share over texts that have one, and its
    correlation with the recall of the artifact, over those that have both."""
    joined = probe.join(recall, "artifact_id", "left")
    both = F.col("verbatim").isNotNull() & F.col("recall").isNotNull()
    x, y = (F.when(both, F.col(c)) for c in ("verbatim", "recall"))
    wanted = joined.groupingSets([[], *[[c] for c in levels]], *levels)
    return wanted.agg(
        F.count("*").alias("n"), F.avg("verbatim").alias("verbatim"), F.count_if(both).alias("n_correlated"),
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"),  # null where either does not vary
    )


def policy_runs(findings: DataFrame, edges: DataFrame, keys: list[str], *policies: str) -> DataFrame:
    """variant (the policy), run_id, rounds of canonical elements under gray policies: findings are excused by place, by note,
    or not at all. The findings are matched and sent once for all policies.

    findings has keys (a round of a run), run_id, round, finding, claim, location and zones (location, note); edges link
    findings to defects. Excused findings are no elements; what else is false is clustered.
    """

    def similarity(z: Column) -> Column:
        # As a lambda's variable both sets of words are worked out once.
        words = F.array(F.struct(text.content_tokens(F.col("claim")).alias("a"), text.content_tokens(z["note"]).alias("b")))
        return F.get(F.transform(words, lambda w: text.lexical(w["a"], w["b"])), F.lit(0))

    # Only where the note applies: few findings lie in a zone.
    noted = findings.withColumn("note_similarity", F.transform("zones", lambda z: F.when(location.note_applies(F.col("location"), z), similarity(z))))
    held = F.array_compact(F.array(*[F.when(~matching.gray_flag(noted, p), F.lit(p)) for p in policies]))
    judged = matching.dispositions(noted.withColumn("_held", held).drop("zones", "note_similarity").withColumn("gray", F.lit(False)), edges, keys)
    judged = judged.withColumn("variants", F.when(F.col("disposition") == "false", F.col("_held")))
    return matching.canonical_variants(judged.withColumn("defect_id", F.col("defect").cast("string")), policies)


def policy_table(findings: DataFrame, edges: DataFrame, keys: list[str], runs: DataFrame) -> DataFrame:
    """policy and arm with n, shares of correct and false convergence and mean dynamics, each policy's runs rebuilt.

    runs has run_id, arm and n_defects.
    """
    m = trajectory_metrics(policy_runs(findings, edges, keys, *POLICIES).withColumnRenamed("variant", "policy").join(runs, "run_id"))
    return m.groupBy("policy", "arm").agg(
        F.count("*").alias("n"), _share(F.col("regime") == CC).alias("cc"), _share(F.col("regime") == FC).alias("fc"), F.avg("mean_churn").alias("mean_churn"),
        F.avg("oscillation_degree").alias("oscillation"), F.avg("stabilized_round").alias("stabilized"),
    )
