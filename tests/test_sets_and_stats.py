import math

import pytest
from pyspark.sql import functions as F

from settlepoint.functions import sets, stats
from settlepoint.operators import arms, ranks, resampling, walsh
from settlepoint.operators.trajectories import regime_distribution, rounds_of, trajectory_metrics

A, B, D2 = "def:a", "def:b", "def:d2"


def runs(spark, *rounds, n_defects=2):
    return spark.createDataFrame([(k, r, n_defects) for k, r in enumerate(rounds)], "run_id int, rounds array<array<string>>, n_defects int")


def metrics(spark, *rounds, n_defects=2):
    return trajectory_metrics(runs(spark, *rounds, n_defects=n_defects)).orderBy("run_id").collect()


def test_known_values(spark):
    m = metrics(
        spark,
        [[A], [A], [A, "false:1"]],
        [[A, D2], [A], [A, D2]],
        [[A], [A, B], [A, B]],
        [["def:d1", "false:0"]],
        [["def:d1", "def:d2"], ["def:d1"]],
        [[], []],
    )
    assert m[0].churn == [0.0, 0.5] and m[0].mean_churn == 0.25 and m[0].late_churn == 0.5
    assert m[1].oscillation_degree == 1 and m[0].oscillation_degree == 0
    assert m[2].stabilized_round == 1 and m[0].stabilized_round == 2 and m[2].converged
    assert (m[3].terminal_precision, m[3].terminal_recall) == (0.5, 0.5) and m[3].n_rounds == 1 and m[3].churn == []
    assert m[4].true_attrition_events == 1
    assert m[5].churn == [0.0] and m[5].terminal_precision == 1.0 and m[5].terminal_false_fraction == 0.0


def test_regimes(spark):
    m = metrics(spark, [[A], [A, B], [A, B]], [[A], [A], [A]], [[A], [A, B], [A]], [[A], [A, "false:0"], [A, "false:0", "false:1"]], n_defects=2)
    assert [r.regime for r in m] == ["contractive-to-correct", "false-convergence", "oscillatory-churn", "divergent"]
    d = regime_distribution(trajectory_metrics(runs(spark, [[A], [A]], [[A, B], [A, B]])), "n_defects").collect()
    for row in d:
        assert sum(row[g.replace("-", "_")] for g in sets.REGIMES) == pytest.approx(1)
    assert metrics(spark, [[], []], n_defects=0)[0].terminal_recall == 1.0


def test_rounds_of_fills_empty_rounds(spark):
    p = spark.createDataFrame([(1, 0, "x"), (1, 2, "y"), (2, 1, "x")], "run_id int, round int, element string")
    got = {r.run_id: r.rounds for r in rounds_of(p, 3, ["run_id"], F.col("run_id") == 1).collect()}
    assert got == {1: [["x"], ["x"], ["x", "y"]], 2: [[], ["x"], []]}


def test_run_helpers(spark):
    r = runs(spark, [["def:d1", "false:0"], ["def:d1", "def:d2"], ["def:d2"]], n_defects=3)
    c = F.col("rounds")
    row = r.select(sets.late_true(c), sets.distinct_true(c), sets.round0_recall(c, F.col("n_defects")), sets.first_stable(c)).first()
    assert row[0] == ["def:d2"] and sorted(row[1]) == ["def:d1", "def:d2"] and row[2] == pytest.approx(1 / 3) and row[3] is None


def brute_p(b, c):
    n, k = b + c, min(b, c)
    probs = [math.comb(n, i) * 0.5**n for i in range(n + 1)]
    return min(1.0, sum(p for p in probs if p <= probs[k] + 1e-12)) if n else 1.0


def test_exact_tests(spark):
    cases = [(0, 0), (5, 0), (19, 2), (4, 4), (7, 8), (300, 250)]
    df = spark.createDataFrame(cases, "b int, c int")
    for r in df.select("b", "c", stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect():
        assert r.p == pytest.approx(brute_p(r.b, r.c), rel=1e-9)
        assert stats.exact_tail(min(r.b, r.c), r.b + r.c) == pytest.approx(r.p)
    diffs = spark.createDataFrame([("m", k, d) for k, d in enumerate([1.0, 1.0, 1.0, 1.0, -1.0, 0.0])], "metric string, artifact_id int, diff double")
    s = stats.sign_test(diffs, ["metric"], "diff").first()
    assert (s.n, s.pos, s.neg, s.tie) == (6, 4, 1, 1) and s.p == pytest.approx(brute_p(4, 1))
    assert spark.range(1).select(stats.min_significant_gap(F.lit(6))).first()[0] == 6
    assert spark.range(1).select(stats.min_significant_gap(F.lit(3))).first()[0] is None


def test_agreement(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "a boolean, b boolean")
    assert df.agg(stats.cohen_kappa(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5)
    same = spark.createDataFrame([(True, True)], "a boolean, b boolean")
    assert same.agg(stats.cohen_kappa(F.col("a"), F.col("b"))).first()[0] == 1.0
    one = spark.range(1)
    low, high = one.select(*stats.wilson(F.lit(8), F.lit(10))).first()
    assert (round(low, 3), round(high, 3)) == (0.49, 0.943)
    assert tuple(one.select(*stats.wilson(F.lit(0), F.lit(0))).first()) == (0.0, 0.0)
    pr = stats.precision_recall(*[F.lit(0)] * 4)
    assert tuple(one.select(*[pr[k] for k in ("precision", "recall", "f1", "accuracy")]).first()) == (1.0, 1.0, 1.0, 1.0)
    votes = spark.createDataFrame([(1, True), (1, False), (2, True), (2, True), (2, False)], "k int, v boolean")
    assert {r.k: r.m for r in votes.groupBy("k").agg(stats.majority_vote(F.col("v")).alias("m")).collect()} == {1: False, 2: True}


def test_majority_prefers_the_first_seen(spark):
    rows = [("x", "mem", "b", 1), ("x", "mem", "a", 2), ("y", "mem", "a", 3), ("y", "mem", "b", 4), ("y", "mem", "b", 5)]
    df = spark.createDataFrame(rows, "artifact_id string, arm string, regime string, run_id int")
    assert {r.artifact_id: r.regime for r in arms.majority_regimes(df).collect()} == {"x": "b", "y": "b"}


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    got = {r.test: r.p_holm for r in stats.holm(df).collect()}
    assert got == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06)}


def plain_signed_rank_p(diffs):
    """Two-sided p of the signed-rank test: every assignment of signs counted where it is exact."""
    from statistics import NormalDist

    d = [x for x in diffs if x != 0]
    sizes = sorted(abs(x) for x in d)
    rank = {v: sizes.index(v) + (sizes.count(v) + 1) / 2 for v in set(sizes)}
    n, plus = len(d), sum(rank[abs(x)] for x in d if x > 0)
    low = min(plus, n * (n + 1) / 2 - plus)
    if n == 0:
        return 1.0
    if n > 50 or len(rank) < n or n < len(diffs):
        variance = n * (n + 1) * (2 * n + 1) / 24 - sum(sizes.count(v) ** 3 - sizes.count(v) for v in rank) / 48
        return min(1.0, 2 * NormalDist().cdf((low - n * (n + 1) / 4) / variance**0.5)) if variance > 0 else 1.0
    sums = {0: 1}
    for r in range(1, n + 1):
        more = dict(sums)
        for s, ways in sums.items():
            more[s + r] = more.get(s + r, 0) + ways
        sums = more
    return min(1.0, 2 * sum(w for s, w in sums.items() if s <= low) / 2**n)


def plain_hodges_lehmann(used):
    n, means = len(used), sorted((a + b) / 2 for i, a in enumerate(used) for b in used[i:])
    m = len(means)
    at = max(1, min(round(m / 2 - 1.959964 * (n * (n + 1) * (2 * n + 1) / 24) ** 0.5), m // 2))
    return (means[(m + 1) // 2 - 1] + means[m // 2]) / 2, means[at - 1], means[m - at]


def test_rank_statistics(spark):
    assert plain_signed_rank_p([1, 2, 3, 4, 5]) == pytest.approx(2 / 32)
    assert plain_signed_rank_p([]) == 1.0 and plain_signed_rank_p([0, 0]) == 1.0
    assert 0 < plain_signed_rank_p([1, 1, -1, 2, 2, 3]) < 1
    diffs = [0.5, -0.2, 0.1, 0.9, 0.0]
    df = spark.createDataFrame([("m", k, d) for k, d in enumerate(diffs)], "metric string, artifact_id int, diff double")
    row = walsh.hodges_lehmann(df, ["metric"], "diff").first()
    used = sorted(d for d in diffs if d)
    means = sorted((used[i] + used[j]) / 2 for i in range(4) for j in range(i, 4))
    assert row.estimate == pytest.approx((means[4] + means[5]) / 2) and row.ci_low == pytest.approx(means[0]) and row.ci_high == pytest.approx(means[-1])


def test_bootstrap(spark):
    rows = [(k, float(k % 2 + 1), 2, 0.0, 2) for k in range(20)]
    per = spark.createDataFrame(rows, "artifact_id int, sa double, na int, sb double, nb int")
    boots = resampling.bootstrap_difference(per, 200)
    s = resampling.summary(boots, (0.5,)).first()
    assert s.samples == 200 and s.ci95_low < 0.75 < s.ci95_high and s.p == 0.0
    assert boots.orderBy("b").collect() == resampling.bootstrap_difference(per.repartition(3), 200).orderBy("b").collect()


def test_registered_bootstraps_draw_as_many_samples_as_the_reference(spark):
    from settlepoint.plans import convergence

    for name in ("cluster_bootstrap", "majority_bootstrap"):
        row, = convergence.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert row.samples == 20_000


def test_hodges_lehmann_with_repeated_differences(spark):
    import random

    draw = random.Random(3)
    sets_of = {"a": [draw.choice([-0.5, 0.25, 0.25, 1.0, 3.5]) for _ in range(61)], "b": [draw.gauss(-1, 2) for _ in range(40)], "c": [-0.0, 0.0, -2.0], "d": [0.0]}
    df = spark.createDataFrame([(k, i, d) for k, v in sets_of.items() for i, d in enumerate(v)], "metric string, artifact_id int, diff double")
    got = {r.metric: r for r in walsh.hodges_lehmann(df, ["metric"], "diff").collect()}
    assert sorted(got) == ["a", "b", "c"]
    for k, r in got.items():
        used = sorted(d for d in sets_of[k] if d)
        n = len(used)
        assert (r.estimate, r.ci_low, r.ci_high) == pytest.approx(plain_hodges_lehmann(used))


def test_p_labels(spark):
    df = spark.createDataFrame([(0.0005,), (0.005,), (0.04,), (0.5,), (None,)], "p double")
    got = df.select(stats.significance(F.col("p")).alias("s"), stats.format_p(F.col("p")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("***", "<0.001"), ("**", "0.0050"), ("*", "0.0400"), ("ns", "0.5000"), ("ns", None)]


def test_wilcoxon_counts_equal_the_plain_form(spark):
    import random

    draw = random.Random(9)
    cases = {
        "ties": [draw.choice([-2.0, -1.0, 0.0, 1.0, 1.0, 3.0]) for _ in range(200)], "small": [draw.gauss(0.3, 1) for _ in range(20)],
        "large": [draw.gauss(0.1, 1) for _ in range(80)], "zeros": [0.0] * 60, "one": [0.0] * 60 + [1.5],
    }
    data = [(k, d) for k, v in cases.items() for d in v] + [("ties", None), ("ties", float("nan"))]
    got = {r.k: r for r in ranks.wilcoxon(spark.createDataFrame(data, "k string, d double"), ["k"], "d").collect()}
    for k, v in cases.items():
        assert got[k].n == len(v) and got[k].p == pytest.approx(plain_signed_rank_p(v), abs=1e-12)


def test_hodges_lehmann_in_passes(spark):
    """More values than blocks: brackets are narrowed by exact counts, then listed."""
    import random

    draw = random.Random(2)
    cases = {
        "gauss": lambda: draw.gauss(0.2, 1), "lattice": lambda: draw.randrange(-300, 400) / 8, "heavy tails": lambda: draw.choice([-1, 1]) * 10 ** draw.uniform(-9, 9),
        None: lambda: float(draw.choice([-1, 1]) * draw.randrange(1, 300)), "skewed counts": lambda: draw.choice([0.5, draw.gauss(0, 1)]),
    }
    values = {k: [of() for _ in range(500)] + [0.0, None] for k, of in cases.items()}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, d double")
    got = walsh.hodges_lehmann(df.repartition(3), ["k"], "d", blocks=8, listed=3000).collect()
    assert {r.k for r in got} == set(cases)
    for r in got:
        want = plain_hodges_lehmann(sorted(v for v in values[r.k] if v))
        assert (r.estimate, r.ci_low, r.ci_high) == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_ranks_of_one_large_key_are_spread(spark):
    """A key with all rows: its running sums are exact, and no range holds twice the median of rows."""
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % n).alias("v"), (F.col("id") % 3 + 1).alias("w"))
    placed = ranks.cumulative(df, ["k"], "v", "w")
    assert placed.where("_index <> v").count() == 0
    last = placed.orderBy(F.desc("v")).first()
    assert last["_before"] + last["w"] == df.agg(F.sum("w")).first()[0]
    sizes = sorted(r["count"] for r in df.repartitionByRange(4, "v").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    middle = ranks.quantiles(df, ["k"], "v", {"p50": 0.5, "p0": 0.0, "p100": 1.0, "p30": 0.3}).first()
    assert (middle.p0, middle.p50, middle.p100) == (0, (n - 1) / 2, n - 1) and middle.p30 == pytest.approx(0.3 * (n - 1))


def test_quantiles_with_ties_and_nulls(spark):
    import random
    import statistics

    draw = random.Random(4)
    data = {"a": [draw.choice([1.0, 2.0, 2.0, 5.5]) for _ in range(101)], "b": [draw.gauss(0, 1) for _ in range(60)], None: [3.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("a", float("nan")), ("c", None)], "k string, v double")
    got = {r.k: r for r in ranks.quantiles(df, ["k"], "v", {"q": 0.25, "m": 0.5}).collect()}
    assert set(got) == {"a", "b", None}
    for k, vs in data.items():
        assert got[k].m == pytest.approx(statistics.median(vs))
        assert len(vs) == 1 or got[k].q == pytest.approx(statistics.quantiles(vs, n=4, method="inclusive")[0])


def test_blockwise_bootstrap_equals_a_row_a_draw(spark):
    """Same draws, whatever the blocks; and 20,000 samples of many artifacts stay a row a sample and block."""
    import random

    draw = random.Random(8)
    data = [(k, draw.random(), draw.randrange(1, 4), draw.random(), draw.randrange(1, 4)) for k in range(137)]
    per = spark.createDataFrame(data, "artifact_id int, sa double, na int, sb double, nb int")
    plain = {}
    for b in range(23):
        picked = [data[int(x) % 137] for x in resampling.drawn(resampling.np.array([b]), resampling.np.arange(137))[0]]
        sa, na, sb, nb = (sum(p[i] for p in picked) for i in (1, 2, 3, 4))
        plain[b] = sa / na - sb / nb
    for blocks in ({}, {"sample_block": 5, "artifact_block": 10}, {"sample_block": 100, "artifact_block": 137}):
        got = {r.b: r.diff for r in resampling.bootstrap_difference(per, 23, **blocks).collect()}
        assert got == pytest.approx(plain)
    expected = spark.range(23).select(*[resampling.draw(F.col("id"), F.lit(j)).alias(f"d{j}") for j in (0, 5)]).collect()
    assert [[r.d0, r.d5] for r in expected] == resampling.drawn(resampling.np.arange(23), resampling.np.array([0, 5])).tolist()
    assert resampling.bootstrap_difference(per.where("false"), 3).count() == 0


def test_oscillation_is_that_of_each_element(spark):
    import random

    draw = random.Random(3)
    runs = [[draw.sample("abcde", draw.randrange(0, 6)) for _ in range(draw.randrange(0, 7))] for _ in range(200)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(runs)], "k int, rounds array<array<string>>")
    for row in df.select("k", sets.oscillation_degree(F.col("rounds")).alias("n")).collect():
        at = {e: [i for i, r in enumerate(runs[row.k]) if e in r] for e in "abcde"}
        assert row.n == sum(bool(x) and x[-1] - x[0] + 1 > len(x) for x in at.values())
