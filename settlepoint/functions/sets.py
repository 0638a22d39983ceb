"""Set dynamics of a run: column expressions over rounds, an array of arrays of distinct element ids.

True elements are those whose id starts with ``def:``. Everything stays in built-in higher-order
functions, so a run is one row and its metrics are one projection (no shuffle, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_PREFIX = "def:"
#: Thresholds of a correct terminal set, both inclusive (fixed values).
RECALL_AT_LEAST, FALSE_AT_MOST = 0.80, 0.34


def is_true(element: Column) -> Column:
    return F.startswith(element, F.lit(TRUE_PREFIX))


def true_elements(elements: Column) -> Column:
    return F.filter(elements, is_true)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; two empty sets are at distance 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def _pairs(rounds: Column, f) -> Column:
    """f(previous, next) for consecutive rounds; empty for a single round."""
    steps = F.transform(F.sequence(F.lit(1), F.size(rounds) - 1), lambda i: f(F.get(rounds, i - 1), F.get(rounds, i)))
    return F.when(F.size(rounds) > 1, steps)


def set_sizes(rounds: Column) -> Column:
    return F.transform(rounds, lambda r: F.size(r))


def churn(rounds: Column) -> Column:
    return F.coalesce(_pairs(rounds, jaccard_distance), F.array().cast("array<double>"))


def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def last_or(values: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(default))


def false_fraction(rounds: Column) -> Column:
    return F.transform(
        rounds, lambda r: F.when(F.size(r) == 0, F.lit(0.0)).otherwise((F.size(r) - F.size(true_elements(r))) / F.size(r))
    )


def attrition_events(rounds: Column) -> Column:
    """True elements of a round that the next round lacks, over all rounds."""
    lost = _pairs(rounds, lambda a, b: F.size(true_elements(F.array_except(a, b))))
    return F.coalesce(F.aggregate(lost, F.lit(0), lambda s, x: s + x), F.lit(0))


def oscillation_degree(rounds: Column) -> Column:
    """Elements that are present, then absent, then present again: those that appear anew more than once."""
    anew = F.transform(rounds, lambda r, i: F.when(i == 0, F.array_distinct(r)).otherwise(F.array_except(r, F.get(rounds, i - 1))))

    def repeated(sorted_: Column) -> Column:
        return F.size(F.array_distinct(F.filter(sorted_, lambda e, i: (i > 0) & (e == F.get(sorted_, i - 1)))))

    # As a lambda's variable the sorted elements are worked out once.
    return F.get(F.transform(F.array(F.sort_array(F.flatten(anew))), repeated), F.lit(0))


def stabilized_round(rounds: Column) -> Column:
    """The first round from which the set equals the terminal one."""
    last = F.try_element_at(rounds, F.lit(-1))
    differing = F.filter(F.transform(rounds, lambda r, i: F.when(~same_set(r, last), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(differing) + 1, F.lit(0))


def converged(rounds: Column) -> Column:
    last, before = F.try_element_at(rounds, F.lit(-1)), F.try_element_at(rounds, F.lit(-2))
    return F.coalesce(same_set(last, before), F.lit(False))


def first_stable(rounds: Column) -> Column:
    """The first round whose set the next round repeats, null if none does."""
    return F.array_min(F.filter(F.transform(rounds, lambda r, i: F.when(same_set(r, F.get(rounds, i + 1)), i)), lambda i: i.isNotNull()))


def precision(elements: Column) -> Column:
    return F.when(F.coalesce(F.size(elements), F.lit(0)) == 0, F.lit(1.0)).otherwise(F.size(true_elements(elements)) / F.size(elements))


def recall(elements: Column, n_defects: Column) -> Column:
    found = F.coalesce(F.size(true_elements(elements)), F.lit(0))
    return F.when(n_defects == 0, F.lit(1.0)).otherwise(found / n_defects)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def terminal_correct(recall_value: Column, false_value: Column) -> Column:
    return (recall_value >= RECALL_AT_LEAST) & (false_value <= FALSE_AT_MOST)


def regime(is_converged: Column, correct: Column, sizes: Column, oscillation: Column) -> Column:
    """The label of a run, from unrounded metrics."""
    last = F.try_element_at(sizes, F.lit(-1))
    grew = (last > F.get(sizes, F.lit(0))) & (last == F.array_max(sizes))
    return (
        F.when(is_converged & correct, "contractive-to-correct")
        .when(is_converged, "false-convergence")
        .when(grew & (oscillation == 0), "divergent")
        .otherwise("oscillatory-churn")
    )


REGIMES = ("contractive-to-correct", "false-convergence", "oscillatory-churn", "divergent")


def late_true(rounds: Column) -> Column:
    """True elements that appear after round 0 only."""
    first = F.get(rounds, F.lit(0))
    rest = F.flatten(F.slice(rounds, F.lit(2), F.greatest(F.size(rounds), F.lit(1))))
    return F.array_distinct(F.array_except(true_elements(rest), first))


def distinct_true(rounds: Column) -> Column:
    return F.array_distinct(true_elements(F.flatten(rounds)))


def round0_recall(rounds: Column, n_defects: Column) -> Column:
    return F.try_divide(F.size(true_elements(F.get(rounds, F.lit(0)))), n_defects)
