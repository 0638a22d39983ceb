"""The review loop: rounds are a data dependency, items are parallel.

Each round is one DataFrame step over all items: prompts from the artifact and the previous round's
findings, a reviewer (mapInPandas), an extractor (replies parsed with built-in functions), and for
ledger arms the fold of retirements and new findings (compared in a Python worker). State between rounds is a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from ..functions import text
from . import matching
from .judging import with_retries


@dataclass(frozen=True)
class LoopConfig:
    config_id: str
    rounds: int = 6
    memory: bool = False
    panel_size: int = 1
    ledger: bool = False
    grounded_retire: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.rounds <= 8:
            raise ValueError("rounds must be 1 to 8")
        if self.panel_size < 1:
            raise ValueError("panel_size must be at least 1")
        if self.ledger and (self.panel_size != 1 or not self.memory):
            raise ValueError("a ledger needs memory and a panel of one")


def listed(findings: Column) -> Column:
    """Numbered claims with their places."""
    item = lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f["claim"], _place(f["location"]))
    return F.array_join(F.transform(findings, item), "\n")


def _place(location: Column) -> Column:
    shown = text.location_text(location["unit"], location["start"], location["end"])
    return F.when(F.coalesce(shown, F.lit("")) == "", "").otherwise(F.concat(F.lit(" ["), shown, F.lit("]")))


def review_prompt(artifact: Column, prior: Column, config: LoopConfig) -> Column:
    """What a reviewer is asked in a round; prior findings are shown with memory only."""
    base = F.concat(F.lit("Review this artifact and report every defect that you find.\n\n"), text.numbered_listing(artifact))
    if not config.memory:
        return base
    if config.ledger:
        note = "\n\nLedger of findings so far:\n{}\n\nAnswer with a RETIRE section (numbers and grounds) and a NEW section."
    else:
        note = "\n\nFindings of the last round:\n{}\n\nReport the full list that holds now."
    before, after = note.split("{}")
    return F.when(F.size(prior) > 0, F.concat(base, F.lit(before), listed(prior), F.lit(after))).otherwise(base)


def judge_prompt(a: Column, la: Column, b: Column, lb: Column) -> Column:
    side = lambda name, c, loc: F.concat(F.lit(f"{name}: "), c, _place(loc), F.lit("\n"))
    return F.concat(F.lit("Do these two findings report the same issue? Answer SAME or DIFFERENT on the first line.\n"), side("A", a, la), side("B", b, lb))


def asked(prompts: DataFrame, client: Callable[[str], str], panel: int = 1, attempts: int = 3) -> DataFrame:
    """id, replies (array) of a client to each row's prompt."""
    kind = dict(prompts.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies = [[with_retries(lambda p=p: client(p), attempts) or "" for _ in range(panel)] for p in b["prompt"]]
            yield pd.DataFrame({"id": b["id"], "replies": replies})

    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, replies array<string>")


def _merged_ledger(replies: DataFrame, round_index: int, config: LoopConfig) -> DataFrame:
    """Replies with found: survivors of the retirements and then new claims that no survivor states.

    A claim is stated by a finding that is not disjoint from it in place and LEDGER_TAU similar, as in
    matching.ledger_rounds. Claims are compared one by one in order, in a Python worker.
    """
    sections = text.split_sections(F.get("replies", F.lit(0)))
    retired = text.parse_retirements(sections["retire"], F.size("prior"), 2 if config.grounded_retire else 0)
    survivors = F.filter("prior", lambda f, i: ~F.array_contains(retired, i))
    side = lambda c: F.transform(c, matching.comparable)
    both = replies.withColumn("_kept", survivors).withColumn("_new", text.parse_findings(sections["new"], F.lit(round_index)))
    both = both.withColumn("_take", _added(side("_kept"), side("_new")))
    taken = F.filter("_new", lambda _, i: F.get("_take", i))
    return both.withColumn("found", F.concat("_kept", taken)).drop("_kept", "_new", "_take")


@F.pandas_udf(ArrayType(BooleanType()))
def _added(kept: pd.Series, new: pd.Series) -> pd.Series:
    """For each new claim whether neither a survivor nor an earlier added claim states it."""

    def flags(ledger: Iterable, claims: Iterable) -> list[bool]:
        ledger, out = list(ledger), []
        for c in claims:
            out.append(not any(matching.restates(c, g) for g in ledger))
            if out[-1]:
                ledger.append(c)
        return out

    none = lambda x: [] if x is None else x
    return pd.Series([flags(none(k), none(n)) for k, n in zip(kept, new, strict=True)], dtype=object)


def _renumbered(findings: Column, round_index: int) -> Column:
    return F.transform(
        findings,
        lambda f, i: F.struct(
            F.concat(F.lit(f"r{round_index}-f"), i.cast("string")).alias("id"), f["claim"].alias("claim"), f["location"].alias("location"), f["severity"].alias("severity"), f["evidence"].alias("evidence")
        ),
    )


def run_loop(items: DataFrame, client: Callable[[str], str], config: LoopConfig, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, round, findings, transcript of every item and round.

    items has id and artifact. cut materialises a round (checkpoint or a written table) so that no reply
    is asked for twice; without it a round is persisted.
    """
    cut = cut or (lambda df: df.persist())
    empty = F.array().cast(f"array<{text.FINDING}>")
    state = items.select("id", "artifact", empty.alias("prior"))
    out = None
    for r in range(config.rounds):
        prompts = state.withColumn("prompt", review_prompt(F.col("artifact"), F.col("prior"), config))
        replies = state.join(asked(prompts, client, config.panel_size), "id")
        if config.ledger and r > 0:
            replies, found = _merged_ledger(replies, r, config), F.col("found")
        else:  # a panel's findings are a bag union in reviewer order
            found = F.flatten(F.transform("replies", lambda x: text.parse_findings(x, F.lit(r))))
        rows = cut(replies.select("id", "artifact", F.lit(r).alias("round"), _renumbered(found, r).alias("findings"), F.col("replies").alias("transcript")))
        out = rows if out is None else out.unionByName(rows)
        state = rows.select("id", "artifact", F.col("findings").alias("prior"))
    return out.drop("artifact")
