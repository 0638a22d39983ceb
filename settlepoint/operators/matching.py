"""Identity of findings: staged pair decisions, verdict cache, assignment, clustering, canonical runs.

Pairs are rows. The deterministic stages are one CASE over columns, so only the band between them is left
for a judge; callers filter that band before any Python. Order-dependent algorithms (assignment, greedy
clustering) run per run or round in grouped pandas functions over edges decided beforehand.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import location, text
from ..session import shared_path

#: Decision thresholds (fixed values).
TAU_HIGH, TAU_LOW, TAU_MID, RULE_TAU, LEDGER_TAU = 0.60, 0.25, 0.42, 0.34, 0.72

STOP_WORDS = frozenset(text.STOP_WORDS)


def with_similarity(pairs: DataFrame, full: bool = False, a: str = "text_a", b: str = "text_b", tokens: tuple[str, str] | None = None) -> DataFrame:
    """Adds sim and symmetric (and jac): set views only, or with the word ratio where full.

    tokens names columns of content tokens, worked out for each text before it is paired; they are dropped.
    Without them a pair's texts are split here, again for each use of a similarity in a condition.
    """
    if tokens:
        x = pairs.withColumnsRenamed(dict(zip(tokens, ("_a", "_b"), strict=True)))
    else:
        x = pairs.withColumn("_a", text.content_tokens(F.col(a))).withColumn("_b", text.content_tokens(F.col(b)))
    x = x.withColumn("jac", text.jaccard(F.col("_a"), F.col("_b"))).withColumn("_over", 0.85 * text.overlap(F.col("_a"), F.col("_b")))
    if full:
        x = x.withColumn("_ratio", text.word_ratio(text.normalize(F.col(a)), text.normalize(F.col(b))))
        x = x.withColumn("sim", F.greatest("jac", "_ratio", "_over")).withColumn("symmetric", F.greatest("jac", "_ratio"))
    else:
        x = x.withColumn("sim", F.greatest("jac", "_over")).withColumn("symmetric", F.col("jac"))
    return x.drop("_a", "_b", "_over", "_ratio")


def decide(pairs: DataFrame, judge: bool = True, cache: DataFrame | None = None, tau_mid: float = TAU_MID) -> DataFrame:
    """Adds same and method to pairs with sim, symmetric, jac and loc (a compatibility).

    With a cache (pair_key, same) its verdict comes first; what the deterministic stages leave goes to the
    rule judge (token Jaccard), or without one to the middle threshold.
    """
    disjoint = (F.col("loc") == "disjoint") & (F.col("sim") <= TAU_LOW)
    high = (F.col("loc") != "disjoint") & (F.col("sim") >= TAU_HIGH) & (F.col("symmetric") >= TAU_HIGH)
    same = F.when(disjoint, False).when(high, True)
    method = F.when(disjoint, "anchor-disjoint").when(high, "lexical-high")
    if judge:
        same, method = same.otherwise(F.col("jac") >= RULE_TAU), method.otherwise("judge")
    else:
        same, method = same.otherwise(F.col("sim") >= tau_mid), method.otherwise("lexical-fallback")
    if cache is None:
        return pairs.withColumn("same", same).withColumn("method", method)
    known = cache.select(F.col("pair_key"), F.col("same").alias("_known"))
    joined = pairs.join(known, "pair_key", "left")
    hit = F.col("_known").isNotNull()
    return joined.withColumn("same", F.when(hit, F.col("_known")).otherwise(same)).withColumn("method", F.when(hit, "cache").otherwise(method)).drop("_known")


def new_verdicts(decided: DataFrame, cache: DataFrame, order: list[str]) -> DataFrame:
    """pair_key, same of pairs that the cache lacks; of several with one key the first in order counts."""
    missing = decided.join(cache.select("pair_key"), "pair_key", "left_anti")
    return missing.groupBy("pair_key").agg(F.min_by("same", F.struct(*order)).alias("same"))


def gray_flag(findings: DataFrame, policy: str = "positional") -> Column:
    """Whether a finding (columns location, zones and, for semantic, note_similarity) is excused."""
    if policy == "none":
        return F.lit(False)
    if policy == "positional":
        return location.in_gray_zone(F.col("location"), F.col("zones"))
    return location.gray_by_note(F.col("location"), F.col("zones"), F.col("note_similarity"))


def best_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Many-to-one: each finding's best edge, ties to the higher defect."""
    return edges.groupBy(*keys, "finding").agg(F.max(F.struct("score", "defect")).alias("best")).select(*keys, "finding", "best.score", "best.defect")


def maximum_matching(preferences: dict[int, list[int]], order: list[int]) -> dict[int, int]:
    """right -> left of a maximum-cardinality matching; alternating paths are searched depth first, each
    left vertex trying its rights in preference order, with an explicit stack."""
    owner: dict[int, int] = {}
    for start in order:
        tried: set[int] = set()
        path: list[tuple[int, int]] = []  # (left, the right it is trying to take)
        stack = [(start, iter(preferences.get(start, ())))]
        while stack:
            left, rights = stack[-1]
            right = next((r for r in rights if r not in tried), None)
            if right is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            tried.add(right)
            path.append((left, right))
            if right not in owner:
                for taker, taken in path:
                    owner[taken] = taker
                break
            stack.append((owner[right], iter(preferences.get(owner[right], ()))))
    return owner


def _assigned(edges: list[dict]) -> dict[int, int]:
    """finding -> defect of one group's edges (finding, defect, score), which descend by score and defect."""
    preferences: dict[int, list[int]] = {}
    best: dict[int, float] = {}
    for e in edges:
        preferences.setdefault(e["finding"], []).append(e["defect"])
        best.setdefault(e["finding"], float("-inf") if e["score"] is None else e["score"])
    order = sorted(preferences, key=lambda i: (-best[i], i))
    return {left: right for right, left in maximum_matching(preferences, order).items()}


def assign(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, finding, defect of a one-to-one maximum matching per key (a round of a run: a small group).

    A group is one row of its sorted edges, so that Python takes many groups in an Arrow batch. Edges
    without a finding or a defect match nothing.
    """
    kinds = dict(edges.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", finding int, defect int"
    edge = F.struct(F.col("score").cast("double").alias("score"), F.col("defect").cast("int").alias("defect"), F.col("finding").cast("int").alias("finding"))
    grouped = edges.where("finding is not null and defect is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(edge), asc=False).alias("_edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(r, f, d) for r, group in enumerate(b.column(len(keys)).to_pylist()) for f, d in sorted(_assigned(group).items())]
            row, finding, defect = (pa.array([x[k] for x in found], pa.int32()) for k in range(3))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(len(keys))), finding, defect], [*keys, "finding", "defect"])

    return grouped.mapInArrow(run, schema)


def dispositions(findings: DataFrame, edges: DataFrame, keys: list[str], bijective: bool = True) -> DataFrame:
    """keys, finding, defect and disposition (tp, dup, gray or false) of every finding (with its gray flag).

    A finding with edges that loses the assignment only reaches defects that are taken: a duplicate.
    """
    won = assign(edges, keys) if bijective else best_edges(edges, keys).drop("score")
    edged = edges.select(*keys, "finding").distinct().join(won, [*keys, "finding"], "left").withColumn("_edged", F.lit(True))
    # Written, so that its size is known: findings with edges are few, and then the findings stay where they are.
    path = shared_path(edges.sparkSession, "verdicts")
    edged.write.parquet(path)
    out = findings.join(edges.sparkSession.read.schema(edged.schema).parquet(path), [*keys, "finding"], "left")
    kind = F.when(F.col("defect").isNotNull(), "tp").when(F.col("_edged"), "dup").when(F.col("gray"), "gray").otherwise("false")
    return out.withColumn("disposition", kind).drop("_edged")


def missed(defects: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Defects that no finding of a key was assigned to."""
    return defects.join(judged.where("disposition = 'tp'").select(*keys, "defect"), [*keys, "defect"], "left_anti")


def greedy_clusters(items: list, same: Callable) -> list[int]:
    """The leader (position) of each item, in order: the first leader it is the same as, else itself."""
    leaders: list[int] = []
    out = []
    for i, x in enumerate(items):
        found = next((k for k in leaders if same(x, items[k])), None)
        if found is None:
            leaders.append(i)
            found = i
        out.append(found)
    return out


def prepared(f: dict) -> dict:
    """A claim as same_claim compares it: its content tokens as a set, its words in order and counted."""
    words = f["norm"].split()
    return {**f, "tokens": frozenset(f["tokens"]), "words": words, "bag": Counter(words)}


def same_claim(a: dict, b: dict) -> bool:
    """The staged decision with the word ratio and the rule judge, for prepared findings met one by one.

    The ratio is taken only where the sets leave a stage open that its bound (words in common) could reach.
    """
    x, y = a["tokens"], b["tokens"]
    both = len(x & y)
    jac = both / (len(x) + len(y) - both) if x and y else 0.0
    over = 0.85 * both / min(len(x), len(y)) if x and y else 0.0
    compatible = a["unit"] is None or b["unit"] is None
    disjoint = not compatible and (a["unit"] != b["unit"] or (None not in (a["start"], a["end"], b["start"], b["end"]) and not (a["start"] <= b["end"] and b["start"] <= a["end"])))
    if disjoint or jac >= RULE_TAU:  # without a place in common, or already the same, the ratio changes nothing
        return jac >= RULE_TAU
    n = len(a["words"]) + len(b["words"])
    if n and (2 * min(len(a["words"]), len(b["words"])) < TAU_HIGH * n or 2 * (a["bag"] & b["bag"]).total() < TAU_HIGH * n):
        return False
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a["words"], b["words"]).ratio() >= TAU_HIGH


def canonical_runs(judged: DataFrame, n_rounds: DataFrame | None = None) -> DataFrame:
    """run_id, rounds (arrays of element ids): def:<id> for true findings, false:<k> for clusters of false ones.

    judged has run_id, round, finding, defect_id, disposition, claim, location. False findings are clustered
    within their round and then meet the representatives of earlier rounds, in order; a run is one group.
    """
    return canonical_variants(judged.withColumn("variants", F.when(F.col("disposition") == "false", F.array(F.lit("")))), ("",)).drop("variant")


def canonical_variants(judged: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """variant, run_id, rounds: canonical runs where a finding is false under some variants only (an array of their names).

    A run is one row of its findings, so that Python takes many runs in an Arrow batch; text is sent of false ones only, once
    for all variants, and two findings are compared once for all of them.
    """
    false = F.coalesce(F.size("variants"), F.lit(0)) > 0
    place = F.col("location")
    finding = F.struct(
        F.col("round").cast("int").alias("round"), "finding", F.when(F.col("disposition") == "tp", F.coalesce(F.col("defect_id").cast("string"), F.lit("None"))).alias("defect_id"),
        F.when(false, F.coalesce(text.normalize(F.col("claim")), F.lit(""))).alias("norm"), F.when(false, F.col("variants")).alias("variants"),
        *[F.when(false, place[c]).alias(c) for c in ("unit", "start", "end")],
    )
    element = F.when((F.col("disposition") == "tp") | false, finding)
    runs = judged.groupBy("run_id").agg(F.max(F.col("round").cast("int")).alias("_last"), F.sort_array(F.collect_list(element)).alias("_findings"))
    kind = dict(judged.dtypes)["run_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, names, rounds = [], [], []
            for i, (last, found) in enumerate(zip(b.column(1).to_pylist(), _findings(b.column(2)), strict=True)):
                same, done = _Compared(found), {}
                for v in variants:
                    false = tuple(k for k, f in enumerate(found) if f["defect_id"] is None and v in f["variants"])
                    if false not in done:  # most runs are the same under all variants
                        done[false] = _canonical(found, last + 1, false, same)
                    at.append(i)
                    names.append(v)
                    rounds.append(done[false])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column(0).take(pa.array(at, pa.int32())), pa.array(rounds, pa.list_(pa.list_(pa.string())))], ["variant", "run_id", "rounds"])

    return runs.mapInArrow(run, f"variant string, run_id {kind}, rounds array<array<string>>")


def _findings(column: pa.ListArray) -> Iterator[list[dict]]:
    """The findings of each run, read field by field (a struct at a time takes several times as long)."""
    flat = column.flatten()
    names = [f.name for f in flat.type]
    rows = zip(*[c.to_pylist() for c in flat.flatten()], strict=True)
    for n in column.value_lengths().to_pylist():
        yield [dict(zip(names, row, strict=True)) for row in islice(rows, n or 0)]


#: Findings of a run up to which its verdicts are remembered for the next variant.
REMEMBERED = 2000


class _Compared:
    """Findings of a run by their positions: prepared once each, and same_claim of two of them."""

    def __init__(self, found: list[dict]) -> None:
        self.found = found
        self.ready: dict[int, dict] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def __getitem__(self, i: int) -> dict:
        if i not in self.ready:
            words = self.found[i]["norm"].split()
            self.ready[i] = {**self.found[i], "tokens": frozenset(words) - STOP_WORDS, "words": words, "bag": Counter(words)}
        return self.ready[i]

    def __call__(self, i: int, j: int) -> bool:
        if len(self.found) > REMEMBERED:
            return same_claim(self[i], self[j])
        if (i, j) not in self.known:
            self.known[i, j] = same_claim(self[i], self[j])
        return self.known[i, j]


class _Clusters:
    """Clusters of a run's false findings, met in order: of a round each finding meets that round's leaders, and a new leader
    those of the clusters before it.

    All leaders of rounds are indexed by their words and their place, which same_claim asks for: apart from those with a
    place in common, only leaders that share words can be the same.
    """

    def __init__(self, same: _Compared) -> None:
        self.same = same
        self.leaders: list[int] = []  # findings, ascending
        self.sizes: list[int] = []
        self.cluster: list[int | None] = []  # of a leader that began one
        self.holding: defaultdict[str, list[int]] = defaultdict(list)
        self.unplaced: list[int] = []
        self.units: dict[str, tuple[list[int], list[int], list[tuple[int, int, int]]]] = {}  # all, without a bound, spans by start
        self.longest: dict[str, int] = {}
        self.count, self.start = 0, 0

    def begin_round(self) -> None:
        self.start = len(self.leaders)

    def put(self, i: int) -> int | None:
        """The cluster of a finding that leads in its round; None of one that is the same as such a leader."""
        f, start = self.same[i], self.start
        n, sizes, holding = len(f["tokens"]), self.sizes, self.holding
        shared = Counter(chain.from_iterable([holding[w] for w in f["tokens"] if w in holding]))
        alike = [k for k, both in shared.items() if both / (n + sizes[k] - both) >= RULE_TAU]
        if any(k >= start for k in alike):
            return None
        near = self._near(f)
        if any(self.same(i, self.leaders[k]) for k in near if k >= start):
            return None
        found = min((c for k in alike if (c := self.cluster[k]) is not None), default=self.count)
        for k in near:  # ascending, as are their clusters
            c = self.cluster[k]
            if k >= start or (c is not None and c >= found):
                break
            if c is not None and self.same(i, self.leaders[k]):
                found = c
                break
        self._add(i, f, found if found == self.count else None)
        return found

    def _add(self, i: int, f: dict, cluster: int | None) -> None:
        k = len(self.leaders)
        self.leaders.append(i)
        self.sizes.append(len(f["tokens"]))
        self.cluster.append(cluster)
        self.count += cluster is not None
        holding = self.holding
        for w in f["tokens"]:
            holding[w].append(k)
        unit, start, end = f["unit"], f["start"], f["end"]
        if unit is None:
            self.unplaced.append(k)
            return
        everywhere, unbounded, spans = self.units.setdefault(unit, ([], [], []))
        everywhere.append(k)
        if start is None or end is None:
            unbounded.append(k)
        else:
            insort(spans, (start, k, end))
            self.longest[unit] = max(self.longest.get(unit, end - start), end - start)

    def _near(self, f: dict) -> Sequence[int]:
        """The leaders that are not disjoint in place, ascending."""
        unit, start, end = f["unit"], f["start"], f["end"]
        if unit is None:
            return range(len(self.leaders))
        everywhere, unbounded, spans = self.units.get(unit, ((), (), ()))
        if start is None or end is None:
            return sorted([*self.unplaced, *everywhere])
        here = []
        if spans:
            low, high = bisect_left(spans, (start - self.longest[unit],)), bisect_left(spans, (end + 1,))
            here = [k for _, k, e in spans[low:high] if e >= start]
        return sorted([*self.unplaced, *unbounded, *here])


def _canonical(found: list[dict], n_rounds: int, false: Iterable[int], same: _Compared) -> list[list[str]]:
    """The elements of each round of a run, whose findings are sorted by round and finding; false names the false ones."""
    elements: list[set[str]] = [set() for _ in range(n_rounds)]
    for f in found:
        if f["defect_id"] is not None:
            elements[f["round"]].add(f"def:{f['defect_id']}")
    clusters = _Clusters(same)
    for r, of_round in groupby(false, lambda i: found[i]["round"]):
        clusters.begin_round()
        elements[r].update(f"false:{k}" for i in of_round if (k := clusters.put(i)) is not None)
    return [sorted(e) for e in elements]


def comparable(c: Column) -> Column:
    """What restates compares of a struct with claim and location."""
    place = c["location"]
    return F.struct(c["claim"].alias("claim"), text.content_tokens(c["claim"]).alias("tokens"), text.normalize(c["claim"]).alias("norm"), place["unit"].alias("unit"), place["start"].alias("start"), place["end"].alias("end"))


def _null(x: object) -> bool:
    return x is None or x != x


def restates(a: dict, b: dict, tau: float = LEDGER_TAU) -> bool:
    """Whether two comparable claims are not disjoint in place and at least tau similar."""
    from difflib import SequenceMatcher

    x, y = set(a["tokens"]), set(b["tokens"])
    if not _null(a["unit"]) and not _null(b["unit"]):
        bounds = (a["start"], a["end"], b["start"], b["end"])
        if a["unit"] != b["unit"] or (not any(map(_null, bounds)) and not (bounds[0] <= bounds[3] and bounds[2] <= bounds[1])):
            return False
    both = len(x & y)
    sets = max(both / len(x | y), 0.85 * both / min(len(x), len(y))) if x and y else 0.0
    return sets >= tau or SequenceMatcher(None, a["norm"].split(), b["norm"].split()).ratio() >= tau


def ledger_rounds(rounds: DataFrame, tau: float = LEDGER_TAU) -> DataFrame:
    """run_id, round, ledger (claims kept), retired and added counts, by folding a run's rounds in order.

    rounds has run_id, round, retired (array of positions) and claims (array<struct<claim, location>>). A new
    claim is added unless a kept one is not disjoint from it and at least tau similar.
    """
    kind = dict(rounds.dtypes)["run_id"]
    claims = F.transform("claims", comparable)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ledger: list[dict] = []
        out = []
        for row in group.sort_values("round").itertuples():
            gone = {int(i) for i in (row.retired if row.retired is not None else [])}
            kept = [c for i, c in enumerate(ledger) if i not in gone]
            retired, before = len(ledger) - len(kept), len(kept)
            for c in row.claims if row.claims is not None else []:
                if not any(restates(c, g, tau) for g in kept):
                    kept.append(c)
            ledger = kept
            out.append([key[0], int(row.round), [c["claim"] for c in ledger], retired, len(ledger) - before])
        return pd.DataFrame(out, columns=["run_id", "round", "ledger", "retired", "added"])

    prepared = rounds.select("run_id", "round", "retired", claims.alias("claims"))
    return prepared.groupBy("run_id").applyInPandas(run, f"run_id {kind}, round int, ledger array<string>, retired int, added int")
