"""Pairs of texts under the word ratio without a ratio for every pair, and without every pair.

The word ratio of two texts (matching blocks, in Python) is at most twice their shared words over all their words, words
counted as often as both have them: a bound out of array functions. A pair goes to Python only where the ratio could still
change what is asked of it; `Need` names what is asked.

Pairs that can be the same at all are found by an inverted index over the first words of each text in one fixed order, long
ones first (prefix filtering): two texts with a token Jaccard of RULE_TAU, or a word ratio of TAU_HIGH, share one of them. What
is left of both texts behind that word, and which of 64 bits their words set, bound what they share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import location, text
from ..session import shared_path
from .matching import RULE_TAU, TAU_HIGH, TAU_LOW, decide

#: Of a pair's jac, overlap, bound (all as columns) and loc: whether its ratio must be known.
Need = Callable[[Column, Column, Column, Column], Column]


def bag(tokens: Column) -> Column:
    """Words with their occurrence in the text (a#1, a#2, b#1), so that sets of them intersect as multisets."""

    def numbered(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.concat(w, F.lit("#"), (i - F.array_position(words, w) + 2).cast("string")))

    # As a lambda's variable the sorted words are worked out once, not for each word.
    return F.get(F.transform(F.array(F.sort_array(tokens)), numbered), F.lit(0))


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the word ratio of two texts with these bags; 1 for two empty ones, as the ratio."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / both)


def for_decision(jac: Column, over: Column, bound: Column, loc: Column) -> Column:
    """The staged decision: only pairs whose sets leave a stage open that the bound could reach."""
    return F.when(loc == "disjoint", (F.greatest(jac, over) <= TAU_LOW) & (bound > TAU_LOW)).otherwise((jac < TAU_HIGH) & (bound >= TAU_HIGH))


def for_same_scores(jac: Column, over: Column, bound: Column, loc: Column) -> Column:
    """Whether pairs are the same, and the similarity and stage of those that are.

    Pairs that are disjoint in place are the same by their sets alone: either stage that they can come to asks for those.
    """
    can_be_same = (jac >= RULE_TAU) | ((loc != "disjoint") & (bound >= TAU_HIGH))
    decides = (loc != "disjoint") & for_decision(jac, over, bound, loc)
    return decides | (can_be_same & (bound > F.greatest(jac, over)))


def for_thresholds(*taus: float) -> Need:
    """On which side of each threshold the similarity lies."""

    def need(jac: Column, over: Column, bound: Column, loc: Column) -> Column:
        known = F.greatest(jac, over)
        inside = F.lit(False)
        for tau in taus:
            inside = inside | ((known < tau) & (bound >= tau))
        return inside

    return need


def for_similarity(jac: Column, over: Column, bound: Column, loc: Column) -> Column:
    """The similarity itself."""
    return bound > F.greatest(jac, over)


def for_both_similarities(jac: Column, over: Column, bound: Column, loc: Column) -> Column:
    """The similarity and the symmetric one."""
    return bound > jac


def with_profile(df: DataFrame, column: str, suffix: str) -> DataFrame:
    """Adds what pairs are compared by, worked out once a text (null: empty): tokens, bag and norm with the suffix."""
    body = F.coalesce(F.col(column), F.lit(""))
    out = df.withColumn(f"tokens_{suffix}", text.content_tokens(body)).withColumn(f"norm_{suffix}", text.normalize(body))
    return out.withColumn(f"bag_{suffix}", bag(text.tokens(body)))


def settle(pairs: DataFrame, need: Need | None) -> DataFrame:
    """Adds jac, sim, symmetric and asked (whether Python saw the pair) to pairs of profiled texts; drops the profiles.

    Where the ratio isn't needed, sim and symmetric are those without it, which is the same for what is asked. Without a
    need no ratio is taken at all.
    """
    x = pairs.withColumn("jac", text.jaccard(F.col("tokens_a"), F.col("tokens_b"))).withColumn("_over", 0.85 * text.overlap(F.col("tokens_a"), F.col("tokens_b")))
    if need is None:
        x = x.withColumn("sim", F.greatest("jac", "_over")).withColumn("symmetric", F.col("jac")).withColumn("asked", F.lit(False))
    else:
        x = x.withColumn("_bound", ratio_bound(F.col("bag_a"), F.col("bag_b")))
        asked = F.coalesce(need(F.col("jac"), F.col("_over"), F.col("_bound"), F.col("loc")), F.lit(False))
        # A bound of nothing or of one shared word is the ratio (long texts leave out frequent words, so not for those).
        exact = (F.col("_bound") == 0) | ((F.size(F.array_intersect("bag_a", "bag_b")) <= 1) & (F.size("bag_b") < 200) & (F.size("bag_a") > 0))
        x = x.withColumn("_exact", exact).withColumn("asked", asked & ~F.col("_exact"))
        given = lambda c: F.when(F.col("asked"), F.col(c))
        x = x.withColumn("_ratio", F.coalesce(F.when(F.col("_exact"), F.col("_bound")), text.word_ratio(given("norm_a"), given("norm_b")), F.lit(0.0)))
        x = x.withColumn("sim", F.greatest("jac", "_ratio", "_over")).withColumn("symmetric", F.greatest("jac", "_ratio"))
    return x.drop("_over", "_bound", "_exact", "_ratio", *[f"{c}_{s}" for c in ("tokens", "norm", "bag") for s in "ab"])


# candidates --------------------------------------------------------------------------------------------


def _kept(n: Column, share: float) -> Column:
    """How many of n words, first ones first, cannot all be missed by a text that shares at least share * n of them."""
    return n - F.ceil(F.lit(share) * n - F.lit(1e-9)) + 1


def _bits(words: Column) -> Column:
    """A long with the bit of each word's hash."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda seen, w: seen.bitwiseOR(bit(w)))


def _postings(side: DataFrame, ids: list[str], suffix: str, ratio: bool) -> DataFrame:
    """ids, _word, _n, _at and _bits: the index entries of each text, its first words by length (no statistics, so a text is
    read once and in place), with their places, the number of its words and their bits."""
    # Of two texts that are alike enough the smaller has at least this share of the larger's words. A ratio of t takes t / 2 of
    # both texts' words, and the other has at least those: t / (2 - t) of this one's.
    families = [("c:", f"tokens_{suffix}", RULE_TAU)] + ([("b:", f"bag_{suffix}", TAU_HIGH / (2 - TAU_HIGH))] if ratio else [])

    def entries(name: str, words: str, share: float) -> Column:
        ordered = F.sort_array(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("l"), w.alias("w"))))
        first = F.slice(ordered, 1, F.greatest(F.lit(0), _kept(F.size(words), share)).cast("int"))
        entry = lambda bits: F.transform(first, lambda x, i: F.struct(F.concat(F.lit(name), x["w"]).alias("word"), F.size(words).alias("n"), i.alias("at"), bits.alias("bits")))
        # As a lambda's variable the bits are worked out once, not for each word.
        return F.get(F.transform(F.array(_bits(F.col(words))), entry), F.lit(0))

    found = F.concat(*[entries(*f) for f in families])
    if ratio:  # two texts without words have a ratio of 1
        none = F.array(F.struct(F.lit("e:").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("bits")))
        found = F.when(F.size(f"bag_{suffix}") == 0, none).otherwise(found)
    each = side.select(*ids, F.explode(found).alias("_e"))
    return each.select(*ids, *[F.col(f"_e.{c}").alias(f"_{c}") for c in ("word", "n", "at", "bits")])


def _alike(word: Column, n: Column, at_a: Column, bits_a: Column, m: Column, at_b: Column, bits_b: Column) -> Column:
    """Whether texts of n and m words whose first shared word has these places can share as many words as they must."""
    content = F.startswith(word, F.lit("c:"))
    need = F.when(content, F.lit(RULE_TAU / (1 + RULE_TAU))).otherwise(F.lit(TAU_HIGH / 2)) * (n + m) - F.lit(1e-9)
    alone = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    most = F.least(n - at_a, m - at_b, n - alone(bits_a, bits_b), m - alone(bits_b, bits_a))
    return (word == "e:") | (most >= need)


def candidates(a: DataFrame, b: DataFrame, keys: list[str], id_a: list[str], id_b: list[str], ratio: bool = True) -> DataFrame:
    """keys, id_a, id_b of the pairs within a key that the staged decision can call the same; profiled sides.

    The index of b is written, so that its size is known: a small one meets a in place, without a shuffle of a.
    """
    left = _postings(a, [*keys, *id_a], "a", ratio)
    right = _written(_postings(b, [*keys, *id_b], "b", ratio), "index").withColumnsRenamed({"_n": "_m", "_at": "_at_b", "_bits": "_bits_b"})
    alike = _alike(*[F.col(c) for c in ("_word", "_n", "_at", "_bits", "_m", "_at_b", "_bits_b")])
    return left.join(right, [*keys, "_word"]).where(alike).select(*keys, *id_a, *id_b).distinct()


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same_pairs(a: DataFrame, b: DataFrame, keys: list[str], id_a: list[str], id_b: list[str], full: bool = True) -> DataFrame:
    """keys, id_a, id_b, sim and method of the pairs within a key that the staged decision calls the same.

    Either side has keys, its ids, text and location; ids name rows (rows that repeat them are compared each). Candidates
    (ids), the words of the texts that have any, and the pairs found are written: never a copy of either side.
    """

    def named(side: DataFrame, ids: list[str], s: str) -> DataFrame:
        return side.select(*keys, *ids, F.col("text").alias("_text"), F.col("location").alias(f"location_{s}"))

    a, b = named(a, id_a, "a"), named(b, id_b, "b")
    profile = lambda side, s: with_profile(side, "_text", s).drop("_text")
    found = _written(candidates(profile(a, "a"), profile(b, "b"), keys, id_a, id_b, full), "candidates")
    met = lambda side, ids, s: _written(profile(side.join(found.select(*keys, *ids).distinct(), [*keys, *ids], "left_semi"), s), "words")
    pairs = found.join(met(a, id_a, "a"), [*keys, *id_a]).join(met(b, id_b, "b"), [*keys, *id_b])
    pairs = pairs.withColumn("loc", location.compatibility(F.col("location_a"), F.col("location_b"))).drop("location_a", "location_b")
    judged = decide(settle(pairs, for_same_scores if full else None))
    return _written(judged.where("same").select(*keys, *id_a, *id_b, "sim", "method", "asked"), "same")
