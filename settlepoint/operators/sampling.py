"""Samples by hash order: reproducible, independent of partitioning, the same in any engine.

Window ranks with a limit are pruned before their shuffle, so a stratum of any size sends at most the
wanted rows of each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resampling import draw, numbered


def hash_order(key: Column, seed: int) -> Column:
    return draw(F.lit(seed), key)


def stratified(df: DataFrame, strata: list[str], key: str, each: int, seed: int) -> DataFrame:
    """The first rows of each stratum in hash order."""
    w = Window.partitionBy(*strata).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= each).drop("_k")


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows that take turns over the strata, with their turn."""
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    turns = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return turns.orderBy("turn", stratum).limit(n)


def first_by(df: DataFrame, first: Column, key: str, n: int, seed: int) -> DataFrame:
    """n rows, those where first holds before the others, in hash order."""
    return df.orderBy(first.cast("int").desc(), hash_order(F.col(key), seed), key).limit(n)


def systematic(df: DataFrame, order: str, step: int, n: int) -> DataFrame:
    """Every step-th row in order, n of them; only the n * step first rows are ranked."""
    head = df.orderBy(order).limit(n * step)
    ranked = head.withColumn("_k", F.row_number().over(Window.orderBy(order)))
    return ranked.where((F.col("_k") - 1) % step == 0).drop("_k")


def first_per_group(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in order (a grouped minimum: combined before the shuffle)."""
    columns = [c for c in df.columns if c not in order]
    row = F.min(F.struct(*order, *columns)).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(row).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def gold_positives(defects: DataFrame) -> DataFrame:
    """Pairs x < y of the wordings (description and paraphrases) of one defect."""
    v = defects.select("id", F.posexplode("variants").alias("x", "a_text"))
    w = v.select("id", F.col("x").alias("y"), F.col("a_text").alias("b_text"))
    pairs = v.join(w, "id").where("x < y")
    return pairs.select(F.concat("id", F.lit("~pos~"), "x", F.lit("-"), "y").alias("pair_id"), "a_text", "b_text", F.lit(True).alias("label"), F.lit("positive").alias("source"))


def gold_hard_negatives(defects: DataFrame) -> DataFrame:
    """Pairs of different defects of one item, by position."""
    a = defects.select("item", F.col("pos").alias("i"), F.col("id").alias("a"), F.get("variants", F.lit(0)).alias("a_text"))
    b = defects.select("item", F.col("pos").alias("j"), F.col("id").alias("b"), F.get("variants", F.lit(0)).alias("b_text"))
    pairs = a.join(b, "item").where("i < j")
    return pairs.select(F.concat("a", F.lit("~neg~"), "b").alias("pair_id"), "a_text", "b_text", F.lit(False).alias("label"), F.lit("same-artifact").alias("source"))


def gold_easy_negatives(defects: DataFrame, n: int, seed: int, tries: int | None = None) -> DataFrame:
    """n distinct random pairs of defects of different items, or as many as the tries (2n if not given) find.

    The draws of two defect numbers meet the numbered defects in equi-joins: no cross join.
    """
    first = numbered(defects.select("id", "item", F.get("variants", F.lit(0)).alias("t")), "id", "k").select("k", "id", "item", "t")
    total = first.agg(F.count("*").alias("total"))
    draws = defects.sparkSession.range(2 * n if tries is None else tries).toDF("s").crossJoin(F.broadcast(total)).where("total > 1")  # total is one row
    draws = draws.select("s", (draw(F.lit(seed), F.col("s")) % F.col("total")).alias("k"), (draw(F.lit(seed + 1), F.col("s")) % F.col("total")).alias("l"))
    a, b = first.toDF("k", "a", "ia", "a_text"), first.toDF("l", "b", "ib", "b_text")
    pairs = draws.join(a, "k").join(b, "l").where("ia <> ib and a < b")
    pairs = pairs.groupBy("a", "b", "a_text", "b_text").agg(F.min("s").alias("s")).orderBy("s").limit(n)
    return pairs.select(F.concat("a", F.lit("~xneg~"), "b").alias("pair_id"), "a_text", "b_text", F.lit(False).alias("label"), F.lit("cross-artifact").alias("source"))


def gold(defects: DataFrame, seed: int) -> DataFrame:
    """Positives, hard negatives and as many easy negatives as balance the classes.

    Tries are bounded as in the reference (50,000) or, for more pairs, at 16 for each.
    """
    positives, hard = gold_positives(defects), gold_hard_negatives(defects)
    n = max(0, positives.count() - hard.count())
    return positives.unionByName(hard).unionByName(gold_easy_negatives(defects, n, seed, max(50_000, 16 * n)))
