"""Mixing sources to target weights by whole-document repetition.

Sizes are aggregated per source; targets share the whole size by weight, no target exceeds a multiple
of its source's size, and the excess is shared again by weight (water filling, in closed form over the
sources). A source's repetition rate is target / size. Each document is emitted floor(rate) times, plus
once more if a hash of its id and its source's seed falls below the fractional part: a hash-seeded
Bernoulli draw. Of a fixed list of seeds, each source uses the one whose draw comes nearest to its
target (one aggregation with a sum per seed), which takes most of the variance that a few very long
documents would cause; since a source's seed depends on the sums of its draws, the chance of a copy is the
fraction over the seeds before the choice, not given the chosen one. Everything is a function of the rows,
so reruns agree.

The per-source tables have one row per source; all row-sized work is partial aggregation and a join
of the documents with that table, never a grouping of a source's rows in one task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null
doc_id draws like id -1; repeated rows draw alike; sources without words get target 0 and rate 0;
an empty table gives no rows; extra columns are kept by ``mix`` and ignored by ``plan_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, written

PRIME = 2147483647
SEEDS = tuple(range(1, 33))
WORD = r"[^\x20\x09-\x0D]+"


def size_column(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: Column) -> Column:
    """Pseudo-random integer in [0, PRIME), by integer arithmetic that any SQL engine reproduces."""
    base = F.pmod(F.coalesce(doc_id.cast("long"), F.lit(-1).cast("long")), F.lit(PRIME).cast("long"))
    a = (base * F.lit(48271).cast("long") + seed * F.lit(69621).cast("long") + 12345) % PRIME
    b = (a * (a + seed * 2 + 1)) % PRIME
    return (b * F.lit(16807).cast("long") + a) % PRIME


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target, rate. The windows run over one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("w", cycle).withColumn("ratio", most * F.col("source_size") / F.col("w"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped_before", F.coalesce(F.sum(most * F.col("source_size")).over(by_ratio), F.lit(0.0)))
        .withColumn("w_from_here", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("w_from_here"))
    )
    # The water level is the first one that its own source's cap does not undercut.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    per = per.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(level, F.lit(0.0)) * F.col("w")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    return per.select("source", "source_size", "target", rate.alias("rate"))


def _threshold(rate: Column) -> Column:
    return ((rate - F.floor(rate)) * PRIME).cast("double")


def mixture(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target, rate, seed for a table of doc_id, source, size."""
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "target_source")
    rated = sized.join(targets, F.col("source").eqNullSafe(F.col("target_source")))
    sums = [
        F.sum(F.when(draw(F.col("doc_id"), F.lit(s).cast("long")) < _threshold(F.col("rate")), F.col("size")).otherwise(0)).alias(f"extra{s}")
        for s in SEEDS
    ]
    per = rated.groupBy("target_source", "source_size", "target", "rate").agg(*sums)
    wanted = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.round(F.abs(F.col(f"extra{s}") - wanted), 3).alias("off"), F.lit(s).cast("long").alias("seed")) for s in SEEDS]))
    return per.select(F.col("target_source").alias("source"), "source_size", "target", "rate", best["seed"].alias("seed"))


def with_copies(docs: DataFrame, mixture_table: DataFrame, name: str = "copies") -> DataFrame:
    """docs with the number of copies (bigint) of each row, joined on the source."""
    source, rate, seed = spare([*docs.columns, name], "mix_source", "mix_rate", "mix_seed")
    mix = mixture_table.select(F.col("source").alias(source), F.col("rate").alias(rate), F.col("seed").alias(seed))
    joined = docs.join(mix, F.col("source").eqNullSafe(F.col(source)), "left")
    extra = F.when(draw(F.col("doc_id"), F.col(seed)) < _threshold(F.col(rate)), 1).otherwise(0)
    copied = joined.withColumn(name, (F.floor(rate) + extra).cast("long"))
    return copied.drop(source, rate, seed)


def plan_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every document."""
    sized = written(docs.select("doc_id", "source", size_column().alias("size")), "sizes")
    table = written(mixture(sized, weights, most), "mixture")
    sources = table.select(F.col("source").alias("_source"), "source_size", "target")
    return with_copies(sized, table).join(sources, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The mixed rows themselves, with the columns of docs."""
    sized = written(docs.select("doc_id", "source", size_column().alias("size")), "sizes")
    copies, copy = spare(docs.columns, "copies", "copy")
    copied = with_copies(docs, written(mixture(sized, weights, most), "mixture"), copies)
    repeats = F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return copied.withColumn(copy, repeats).select(*[F.col(f"`{c}`") for c in docs.columns])
