"""How text filters interact: every order of the filters is replayed over every document's failure flags.

A document is crossed with all orders (a broadcast table of n! rows, 120 for five filters), exploded into the steps
of the order, and counted under (part, order, step) with map-side combining, so what is shuffled is the counts of a
task, 600 rows a part. Texts are read once, for the flags, which are written and read again.

Defined cases. A null text is empty. A null part counts as the empty string. A row without doc_id never fails E, nor
makes another row fail it; rows that repeat id and text are no earlier copy of each other. Equal texts are told by
SHA-256. Of repeated label rows any with value 1 counts; documents without labels are neither good nor toxic. Other
columns are ignored, whatever their names. No documents: no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

WORD_BREAK = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on one text: short, repetitive, loud, and with symbols."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and a boolean for each filter A to E, a row per document; E: a smaller doc_id has the same text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        *[fails.alias(letter) for letter, fails in text_failures(text).items()],
    )
    seen = written(seen, "filter-flags")
    # A document is the first of its text or a copy; joined on text and id, so that a hot text is spread over its ids.
    first = seen.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    first = first.select(F.col("digest").alias("first_digest"), "first_id")
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    copies = seen.join(first, (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id")), "left")
    flagged = copies.join(marks, F.col("doc_id") == F.col("label_id"), "left")
    return flagged.select(
        "doc_id", "part", *"ABCD", (F.col("doc_id").isNotNull() & F.col("first_id").isNull()).alias("E"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def orders(spark: SparkSession, filters: str) -> DataFrame:
    """Every order of the filters, with the bit of the filter at each step; n! rows, at most 720."""
    if not 1 <= len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("one to six different filters")
    bit = {f: 1 << i for i, f in enumerate(filters)}
    rows = [("".join(p), [bit[f] for f in p]) for p in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Counts for every part, order and step, out of part, good, toxic and a boolean column for each filter.

    kept: documents left after the step; removed: at it; redundant: failing its filter but removed before;
    unique_fails: failing its filter only; good_lost, toxic_lost: removed at it and so labelled; shapley: removals by
    the step's filter over all orders and steps.
    """
    n = len(filters)
    mask = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    documents = flags.select("part", "good", "toxic", mask.alias("mask"))
    by_step = orders(flags.sparkSession, filters).select("filter_order", *[F.col("bits")[s].alias(f"bit{s + 1}") for s in range(n)])
    crossed = documents.crossJoin(F.broadcast(by_step))
    first = F.lit(n + 1)  # the step that removes the document, or one past the last
    for s in range(n, 0, -1):
        first = F.when(F.col("mask").bitwiseAND(F.col(f"bit{s}")) != 0, s).otherwise(first)
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"bit{s}").alias("bit")) for s in range(1, n + 1)]))
    replayed = crossed.select("part", "good", "toxic", "mask", "filter_order", first.alias("gone"), steps.alias("at"))
    step, bit, gone = F.col("at.step"), F.col("at.bit"), F.col("gone")
    counted = replayed.groupBy("part", "filter_order", step.alias("step")).agg(
        F.count_if(gone > step).alias("kept"),
        F.count_if(gone == step).alias("removed"),
        F.count_if((F.col("mask").bitwiseAND(bit) != 0) & (gone < step)).alias("redundant"),
        F.count_if(F.col("mask") == bit).alias("unique_fails"),
        F.count_if((gone == step) & F.col("good")).alias("good_lost"),
        F.count_if((gone == step) & F.col("toxic")).alias("toxic_lost"),
    )
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counted.withColumn("shapley", F.sum("removed").over(own))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over whole documents: flags, then their replay in all 120 orders."""
    return replay(document_flags(docs, labels), "ABCDE")
