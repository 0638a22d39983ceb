"""Near-duplicate lines by a segment-partition edit join, in DataFrame and SQL functions only.

Lines are split into threshold-plus-one segments, of which k edits leave one as it is. Lengths fall into
classes (eight to a doubling), and the segments are those of the shortest length of a class: those of the
first half count from the line's start, those of the second half from its end, so that lines of all lengths
of a class agree on them. A line is indexed under the keys of its segments, for its own length's class and
those of lengths up to k less. Of the segments left as they are one has exactly i - 1 edits before and at
most k + 1 - i after it, if it is the i-th of k + 1 (the first one up to which there are fewer edits than
segments). Hence in the other line it lies at most as many places off, as there can be edits between it and
its end of the line; one of the two lines has it later, so lines probe only for what lies further in.

The number of candidates is held down in three ways, none of which loses any:

* The counts of 20 characters, modulo 4 and in Gray code, are bits that travel along; an edit changes at
  most two of them, so the join's condition keeps only pairs that differ in at most 2k.
* The digits of a line travel along as well, up to 15 of them, packed into a number: an edit of the line is at
  most one edit of its digits, so the join's condition keeps only pairs whose digits are within k edits. Lines
  that differ in a running number alone, however many, so give a candidate for a link, not for every pair.
* Of 2k + 1 blocks of these bits one is equal. Keys that many lines share are therefore joined on each block
  together with the key, so that a segment common to very many lines does not bring all of them together.

Candidates are verified by a banded bit-parallel automaton: for each number of edits e from 0 to k, one
integer holds a bit for each of the 2k + 1 diagonals that e edits can reach; a character of the second
line updates the k + 1 integers with shifts and a mask of the diagonals where the first line has the same
character. Spark's own bounded edit distance goes first, so that only near pairs reach the automaton.

Lines are made distinct first; hashes alone are shuffled for candidate search. The texts fetched for
verification are those that pass a bitmap of at most 2^20 hash buckets (a proven bound, hence broadcast)
and then a join.

Defined cases: a null text has no lines; blank lines (white space alone) take no part (no rows); the edits
allowed are k, but no more than one in each ``chars_per_edit`` characters of the shorter line, so that very
short lines are linked to equal ones only; a null doc_id sorts first, so such lines head their class; rows
that repeat an id and a text give equal rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

BUCKETS = 1 << 20
#: Characters whose counts the necessary condition compares, two bits each (fixed values).
COUNTED = "etaoinshrdlucmfwpg01"
#: Digits of a line that are compared; lines of more pass.
DIGITS = 15
#: Keys of more rows than this are joined on blocks of the counts as well.
CROWD = 128


def length_class(length: Column) -> Column:
    """The shortest length of the class of a length: eight classes to a doubling, single lengths below 16."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length, F.lit(1)))).cast("int") - 3))
    return (length - length % step).cast("int")


def segment(k: int, i: int, base: Column, length: Column) -> tuple[Column, Column, int]:
    """Start (from 1) and size of segment i of 1..k+1 in a line of this length and class, and how far it may be off."""
    lo, hi = F.floor(base * (i - 1) / (k + 1)).cast("int"), F.floor(base * i / (k + 1)).cast("int")
    from_start = 2 * i <= k + 2
    start = lo + 1 if from_start else length - base + lo + 1
    return start, hi - lo, i - 1 if from_start else k + 1 - i


def line_keys(line: Column, length: Column, base: Column, k: int) -> tuple[Column, list[int]]:
    """The keys of a line's segments and of what lies further in, and the places of the latter, the probes.

    What would reach beyond the line is cut off there; its key meets nothing that verification keeps.
    """
    out, probes = [], []
    for i in range(1, k + 2):
        start, size, off = segment(k, i, base, length)
        inward = 1 if 2 * i <= k + 2 else -1
        for d in range(off + 1):
            if d:
                probes.append(len(out))
            out.append(F.xxhash64(base, F.lit(i), F.substring(line, start + inward * d, size)))
    return F.array(*out), probes


def edits(a: Column, b: Column, k: int) -> Column:
    """The edit distance of two strings if it is at most k, else null (banded bit-parallel automaton)."""
    n, m = F.char_length(a), F.char_length(b)
    one = F.lit(1).cast("long")
    width = 2 * k + 1
    full = F.lit((1 << width) - 1).cast("long")

    def step(x: Column, y: Column, state: Column, j: Column) -> Column:
        """Consumes character j (from 1) of b; bit d + k of state.e stands for a's first j + d characters."""
        c = F.get(y, j - 1)
        same = F.lit(0).cast("long")
        for d in range(-k, k + 1):
            hit = F.coalesce(F.get(x, j + (d - 1)) == c, F.lit(False)) & (j + d >= 1) & (j + d <= n)
            same = same.bitwiseOR(F.when(hit, F.lit(1 << (d + k)).cast("long")).otherwise(F.lit(0).cast("long")))
        out = []
        for e in range(k + 1):
            mine = state[f"e{e}"].bitwiseAND(same)
            if e:
                fewer = state[f"e{e - 1}"]
                mine = mine.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1))  # substitution, insertion
                mine = mine.bitwiseOR(F.shiftleft(out[e - 1], 1)).bitwiseAND(full)  # deletion
            out.append(mine)
        return F.struct(*[s.alias(f"e{e}") for e, s in enumerate(out)])

    first = F.struct(*[F.lit(((1 << (e + 1)) - 1) << k & ((1 << width) - 1)).cast("long").alias(f"e{e}") for e in range(k + 1)])
    # A lambda's variable is worked out once; split() inside the step would run again for every character.
    split = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    last = F.get(F.transform(split, lambda s: F.aggregate(F.sequence(F.lit(1), m), first, lambda state, j: step(s["x"], s["y"], state, j))), F.lit(0))
    end = F.call_function("shiftleft", one, (n - m + k).cast("int"))
    found = F.lit(None).cast("int")
    for e in range(k, -1, -1):
        found = F.when(last[f"e{e}"].bitwiseAND(end) != 0, F.lit(e)).otherwise(found)
    return F.when(F.abs(n - m) > k, F.lit(None)).when(m == 0, n).otherwise(found)
def count_bits(line: Column) -> Column:
    """The counts of COUNTED modulo 4, in Gray code: counts that differ by one differ in one bit."""
    out = F.lit(0).cast("long")
    for t, c in enumerate(COUNTED):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(3))
        gray = F.call_function("shiftright", F.lit(0b10110100), n * 2).bitwiseAND(F.lit(3))  # 0, 1, 3, 2
        out = out.bitwiseOR(F.shiftleft(gray.cast("long"), 2 * t))
    return out


def _blocks(k: int) -> list[tuple[int, int]]:
    """Shift and mask of 2k + 1 blocks of the count bits."""
    blocks, bits = 2 * k + 1, 2 * len(COUNTED)
    edges = [bits * j // blocks for j in range(blocks + 1)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def _block(bits: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(mask).cast("long"))


def _tags(k: int) -> Column:
    """array<struct<tag, j>>: the key itself (j = -1), or of a crowded one its combination with each block."""
    alone = F.array(F.struct(F.col("key").alias("tag"), F.lit(-1).alias("j")))
    each = [F.struct(F.xxhash64("key", F.lit(j), _block(F.col("bits"), *at)).alias("tag"), F.lit(j).alias("j")) for j, at in enumerate(_blocks(k))]
    return F.when(F.col("bucket").isNull(), alone).otherwise(F.array(*each))


def candidate_pairs(distinct_lines: DataFrame, k: int, crowd: int = CROWD) -> DataFrame:
    """ha < hb of lines (h, line, n) that share a segment and whose counts allow k edits (written)."""
    line, n = F.col("line"), F.col("n")
    classes = F.array_distinct(F.array(*[length_class(n - j) for j in range(k + 1)]))
    digits = F.regexp_replace(line, "[^0-9]+", "")
    # Four bits a digit behind a one: hex() gives them back.
    digits = F.when(F.octet_length(digits) <= DIGITS, F.conv(F.concat(F.lit("1"), digits), 16, 10).cast("long"))
    based = distinct_lines.select("h", "line", "n", count_bits(line).alias("bits"), digits.alias("digits"), F.explode(classes).alias("base"))
    keys, probes = line_keys(line, n, F.col("base"), k)
    rows = based.select("h", "bits", "digits", F.posexplode(keys).alias("at", "key"))
    rows = written(rows.select("h", "bits", "digits", "key", F.col("at").isin(probes).alias("probe")), "keys")
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    bucket = F.pmod("key", F.lit(BUCKETS))
    marks = F.broadcast(crowded.select(bucket.alias("bucket")).distinct())
    tagged = rows.join(marks, bucket == F.col("bucket"), "left").select("h", "bits", "digits", "probe", F.explode(_tags(k)).alias("t")).select("h", "bits", "digits", "probe", "t.*")
    one = tagged.where(~F.col("probe")).select(F.col("h").alias("ha"), F.col("bits").alias("a"), F.col("digits").alias("da"), "tag")
    other = tagged.select(F.col("h").alias("hb"), F.col("bits").alias("b"), F.col("digits").alias("db"), "probe", "tag", "j")
    met = one.join(other, "tag").where((F.col("ha") < F.col("hb")) | (F.col("probe") & (F.col("ha") != F.col("hb"))))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(2 * k)  # a pair counts under the first of its equal blocks
    for j, at in reversed(list(enumerate(_blocks(k)))):
        first = F.when(_block(apart, *at) == 0, F.lit(j)).otherwise(first)
    near = (F.col("da") == F.col("db")) | (F.levenshtein(F.hex("da"), F.hex("db"), k) >= 0)
    met = met.where((F.bit_count(apart) <= 2 * k) & ((F.col("j") < 0) | (F.col("j") == first)) & F.coalesce(near, F.lit(True)))
    return written(met.select(F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb")).distinct(), "pairs")


def line_join(docs: DataFrame, k: int = 2, chars_per_edit: int = 10, crowd: int = CROWD) -> DataFrame:
    """Per line: doc_id, line_no (from 0), class_doc_id, class_line_no, n_links, kept.

    A class is a connected component of lines linked by at most k edits (equal lines are linked); it is
    named by its first line, the one that is kept. n_links counts the other lines a line is linked to.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.btrim("line", F.lit(" \t\x0b\f\r")) != "")
    h1, h2 = F.xxhash64("line"), F.xxhash64(F.lit("second"), F.col("line"))
    places = lines.select("doc_id", "line_no", h1.alias("h1"), h2.alias("h2"))
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    distinct = written(places.groupBy("h1", "h2").agg(first, F.count("*").alias("copies")), "lines")

    length = F.char_length("line")
    # Lengths are a column of their own, so that each is worked out once and not in every key.
    single = written(lines.where(length >= chars_per_edit).select("line").distinct().select(h1.alias("h"), "line", length.alias("n")), "texts")
    candidates = candidate_pairs(single, k, crowd)

    named = candidates.select(F.col("ha").alias("h")).union(candidates.select("hb")).distinct()
    buckets = F.broadcast(named.select(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).distinct())
    texts = single.join(buckets, F.pmod("h", F.lit(BUCKETS)) == F.col("bucket"), "left_semi").join(named, "h", "left_semi")
    texts = written(texts.select("h", h2.alias("h2"), "line", "n"), "texts")

    pairs = candidates.join(texts.toDF("ha", "ha2", "a", "na"), "ha").join(texts.toDF("hb", "hb2", "b", "nb"), "hb")
    allowed = F.least(F.lit(k), F.floor(F.least("na", "nb") / chars_per_edit))
    pairs = pairs.where(F.levenshtein("a", "b", k) >= 0).where(edits(F.col("a"), F.col("b"), k) <= allowed)
    pairs = written(pairs.select("ha", "ha2", "hb", "hb2"), "linked")

    one, other = distinct.toDF("ha", "ha2", "a", "a_copies"), distinct.toDF("hb", "hb2", "b", "b_copies")
    links = written(pairs.join(one, ["ha", "ha2"]).join(other, ["hb", "hb2"]).select("a", "b", "a_copies", "b_copies"), "links")
    both = links.select(F.col("a").alias("first"), F.col("b_copies").alias("n")).union(links.select("b", "a_copies"))
    linked = both.groupBy("first").agg(F.sum("n").alias("links"))
    roots = components(links, "a", "b")

    classes = distinct.join(linked, "first", "left").join(roots, F.col("first") == F.col("node"), "left")
    classes = classes.select("h1", "h2", F.coalesce("root", "first").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return places.join(classes, ["h1", "h2"]).select(
        "doc_id",
        "line_no",
        F.col("class.doc_id").alias("class_doc_id"),
        F.col("class.line_no").alias("class_line_no"),
        F.col("n_links").cast("long").alias("n_links"),
        (F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("line_no") == F.col("class.line_no"))).alias("kept"),
    )
