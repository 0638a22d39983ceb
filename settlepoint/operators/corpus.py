"""Corpus rules, freezing and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Item types, bands, and licences that may be redistributed by type.
TYPES = ("code", "paper", "spec")
DEFECT_BAND, PARAPHRASE_BAND = (3, 8), (2, 3)
CODE_LICENSES = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Unlicense", "CC0-1.0", "PSF-2.0", "Python-2.0",
    "CC-BY-4.0", "CC-BY-3.0", "public-domain",
)
PAPER_LICENSES = ("CC-BY-4.0", "CC-BY-3.0", "CC0-1.0", "public-domain")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def item_rules() -> list[tuple[str, str, Column]]:
    """(level, code, violated) of rules on an item's own columns."""
    n = F.when(F.col("defects").isNull(), 0).otherwise(F.size("defects"))
    zones = F.col("known_gray_zone")
    origin = F.coalesce(F.col("source.origin"), F.lit(""))
    license_ = F.coalesce(F.col("source.license"), F.lit(""))
    derived = origin == "derived"
    allowed = F.when(F.col("type") == "paper", license_.isin(*PAPER_LICENSES)).otherwise(license_.isin(*CODE_LICENSES))
    typed = F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    rules = [
        ("error", "bad-type", ~typed),
        ("error", "id-dir-mismatch", ~F.col("id").eqNullSafe(F.col("folder"))),
        ("error", "type-dir-mismatch", typed & ~F.col("type").eqNullSafe(F.col("type_folder"))),
        ("error", "missing-artifact", F.col("artifact").isNull()),
        ("error", "empty-artifact", F.col("artifact").isNotNull() & (F.trim("artifact", F.lit(" \t\r\n")) == "")),
        ("error", "no-defects", n == 0),
        ("warning", "defect-count-band", (n > 0) & ~n.between(*DEFECT_BAND)),
        ("error", "defect-count-mismatch", F.col("defect_count").isNotNull() & (F.col("defect_count") != n)),
        ("warning", "no-clean-regions", F.coalesce(F.size("clean_regions"), F.lit(0)) <= 0),
        ("error", "bad-gray-zone-entry", F.exists(zones, lambda z: z["location"].isNull() | z["note"].isNull())),
        ("error", "empty-gray-zone-note", F.exists(zones, lambda z: z["location"].isNotNull() & z["note"].isNotNull() & _blank(z["note"]))),
        ("error", "bad-origin", ~origin.isin("synthetic", "derived")),
        *[("error", "missing-provenance", derived & _blank(F.col(f"source.{c}"))) for c in ("url", "license", "source_ref")],
        ("warning", "missing-retrieved", derived & _blank(F.col("source.retrieved"))),
        ("warning", "missing-attribution", derived & _blank(F.col("source.attribution"))),
        ("error", "license-not-allowed", derived & (license_ != "") & ~allowed),
    ]
    return [(level, code, F.coalesce(bad, F.lit(False))) for level, code, bad in rules]


def _defect_rules() -> list[tuple[str, str, Column]]:
    d = F.col("d")
    paraphrases = F.coalesce(d["paraphrases"], F.array().cast("array<string>"))
    described = F.trim(F.coalesce(d["description"], F.lit("")))
    anchored = ~_blank(d["anchor"])
    rules = [
        ("error", "defect-id-prefix", ~F.startswith(d["id"], F.concat("id", F.lit("-")))),
        ("error", "empty-description", described == ""),
        ("error", "empty-location-unit", _blank(d["location"]["unit"])),
        ("error", "anchor-needs-line", anchored & d["location"]["start"].isNull()),
        ("warning", "missing-category", _blank(d["category"])),
        ("warning", "paraphrase-count", ~F.size(paraphrases).between(*PARAPHRASE_BAND)),
        ("error", "empty-paraphrase", F.exists(paraphrases, _blank)),
        ("warning", "paraphrase-echoes-description", F.exists(paraphrases, lambda p: F.trim(p) == described)),
    ]
    return [(level, code, F.coalesce(bad, F.lit(False))) for level, code, bad in rules]


def _issues(df: DataFrame, rules: list[tuple[str, str, Column]], detail: Column) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, bad in rules]))
    return df.select(F.col("id").alias("item_id"), F.explode(found).alias("i"), detail.alias("detail")).select("item_id", "i.level", "i.code", "detail")


def validate(items: DataFrame, line_map: DataFrame | None = None) -> DataFrame:
    """item_id, level, code, detail: every broken rule of every item, repeated ids corpus-wide included.

    items has the columns that the item reader gives; line_map (id, no, line) serves the anchors.
    """
    nothing = F.lit(None).cast("string")
    out = _issues(items, item_rules(), nothing)
    defects = items.select("id", F.posexplode("defects").alias("pos", "d"))
    if line_map is not None:
        out = out.unionByName(_anchor_issues(defects, line_map))
    out = out.unionByName(_issues(defects, _defect_rules(), F.col("d.id")))
    repeated = defects.groupBy("id", F.col("d.id").alias("did")).agg(F.count("*").alias("n")).where("n > 1")
    within = F.explode(F.array_repeat(F.lit("duplicate-defect-id"), (F.col("n") - 1).cast("int")))
    out = out.unionByName(repeated.select(F.col("id").alias("item_id"), F.lit("error").alias("level"), within.alias("code"), F.col("did").alias("detail")))
    owners = defects.select("id", F.col("d.id").alias("did")).distinct().groupBy("did").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    others = defects.select("id", F.col("d.id").alias("did")).distinct().join(owners, "did").where("id <> first")
    return out.unionByName(others.select(F.col("id").alias("item_id"), F.lit("error").alias("level"), F.lit("duplicate-defect-id-global").alias("code"), F.col("did").alias("detail")))


def _anchor_issues(defects: DataFrame, line_map: DataFrame) -> DataFrame:
    """The anchors that the lines of their place don't hold; lines meet the anchors alone, not whole defects."""
    lo, hi = F.col("d.location.start"), F.coalesce("d.location.end", "d.location.start")
    anchors = defects.where(F.col("d.anchor").isNotNull() & lo.isNotNull()).select("id", F.col("d.id").alias("did"), F.col("d.anchor").alias("anchor"), lo.alias("lo"), hi.alias("hi"))
    anchors = anchors.withColumn("row", F.monotonically_increasing_id())
    lines = line_map.select("id", "no", "line")
    met = anchors.join(lines.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & F.col("no").between(F.col("lo"), F.col("hi")), "left")
    held = met.groupBy("id", "row", "did", "anchor").agg(F.array_sort(F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", "line")))).alias("l"))
    span = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    wrong = ~_blank(F.col("anchor")) & ~F.contains(span, F.col("anchor"))
    return _issues(held, [("error", "anchor-mismatch", F.coalesce(wrong, F.lit(False)))], F.col("did"))


def unconfirmed(items: DataFrame) -> DataFrame:
    d = items.select(F.col("id").alias("item_id"), F.explode("defects").alias("d"))
    return d.where(~F.coalesce("d.confirmed", F.lit(False))).select("item_id", F.col("d.id").alias("defect_id"))


def freeze_blockers(items: DataFrame, line_map: DataFrame | None = None) -> DataFrame:
    """Errors and unconfirmed defects; a corpus without any may be frozen."""
    errors = validate(items, line_map).where("level = 'error'").select("item_id", "code", "detail")
    return errors.unionByName(unconfirmed(items).select("item_id", F.lit("unconfirmed").alias("code"), F.col("defect_id").alias("detail")))


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """path and status (added, removed or changed) of entries that differ between two manifests."""
    r, c = recorded.select("path", F.col("digest").alias("old")), current.select("path", F.col("digest").alias("new"))
    both = r.join(c, "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def upsert_defects(defects: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows by key and add new ones; applying it twice changes nothing more."""
    return defects.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def resolve_anchors(anchors: DataFrame, line_map: DataFrame) -> DataFrame:
    """id, anchor, line: the line of the only hit; 0 where there is none, -n where there are n."""
    hits = anchors.join(line_map, "id").where(F.contains("line", F.col("anchor"))).groupBy("id", "anchor").agg(F.count("*").alias("n"), F.min("no").alias("at"))
    out = anchors.join(hits, ["id", "anchor"], "left")
    return out.select("id", "anchor", F.when(F.col("n").isNull(), 0).when(F.col("n") > 1, -F.col("n")).otherwise(F.col("at")).cast("int").alias("line"))
