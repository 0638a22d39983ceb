"""Sinks: reports, worksheets, caches, manifests, releases; gates run before anything is committed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import delete_path, move_path


class GateError(RuntimeError):
    """A result that must not be published."""


def write_report(runs: DataFrame, path: str, expected: int | None = None, undecided: int | str = 0, most_undecided: int = 0) -> str:
    """Runs as JSON; beyond the limit of undecided pairs the output goes to <path>.partial instead.

    undecided is their number, or the column of runs that holds each run's. Runs are read once: they are written beside the
    path while rows (and undecided pairs) are counted, and moved to it when the gate has passed. An unexpected number of runs
    raises and leaves nothing. Returns the path written.
    """
    spark, seen, staged = runs.sparkSession, Observation(), f"{path}.staged-{uuid.uuid4().hex}"
    left = F.lit(undecided) if isinstance(undecided, int) else F.col(undecided)
    counted = F.coalesce((F.max if isinstance(undecided, int) else F.sum)(left), F.lit(0 if isinstance(undecided, str) else undecided))
    runs.observe(seen, F.count(F.lit(1)).alias("n"), counted.alias("undecided")).write.json(staged)
    if expected is not None and seen.get["n"] != expected:
        delete_path(spark, staged)
        raise GateError(f"{seen.get['n']} runs where {expected} are expected")
    target = path if seen.get["undecided"] <= most_undecided else f"{path}.partial"
    move_path(spark, staged, target)
    return target


def report_summary(runs: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: n_runs, n_files, n_skipped, skipped_files, and the runs by config, artifact type and regime.

    skipped has a row for each file that gave no run. Distributions have an entry a name, none for nulls.
    """
    out = None
    for name, column in (("by_config", "config_id"), ("by_type", "artifact_type"), ("by_regime", "regime")):
        n = runs.groupBy(F.coalesce(column, F.lit("none")).alias("k")).agg(F.count("*").alias("n"))
        one = n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # single rows
    counts = runs.agg(F.count("*").alias("n_runs"))
    lost = skipped.agg(F.count("*").alias("n_skipped"), F.array_sort(F.collect_list("file")).alias("skipped_files"))
    one = out.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(lost))
    return one.select("n_runs", (F.col("n_runs") + F.col("n_skipped")).alias("n_files"), "n_skipped", "skipped_files", "by_config", "by_type", "by_regime")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write files (path below root, content binary, null as empty) to a new folder; returns path, digest, n_bytes.

    Each file is written whole under a name of its attempt and then moved to its own, so that a retried task
    leaves the same files. The folder is named as pyarrow's file systems know it. A path that leaves it is
    refused. The rows are those written, in a table beside the folder, so that reading them writes nothing again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import posixpath
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path is None or posixpath.normpath(path).startswith(("..", "/")):
                    raise ValueError(f"a path outside the folder: {path}")
                content = content or b""
                place = f"{base}/{posixpath.normpath(path)}"
                store.create_dir(posixpath.dirname(place), recursive=True)
                attempt = f"{posixpath.dirname(place)}/.{uuid.uuid4().hex}"
                with store.open_output_stream(attempt, compression=None) as f:
                    f.write(content)
                store.move(attempt, place)
                out.append((posixpath.normpath(path), hashlib.sha256(content).hexdigest(), len(content)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "digest", "n_bytes"])

    written = files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, digest string, n_bytes bigint")
    listing = f"{root.rstrip('/')}.files"
    written.write.parquet(listing)
    return files.sparkSession.read.schema(written.schema).parquet(listing)


def write_cache(verdicts: DataFrame, path: str) -> None:
    """pair_key, same in key order: stable files for stable content."""
    verdicts.select("pair_key", "same").orderBy("pair_key").write.mode("overwrite").json(path)


def write_gold(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def write_worksheet(pairs: DataFrame, sheet: str, key: str) -> None:
    """A blinded sheet for labelling and, apart from it, the key to the pairs."""
    opaque = pairs.withColumn("id", F.concat(F.lit("k"), F.substring(F.sha1("pair_id"), 1, 10)))
    blank = opaque.select("id", F.col("a_text").alias("finding_a"), F.col("b_text").alias("finding_b"), F.lit("").alias("label"), F.lit("").alias("notes"))
    options = {"header": True, "escape": '"', "emptyValue": ""}
    blank.orderBy("id").write.mode("overwrite").options(**options).csv(sheet)
    opaque.select("id", "pair_id").orderBy("id").write.mode("overwrite").options(**options).csv(key)


def manifest_lines(digests: DataFrame) -> DataFrame:
    return digests.orderBy("path").select(F.concat("digest", F.lit("  "), "path").alias("value"))


def write_manifest(digests: DataFrame, path: str, blockers: DataFrame | None = None) -> None:
    """The manifest, unless there are blockers (errors or unconfirmed defects)."""
    if blockers is not None and not blockers.isEmpty():
        raise GateError(f"{blockers.count()} blockers")
    manifest_lines(digests).write.mode("overwrite").text(path)


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """A Markdown table as rows of text: two header rows, then one row each; bars in cells are escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(columns) + " |",), ("|" + "---|" * len(columns),)], "value string")
    return head.unionByName(body)


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def release_listing(files: DataFrame, keep: dict[str, int], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first files of each arm by name (keep: how many), and the wanted names that are missing."""
    limit = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])[F.col("arm")]
    rank = F.row_number().over(Window.partitionBy("arm").orderBy("name"))
    first = files.withColumn("_k", rank).where(F.col("_k") <= limit).drop("_k")
    return first, wanted.join(files.select("name"), "name", "left_anti")


def archives(files: DataFrame, key: str) -> DataFrame:
    """key and content: a gzipped tar archive of each key's files (path, content) in the order of their names.

    The files of a key must fit a task. Equal files give equal bytes.
    """
    kind = dict(files.dtypes)[key]

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import gzip
        import io
        import tarfile

        out = io.BytesIO()
        with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as packed, tarfile.open(fileobj=packed, mode="w") as tar:
            for path, content in sorted(zip(rows["path"], rows["content"], strict=True)):
                info = tarfile.TarInfo(path)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return pd.DataFrame({key: [group[0]], "content": [out.getvalue()]})

    return files.select(key, "path", F.col("content").cast("binary").alias("content")).groupBy(key).applyInPandas(run, f"{key} {kind}, content binary")


def source_listing(text: Column, start: Column, end: Column) -> Column:
    """A text's numbered lines as HTML, those of start to end marked as the zone."""
    def line(x: Column, i: Column) -> Column:
        no = i + 1
        zone = F.coalesce((start > 0) & (end > 0) & no.between(start, end), F.lit(False))
        shown = F.lpad(no.cast("string"), F.greatest(F.lit(4), F.length(no.cast("string"))), F.lit(" "))
        return F.concat(F.when(zone, F.lit("<span class=zone>")).otherwise(F.lit("<span>")), shown, F.lit("  "), html_escape(x), F.lit("</span>"))

    return F.concat(F.lit("<pre>"), F.array_join(F.transform(F.split(F.regexp_replace(text, r"\n$", ""), r"\R", -1), line), "\n"), F.lit("</pre>"))


def review_cards(items: DataFrame) -> DataFrame:
    """items with a column card: an HTML card with a verdict to choose.

    items has id, arm, module, weight, claim, unit, start, end and source (the module's text); all but weight are
    escaped, nulls are shown as empty and a null unit as (unlocalized).
    """
    e = lambda c: html_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    span = F.concat(e("unit"), F.coalesce(F.concat(F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")), F.lit("")))
    place = F.when(F.col("unit").isNull(), F.lit("(unlocalized)")).otherwise(span)
    choices = [F.concat(F.lit('<label><input type=radio name="'), e("id"), F.lit(f'" value="{v}"> {v}</label>')) for v in ("real", "false", "unsure")]
    card = F.concat(
        F.lit('<div class=card data-item="'), e("id"), F.lit('" data-arm="'), e("arm"), F.lit('" data-module="'), e("module"), F.lit('" data-weight="'), F.col("weight").cast("string"), F.lit('">'),
        F.lit("<div class=claim>"), e("claim"), F.lit("</div><div class=loc>"), place, F.lit(" in "), F.col("weight").cast("string"), F.lit(" run(s)</div>"),
        *choices, source_listing(F.coalesce("source", F.lit("")), F.col("start"), F.col("end")), F.lit("</div>"),
    )
    return items.withColumn("card", card)


def write_review_pages(items: DataFrame, root: str, title: str, each: int = 500) -> DataFrame:
    """Pages of cards, each items at most to a page, by arm and module; returns path, digest, n_bytes of the pages.

    A page covers one arm and module; those with more items get numbered pages.
    """
    place = Window.partitionBy("arm", "module").orderBy("id")
    cards = review_cards(items).withColumn("_page", F.floor((F.row_number().over(place) - 1) / each).cast("long"))
    pages = cards.groupBy("arm", "module", "_page").agg(F.array_sort(F.collect_list(F.struct("id", "card"))).alias("c"))
    head = F.lit(f"<!doctype html><meta charset=utf-8><title>{title}</title><style>.zone{{background:#ffd}}</style>\n")
    body = F.array_join(F.transform("c", lambda x: x["card"]), "\n")
    name = F.concat_ws("/", "arm", F.concat("module", F.lit("-"), F.col("_page").cast("string"), F.lit(".html")))
    return write_files(pages.select(name.alias("path"), F.encode(F.concat(head, body), "UTF-8").alias("content")), root)
