"""Readers: corpora, trajectories, scored runs, gold pairs, worksheets, caches, manifests, settings."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as texts
from . import schemas


def _json(spark: SparkSession, path, schema: str, strict: bool = False) -> DataFrame:
    """One JSON object a file, with its path; strict files fail on invalid JSON, others read as nulls."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path).withColumn("_path", F.col("_metadata.file_path"))


def _folder(depth: int):
    """A path part counted from the end (1: the file name)."""
    return F.element_at(F.split("_path", "/"), -depth)


def items(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Corpus items: meta, defects, artifact text, folder and type folder, by type and name.

    Items lie in <root>/<type>/<name>/meta.json; type order is code, paper, spec.
    """
    meta = _json(spark, f"{root}/*/*/meta.json", schemas.META, strict).withColumn("folder", _folder(2)).withColumn("type_folder", _folder(3))
    meta = meta.where(F.col("type_folder").isin("code", "paper", "spec")).drop("_path")
    defects = _json(spark, f"{root}/*/*/defects.json", schemas.DEFECTS, strict).select(_folder(2).alias("folder"), _folder(3).alias("type_folder"), "defects")
    out = meta.join(defects, ["type_folder", "folder"], "left").join(artifacts(spark, root), ["type_folder", "folder", "artifact_file"], "left")
    return out.orderBy("type_folder", "folder")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """type_folder, folder, artifact_file, artifact: whole text files beside the metadata."""
    raw = spark.read.text(f"{root}/*/*/*", wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    raw = raw.select(_folder(3).alias("type_folder"), _folder(2).alias("folder"), _folder(1).alias("artifact_file"), F.col("value").alias("artifact"))
    return raw.where(~F.col("artifact_file").isin("meta.json", "defects.json"))


def line_map(items_df: DataFrame) -> DataFrame:
    """id, no, line of each artifact: file lines, or a diff's new-file lines."""
    plain = F.transform(F.split(F.regexp_replace("artifact", r"\n$", ""), r"\R", -1), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    rows = F.when(F.endswith("artifact_file", F.lit(".diff")), texts.diff_postimage(F.col("artifact"))).otherwise(plain)
    return items_df.select("id", F.explode(rows).alias("l")).select("id", "l.no", "l.line")


def trajectories(spark: SparkSession, root: str) -> DataFrame:
    """One row a run from JSON files anywhere below root (reports and hidden files are skipped)."""
    reader = spark.read.schema(schemas.TRAJECTORY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    raw = reader.json(root).withColumn("_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    raw = raw.where((F.col("_name") != "metrics.json") & ~F.startswith("_name", F.lit("._")))
    return raw.select("trajectory.*", "transcripts", "reviewer_calls", "extractor_calls", "prompt_version", F.col("_name").alias("file"))


def round_findings(trajectory_rows: DataFrame) -> DataFrame:
    """run_id, artifact_id, config_id, round, finding (position) and the finding's fields; severity defaults to minor."""
    rounds = trajectory_rows.select("run_id", "artifact_id", "config_id", F.posexplode_outer("rounds").alias("round", "r"))
    f = rounds.select("run_id", "artifact_id", "config_id", "round", F.posexplode("r.findings").alias("finding", "f"))
    return f.select("run_id", "artifact_id", "config_id", "round", "finding", "f.claim", "f.location", F.coalesce("f.severity", F.lit("minor")).alias("severity"), "f.evidence")


def transcript_lengths(trajectory_rows: DataFrame) -> DataFrame:
    """artifact, config (from the file name), round and the characters of its transcript."""
    parts = F.split(F.regexp_replace("file", r"\.json$", ""), "__")
    rows = trajectory_rows.select(F.get(parts, F.lit(0)).alias("artifact"), F.get(parts, F.lit(1)).alias("config"), F.posexplode("transcripts").alias("round", "t"))
    return rows.select("artifact", "config", "round", F.length(F.array_join("t", " ")).alias("n_chars"))


def scored_runs(spark: SparkSession, paths) -> DataFrame:
    """The runs of several reports with their position (ties of majorities are broken by it)."""
    raw = _json(spark, paths, schemas.SCORED)
    return raw.select("_path", F.posexplode("runs").alias("pos", "r")).select("_path", "pos", "r.*")


def report_runs(spark: SparkSession, paths) -> DataFrame:
    """The runs of reports as the writer leaves them, a JSON object a line."""
    return spark.read.schema(T.StructType.fromDDL(f"r {schemas.SCORED_RUN}")["r"].dataType).json(paths)


def gold_pairs(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.GOLD).json(path)


def collected_pairs(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.COLLECTED).json(path)


def worksheet(spark: SparkSession, path) -> DataFrame:
    """id and label of a hand-labelled sheet; rows without a readable label are dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    ids = [F.nullif(F.col(c), F.lit("")) for c in ("id", "pair_id") if c in raw.columns]
    return raw.select(F.coalesce(*ids).alias("id"), texts.parse_label(F.col("label")).alias("label")).where("id is not null and label is not null")


def verdict_cache(spark: SparkSession, path: str) -> DataFrame:
    """pair_key, same of one JSON object with a verdicts map, or of the writer's JSON lines; a missing file is an empty cache."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "pair_key string, same boolean")
    whole = _json(spark, path, schemas.CACHE).select(F.explode("verdicts").alias("pair_key", "same"))
    lines = spark.read.schema("pair_key string, same boolean").json(path).where("pair_key is not null")
    return whole.union(lines)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, digest of lines of digest, two spaces, path."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.regexp_extract("value", r"^(\S+)  (.*)$", 2).alias("path"), F.regexp_extract("value", r"^(\S+)  (.*)$", 1).alias("digest"))


def file_digests(spark: SparkSession, root: str, manifest_name: str = "MANIFEST.sha256") -> DataFrame:
    """path (relative), digest, length of every file below root but the manifest (Spark lists no empty or hidden files)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/*", "/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.concat(F.lit(r"^\Q"), base, F.lit(r"\E/*")), F.lit(""))
    out = raw.select(relative.alias("path"), F.sha2("content", 256).alias("digest"), "length")
    return out.where(F.col("path") != manifest_name)


_FIELD = r'(?s)(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def csv_records(
    spark: SparkSession, path, null_tokens: tuple[str, ...] = ("",), types: dict[str, str] | None = None, fill: dict[str, str] | None = None, rest: str | None = None
) -> DataFrame:
    """CSV with quotes, doubled quotes and embedded line ends; null tokens read as null.

    types casts columns (null where a value does not fit), fill gives the value of fields that a row lacks. rest
    names an array column for the fields that a row has beyond the header, null where it has none.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "nullValue": null_tokens[0] if null_tokens else ""}
    raw = spark.read.options(**options).csv(path)
    names = raw.columns
    if rest is not None:
        bad = "_record"
        while bad in names:
            bad = "_" + bad
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]])
        raw = spark.read.options(**options, columnNameOfCorruptRecord=bad, enforceSchema=True).schema(schema).csv(path)
        record = F.regexp_replace(F.col(f"`{bad}`"), r"\r?\n$", "")
        every = F.regexp_extract_all(record, F.lit(_FIELD), F.lit(1))
        fields = F.slice(every, F.lit(len(names) + 1), F.greatest(F.size(every), F.lit(0)))
        plain = F.transform(fields, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
        raw = raw.select(*[F.col(f"`{n}`") for n in names], F.when(F.size(fields) > 0, plain).alias(rest))
    for name in names:
        c = F.col(f"`{name}`")
        if len(null_tokens) > 1:
            c = F.when(~c.isin(*null_tokens[1:]), c)
        if fill and name in fill:
            c = F.coalesce(c, F.lit(fill[name]))
        if types and name in types:
            c = c.try_cast(types[name])
        raw = raw.withColumn(name, c)
    return raw


def key_status(environment: dict[str, str], names: tuple[str, ...]) -> dict[str, bool]:
    """Which of the named settings have a value (the values are not shown)."""
    return {x: bool(environment.get(x, "").strip()) for x in names}


def settings(text: str, env: dict[str, str] | None = None, override: bool = False) -> dict[str, str]:
    """KEY=value lines (export, quotes, comments); the environment wins unless override."""
    out = dict(os.environ if env is None else env)
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        key, eq, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not eq or not key or key.startswith("#"):
            continue
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
        value = value[1:-1] if quoted else value.partition(" #")[0].strip()
        if override or key not in out:
            out[key] = value
    return out


def archived_files(spark: SparkSession, path, suffix: str = "") -> DataFrame:
    """archive, path, content of the regular files in tar archives (compressed or not) whose name ends with suffix.

    An archive is read by one task, file by file; it is one binary value, so below 2 GB. Nothing is unpacked to disk,
    and names are only text: a name that leads out of a folder is kept as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import tarfile

        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(suffix):
                            row = [[archive], [member.name], [tar.extractfile(member).read()]]
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.string(), pa.binary()), strict=True)], ["archive", "path", "content"])

    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("archive"), "content").mapInArrow(run, "archive string, path string, content binary")


def archived_trajectories(spark: SparkSession, path) -> DataFrame:
    """As trajectories, from the JSON files of tar archives (reports and hidden files are skipped)."""
    raw = archived_files(spark, path, ".json").withColumn("file", F.element_at(F.split("path", "/"), -1))
    raw = raw.where((F.col("file") != "metrics.json") & ~F.startswith("file", F.lit("._")))
    r = raw.select("file", F.from_json(F.decode("content", "UTF-8"), schemas.TRAJECTORY).alias("r"))
    return r.select("r.trajectory.*", "r.transcripts", "r.reviewer_calls", "r.extractor_calls", "r.prompt_version", "file")
