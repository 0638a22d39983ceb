"""WARC archives with a two-level capture index.

Writing: rows are range-partitioned and sorted by their key, the URL with its host reversed, and then by
page id. Each task streams its rows into one archive (a gzip member per record) and one index file:
sorted index lines in compressed blocks of a fixed number of lines, then a sparse directory with the
first key and page id and the place of each block. Of records with equal payloads the one with the largest page id
is the response and the others are revisits that name it.

Reading: a lookup finds the index file by binary search over the files' first keys and page ids (one entry
a file), the block by binary search over that file's directory, the line by binary search in the block, and
then reads the record's byte range from the archive. As page ids are part of the order everywhere, a capture
of a URL with any number of captures takes as few block reads as that of a URL with one.

Files go to the shared folder through pyarrow's file systems. A task attempt writes files of its own
name and only the rows of a successful attempt name them, so lost executors, retries and speculation
leave at most unreferenced files. A task holds one record, one block and one directory at a time.

Defined cases: a null payload is empty; equal payloads of any size (also empty ones) from ``dedup_bytes``
on are deduplicated; a null or unparsable URL has its text as its key; rows that repeat a URL and a page id
are captures of their own, all of which a lookup returns; if such rows repeat the largest page id of equal
payloads, all of them are responses; a null page id is never referred to, so that equal payloads of which
no row has a page id are all responses; an empty table gives no archives; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete_path, fresh_path, small_batches, written

BLOCK_LINES = 2048
INDEX_SCHEMA = "first_key string, first_page bigint, lines bigint, archive string, index string, directory_at bigint, directory_length bigint"
CAPTURE_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def reversed_host_key(url: Column) -> Column:
    """com,example,www)/path?query of a URL, lower-case host, without scheme, user, port 80/443 and fragment."""
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)", 1)
    port = F.when(port.isin(":80", ":443"), F.lit("")).otherwise(port)
    rest = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest)
    return F.when(host == "", text).otherwise(key)


def keepers(pages: DataFrame, dedup_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with key, and keep_id of each repeated payload of dedup_bytes or more.

    The groups are counted by digest with map-side combining and written, so that the join back on the
    digest knows their size: few groups are broadcast and the payloads stay where they are; for many
    groups it is a shuffled join, which splits a payload that very many pages share over several tasks.
    """
    hashed = pages.withColumn("_sha", F.sha1("payload")).withColumn("key", reversed_host_key(F.col("url")))
    large = hashed.where(F.length("payload") >= dedup_bytes)
    groups = large.groupBy("_sha").agg(F.max("page_id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
    groups = written(groups.drop("copies"), "groups")
    return hashed.join(groups, "_sha", "left").drop("_sha")


def _arrow_uri(folder: str) -> str:
    """Spark's name of a shared folder as pyarrow's file systems know it (file, hdfs, s3, gs, abfs)."""
    return re.sub(r"^s3[an]://", "s3://", re.sub(r"^abfss://", "abfs://", folder))


def _header(lines: list[tuple[str, str]]) -> bytes:
    clean = (f"{k}: " + re.sub(r"[\r\n]+", " ", v) + "\r\n" for k, v in lines)
    return ("WARC/1.1\r\n" + "".join(clean) + "\r\n").encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str, str]:
    """An uncompressed record, its payload digest and type; the block of a revisit is empty."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        lines += [
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    return _header([*lines, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n", digest, kind


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its block")
    return fields, rest[:n]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, dedup_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write archives and index files below folder; returns one row per index file (see INDEX_SCHEMA)."""
    small_batches(pages.sparkSession, 512)
    rows = keepers(pages, dedup_bytes).select("key", "page_id", "url", "payload", "keep_id")
    dealt = rows.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(_arrow_uri(folder))
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        archive = index = None
        directory: list[tuple[str, int | None, int, int]] = []
        block: list[str] = []
        n = 0

        def end_block() -> None:
            data = zlib.compress("\n".join(block).encode("utf-8", "surrogatepass"))
            first, _, entry = block[0].partition("\t")
            directory.append((json.loads(first), json.loads(entry)[0], index.tell(), len(data)))
            index.write(data)
            block.clear()

        for b in batches:
            if b.num_rows and archive is None:
                archive = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
                index = store.open_output_stream(f"{base}/{name}.idx", compression=None)
                first_key, first_page = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            for r in range(b.num_rows):
                key, page_id, url, payload, keep = (c[r].as_py() for c in b.columns)
                # The response is the page that keeps its payload; payloads that occur once have no keeper.
                refers = None if keep is None or keep == page_id else keep
                data, digest, kind = record(page_id, url, payload, refers, date)
                at = archive.tell()
                member = _gzip(data)
                archive.write(member)
                block.append("\t".join((json.dumps(key), json.dumps([page_id, at, len(member), digest, kind]))))
                n += 1
                if len(block) >= BLOCK_LINES:
                    end_block()
        if archive is not None:
            if block:
                end_block()
            at = index.tell()
            data = zlib.compress(json.dumps(directory).encode())
            index.write(data)
            archive.close()
            index.close()
            yield pa.RecordBatch.from_pylist(
                [{"first_key": first_key, "first_page": first_page, "lines": n, "archive": f"{name}.warc.gz", "index": f"{name}.idx", "directory_at": at, "directory_length": len(data)}]
            )

    return written(dealt.mapInArrow(run, INDEX_SCHEMA), "archives")


def place(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """What captures are ordered by; a null page id comes first."""
    return key, page_id is not None, page_id or 0


class CaptureIndex:
    """Binary searches over index files; keeps the last directory and block of one file."""

    def __init__(self, folder: str, files: list[tuple[str, int | None, str, str, int, int]]):
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(_arrow_uri(folder))
        self.files = files  # first_key, first_page, archive, index, directory_at, directory_length; ascending
        self.firsts = [place(*f[:2]) for f in files]
        self.open_at: tuple | None = None
        self.block_at: tuple | None = None

    def _range(self, name: str, at: int, length: int) -> bytes:
        with self.store.open_input_file(f"{self.base}/{name}") as f:
            return f.read_at(length, at)

    def _file(self, k: int) -> list:
        if self.open_at is None or self.open_at[0] != k:
            _, _, _, name, at, length = self.files[k]
            self.open_at = (k, json.loads(zlib.decompress(self._range(name, at, length))))
        return self.open_at[1]

    def _block(self, k: int, j: int) -> tuple[list[str], list[list]]:
        if self.block_at is None or self.block_at[0] != (k, j):
            _, _, at, length = self._file(k)[j]
            lines = [x.split("\t") for x in zlib.decompress(self._range(self.files[k][3], at, length)).decode("utf-8", "surrogatepass").split("\n")]
            self.block_at = ((k, j), [json.loads(a) for a, _ in lines], [json.loads(b) for _, b in lines])
        return self.block_at[1], self.block_at[2]

    def _from(self, start: tuple) -> Iterator[tuple[int, list[str], list[list], int]]:
        """The blocks that hold places from start on: file number, keys, entries and where to begin; the caller stops."""
        for k in range(max(0, bisect.bisect_left(self.firsts, start) - 1), len(self.files)):
            directory = self._file(k)
            for j in range(max(0, bisect.bisect_left(directory, start, key=lambda e: place(*e[:2])) - 1), len(directory)):
                keys, entries = self._block(k, j)
                at = lambda i, keys=keys, entries=entries: place(keys[i], entries[i][0])
                yield k, keys, entries, bisect.bisect_left(range(len(keys)), start, key=at)

    def lookup(self, key: str) -> Iterator[tuple[int, list]]:
        """All captures of a key as (file number, [page_id, offset, length, digest, type])."""
        for k, keys, entries, begin in self._from((key, False, 0)):
            for i in range(begin, len(keys)):
                if keys[i] != key:
                    return
                yield k, entries[i]

    def seek(self, key: str, page_id: int | None) -> Iterator[tuple[int, list]]:
        """The captures of a key with this page id (keys and then ids ascend over blocks and files)."""
        probe = place(key, page_id)
        for k, keys, entries, begin in self._from(probe):
            for i in range(begin, len(keys)):
                if place(keys[i], entries[i][0]) != probe:
                    return
                yield k, entries[i]


def read_captures(requests: DataFrame, folder: str, archives: DataFrame) -> DataFrame:
    """The captures (see CAPTURE_SCHEMA) of requests, a table of key and page_id, once however often requested.

    The files' first keys are collected: one short row per written partition, whose number the writer
    bounds. Requests are sorted by range, so a task walks through neighbouring blocks and records.
    """
    spark = requests.sparkSession
    rows = archives.orderBy("first_key", "first_page", "archive").select("first_key", "first_page", "archive", "index", "directory_at", "directory_length").collect()
    files = [tuple(r) for r in rows]
    if not files:
        return spark.createDataFrame([], CAPTURE_SCHEMA)
    parts = max(len(files), spark.sparkContext.defaultParallelism)
    dealt = requests.select("key", "page_id").repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, files)
        archive: tuple | None = None
        before: tuple | None = None
        for b in batches:
            out, size = [], 0
            for request in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if request == before:
                    continue
                before, page_id = request, request[1]
                for k, (_, at, length, digest, _) in index.seek(*request):
                    if archive is None or archive[0] != k:
                        archive = (k, index.store.open_input_file(f"{index.base}/{files[k][2]}"))
                    fields, body = parse_record(zlib.decompress(archive[1].read_at(length, at), 31))
                    kind = fields["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"page {page_id}: its payload does not have its digest")
                    refers = fields.get("warc-refers-to")
                    refers = None if refers is None else int(refers[len("<urn:page:") : -1])
                    size += len(body)
                    out.append((page_id, int(fields["x-payload-length"]), fields["warc-payload-digest"].partition(":")[2], kind, refers, fields["warc-target-uri"], body))
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, CAPTURE_SCHEMA)


def pages_as_payloads(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))


def new_folder(spark) -> str:
    return fresh_path(spark, "warc")


def remove(spark, folder: str) -> None:
    delete_path(spark, folder)
