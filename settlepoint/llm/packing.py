"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

A document is its token ids followed by one end id. Pieces of exactly the sequence length fill a
sequence of their own; what remains of each document waits in a bounded pool. A pool is packed at
once: its sequences have just enough capacity for its tokens, each remainder has an estimated
attention cost ``linear * n + quadratic * n * n``, and remainders go in descending order to the
sequence of lowest cost that has capacity left, cut where that capacity ends. The last tokens of a
pool go to sequences whose lengths are descending powers of two, which need no padding.

The operator makes one pass over each partition and no shuffle. Sequence numbers derive from the
partition number, so a retried task yields the same rows.

Defined cases: null and empty texts are documents of the end id alone; a text of any length is cut
into as many pieces as it needs; repeated rows are packed once each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)

#: Pretokens of the byte-level vocabulary (fixed values); white space is Unicode's own property.
PRETOKENS = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


class PieceIds(dict):
    """Pretoken -> its ids as little-endian unsigned 32-bit bytes; filled as pretokens are met.

    Once LIMIT pretokens are held, further ones are encoded without being kept, which bounds memory.
    """

    LIMIT = 300_000

    def __init__(self, tokenizer_path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.encode = _rank_encoder(tokenizer_path)

    def __missing__(self, piece: str) -> bytes:
        packed = self.whole(piece)
        if len(self) < self.LIMIT:
            self[piece] = packed
        return packed

    def whole(self, text: str) -> bytes:
        if self.encode is None:
            return self.library(text)
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class ChunkIds(dict):
    """Text between two white-space characters -> ids of ``lead`` + that text."""

    LIMIT = 300_000

    def __init__(self, pieces: PieceIds, split: Callable[[str], list[str]], lead: str):
        super().__init__()
        self.pieces, self.split, self.lead = pieces, split, lead

    def __missing__(self, chunk: str) -> bytes:
        packed = b"".join(map(self.pieces.__getitem__, self.split(self.lead + chunk)))
        if len(self) < self.LIMIT:
            self[chunk] = packed
        return packed


class TextIds:
    """Whole texts to ids. The file's added tokens (control strings) are found first, as the library does, and
    what lies between them is encoded. Where no two white-space characters meet, a pretoken never spans the
    place before a single space or either side of a single line feed, so such parts are split there and the
    pieces looked up; all others go through the pretoken pattern."""

    def __init__(self, tokenizer_path: str):
        import regex

        self.split = regex.compile(PRETOKENS).findall
        self.pieces = PieceIds(tokenizer_path)
        self.odd_space = re.compile(r"\s(?=\s|\Z)").search
        self.first = ChunkIds(self.pieces, self.split, "")
        self.spaced = ChunkIds(self.pieces, self.split, " ")
        added = self.pieces.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items()}
        longest_first = sorted(self.added, key=lambda x: (-len(x), x))
        self.control = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        # Tokens that take white space with them or match normalised text or words only: left to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())

    def __call__(self, text: str) -> bytes:
        if self.pieces.encode is None:  # a vocabulary of another kind: no pretokens are known
            return self.pieces.whole(text)
        if self.control is None or not self.control.search(text):
            return self.between(text)
        if not self.plain:
            return self.pieces.library(text)
        parts = self.control.split(text)
        return b"".join(self.added[x] if k % 2 else self.between(x) for k, x in enumerate(parts))

    def between(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd_space(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.first[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.pieces["\n"].join(lines)


def _rank_encoder(tokenizer_path: str):
    """Encoder of single pretokens over the vocabulary of a byte-level tokenizers file, else None.

    It merges by ascending id, which is the file's own order if the results of its merges, in the order of
    the file, ascend by id and the single bytes come before them. That is checked for all merges; a file of
    another kind, or with a setting that changes how it merges, is left to the library.
    """
    import json

    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    unusual = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or spec.get("normalizer") or any(model.get(k) for k in unusual):
        return None
    to_byte = _byte_level_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {token: i for token, i in model["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    single = [i for token, i in vocab.items() if len(token) == 1]
    if len(single) != 256 or made != sorted(set(made)) or made and made[0] <= max(single) or len(made) + 256 != len(vocab):
        return None
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items()}
    core = tiktoken.Encoding("bytes", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return core.encode_ordinary


def _byte_level_alphabet() -> dict[str, int]:
    """Byte-level files write printable bytes as themselves and the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    rest = (b for b in range(256) if b not in set(printable))
    out.update({chr(256 + k): b for k, b in enumerate(rest)})
    return out


def power_of_two_parts(n: int) -> list[int]:
    """Descending powers of two that sum to n."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def assign(
    lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1.0 / 1024
) -> list[tuple[int, int, int, int, int]]:
    """Place remainders; returns (item, start in item, length, sequence, offset), sequences from 0.

    Items go in descending cost order, ties by position, to the lowest-cost sequence with capacity.
    """
    total = sum(lengths)
    capacities = [size] * (total // size) + power_of_two_parts(total % size)
    heap = [(0.0, k) for k in range(len(capacities))]
    used = [0] * len(capacities)
    out = []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        start, left = 0, lengths[item]
        while left:
            cost, k = heap[0]
            take = min(left, capacities[k] - used[k])
            out.append((item, start, take, k, used[k]))
            used[k] += take
            start += take
            left -= take
            if used[k] < capacities[k]:
                heapq.heapreplace(heap, (cost + linear * take + quadratic * take * take, k))
            else:
                heapq.heappop(heap)
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    pool_items: int = 16_384,
    pool_tokens: int = 8_000_000,
) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset (columns: see SCHEMA)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = TextIds(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        end = end_id.to_bytes(4, "little")
        rows: list[tuple] = []
        pool: list[tuple[int, int, bytes, int]] = []
        waiting = 0

        def flush_pool() -> None:
            nonlocal sequence, pool, waiting
            placed = assign([len(p[2]) >> 2 for p in pool], size, linear, quadratic)
            for item, start, length, k, offset in placed:
                doc_id, base, ids, n = pool[item]
                piece = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, base + start, length, piece, n, sequence + k, offset))
            sequence += 1 + max((p[3] for p in placed), default=-1)
            pool, waiting = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                ids = encode(text) + end
                n = len(ids) >> 2
                full = n - n % size
                for start in range(0, full, size):
                    rows.append((doc_id, start, size, ids[4 * start : 4 * (start + size)], n, sequence, 0))
                    sequence += 1
                    if len(rows) >= 2048:
                        yield batch()
                if full < n:
                    pool.append((doc_id, full, ids[4 * full :], n))
                    waiting += n - full
                    if len(pool) >= pool_items or waiting >= pool_tokens:
                        flush_pool()
                if len(rows) >= 2048:
                    yield batch()
        if pool:
            flush_pool()
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
