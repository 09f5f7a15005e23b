"""Bounded-space online packing of token ids.

Each partition keeps OPEN windows open. A document's full windows leave at once; its rest goes to
the open window that it fills best. When none fits, the fullest is filled up with the head of the
piece if the gap is worth a cut, and emitted; the tail is placed in turn. What is open at the end
of a partition is merged with what FAN other partitions have left.
"""

from __future__ import annotations

import base64
import re
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, partitions, stash, text_or_empty

LENGTH = 1024
OPEN = 32
#: A gap of fewer ids is left as padding rather than filled with a cut piece.
LEAST_CUT = 8
#: Partitions whose leftovers meet in one task: at most FAN * OPEN windows.
FAN = 64

_ROW = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, rest int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("rest", pa.int32())])
_held: dict = {}
#: White space that may stand beside other white space.
_WIDE = re.compile(r"[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The vocabulary's rule for splitting a text without adjacent white space: there its look-ahead
#: never decides, and the rule without it runs much faster.
_SIMPLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_END = b"\0\0\0\0"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, as `tokenizers` gives them without adding special tokens.

    `tiktoken` holds the same vocabulary and rules and is several times as fast; a text that could
    hold a special token goes to `tokenizers`.
    """

    def __init__(self, path: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = Tokenizer.from_file(path)
        self.full, self.simple = (tiktoken.Encoding("text", pat_str=p, mergeable_ranks=table, special_tokens={}).encode_ordinary for p in (PATTERN, _SIMPLE))

    def __call__(self, text: str) -> bytes:
        if "<|" in text:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        elif "  " in text or "\n\n" in text or "\n " in text or " \n" in text or _WIDE.search(text):
            ids = self.full(text)
        else:
            ids = self.simple(text)
        return array("I", ids).tobytes()


def encode(texts: list[str], path: str, ranks: str) -> list[bytes]:
    """Little-endian uint32 ids of each text and a 0; a worker keeps its encoder."""
    if path not in _held:
        _held[path] = Encoder(path, ranks)
    return [_held[path](t) + _END for t in texts]


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) in at most `width` open windows."""

    def __init__(self, emit, width: int = OPEN, length: int = LENGTH):
        self.emit, self.width, self.length, self.open = emit, width, length, []

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        at, end = 0, len(ids) // 4  # a long text's ids are cut where they are, not copied per window
        while at < end:
            n = end - at
            if n >= self.length:
                self.emit([(doc_id, start + at, ids[4 * at : 4 * (at + self.length)], total)])
                at += self.length
                continue
            fits = [w for w in self.open if self.length - w[0] >= n]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.width:
                self.open.append(window := [0, []])
            else:
                window = max(self.open, key=lambda w: w[0])
                gap = self.length - window[0]
                if gap >= LEAST_CUT:
                    window[1].append((doc_id, start + at, ids[4 * at : 4 * (at + gap)], total))
                    at += gap
                self.open.remove(window)
                self.emit(window[1])
                continue
            window[0] += n
            window[1].append((doc_id, start + at, ids[4 * at :], total))
            if window[0] == self.length:
                self.open.remove(window)
                self.emit(window[1])
            return

    def rest(self) -> list:
        out = [w[1] for w in sorted(self.open, key=lambda w: -w[0])]
        self.open = []
        return out


class Rows:
    """Collects the pieces of emitted sequences, numbered from a task's own range."""

    def __init__(self, first: int):
        self.next, self.rows = first, []

    def emit(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, self.next, offset, None))
            offset += len(ids) // 4
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _pack(path: str, ranks: str):
    def run(batches):
        task = TaskContext.get().partitionId()
        rows = Rows(task << 32)
        packer = Packer(rows.emit)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist(), path, ranks)):
                    packer.add(doc_id, 0, ids, len(ids) // 4)
                if len(rows.rows) >= 2000:
                    yield rows.batch()
        for window in packer.rest():
            rows.rows += [(d, s, len(i) // 4, i, t, None, None, task // FAN) for d, s, i, t in window]
        if rows.rows:
            yield rows.batch()

    return run


def _merge(batches):
    """Leftovers of up to FAN partitions. The last windows are cut to fill each other, so a task
    leaves one sequence that is not full."""
    task = TaskContext.get().partitionId()
    rows = Rows(-((task + 1) << 32))
    packer = Packer(rows.emit)
    for batch in batches:
        for r in batch.to_pylist():
            packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        if len(rows.rows) >= 2000:
            yield rows.batch()
    last = Packer(rows.emit, 1)
    for window in packer.rest():
        for piece in window:
            last.add(*piece)
    for window in last.rest():
        rows.emit(window)
    if rows.rows:
        yield rows.batch()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ids is binary: little-endian uint32. A document is its text's ids and a 0; a null or empty text
    is that 0 alone. path and ranks are one vocabulary in two libraries' formats. Pieces of a sequence lie without gaps from offset 0; a sequence of fewer than
    1024 ids is to be padded. Rows that repeat an id, or have none, are documents of their own. A very
    long text is encoded whole and cut into full sequences. An empty table gives no rows; columns beside
    id and text, whatever their names, are ignored.
    """
    path, ranks = path or tokenizer_path(), ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    placed = stash(base.transform(in_arrow, _pack(path, ranks), _ROW))
    left = placed.where("rest is not null").repartition(partitions(docs.sparkSession), "rest").transform(in_arrow, _merge, _ROW)
    return placed.where("rest is null").union(left).drop("rest").withColumnRenamed("doc_id", id_col)
