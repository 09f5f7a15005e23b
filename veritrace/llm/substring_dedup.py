"""Substring dedup by super-k-mer partitioning.

A window is `k` consecutive words of one document. Consecutive windows that share a minimiser
(the smallest hash of `m` consecutive words in the window) travel as one packed string of words to
the minimiser's bucket. Equal windows have equal minimisers, so a bucket sees all occurrences of
its windows; sorting them by hash and comparing the words of equal hashes counts them exactly.

Before anything travels, a chunk of documents settles its own repeats: of equal windows only the
first leaves, marked as repeated, and the chunk answers for all of them. So a passage held by a third of all
documents reaches its bucket once per chunk, not once per document.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, buffers, chunks, groups, in_arrow, long_runs, mix, partitions, runs, text_or_empty

#: Words of a window, and of the m-mers whose smallest hash is its minimiser.
WINDOW, MINIMISER = 35, 6
#: Buckets in a partition: a bucket is what a task holds in memory at once.
FINE = 8

_ROW = "bucket int, mark long, mark2 long, first int, last int, packed binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("mark", pa.int64()), ("mark2", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("packed", pa.binary())])


def normalised(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each: buffer, starts, ends."""
    size = words.ends - words.starts
    ends = np.cumsum(size + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.starts] = 1
    inside = np.zeros(len(words.data), bool)
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.starts] += 1
    np.add.at(step, words.ends, -1)
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    index = np.cumsum(edge[:-1], dtype=np.int64)[inside] - 1
    out[np.arange(len(index)) + index] = words.data[inside]
    return out, ends - size, ends


def repeated(text: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, at: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that start at the words `at`: which occur twice among them (or equal one that
    is known to be repeated), and which are the first of their kind. Hashes sort them; words decide."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = np.zeros(len(at), bool)
    same[1:] = hs[1:] == hs[:-1]
    begin, end = starts[at].tolist(), ends[at + k - 1].tolist()
    heads = np.flatnonzero(~same)
    head = order[heads[np.cumsum(~same) - 1]] if len(order) else order
    odd = []
    pairs = np.flatnonzero(same)
    for p, i, j in zip(pairs.tolist(), order[pairs].tolist(), head[pairs].tolist()):
        if text[begin[i] : end[i]] != text[begin[j] : end[j]]:
            odd.append(p)
    kind = np.cumsum(~same) - 1  # of each sorted window
    if odd:  # different words under one hash: their run gets a kind for each string
        fresh = int(kind[-1])
        for run in set(kind[odd].tolist()):
            seen: dict[bytes, int] = {}
            for p in np.flatnonzero(kind == run).tolist():
                i = int(order[p])
                word = text[begin[i] : end[i]]
                if word not in seen:
                    fresh += 1
                    seen[word] = fresh
                kind[p] = seen[word]
    _, first, back, times = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
    twice = times > 1
    if known is not None:
        twice[back[known[order]]] = True
    many, lead = np.zeros(len(at), bool), np.zeros(len(at), bool)
    many[order] = twice[back]
    lead[order[first]] = True
    return many, lead


def spans(at: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (first words, sorted) of owners to merged word spans: index of the first window, first word, end."""
    if not len(at):
        return at, at, at
    cut = np.concatenate([[True], (at[1:] > at[:-1] + k) | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(cut)
    finish = np.concatenate([begin[1:], [len(at)]]) - 1
    return begin, at[begin], at[finish] + k


def _send(buckets: int, k: int, m: int):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for table in chunks(batches):
            data, offsets = buffers(table.column("text"))
            words = Words(data, offsets)
            if len(words) < k:
                continue
            buffer, starts, ends = normalised(words)
            text = buffer.tobytes()
            h = words.hashes()
            at = np.flatnonzero(words.text[: len(words) - k + 1] == words.text[k - 1 :])
            if not len(at):
                continue
            many, lead = repeated(text, starts, ends, long_runs(h, k)[at], at, k)
            marks = [table.column(c).combine_chunks() for c in ("mark", "mark2")]
            # What the chunk knows already.
            own = at[many]
            begin, first, last = spans(own, words.text[own], k)
            doc = words.text[first]
            base = words.firsts[doc]
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array((doc % buckets).astype(np.int32)), *(m.take(pa.array(doc)) for m in marks), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.nulls(len(doc), pa.binary())], schema=_ARROW)
            # Minimisers: of k - m + 1 hashes, by doubling.
            low, width, span = runs(h, m), 1, k - m + 1
            while 2 * width <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if span > width:
                low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
            go = at[lead]
            flag, least = many[lead], low[at][lead]
            cut = np.flatnonzero(np.concatenate([[True], (go[1:] != go[:-1] + 1) | (least[1:] != least[:-1]) | (flag[1:] != flag[:-1]) | (words.text[go[1:]] != words.text[go[:-1]])]))
            size = np.diff(np.concatenate([cut, [len(go)]]))
            head = go[cut]
            bucket = (mix(least[cut]) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            head, size, bucket, flag = head[order], size[order], bucket[order], flag[cut][order]
            doc = words.text[head]
            left, right = starts[head].tolist(), ends[head + size + k - 2].tolist()
            place = (head - words.firsts[doc]).astype(np.int32)
            mark, mark2 = (m.to_numpy()[doc] for m in marks)
            turn = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            rows = []
            for a, b in zip(turn[:-1].tolist(), turn[1:].tolist()):
                n = b - a
                fields = (np.int32(n), mark[a:b], mark2[a:b], place[a:b], size[a:b].astype(np.int32), flag[a:b])
                rows.append(pack.compress(b"".join(x.tobytes() for x in fields) + b"\n".join([text[i:j] for i, j in zip(left[a:b], right[a:b])])))
            for a in range(0, len(rows), 512):
                part = rows[a : a + 512]
                none, long = pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[turn[:-1]][a : a + 512]), long, long, none, none, pa.array(part, pa.binary())], schema=_ARROW)

    return run


_LINES = np.zeros(256, bool)
_LINES[[0x20, 0x0A]] = True


def _count(k: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for bucket, table in groups(batches, "bucket"):
            yield from table.filter(table.column("packed").is_null()).cast(_ARROW).to_batches()
            parts, texts = [], []
            for blob in table.column("packed").drop_null().to_pylist():
                raw = unpack.decompress(blob)
                n, at = int(np.frombuffer(raw, np.int32, 1)[0]), 4
                row = []
                for kind in (np.int64, np.int64, np.int32, np.int32, np.bool_):
                    row.append(np.frombuffer(raw, kind, n, at))
                    at += n * np.dtype(kind).itemsize
                parts.append(row)
                texts.append(raw[at:])
            if not parts:
                continue
            mark, mark2, place, size, flag = (np.concatenate(x) for x in zip(*parts))
            text = b"\n".join(texts)
            words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), _LINES)
            base = np.concatenate([[0], np.cumsum(size + k - 1)])[:-1]  # of each string, its first word
            run_of = np.repeat(np.arange(len(size)), size)
            at = base[run_of] + np.arange(len(run_of)) - np.repeat(np.cumsum(size) - size, size)
            many, _ = repeated(text, words.starts, words.ends, long_runs(words.hashes(), k)[at], at, k, flag[run_of])
            ask = np.flatnonzero(many & ~flag[run_of])
            begin, first, last = spans(at[ask], run_of[ask], k)
            if len(begin):
                r = run_of[ask][begin]
                move = place[r] - base[r]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), bucket, np.int32)), pa.array(mark[r]), pa.array(mark2[r]), pa.array((first + move).astype(np.int32)), pa.array((last + move).astype(np.int32)), pa.nulls(len(r), pa.binary())], schema=_ARROW)

    return run


def repeated_spans(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """docs: mark long, mark2 long, text string. Spans of words (first, last exclusive; they may overlap) of
    each document that repeated windows cover; the marks come along as given."""
    n = partitions(docs.sparkSession)
    sent = docs.select("mark", "mark2", "text").transform(in_arrow, _send(n * FINE, k, m), _ROW)
    there = sent.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")
    return there.transform(in_arrow, _count(k), _ROW).select("mark", "mark2", "first", "last")


def _remove(batches):
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        words = Words(data, offsets)
        base, finish = words.firsts[:-1], words.firsts[1:]
        spans_of = batch.column("spans")
        at = spans_of.offsets.to_numpy()
        flat = spans_of.values
        first, last = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        shift = np.repeat(base, np.diff(at))
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, first[at[0] : at[-1]] + shift, 1)
        np.add.at(step, last[at[0] : at[-1]] + shift, -1)
        gone = np.cumsum(step)[:-1] > 0
        raw, kept = data.tobytes(), []
        total = np.concatenate([[0], np.cumsum(gone)])
        starts, ends = words.starts.tolist(), words.ends.tolist()
        for a, b in zip(base.tolist(), finish.tolist()):
            stay = (np.flatnonzero(~gone[a:b]) + a).tolist()
            kept.append(b" ".join([raw[starts[i] : ends[i]] for i in stay]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(finish - base, pa.int64()), pa.array(total[finish] - total[base], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """One row per row of docs: (id, n_words, n_removed, kept_text).

    Words are maximal runs of bytes other than U+0020 and U+0009 to U+000D, unchanged. A word goes
    when a window of k words over it starts anywhere else too, in the same document or another, as
    the input stands; kept words are joined by one space. A null or empty text has no words; a text
    of fewer than k words loses none. Rows that repeat an id and a text are documents of their own:
    each is the other's repeat. Rows without an id count like any other. A very long text is a chunk of
    its own, read whole. Ties need no rule: a window is repeated or not. Empty tables give no rows;
    columns beside id and text, whatever their names, are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # 128 bits of id and text are a row's identity; rows that agree in both have equal spans.
    base = base.withColumns({"mark": F.xxhash64("text", "doc_id"), "mark2": F.xxhash64(F.lit(1), "text", "doc_id")})
    found = repeated_spans(base, k, m)
    by_doc = found.groupBy("mark", "mark2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = base.join(by_doc, ["mark", "mark2"], "left")
    none = F.array().cast("array<struct<first:int,last:int>>")
    out = joined.select("doc_id", "text", F.coalesce("spans", none).alias("spans")).transform(in_arrow, _remove, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("doc_id", id_col)
