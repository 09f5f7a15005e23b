"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. Each partition sends the sorted, distinct 64-bit hashes of its texts to the owners of the hash
   ranges, Golomb-Rice coded, with a bit for hashes that it holds more than once.
2. An owner marks the hashes that it got from two senders, or marked as repeated, and returns to
   each sender a bitmap over the list it had sent.
3. A sender's list under its bitmap gives the suspects. Their texts, and no others but those that
   share a slot of a fixed-size filter, are grouped by their bytes: that is the verification.

A text held by a third of all rows is one hash in each sender's list, and the grouping by bytes
combines it within each task before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, groups, in_arrow, key_filter, partitions, passing, stash, text_or_empty

#: A group of more than 1 / HOT of all rows is hot: there are fewer than HOT of them, so they are sent to
#: all tasks, and no task of the join of the others gets more than a HOT-th of all rows for one key.
HOT = 1000


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted uint64 values as gaps: (remainder bits, unary quotients, packed remainders)."""
    gaps = np.diff(values, prepend=U64(0))
    mean = float(values[-1]) / len(values) if len(values) else 1.0
    k = max(0, min(63, int(np.log2(max(mean, 1.0)))))
    quotient = (gaps >> U64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), bool)
    unary[np.cumsum(quotient + 1) - 1] = True
    rest = np.zeros((len(values), k), np.uint8)
    for j in range(k):
        rest[:, j] = (gaps >> U64(k - 1 - j)) & U64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotient = (np.diff(ones, prepend=-1) - 1).astype(U64)
    gaps = quotient << U64(k)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k)
    for j in range(k):
        gaps = gaps + (bits[:, j].astype(U64) << U64(k - 1 - j))
    return np.cumsum(gaps, dtype=U64)


_SENT = "owner int, sender long, n int, k int, unary binary, rest binary, repeated binary"


def _send(owners: int):
    def run(batches):
        held = [b.column(0).to_numpy(zero_copy_only=False).view(U64) for b in batches if b.num_rows]
        if not held:
            return
        values, times = np.unique(np.concatenate(held), return_counts=True)
        width = ((1 << 64) + owners - 1) // owners
        cuts = np.searchsorted(values, np.array([i * width for i in range(owners)], U64)).tolist() + [len(values)]
        rows = []
        for owner, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                coded = golomb_encode(values[a:b] - U64(owner * width))
                rows.append((owner, TaskContext.get().partitionId(), b - a, *coded, np.packbits(times[a:b] > 1).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["owner", "sender", "n", "k", "unary", "rest", "repeated"])

    return run


def _own(batches):
    """An owner's answer: for each list it got, the bitmap of the hashes held elsewhere too."""
    for owner, table in groups(batches, "owner"):
        lists = [golomb_decode(r["n"], r["k"], r["unary"], r["rest"]) for r in table.select(["n", "k", "unary", "rest"]).to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(v)].astype(bool) for x, v in zip(table.column("repeated").to_pylist(), lists)]
        values, back, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = times > 1
        twice[back[np.concatenate(flags)]] = True
        marks = np.split(twice[back], np.cumsum([len(v) for v in lists])[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([owner] * len(lists), pa.int32()), table.column("sender").combine_chunks(), pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())], names=["owner", "sender", "bitmap"])


def _suspects(owners: int):
    width = ((1 << 64) + owners - 1) // owners

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                marked = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8))[: r["n"]].astype(bool)
                found = golomb_decode(r["n"], r["k"], r["unary"], r["rest"])[marked] + U64(r["owner"] * width)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64), pa.int64())], names=["h"])

    return run


def suspect_hashes(hashes: DataFrame) -> DataFrame:
    """hashes: one column h (long). Returns the distinct values that occur more than once."""
    owners = partitions(hashes.sparkSession)
    sent = stash(hashes.transform(in_arrow, _send(owners), _SENT))
    answers = sent.repartitionById(owners, F.col("owner")).sortWithinPartitions("owner").transform(in_arrow, _own, "owner int, sender long, bitmap binary")
    joined = sent.join(answers.hint("shuffle_hash"), ["owner", "sender"])
    return joined.select("owner", "n", "k", "unary", "rest", "bitmap").transform(in_arrow, _suspects(owners), "h long").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the
    largest id stays; rows without an id come after all others. Rows that agree in id and text are
    one group whose rows are all marked alike, except that only one row per group can be kept:
    equal ids within a group are told apart by their order in the group's key, so exact repeats of
    the kept row are kept = true each (they carry the same id). A very long text is hashed and, if
    suspected, compared whole. Empty tables give no rows; columns beside id and text, whatever their
    names, are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    suspects = stash(suspect_hashes(base.select("h")))
    texts = passing(base.select("h", "text", "id"), "h", key_filter(suspects))
    # Texts meet by their bytes: the grouping key is the text itself, combined in each task first.
    equal = texts.groupBy("h", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    equal = stash(equal.select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    rows = base.select("id", "h", F.sha2("text", 256).alias("text_sha256"))
    hot = F.col("group_size") * HOT > base.count()
    few = equal.where(hot).select("h", "text_sha256", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    # Rows of hot groups go into the second join under a key of their own, which meets nothing.
    met = rows.join(F.broadcast(few), ["h", "text_sha256"], "left").withColumn("key", F.when(F.col("hot_size").isNull(), F.col("h")).otherwise(F.xxhash64("id", F.lit(1))))
    rest = equal.where(~hot).select(F.col("h").alias("key"), F.col("text_sha256").alias("of"), "keep_id", "group_size")
    out = met.join(rest, (met["key"] == rest["key"]) & (F.col("text_sha256") == F.col("of")) & F.col("hot_size").isNull(), "left")
    out = out.select("id", "text_sha256", F.coalesce("hot_id", "keep_id").alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), "text_sha256")
