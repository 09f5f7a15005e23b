"""Which texts stand in a source of many pages, by winnowed anchors.

Of every run of hashes of k characters, the least is an anchor. A text that is long enough has a whole run, so
wherever it stands in the source, the source has its anchors too: a tenth of its places, not all. Each text asks
for its rarest anchor only, and is compared where that stands. The source's pages are joined by a space and
dealt into blocks of equal length that overlap by a run: so texts over any number of pages are found, and
no task holds the whole source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from .ordering import scanned, summing

#: Characters of a block, and how far one reaches into the next: the longest run.
BLOCK, OVERLAP = 8192, 32
#: (least length of a text, characters that are hashed, hashes of a run); shorter texts are hashed whole.
TIERS = [(32, 16, 17), (8, 4, 5)]
SHORT = 8
#: Pages that one task may hold to number their places.
FEW_PAGES = 1000

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hashes(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(x) - k + 1), np.uint64)
    for j in range(k):
        out = out * _PRIME + x[j : j + len(out)]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def anchors(text: str, k: int, run: int, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors, each once. starts: only runs that begin before that place."""
    h = _hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), k)
    n = len(h) - run + 1 if starts is None else min(len(h) - run + 1, starts)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(h, run)[:n]
    at = np.unique(view.argmin(1) + np.arange(n))
    return at, h[at]


def _kind(length: int) -> tuple[int, int]:
    return next(((k, run) for least, k, run in TIERS if length >= least), (length, 1))


_ROW = pa.schema([("id", pa.int64()), ("k", pa.int32()), ("at", pa.int64()), ("h", pa.int64())])


def _rows(ids, kinds, found):
    for i, (k, _), (at, h) in zip(ids, kinds, found):
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(h.view(np.int64))], schema=_ROW)


def _of_texts(batches):
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("n").to_pylist()
        kinds = [_kind(len(t)) for t in texts]
        yield from _rows(ids, kinds, (anchors(t, *kind) for t, kind in zip(texts, kinds)))


#: Bits of the set of hashes asked for that goes to all tasks: a fixed size, whatever the number of texts.
FILTER_BITS = 1 << 22


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(17)) % np.uint64(FILTER_BITS)


def _asked_filter(asked: DataFrame):
    """A broadcast of FILTER_BITS: which slots hold a hash that some text asks for."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_slots(batch.column(0).to_numpy().view(np.uint64))] = True
        for i in np.unique(np.flatnonzero(bits) >> 19).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(bits[i << 19 : (i + 1) << 19]).tobytes()], pa.binary())], names=["i", "bits"])

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in asked.select("h").distinct().mapInArrow(run, "i int, bits binary").toLocalIterator():
        bits[r.i << 16 : (r.i + 1) << 16] |= np.frombuffer(r.bits, np.uint8)
    return asked.sparkSession.sparkContext.broadcast(bits.tobytes())


def _of_blocks(kinds: list[tuple[int, int]], held):
    def run(batches):
        wanted = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            for i, t in zip(batch.column("block").to_pylist(), batch.column("s").to_pylist()):
                for kind in kinds:
                    at, h = anchors(t, *kind, starts=BLOCK)
                    if kind[1] == 1:  # the text is its hash's characters: one place of each is enough
                        h, first = np.unique(h, return_index=True)
                        at = at[first]
                    own = wanted[_slots(h)]
                    at, h = at[own], h[own]
                    yield from _rows([i], [kind], [(at + i * BLOCK, h)])

    return run


def blocks(pages: DataFrame, text: str, order: list[str]) -> DataFrame:
    """(block, s): the pages' texts in order, joined by a space, without empty ones; s reaches into the next block."""
    # Settled first: each pass below, and each filter, would work the texts out again.
    rows = settled(pages.select(*order, text)).where(F.col(text) != "").withColumns({"_all": F.lit(0), "_size": (F.length(text) + 1).cast("long")})
    # Texts come along, so that few of them are one task's: the rest goes by ranges.
    placed = scanned(rows, summing(F.col("_size")), ["_all"], order, "_end", hot_rows=FEW_PAGES).withColumn("_start", F.col("_end") - F.col("_size"))
    first = F.greatest(F.floor((F.col("_start") - OVERLAP) / BLOCK), F.lit(0))
    met = placed.select("_start", "_end", F.concat(text, F.lit(" ")).alias("t"), F.explode(F.sequence(first, F.floor((F.col("_end") - 1) / BLOCK))).alias("block"))
    begin = F.greatest(F.col("_start"), F.col("block") * BLOCK)
    piece = F.substr("t", (begin - F.col("_start") + 1).cast("int"), (F.least(F.col("_end"), F.col("block") * BLOCK + BLOCK + OVERLAP) - begin).cast("int"))
    met = met.select("block", begin.alias("at"), piece.alias("s")).where("s <> ''")
    return met.groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), "").alias("s"))


def contained(pages: DataFrame, texts: DataFrame, text: str = "t", order: list[str] | None = None, wanted: str = "n") -> DataFrame:
    """The different texts of `wanted` that stand in the pages' texts as joined by a space, over any number of
    pages: (n). Empty texts and nulls stand nowhere."""
    need = settled(texts.select(F.col(wanted).alias("n")).where("n <> ''").distinct().withColumn("id", F.monotonically_increasing_id()))
    lengths = need.select(F.when(F.length("n") < SHORT, F.length("n")).otherwise(F.when(F.length("n") < TIERS[0][0], SHORT).otherwise(TIERS[0][0])).alias("l")).distinct()
    kinds = sorted({_kind(r.l) for r in lengths.collect()})  # nine at most
    source = settled(blocks(pages, text, order or ["page"]))
    asked = settled(need.mapInArrow(_of_texts, "id long, k int, at long, h long").withColumnRenamed("at", "within"))
    # Of the source's anchors only those that a text may ask for leave their task; the joins below are exact.
    there = settled(source.mapInArrow(_of_blocks(kinds, _asked_filter(asked)), "id long, k int, at long, h long").drop("id"))
    often = there.groupBy("k", "h").agg(F.count("*").alias("n"))
    # The rarest anchor of each text; one that the source lacks shows that the text is not there.
    rarest = asked.join(often, ["k", "h"], "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "h", "within")).alias("a")).where("a.n > 0").select("id", "a.k", "a.h", "a.within")
    met = rarest.join(there, ["k", "h"]).select("id", (F.col("at") - F.col("within")).alias("start")).where("start >= 0").distinct().join(need, "id")
    last = F.floor((F.col("start") + F.length("n") - 1) / BLOCK)
    parts = met.select("id", "start", "n", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), last)).alias("block"), (last - F.floor(F.col("start") / BLOCK) + 1).alias("of"))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    size = (F.least(F.col("start") + F.length("n"), (F.col("block") + 1) * BLOCK) - begin).cast("int")
    equal = F.substr("n", (begin - F.col("start") + 1).cast("int"), size) == F.substr("s", (begin - F.col("block") * BLOCK + 1).cast("int"), size)
    right = parts.join(source, "block").where(equal).groupBy("id", "start").agg(F.count("*").alias("k"), F.first("of").alias("of")).where("k = of")
    return need.join(right.select("id").distinct(), "id", "left_semi").select(F.col("n").alias(wanted))
