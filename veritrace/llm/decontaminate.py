"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and case; numbers, units after a number, and names (capitalised
inside a sentence) become typed placeholders whose values are kept aside as slots. Windows of K
template words of the benchmark are joined to those of the documents by hash. An item is found in
a document when enough of its windows are in one occurrence, whose slots map to the document's by a
function: one value of the item never stands for two of the occurrence. So re-parameterised copies
count, and chance meetings of templates do not. Windows with the item's own slots always count, so
that no further text of a document clears it. Windows with few literal words say too little as
templates: they are joined by their raw words, operators between them included.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, Words, buffers, chunks, in_arrow, key_filter, mix, runs, stash, text_mark, text_or_empty

#: Words of a window; literal words that a window needs to stand as a template; share of an item's windows
#: that a document must hold.
K, LITERAL, COVERAGE = 8, 4, 0.5
#: Windows of the benchmark up to which their sorted hashes are sent to all tasks (8 bytes each);
#: beyond it, a filter of fixed size goes out instead. In both cases Spark joins what passes, and up to
#: an eighth of that number of windows it may broadcast them (some 100 bytes each).
SENT_WINDOWS = 1 << 20
#: Bytes of text that a task works on at once; parts into which the rows of one window are dealt.
CHUNK, SALTS = 1 << 20, 16
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches s sec min h hr hour hours day days week weeks year years km/h mph l ml % percent usd eur dollars euros cents degrees c f w kw kwh mb gb tb hz khz mhz ghz".split()
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "%"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NUMBER, NAME, UNIT = (mix(np.array([i], U64))[0] for i in (101, 102, 103))


def _hash_words(words: list[str]) -> np.ndarray:
    text = " ".join(words).encode()
    return Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hashes()


class Template:
    """The template words of many texts: canonical hashes, slot values (0: literal), text, firsts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        raw = Words(data, offsets)
        starts, ends = raw.starts.copy(), raw.ends.copy()
        for edge, step in ((starts, 1), (ends, -1)):
            live = np.arange(len(starts))
            while len(live):
                at = edge[live] if step > 0 else edge[live] - 1
                live = live[_PUNCTUATION[data[at]]]
                edge[live] += step
                live = live[starts[live] < ends[live]]
        lower = _LOWER[data]
        after = np.zeros(len(data), bool)  # second bytes of Latin capitals
        after[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lower = lower + (after * np.uint8(32))
        keep = np.flatnonzero(starts < ends)
        last = data[raw.ends - 1] if len(raw) else np.zeros(0, np.uint8)
        opens = np.ones(len(raw), bool)  # the first word of a text or sentence, or after a line break
        opens[1:] = _STOP[last[:-1]] | (raw.text[1:] != raw.text[:-1])
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        opens[1:] |= breaks[raw.starts[1:]] > breaks[raw.starts[:-1]]
        self.text, opens = raw.text[keep], opens[keep]
        words = object.__new__(Words)
        words.data, words.starts, words.ends = lower, starts[keep], ends[keep]
        h = words.hashes() if len(keep) else np.zeros(0, U64)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        number = digits[words.ends] > digits[words.starts]
        first = data[words.starts] if len(keep) else np.zeros(0, np.uint8)
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & after[np.minimum(words.starts + 1, max(0, len(data) - 1))])
        name = capital & ~opens & ~number
        unit = np.zeros(len(h), bool)
        unit[1:] = number[:-1] & np.isin(h[1:], _hash_words(UNITS)) & ~number[1:] & (self.text[1:] == self.text[:-1])
        name &= ~unit
        self.value = np.where(number | name | unit, h | U64(1), U64(0))
        self.h = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
        self.firsts = np.searchsorted(self.text, np.arange(len(offsets)))
        self.word, self.joined = h, h.copy()  # joined: with the marks (+, -, =) that stand before the word
        marks = np.flatnonzero(starts >= ends)
        if len(marks) and len(keep):
            lone = object.__new__(Words)
            lone.data, lone.starts, lone.ends = lower, raw.starts[marks], raw.ends[marks]
            before = np.searchsorted(keep, marks)
            own = before < len(keep)
            np.add.at(self.joined, before[own], mix(lone.hashes()[own] + (keep[np.minimum(before, len(keep) - 1)] - marks)[own].astype(U64)))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words and hashes of the windows of k words, and whether they are raw: windows with
        enough literal words are hashed as templates, the others by their words themselves."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)
        literal = np.concatenate([[0], np.cumsum(self.value == 0)])
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        raw = (literal[k:] - literal[:-k])[at] < min(LITERAL, k - k // 3)
        out = runs(self.h, k)[at] ^ U64(k)
        if raw.any():
            rest = runs(self.joined[1:], k - 1)[at[raw]] if k > 1 else np.zeros(int(raw.sum()), U64)
            out[raw] = mix(rest * U64(0x9E3779B97F4A7C15 | 1) + self.word[at[raw]]) ^ U64(1000 + k)
        return at, out, raw


def _item_windows(batches):
    """Windows of the benchmark; an item of fewer than K template words is one window."""
    for table in chunks(batches):
        t = Template(*buffers(table.column("text")))
        ids = table.column("item_id").to_pylist()
        size = np.diff(t.firsts)
        rows = []
        for k in [K, *sorted(set(size[(size > 0) & (size < K)].tolist()))]:
            at, h, raw = t.windows(k)
            own = (size[t.text[at]] >= K) if k == K else (size[t.text[at]] == k)
            for a, x, exactly in zip(at[own].tolist(), h[own].tolist(), raw[own].tolist()):
                rows.append((ids[t.text[a]], a - int(t.firsts[t.text[a]]), x - (1 << 64) if x >> 63 else x, k, exactly, t.value[a : a + k].view(np.int64).tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64())))], names=["item_id", "item_pos", "h", "k", "raw", "item_slots"])


def _find(lengths: list[int], passes):
    """Windows of documents that may be windows of the benchmark."""

    def run(batches):
        for table in chunks(batches, limit=CHUNK):
            t = Template(*buffers(table.column("text")))
            for k in lengths:
                at, h, _ = t.windows(k)
                own = passes(h)
                at, h = at[own], h[own]
                for a in range(0, len(at), 20_000):
                    part, x = at[a : a + 20_000], h[a : a + 20_000]
                    doc = pa.array(t.text[part])
                    slots = t.value[part[:, None] + np.arange(k)].view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * k), pa.array(slots.ravel()))
                    yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(doc), table.column("mark").combine_chunks().take(doc), pa.array(x.view(np.int64)), pa.array(part - t.firsts[t.text[part]], pa.int64()), lists], names=["doc_id", "mark", "h", "doc_pos", "doc_slots"])

    return run


def _occurrence(hits: list[dict], least: float) -> tuple[bool, bool]:
    """Whether some occurrence has at least that many item positions and steady slots, and whether
    one has the item's own slots. An occurrence is the hits of about one shift (document position
    less item position): first of one shift, then within 1, 2, 4 and so on of any, at last all."""
    if len({x["item_pos"] for x in hits}) < least:
        return False, False
    rows = sorted((x["doc_pos"] - x["item_pos"], x["item_pos"], [(a, b) for a, b in zip(x["item_slots"], x["doc_slots"]) if a or b]) for x in hits)
    shifts, found, radius = [r[0] for r in rows], False, 0
    while True:
        held, pairs, values = Counter(), Counter(), Counter()  # positions; pairs; document values of an item's value
        positions = unsteady = foreign = lo = hi = 0
        for anchor in shifts:
            while hi < len(rows) and shifts[hi] <= anchor + radius:
                held[rows[hi][1]] += 1
                positions += held[rows[hi][1]] == 1
                for pair in rows[hi][2]:
                    pairs[pair] += 1
                    if pairs[pair] == 1:
                        values[pair[0]] += 1
                        unsteady += values[pair[0]] == 2
                        foreign += pair[0] != pair[1]
                hi += 1
            while shifts[lo] < anchor - radius:
                held[rows[lo][1]] -= 1
                positions -= held[rows[lo][1]] == 0
                for pair in rows[lo][2]:
                    pairs[pair] -= 1
                    if pairs[pair] == 0:
                        values[pair[0]] -= 1
                        unsteady -= values[pair[0]] == 1
                        foreign -= pair[0] != pair[1]
                lo += 1
            if positions >= least and not unsteady:
                found = True
                if not foreign:
                    return True, True
        if radius > shifts[-1] - shifts[0]:
            return found, False
        radius = 2 * radius or 1


def _judge(coverage: float):
    """Of the hits of a document and an item: whether it is found, and with its own slots."""

    def run(batches):
        for batch in batches:
            rows = []
            for hits, of, of_template in zip(*(batch.column(n).to_pylist() for n in ("hits", "of", "of_template"))):
                own = {x["item_pos"] for x in hits if x["item_slots"] == x["doc_slots"]}
                template = [x for x in hits if not x["raw"]]  # raw windows have no copies with other values
                found, exact = _occurrence(template, coverage * of_template) if template else (False, False)
                share = len({x["item_pos"] for x in template}) / of_template if template else 0.0
                whole = len(own) >= coverage * of
                rows.append((found or whole, exact or whole and not template, max(share, len(own) / of)))
            found, exact, share = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), batch.column("item_id"), pa.array(share, pa.float64()), pa.array(found, pa.bool_()), pa.array(exact, pa.bool_())], names=["doc_id", "mark", "item_id", "coverage", "found", "exact"])

    return run


def _passes(known: DataFrame, n: int, sent: int):
    """A test, for tasks, of which hashes may be among the n of known."""
    spark = known.sparkSession
    if n <= sent:
        held = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in known.collect()], np.int64).view(U64)).tobytes())

        def passes(h):
            table = np.frombuffer(held.value, U64)
            return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(table) else np.zeros(len(h), bool)
    else:
        held = key_filter(known)  # built in tasks, of fixed size

        def passes(h):
            slot = mix(h) % U64(8 * common.FILTER_BYTES)
            return (np.frombuffer(held.value, np.uint8)[(slot >> U64(3)).astype(np.int64)] >> (7 - (slot & U64(7)).astype(np.uint8))) & 1 == 1

    return passes


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, sent: int = SENT_WINDOWS) -> DataFrame:
    """One row per document and benchmark item found in it: (id, item_id, coverage, exact, text_mark).

    coverage is the share of the item's windows that the document holds, exact whether an occurrence
    has the item's own values in all slots, text_mark the sha256 of the text (binary). Null and empty texts hold
    and are nothing; windows with few literal words (an item of numbers and names) must have the same
    words. A very long text is read whole: its windows stream, and only those that the benchmark has
    are kept. Repeated items of one id are one item, items of equal text are found alike, repeated
    documents give one result, and so do rows without an id per text. Texts that repeat an id are
    documents of their own. Empty tables give no rows; further columns, whatever their names, are
    ignored. A passage that very many documents hold makes rows per document and window only; they are
    dealt over SALTS parts per window, or meet a broadcast, and are grouped by document.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("mark", text_mark(F.col("text")))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_or_empty(item_text_col).alias("text"))
    windows = items.transform(in_arrow, _item_windows, "item_id long, item_pos int, h long, k int, raw boolean, item_slots array<long>")
    windows = stash(windows.dropDuplicates(["item_id", "item_pos", "h"]))
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # K at most
    known = windows.select("h").distinct()
    rows, n = windows.count(), known.count()
    found = base.transform(in_arrow, _find(lengths, _passes(known, n, sent)), "doc_id long, mark binary, h long, doc_pos long, doc_slots array<long>")
    side = windows.select("item_id", "item_pos", "h", "raw", "item_slots")
    if rows <= sent // 8:
        hits = found.join(F.broadcast(side), "h")
    else:
        dealt = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int")).join(dealt, ["h", "salt"])
    met = hits.groupBy("doc_id", "mark", "item_id").agg(F.collect_set(F.struct("doc_pos", "item_pos", "raw", "item_slots", "doc_slots")).alias("hits"))
    total = windows.groupBy("item_id").agg(F.countDistinct("item_pos").alias("of"), F.countDistinct(F.when(~F.col("raw"), F.col("item_pos"))).alias("of_template"))
    out = met.join(total, "item_id").select("doc_id", "mark", "item_id", "hits", "of", "of_template")
    out = out.transform(in_arrow, _judge(coverage), "doc_id long, mark binary, item_id long, coverage double, found boolean, exact boolean").where("found")
    return out.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "coverage", "exact", F.col("mark").alias("text_mark"))
