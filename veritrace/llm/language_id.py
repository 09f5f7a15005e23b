"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into segments; over each, a forward and a backward GRU give every position
its probabilities of the learned languages, and a document's probabilities are their mean over all
its positions. The network is trained in numpy by backpropagation through time, on the driver, from
a bounded sample of labelled rows; its few kilobytes of weights go to the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, chunks, in_arrow

#: Bytes of a segment, hidden units of a direction.
SEGMENT, HIDDEN = 128, 8
#: Labelled documents per language in the training sample, and segments taken of each.
SAMPLE_DOCS, SAMPLE_SEGMENTS = 1200, 2
#: Languages at most; rows that are drawn for each that is kept, since copies are drawn together; steps of a draw.
MOST_LABELS, DRAWN, _DRAW = 200, 2, 1 << 62
STEPS, BATCH, RATE = 260, 256, 0.02
#: Segments that inference works on at once.
WIDE = 1024


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): the squashing function of gates and candidates, several times as fast as tanh."""
    below = np.abs(x)
    below += 1
    return np.divide(x, below, out=below)


class Gru:
    """One direction. A gate is (1 + squash(x)) / 2; arrays are (positions, segments, hidden)."""

    def __init__(self, rng, hidden: int):
        self.h = hidden
        self.x = [(rng.standard_normal((256, hidden)) * 0.3).astype(np.float32) for _ in range(3)]
        self.u = [(rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32) for _ in range(3)]

    def forward(self, bytes_: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """bytes_: (positions, segments); mask: with a last axis of 1. Returns the states."""
        t, b = bytes_.shape
        index = bytes_.astype(np.intp)
        xz, xr, xn = (np.take(x, index, axis=0) for x in self.x)
        uz, ur, un = self.u
        out = np.empty((t, b, self.h), np.float32)
        state = np.zeros((b, self.h), np.float32)
        kept = []
        for i in range(t):
            z = state @ uz
            z += xz[i]
            z = squash(z)
            z += 1
            z *= 0.5
            r = state @ ur
            r += xr[i]
            r = squash(r)
            r += 1
            r *= 0.5
            a = state @ un
            n = r * a
            n += xn[i]
            n = squash(n)
            if keep:
                kept.append((state, z, r, a, n))
            now = np.subtract(state, n, out=out[i])
            now *= z
            now += n
            if mask is not None:
                now *= mask[i]
            state = now
        return (out, kept) if keep else out

    def backward(self, bytes_, mask, kept, grad):
        """grad: of the states. Returns the gradients of x and u, in their order."""
        h, (t, b) = self.h, bytes_.shape
        dx = [np.empty((t, b, h), np.float32) for _ in range(3)]
        du = [np.zeros_like(u) for u in self.u]
        uz, ur, un = self.u
        ds = np.zeros((b, h), np.float32)
        slope = lambda y: (1 - np.abs(y)) ** 2
        for i in range(t - 1, -1, -1):
            before, z, r, a, n = kept[i]
            ds = (ds + grad[i]) * mask[i]
            dn = ds * (1 - z) * slope(n)
            dz = ds * (before - n) * slope(2 * z - 1) * 0.5
            dr = dn * a * slope(2 * r - 1) * 0.5
            da = dn * r
            for k, d in enumerate((dz, dr, da)):
                du[k] += before.T @ d
            for k, d in enumerate((dz, dr, dn)):
                dx[k][i] = d
            ds = ds * z + dz @ uz.T + dr @ ur.T + da @ un.T
        flat = bytes_.ravel()
        sums = [np.stack([np.bincount(flat, d[..., j].ravel(), 256) for j in range(h)], 1) for d in dx]
        return [*sums, *du]


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.out = (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.x, *self.ahead.u, *self.back.x, *self.back.u, self.out, self.bias]

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def probabilities(self, bytes_: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """(languages, positions, segments). Each step looks its bytes up and works in place, so that what it
        touches stays in the processor's cache; only the logits of all positions are kept."""
        h, (t, b) = self.ahead.h, bytes_.shape
        logits = np.empty((t, b, len(self.languages)), np.float32)
        x, z, r, n, below = (np.empty((b, h), np.float32) for _ in range(5))
        share = np.empty(logits.shape[1:], np.float32)

        def squash_into(y):
            np.abs(y, out=below)
            np.add(below, 1, out=below)
            np.divide(y, below, out=y)

        for gru, out, steps in ((self.ahead, self.out[:h], range(t)), (self.back, self.out[h:], range(t - 1, -1, -1))):
            (xz, xr, xn), (uz, ur, un) = gru.x, gru.u
            state = np.zeros((b, h), np.float32)
            for i in steps:
                at = bytes_[i].astype(np.intp)
                for gate, table, u in ((z, xz, uz), (r, xr, ur)):
                    np.matmul(state, u, out=gate)
                    gate += np.take(table, at, axis=0, out=x, mode="clip")  # bytes are all in range
                    squash_into(gate)
                    gate += 1
                    gate *= 0.5
                np.matmul(state, un, out=n)
                n *= r
                n += np.take(xn, at, axis=0, out=x, mode="clip")
                squash_into(n)
                state -= n
                state *= z
                state += n
                if mask is not None:
                    state *= mask[i]
                if gru is self.ahead:
                    np.matmul(state, out, out=logits[i])
                else:
                    np.matmul(state, out, out=share)
                    logits[i] += share
        logits += self.bias
        p = np.ascontiguousarray(logits.reshape(t * b, -1).T)
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p.reshape(-1, t, b)

    def train(self, bytes_: np.ndarray, mask: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 2) -> None:
        """bytes_, mask: (segments, positions); labels: (segments,). Adam; the rate falls to 0."""
        rng = np.random.default_rng(seed)
        params = self.weights()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        h = self.ahead.h
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(bytes_), batch)
            x, m, y = np.ascontiguousarray(bytes_[pick].T), np.ascontiguousarray(mask[pick].T).astype(np.float32)[..., None], labels[pick]
            ahead, kept_a = self.ahead.forward(x, m, True)
            back, kept_b = self.back.forward(x[::-1], m[::-1], True)
            states = np.concatenate([ahead, back[::-1]], 2).reshape(-1, 2 * h)
            p = self._softmax(states @ self.out + self.bias).reshape(*x.shape, -1)
            p[:, np.arange(len(y)), y] -= 1
            p *= m / m.sum()
            flat = p.reshape(-1, p.shape[-1])
            grad = (flat @ self.out.T).reshape(*x.shape, 2 * h)
            grads = [*self.ahead.backward(x, m, kept_a, grad[..., :h]), *self.back.backward(x[::-1], m[::-1], kept_b, grad[::-1, :, h:]), states.T @ flat, flat.sum(0)]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - (step - 1) / steps)
            for w, g, a, b in zip(params, grads, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each segment begins, its length, and its text."""
    size = np.diff(offsets)
    count = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), count)
    index = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][text] + index * SEGMENT
    return begin, np.minimum(SEGMENT, offsets[1:][text] - begin), text


def pooled(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over all positions of each text: (texts, languages); empty texts: zeros."""
    total = np.zeros((len(offsets) - 1, len(network.languages)))
    begin, length, text = segments(data, offsets)
    padded = np.concatenate([data, np.zeros(SEGMENT, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, SEGMENT)
    for full in (True, False):
        own = np.flatnonzero((length == SEGMENT) == full)
        if not full:
            own = own[np.argsort(length[own], kind="stable")]  # so that a batch is as long as need be
        for a in range(0, len(own), WIDE):
            pick = own[a : a + WIDE]
            longest = int(length[pick].max())
            x = np.ascontiguousarray(view[begin[pick], :longest].T)
            mask = None if full else (np.arange(longest)[:, None] < length[pick]).astype(np.float32)[..., None]
            p = network.probabilities(x, mask)
            np.add.at(total, text[pick], (p if full else p * mask[..., 0]).sum(1).T)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def fit(docs: DataFrame, text: Column, label: Column, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Trains on sample_docs different texts per label at most, chosen by a hash of them, of those with a
    label and a letter; None if there are none. Labels are the MOST_LABELS most frequent (of equals the
    first by name). Texts are sampled anywhere, not at their beginning. So what reaches the driver is bounded,
    whatever repeats in the table: a text drawn is drawn with its copies, which then count once."""
    rows = docs.select(text.alias("text"), label.alias("label")).where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LABELS).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    drawn = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(_DRAW))
    few = rows.where(drawn <= F.try_element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, DRAWN * sample_docs / n) * _DRAW))]), F.col("label"))).distinct()
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text", F.lit(3)), "text"))).where(F.col("place") <= sample_docs)
    span = F.greatest(F.length("text") - SEGMENT, F.lit(0)) + 1
    parts = F.array(*[F.substr("text", (F.pmod(F.xxhash64("text", F.lit(10 + i)), span) + 1).cast("int"), F.lit(SEGMENT)) for i in range(SAMPLE_SEGMENTS)])
    got = sorted((r["label"], p.encode()[:SEGMENT]) for r in few.select("label", parts.alias("parts")).collect() for p in r["parts"])
    x = np.zeros((len(got), SEGMENT), np.uint8)
    mask = np.zeros((len(got), SEGMENT), bool)
    for i, (_, b) in enumerate(got):
        x[i, : len(b)], mask[i, : len(b)] = np.frombuffer(b, np.uint8), True
    network = Network(languages)
    if len(languages) > 1:
        network.train(x, mask, np.array([languages.index(k) for k, _ in got]))
    return network


def _label(network: Network | None, inside: str | None):
    """inside: the text's field of the carried row, which then has no column of its own."""

    def texts(batch):
        return batch.append_column("text", batch.column("row").field(inside)) if inside else batch

    def run(batches):
        names = np.array([*(network.languages if network else []), "und"], object)
        for table in chunks(map(texts, batches)):
            data, offsets = buffers(table.column("text"))
            clear = table.column("letters").to_numpy().astype(bool)
            if network:
                p = pooled(network, data, offsets)
                best = p.argmax(1)
                score = np.clip(p[np.arange(len(p)), best], 0.0, 1.0)
            else:
                clear &= False
                best, score = np.zeros(len(clear), int), np.zeros(len(clear))
            best = np.where(clear, best, len(names) - 1)
            kept = [x for x in table.column_names if x not in ("letters", "text")]
            out = [table.column(x) for x in kept]
            fields = [*out, pa.chunked_array([pa.array(names[best], pa.string())]), pa.chunked_array([pa.array(np.where(clear, score, 0.0))])]
            yield from pa.Table.from_arrays(fields, names=[*kept, "lang_pred", "score"]).to_batches()

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are not learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", network: Network | None = None, carry: bool = False) -> DataFrame:
    """One row per row of docs: (id, held_out, lang_pred, score), and with carry the row itself as a struct.

    Learned from text and lang of rows that are not held out and have both; only the text decides a
    prediction. A text that is null, empty or without a letter is `und` with score 0, and so are all
    texts if nothing can be learned. Every byte of a text is labelled. Repeated rows get equal
    answers; a row without an id counts as the empty id; empty tables give no rows; further columns
    are ignored. Of equal probabilities the first language by name wins.
    """
    if network is None:
        network = fit(docs.where(~held_out(id_col)), F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    text = F.col(text_col).cast("string")
    own = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
    inside = text_col if carry and isinstance(docs.schema[text_col].dataType, T.StringType) else None
    body = [] if inside else [F.coalesce(text, F.lit("")).alias("text")]
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), *own).schema.fields
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), *own, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), *body)
    schema = T.StructType([*out, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.transform(in_arrow, _label(network, inside), schema).withColumnRenamed("doc_id", id_col)
