"""N-gram Jaccard join: a size-aware heavy-light join with exact verification.

The sets are the distinct shingles of each text, under one global order that puts shingles last
which many documents have. Two sets of similarity t share at least t times the size of either.

* Light: of a small set, all 2-subsets of a prefix two shingles longer than what may be missing.
* Heavy: of a large set, each shingle of a prefix one longer; such lists are scanned.
* The boundary is the largest size at which the subsets cost no more than the scans; sets up to
  1/t of it post both, so that a small and a large set meet in the subsets.

Every pair of similar sets meets in some list. A first round checks each list's members against one
of them, the set that meets most others in all its lists (of a group of near copies, the one most
like the rest); in a second, members of lists still apart meet a few others. This joins most groups.
The lists whose members then still lie in two components are scanned for all pairs across components that sizes and positions allow. Pairs inside a
component are never made. Equal sets are one representative throughout.

A list that its shingle's count announces as long is dealt over parts, by the numbers of its sets: its
members lie in several buckets, meet their hub by a salted join, and are scanned in blocks, each
block of the list's largest component against each block of the others. So no task holds a list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, buffers, chunks, groups, grouped_join, in_arrow, key_filter, mix, partitions, passing, runs, stash, text_mark, text_or_empty, whole_groups
from .components import components
from .substring_dedup import normalised

#: Words of a shingle; similarity as a fraction.
SHINGLE, NUM, DEN = 5, 75, 100
#: Cells of the table of document counts (a byte each when sent out), in 16 segments.
CELLS = 1 << 22
FINE = 8
POSTINGS = 1 << 18
#: Bytes of text, and documents, that a task works on at once.
CHUNK, DOCS = 1 << 20, 250
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, Words]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    words = Words(data, offsets)
    h, size = words.hashes(), np.diff(words.firsts)
    at = np.flatnonzero(words.text[: max(0, len(h) - n + 1)] == words.text[n - 1 :]) if len(h) >= n else np.zeros(0, np.int64)
    found, text = runs(h, n)[at], words.text[at]
    for k in sorted(set(size[(size > 0) & (size < n)].tolist())):  # the whole sequence of a short text
        first = words.firsts[:-1][size == k]
        found = np.concatenate([found, mix(runs(h, k)[first] + U64(k))])
        text = np.concatenate([text, words.text[first]])
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    found, text = found[new], text[new]
    return found, np.searchsorted(text, np.arange(len(offsets))), words


_SETS = "uid long, doc_id long, mark binary, size int, one long, two long, words binary, segment int, counts binary"
_SETS_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.binary()), ("size", pa.int32()), ("one", pa.int64()), ("two", pa.int64()), ("words", pa.binary()), ("segment", pa.int32()), ("counts", pa.binary())])


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> U64(20)) % U64(CELLS)


def _sets(batches):
    """Size, 128-bit fingerprint and compressed words of each text; words only for the first of
    equal sets in a task. At the end, in how many of those sets each cell's shingles occur."""
    pack = zstandard.ZstdCompressor(level=3)
    counts = np.zeros(CELLS, np.uint32)
    met: set[tuple[int, int]] = set()
    some = False
    for table in chunks(batches, limit=CHUNK):
        data, offsets = buffers(table.column("text"))
        h, first, words = shingle_sets(_LOWER[data], offsets)
        buffer, starts, ends = normalised(words)
        text = buffer.tobytes()
        total = [np.concatenate([[U64(0)], np.cumsum(mix(h * U64(c)))]) for c in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)]
        one, two = ((t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total)
        size = np.diff(first)
        kept, lead = [], np.zeros(len(size), bool)
        for i, key in enumerate(zip(one.tolist(), two.tolist())):
            if size[i] and key not in met:
                met.add(key)
                lead[i] = some = True
                a, b = words.firsts[i], words.firsts[i + 1] - 1
                kept.append(pack.compress(text[starts[a] : ends[b]]))
            else:
                kept.append(None)
        np.add.at(counts, _cell(h[np.repeat(lead, size)]).astype(np.int64), 1)
        none = len(size)
        fields = [table.column("uid").combine_chunks(), table.column("doc_id").combine_chunks(), table.column("mark").combine_chunks(), pa.array(size, pa.int32()), pa.array(one), pa.array(two), pa.array(kept, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())]
        yield pa.RecordBatch.from_arrays(fields, schema=_SETS_ARROW)
    for segment in range(16) if some else []:
        part = pack.compress(counts[segment * (CELLS // 16) : (segment + 1) * (CELLS // 16)].tobytes())
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), *[pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())], pa.array([segment], pa.int32()), pa.array([part], pa.binary())], schema=_SETS_ARROW)


def _sum_counts(batches):
    pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for key, table in groups(batches, "key"):
        total = np.zeros(CELLS // 16, np.uint32)
        for blob in table.column("counts").to_pylist():
            total += np.frombuffer(unpack.decompress(blob), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([pack.compress(total.tobytes())], pa.binary())], names=["key", "counts"])


def _ranks(sets: DataFrame) -> tuple[np.ndarray, float]:
    """Of each cell, the whole binary logarithm of its count; and the mean list length of the rarer half."""
    n = partitions(sets.sparkSession)
    rows = sets.where("segment is not null").select((F.col("segment") * 64 + F.pmod("uid", F.lit(64))).cast("int").alias("key"), "counts")
    rows = rows.repartition(n, "key").sortWithinPartitions("key").transform(in_arrow, _sum_counts, "key int, counts binary")
    rows = rows.select((F.col("key") / 64).cast("int").alias("key"), "counts").repartition(n, "key").sortWithinPartitions("key").transform(in_arrow, _sum_counts, "key int, counts binary")
    counts = np.zeros(CELLS, np.uint32)
    for r in rows.toLocalIterator():
        counts[r["key"] * (CELLS // 16) : (r["key"] + 1) * (CELLS // 16)] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.uint32)
    ranks = np.log2(np.maximum(counts, 1)).astype(np.uint8)
    rare = counts[(ranks <= np.median(ranks)) & (counts > 0)].astype(float)
    length = float((rare * rare).sum() / rare.sum() - rare.mean()) if len(rare) else 1.0
    return ranks, max(1.0, length)


def _missing(size):
    """How many shingles a set may lack in common with a similar one."""
    return size - (NUM * size + DEN - 1) // DEN


def boundary(length: float) -> int:
    """The largest size whose subsets cost no more than scanning its lists of the given length."""
    size = 2
    while (_missing(size + 1) + 2) * (_missing(size + 1) + 1) / 2 <= (_missing(size + 1) + 1) * (1 + length):
        size += 1
    return size


_LIST = "sig long, uid long, size int, pos int, length long, parts int"
_LIST_ARROW = pa.schema([("sig", pa.int64()), ("uid", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("length", pa.int64()), ("parts", pa.int32())])
#: Members of a list, by its shingle's count, from which on it is dealt over parts of about that size
#: (binary logarithm); and the most parts.
SPLIT, MOST_PARTS = 9, 15
#: Partners that each member of a list meets before all pairs across components are scanned.
FEW = 12


def _parts(rank: np.ndarray, split: int) -> np.ndarray:
    """Binary logarithm of a list's parts, from that of its shingle's count."""
    return np.clip(rank.astype(np.int64) - split, 0, MOST_PARTS)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte plane, so that planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplane(raw: bytes, dtype, n: int, at: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(dtype).ravel()


def _post(buckets: int, ranks, limit: int, split: int):
    """Signatures of each set, packed by bucket. A list of several parts lies in as many buckets, one
    after the other, by its members' numbers."""

    def run(batches):
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        rank = np.frombuffer(ranks.value, np.uint8)
        held: list[list[np.ndarray]] = []

        def flush():
            sig, uid, size, pos, wide = (np.concatenate(x) for x in zip(*held))
            held.clear()
            part = (mix(uid.view(U64)) & ((U64(1) << wide.astype(U64)) - U64(1))).astype(np.int64)
            bucket = ((sig % U64(buckets)).astype(np.int64) + part) % buckets
            code = (wide << 16 | part).astype(np.int32)
            order = np.lexsort((uid, bucket))
            sig, uid, size, pos, bucket, code = (sig[order] >> U64(32)).astype(np.uint32), uid[order], size[order], pos[order], bucket[order], code[order]
            cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            blobs = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                who, first, index = np.unique(uid[a:b], return_index=True, return_inverse=True)
                head = np.array([b - a, len(who)], np.int32).tobytes()
                body = (np.diff(who, prepend=0), size[a:b][first], np.diff(index, prepend=0).astype(np.int32), pos[a:b].astype(np.int32), code[a:b])
                blobs.append(pack.compress(head + sig[a:b].tobytes() + b"".join(map(_planes, body))))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        total = 0
        for batch in batches:
            for a in range(0, batch.num_rows, DOCS):
                part = batch.slice(a, DOCS)
                texts = [unpack.decompress(x) for x in part.column("words").to_pylist()]
                uids = part.column("uid").to_numpy()
                h, first, _ = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
                size = np.diff(first)
                text = np.repeat(np.arange(len(size)), size)
                seen = rank[_cell(h).astype(np.int64)]
                order = np.lexsort((h, seen, text))
                h, wide = h[order], _parts(seen[order], split)
                place = np.arange(len(h)) - first[text]
                own = (place <= _missing(size)[text]) & (size[text] > limit)
                if own.any():
                    held.append([mix(h[own]), uids[text[own]], size[text[own]].astype(np.int32), place[own], wide[own]])
                    total += int(own.sum())
                for i in np.flatnonzero((size > 1) & (size <= limit * DEN // NUM)).tolist():
                    n = int(_missing(size[i])) + 2
                    x, y = np.triu_indices(n, 1)
                    p, w = h[first[i] : first[i] + n], wide[first[i] : first[i] + n]
                    held.append([mix(p[x] * U64(3) + p[y]), np.full(len(x), uids[i]), np.full(len(x), size[i], np.int32), np.full(len(x), -1), w[x]])
                    total += len(x)
                if total >= POSTINGS:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return run


def _lists(buckets: int):
    """The lists with two members or more, and all members of lists in several parts. length: of the
    list, estimated from the part if there are several."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for bucket, table in groups(batches, "bucket"):
            rows = []
            for blob in table.column("blob").to_pylist():
                raw = unpack.decompress(blob)
                n, m = np.frombuffer(raw, np.int32, 2).tolist()
                at = 8 + 4 * n
                who, size = np.cumsum(_unplane(raw, np.int64, m, at)), _unplane(raw, np.int32, m, at + 8 * m)
                at += 12 * m
                index, pos, code = np.cumsum(_unplane(raw, np.int32, n, at)), _unplane(raw, np.int32, n, at + 4 * n), _unplane(raw, np.int32, n, at + 8 * n)
                rows.append((np.frombuffer(raw, np.uint32, n, 8), who[index], size[index], pos, code))
            sig, uid, size, pos, code = (np.concatenate(x) for x in zip(*rows))
            key = sig.astype(np.int64) << 20 | (int(bucket) - (code & 0xFFFF)) % buckets
            order = np.lexsort((uid, size, key))
            key, uid, size, pos, code = key[order], uid[order], size[order], pos[order], code[order]
            new = np.ones(len(key), bool)  # a set that two shingles of one bucket bring to one list counts once
            new[1:] = (key[1:] != key[:-1]) | (uid[1:] != uid[:-1])
            key, uid, size, pos, wide = key[new], uid[new], size[new], pos[new], (code >> 16)[new]
            near = np.flatnonzero(key[1:] == key[:-1])
            many = wide > 0
            many[near] = many[near + 1] = True
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.repeat(np.diff(np.append(begin, len(key))), np.diff(np.append(begin, len(key)))) << wide
            for a in range(0, int(many.sum()), 100_000):
                own = np.flatnonzero(many)[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(uid[own]), pa.array(size[own]), pa.array(pos[own], pa.int32()), pa.array(length[own], pa.int64()), pa.array((1 << wide[own]).astype(np.int32))], schema=_LIST_ARROW)

    return run


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])


def _possible(size_x: np.ndarray, pos_x: np.ndarray, size_y: np.ndarray, pos_y: np.ndarray) -> np.ndarray:
    """Which pairs of a list's members may be met here, by sizes and places (below 0: a subset's list).

    Similar sets share `least` at least, so one within the first size - least + 1 of both: in that
    one's list, if not in this, they are met. Of a shared one, what lies before and after in both
    bounds what they share."""
    least = -(-NUM * (size_x + size_y) // (NUM + DEN))
    most = np.minimum(pos_x, pos_y) + np.minimum(size_x - pos_x, size_y - pos_y)
    return (pos_x < 0) | ((pos_x <= size_x - least) & (pos_y <= size_y - least) & (most >= least))


def _star(batches):
    """Of each list, the member that meets most others in all its lists, paired with the rest."""
    for table in whole_groups(batches, "sig"):
        sig, uid, size, pos, met = (table.column(c).to_numpy() for c in ("sig", "uid", "size", "pos", "met"))
        order = np.lexsort((uid, -met, sig))
        sig, uid, size, pos = sig[order], uid[order], size[order].astype(np.int64), pos[order].astype(np.int64)
        head = np.concatenate([[True], sig[1:] != sig[:-1]])
        hub = np.flatnonzero(head)[np.cumsum(head) - 1]
        own = ~head & (np.minimum(size, size[hub]) * DEN >= np.maximum(size, size[hub]) * NUM) & _possible(size, pos, size[hub], pos[hub])
        if own.any():
            yield _pairs(uid[own], uid[hub][own])


def _wide_stars(rows: DataFrame) -> DataFrame:
    """As _star, for lists in several parts: the hub is an aggregate, and meets each part by a join."""
    hub = rows.groupBy("sig").agg(F.max_by(F.struct("uid", "size", "pos"), F.struct("met", -F.col("uid"))).alias("hub"), F.max("parts").alias("n"))
    hub = hub.select("sig", "hub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
    both = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).join(hub, ["sig", "salt"])
    x, y = (lambda c: F.col(c)), (lambda c: F.col(f"hub.{c}"))
    least = -F.floor(-NUM * (x("size") + y("size")) / (NUM + DEN))
    most = F.least(x("pos"), y("pos")) + F.least(x("size") - x("pos"), y("size") - y("pos"))
    possible = (x("pos") < 0) | ((x("pos") <= x("size") - least) & (y("pos") <= y("size") - least) & (most >= least))
    fits = F.least(x("size"), y("size")) * DEN >= F.greatest(x("size"), y("size")) * NUM
    return both.where((x("uid") != y("uid")) & fits & possible).select(F.least(x("uid"), y("uid")).alias("x"), F.greatest(x("uid"), y("uid")).alias("y"))


def _blocks(members: DataFrame, split: int) -> DataFrame:
    """Members of lists in several parts whose sets lie in several components, once for each pair of
    blocks in which they meet others: blocks of the list's largest component (side 0) with blocks of
    the others (side 1), and the others' blocks among themselves (side 2: within one block)."""
    sizes = members.groupBy("sig", "component").agg(F.count("*").alias("n"), F.max("parts").alias("parts"))
    of = sizes.groupBy("sig").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"), F.max("parts").alias("p"), F.count("*").alias("met")).where("met > 1")
    of = of.select("sig", F.col("top.component").alias("top"), F.ceil((F.col("total") - F.col("top.n")) / (1 << split)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("salt"))
    rows = members.withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).join(of, ["sig", "salt"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("q")).cast("int"))
    cell = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    own = F.col("own")
    inner = each("q", lambda k: cell(-1 - F.least(own, k), F.greatest(own, k), F.when(own == k, 2).when(own < k, 0).otherwise(1)))
    where = F.when(F.col("component") == F.col("top"), each("q", lambda k: cell(F.col("salt"), k, F.lit(0)))).otherwise(F.concat(each("parts", lambda k: cell(k, own, F.lit(1))), inner))
    return rows.select("sig", "uid", "size", "pos", "component", F.explode(where).alias("w")).select(F.xxhash64("sig", "w.a", "w.b").alias("sig"), "uid", "size", "pos", "component", "w.side")


def _cross(steps: int | None = None):
    """Pairs of a list (or of two of its blocks) across components that sizes and places allow. With steps,
    each member meets only so many others, which its number's hash chooses."""

    def run(batches):
        for table in whole_groups(batches, "sig"):
            sig, uid, size, pos, comp, side = (table.column(c).to_numpy() for c in ("sig", "uid", "size", "pos", "component", "side"))
            order = np.lexsort((uid, size, sig)) if steps is None else np.lexsort((mix(uid.view(U64)), sig))
            sig, uid, size, pos, comp, side = sig[order], uid[order], size[order].astype(np.int64), pos[order].astype(np.int64), comp[order], side[order]
            i, step = np.arange(len(sig)), 0
            while len(i) and step != steps:  # each member against the one `step` places on, as long as sizes allow
                step += 1
                i = i[: np.searchsorted(i, len(sig) - step)]
                fits = np.minimum(size[i], size[i + step]) * DEN >= np.maximum(size[i], size[i + step]) * NUM
                i, near = (i[(sig[i] == sig[i + step]) & fits], None) if steps is None else (i[sig[i] == sig[i + step]], fits[sig[i] == sig[i + step]])
                x = i if near is None else i[near]
                x = x[(comp[x] != comp[x + step]) & ((side[x] == 2) | (side[x] != side[x + step]))]
                y = x + step
                ok = _possible(size[x], pos[x], size[y], pos[y])
                if ok.any():
                    yield _pairs(uid[x[ok]], uid[y[ok]])

    return run


def _verify(batches):
    """Pairs with the words of both: those that are similar. Rows come sorted by y."""
    unpack = zstandard.ZstdDecompressor()
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        for a in range(0, batch.num_rows, 400):
            part = batch.slice(a, 400)
            x, y = part.column("x").to_numpy(), part.column("y").to_numpy()
            fresh = {}
            for ids, blobs in ((x, part.column("words_x")), (y, part.column("words_y"))):
                for i, k in enumerate(ids.tolist()):
                    if k not in known and k not in fresh:
                        fresh[k] = unpack.decompress(blobs[i].as_py())
            need = set(x.tolist()) | set(y.tolist())
            known = {k: v for k, v in known.items() if k in need}
            if fresh:
                texts = list(fresh.values())
                h, first, _ = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
                known.update((k, h[p:q]) for k, p, q in zip(fresh, first[:-1].tolist(), first[1:].tolist()))
            linked = []
            for i, j in zip(x.tolist(), y.tolist()):
                p, q = known[i], known[j]
                both = len(p) + len(q) - len(np.union1d(p, q))
                linked.append(DEN * both >= NUM * (len(p) + len(q) - both))
            ok = np.array(linked, bool)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], names=["u", "v"])


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: (x, y), distinct; texts: (uid, words). The pairs that are similar, as (u, v)."""
    ids = pairs.select(F.col("x").alias("uid")).union(pairs.select("y")).distinct()
    own = passing(texts, "uid", key_filter(ids))
    left = pairs.join(own.select(F.col("uid").alias("x"), F.col("words").alias("words_x")), "x")
    return left.join(own.select(F.col("uid").alias("y"), F.col("words").alias("words_y")), "y").select("x", "y", "words_x", "words_y").transform(in_arrow, _verify, "u long, v long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: bool = False, split_at: int = SPLIT) -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id); with marks also text_mark (the sha256
    of the text, binary), class (a number of the component) and group_size (its rows; 1 without a shingle).

    Texts are lower-cased in A-Z; two documents link when their sets of distinct 5-word shingles
    have a Jaccard similarity of 0.75 or more, compared in integers; a text of one to four words is
    one shingle. component_id is the smallest id that links reach. Null, empty and blank texts have
    no shingle and link with nothing: their component is their own id. Rows that agree in id and
    text link like any equal texts; rows without an id link like others but give no component id. A very long
    text is one set, whole; it and its words are held by one task at a time. Ties need no rule: links
    have no direction. Empty tables give no rows; further columns, whatever their names, are ignored.
    Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = text_or_empty(text_col)
    # A row's number is fixed by the first table written. Numbers of a task lie close together, so lists of them compress.
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumns({"mark": text_mark(F.col("text")) if marks else F.lit(None).cast("binary"), "uid": F.monotonically_increasing_id()})
    sets = stash(base.select("uid", "doc_id", "mark", "text").transform(in_arrow, _sets, _SETS))
    ranks, length = _ranks(sets)
    rows = sets.where("segment is null")
    leads = rows.where("words is not null")
    classes = rows.where("size > 0").groupBy("one", "two").agg(F.min(F.when(F.col("words").isNotNull(), F.col("uid"))).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("held"))
    # Words of representatives: leads of other tasks with the same set are left out.
    extra = stash(leads.select("uid", "one", "two").join(classes, ["one", "two"]).where("uid <> rep").select("uid").distinct())
    held = key_filter(extra)
    light = leads.select("uid", "words")
    texts = passing(light, "uid", held, want=False).union(passing(light, "uid", held).join(extra, "uid", "left_anti"))
    posted = texts.transform(in_arrow, _post(n * FINE, spark.sparkContext.broadcast(ranks.tobytes()), boundary(length), split_at), "bucket int, blob binary")
    lists = stash(posted.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket").transform(in_arrow, _lists(n * FINE), _LIST))
    met = lists.groupBy("uid").agg(F.sum("length").alias("met"))
    ranked = lists.drop("length").join(met, "uid")
    stars = ranked.where("parts = 1").select("sig", "uid", "size", "pos", "met").repartition(n, "sig").sortWithinPartitions("sig").transform(in_arrow, _star, "x long, y long")
    tried = stash(stars.union(_wide_stars(ranked.where("parts > 1"))).distinct())
    first = stash(similar(tried, light))
    dealt = lambda rows: rows.repartition(n, "sig").sortWithinPartitions("sig")

    def split(links: DataFrame) -> DataFrame:
        """Members of the lists whose sets lie in several components of links."""
        joined = components(links)
        members = lists.drop("length").join(joined.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
        apart = members.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
        return stash(members.join(apart, "sig", "left_semi"))

    # A few partners for each member: most of what the hubs left apart comes together by them.
    few = split(first).select(F.when(F.col("parts") > 1, F.xxhash64("sig", F.pmod(F.xxhash64("uid"), F.col("parts")))).otherwise(F.col("sig")).alias("sig"), "uid", "size", "pos", "component", F.lit(2).alias("side"))
    some = dealt(few).transform(in_arrow, _cross(FEW), "x long, y long").distinct()
    some = stash(some.join(tried, ["x", "y"], "left_anti"))
    second = stash(first.union(similar(some, light)))
    tried = tried.union(some)
    members = split(second)
    short = members.where("parts = 1").select("sig", "uid", "size", "pos", "component", F.lit(2).alias("side"))
    across = dealt(short.union(_blocks(members.where("parts > 1"), split_at))).transform(in_arrow, _cross(), "x long, y long").distinct()
    across = stash(across.join(tried, ["x", "y"], "left_anti"))
    links = second.union(similar(across, light))
    node = components(links)
    # Sets and their components first, then one join with the rows: a set or component that many rows have is one row until then.
    sets_of = stash(classes.join(node.withColumnRenamed("node", "rep"), "rep", "left").select("one", "two", F.coalesce("component", "rep").alias("class"), "least", "held"))
    least = sets_of.groupBy("class").agg(F.min("least").alias("least"), F.sum("held").alias("rows"), F.count("*").alias("n_sets"))
    known = grouped_join(sets_of.drop("least"), least, ["class"], "n_sets", "one")
    found = grouped_join(rows.select("uid", "doc_id", "mark", "size", "one", "two"), known, ["one", "two"], "held", "uid")
    found = found.withColumn("class", F.when(F.col("size") > 0, F.col("class")))
    more = [F.col("mark").alias("text_mark"), "class", F.coalesce("rows", F.lit(1)).alias("group_size")] if marks else []
    return found.select(F.col("doc_id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), *more)
