"""Helpers shared by the operators: shared storage, word tables over Arrow batches, hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one round of a vectorised Python step works on.
CHUNK_BYTES = 4 << 20
#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U64)


_stashed: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the checkpoint folder that the
    session has set. A session on one machine without either gets a folder of its own; on a cluster
    that is an error, since a machine's own folder would lose or mix up data there."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veritrace-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get()
    return folder.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: its lineage is cut,
    lost executors do not lose it, and both uses of it see the same rows. drop_stashed removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veritrace-{uuid.uuid4().hex}"
    _stashed.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stashed(spark: SparkSession) -> None:
    """Deletes this process's stashed tables. Results that still read them must be written before."""
    while _stashed:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stashed.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch. A row may be short or long, so a count of rows bounds nothing; a batch
#: is held by the JVM, on its way, and by Python at once, for each core of an executor.
BATCH_BYTES = 8 << 20


def tidy(run):
    """run, after which the allocators return to the system what they hold: Python workers live on."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return tidied


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of at most about BATCH_BYTES (or one row)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidy(run), schema)


def partitions(spark: SparkSession) -> int:
    """What the cluster deals its shuffles out to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_mark(text: Column) -> Column:
    """What tells texts of one id, or of none, apart: their sha256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """The words of many texts: byte offsets in one buffer, and the text each word belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data = data
        gap = space[data]
        first = ~gap
        last = first.copy()
        inner = np.zeros(len(data), bool)  # bytes whose left neighbour is of the same text
        inner[1:] = True
        inner[offsets[:-1][offsets[:-1] < len(data)]] = False
        first[1:] &= gap[:-1] | ~inner[1:]
        last[:-1] &= gap[1:] | ~inner[1:]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.firsts = np.searchsorted(self.text, np.arange(len(offsets)))  # of each text, its first word

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight bytes at a time."""
        data = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", data, strides=(1,))
        size = self.ends - self.starts
        out = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
        at, left, where = self.starts, size, None
        while len(at):
            block = eight[at] & _TAIL[np.minimum(left, 8)]
            if where is None:
                out = mix((out ^ block) * U64(0x9FB21C651E98DF25))
            else:
                out[where] = mix((out[where] ^ block) * U64(0x9FB21C651E98DF25))
            more = np.flatnonzero(left > 8)
            where = more if where is None else where[more]
            at, left = at[more] + 8, left[more] - 8
        return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """For each run of k hashes from position i, a hash of the run: out[i] covers h[i:i+k]."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0x9E3779B97F4A7C15 | 1) + h[j : j + n]
    return mix(out)


def long_runs(h: np.ndarray, k: int) -> np.ndarray:
    """As runs, by prefix sums: its work does not grow with k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = 0x9E3779B97F4A7C15 | 1
    power = np.concatenate([[U64(1)], np.cumprod(np.full(len(h) - 1, base, U64))])
    back = np.concatenate([[U64(1)], np.cumprod(np.full(n - 1, pow(base, -1, 1 << 64), U64))])
    total = np.concatenate([[U64(0)], np.cumsum(h * power)])
    return mix((total[k:] - total[:-k]) * back)


def chunks(batches, size_of: str = "text", limit: int = CHUNK_BYTES):
    """Cuts Arrow batches into tables of about limit bytes of text; one very long text stands alone."""
    held, total = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(size_of)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + limit - total, "right")) - 1
            stop = max(stop, start + (0 if held else 1))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                total += int(at[stop] - at[start])
                start = stop
            if start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def groups(batches, key: str):
    """Yields (key, table) for each run of rows that share a key, from batches sorted by it."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


#: Bytes of a filter of keys: a fixed bound, whatever the number of keys. With more than about
#: 8 * FILTER_BYTES of them it thins out less; what passes is always joined exactly.
FILTER_BYTES = 1 << 22


def _slots(batches):
    """A filter's set bits, by 64 kB segments; a task sends a segment once."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        slot = mix(batch.column(0).to_numpy(zero_copy_only=False).view(U64)) % U64(8 * FILTER_BYTES)
        for segment in np.unique(slot >> U64(19)).tolist():
            bits = held.setdefault(segment, np.zeros(1 << 19, bool))
            bits[(slot[slot >> U64(19) == segment] & U64((1 << 19) - 1)).astype(np.int64)] = True
    for segment, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "bits"])


def _either(batches):
    for segment, table in groups(batches, "segment"):
        out = np.zeros(1 << 16, np.uint8)
        for x in table.column("bits").to_pylist():
            out |= np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["segment", "bits"])


def key_filter(keys: DataFrame):
    """A broadcast of FILTER_BYTES over the long keys of a one-column frame."""
    spark = keys.sparkSession
    bits = keys.transform(in_arrow, _slots, "segment int, bits binary").repartition(partitions(spark), "segment").sortWithinPartitions("segment").transform(in_arrow, _either, "segment int, bits binary")
    bound = np.zeros(FILTER_BYTES, np.uint8)
    for r in bits.collect():  # FILTER_BYTES at most
        bound[r.segment << 16 : (r.segment + 1) << 16] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(bound.tobytes())


def passing(df: DataFrame, key: str, held, want: bool = True) -> DataFrame:
    """Rows of df whose key may be in the filter (or, for want=False, surely is not)."""
    at = df.columns.index(key)

    def run(batches):
        filtered = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            slot = mix(batch.column(at).to_numpy(zero_copy_only=False).view(U64)) % U64(8 * FILTER_BYTES)
            yield batch.filter(pa.array(((filtered[(slot >> U64(3)).astype(np.int64)] >> (7 - (slot & U64(7)).astype(np.uint8))) & 1 == 1) == want))

    return df.transform(in_arrow, run, df.schema)


def _split(df: DataFrame, keys: DataFrame, on: dict[str, Column]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of df (with its keys, under names of their own) that surely are not among keys, and the
    rest; only the latter need a join, so the others' texts are not shuffled."""
    names = [f"_key_{n}" for n in on]
    held = key_filter(keys.select(F.xxhash64(*on)))
    marked = df.withColumns(dict(zip(names, on.values()))).withColumn("_slot", F.xxhash64(*names))
    return passing(marked, "_slot", held, want=False).select(df.columns), passing(marked, "_slot", held), names


def _same(on: dict[str, Column], names: list[str]) -> Column:
    met = F.lit(True)
    for name, own in zip(on, names):
        met = met & F.col(own).eqNullSafe(F.col(name + "_gone"))
    return met


def without(df: DataFrame, gone: DataFrame, on: dict[str, Column]) -> DataFrame:
    """Rows of df whose keys are not in gone. on: gone's columns, and what they are of a row of df;
    nulls are equal to each other."""
    gone = stash(gone.select(*on).distinct())
    clear, rest, names = _split(df, gone, on)
    return clear.union(rest.join(gone.toDF(*[n + "_gone" for n in on]), _same(on, names), "left_anti").select(df.columns))


def single(df: DataFrame, repeated: DataFrame, on: dict[str, Column]) -> DataFrame:
    """df with one row of those that agree in a key of `repeated`; which one, its whole content decides."""
    repeated = stash(repeated.select(*on).distinct())
    clear, rest, names = _split(df, repeated, on)
    met = rest.join(repeated.toDF(*[n + "_gone" for n in on]), _same(on, names), "left_semi")
    others = rest.join(repeated.toDF(*[n + "_gone" for n in on]), _same(on, names), "left_anti")
    row = F.struct(*[F.col(c) for c in df.columns])
    one = met.groupBy(*names).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row")).select("_row.*")
    return clear.union(others.select(df.columns)).union(one)


#: A key of more than 1 / HOT of all rows is hot: there are fewer than HOT of them.
HOT = 1000


def grouped_join(rows: DataFrame, table: DataFrame, on: list[str], held: str, spread: str) -> DataFrame:
    """rows, left joined with a table of one row per key, of which `held` counts the rows of that key. Hot keys'
    rows of the table, fewer than HOT, go to all tasks; the rows that meet them get a key of their own
    (a hash of `spread`) in the other join, so no task holds more than a HOT-th of all rows for one key."""
    values = [c for c in table.columns if c not in on]
    hot = F.col(held) * HOT > rows.count()
    few = table.where(hot).select(*on, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    rest = table.where(~hot).toDF(*[f"_rest_{c}" for c in table.columns])
    met = rows.join(F.broadcast(few), on, "left").withColumn("_first", F.when(F.col("_hot").isNull(), F.col(on[0])).otherwise(F.xxhash64(spread)))
    same = F.col("_hot").isNull() & (F.col("_first") == F.col(f"_rest_{on[0]}"))
    for c in on[1:]:
        same = same & (F.col(c) == F.col(f"_rest_{c}"))
    out = met.join(rest, same, "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in values])


def whole_groups(batches, key: str):
    """Tables of complete runs of equal keys, from batches sorted by it: many small groups at once."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        turn = np.flatnonzero(keys[1:] != keys[:-1])
        cut = int(turn[-1]) + 1 if len(turn) else 0
        if held and not cut and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
