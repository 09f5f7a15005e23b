"""How far the sources of a language diverge in their words, by inclusion and exclusion over supports.

A source's probability of a term depends on the term's count there alone, so all terms that it lacks
share one value z. For two sources g and h, the sum of |p_g - p_h| over all kept terms is

    sum over g's terms of |p_g - z_h|  +  sum over h's terms of |z_g - p_h|       (one-sided terms)
  + sum over common terms of |p_g - p_h| - |p_g - z_h| - |z_g - p_h|             (corrections)
  + (V - |g| - |h| + |g and h|) |z_g - z_h|                                       (terms that both lack)

The first line comes from each source's histogram of probabilities, which has few distinct values; the
second from postings, the sources that have a term, met by term in tiles of sources; the third from
four counts. No pair of sources is ever written once per term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, buffers, chunks, groups, in_arrow, partitions, stash, text_or_empty

#: Documents of a language that a kept term occurs in at least; what is added to each count.
LEAST_DOCS, ADDED = 30, 5
#: Probabilities are whole numbers of this unit.
UNIT = 1_000_000_000
#: Ranks of terms that are reported.
TERM_RANKS = 50
#: Sources of a tile: two tiles' sums of pairs are what a task holds.
TILE = 128
#: Postings of a block of terms; a language has as many blocks as its postings fill. A block gives a row for
#: each pair of sources, so it has as many postings as there are pairs, if that is more.
BLOCK_POSTINGS = 1 << 15
#: Parts of a language's one-sided sums, so that one language is not one task.
PARTS = 16

#: Bytes that are no part of a term: all of ASCII but its letters.
_GAPS = np.ones(256, bool)
_GAPS[0x41:0x5B] = _GAPS[0x61:0x7B] = _GAPS[0x80:] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20

_COUNTED = "lang string, source string, term string, n long, docs long"


def _terms(words: Words) -> pa.DictionaryArray:
    """Each word as a string, encoded by a dictionary."""
    size = words.ends - words.starts
    step = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(step, words.starts, 1)
    np.add.at(step, words.ends, -1)
    body = words.data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))).dictionary_encode()


def _count(batches):
    """A chunk's counts of terms by language and source: occurrences, and documents that have them."""
    for table in chunks(batches):
        data, offsets = buffers(table.column("text"))
        words = Words(_FOLD[data], offsets, _GAPS)
        if not len(words):
            continue
        keys = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
        lang, source = (k.indices.to_numpy().astype(np.int64) for k in keys)
        group = lang * len(keys[1].dictionary) + source
        terms = _terms(words)
        code, width = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
        of_doc, times = np.unique(words.text.astype(np.int64) * width + code, return_counts=True)  # words.text: the row
        key = group[of_doc // width] * width + of_doc % width
        held, back = np.unique(key, return_inverse=True)
        n = np.zeros(len(held), np.int64)
        np.add.at(n, back, times)
        docs = np.bincount(back, minlength=len(held)).astype(np.int64)
        g = held // width
        columns = [keys[0].dictionary.take(pa.array(g // len(keys[1].dictionary))), keys[1].dictionary.take(pa.array(g % len(keys[1].dictionary))), terms.dictionary.take(pa.array(held % width)).cast(pa.string()), pa.array(n), pa.array(docs)]
        yield from pa.Table.from_arrays(columns, names=["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=1 << 16)


def postings(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """rows: lang, source, text. (lang, source, term, n, total, lead) of each kept term and each source
    that has it: its occurrences there and in the language; lead marks one row of each term. A term's
    rows are as many as the language's sources at most, since counts are combined by source before."""
    counts = rows.transform(in_arrow, _count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    out = counts.withColumns({"total": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "lead": F.row_number().over(term.orderBy("source")) == 1})
    return out.where(F.col("in_docs") >= least_docs).drop("docs", "in_docs")


def _p(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (n + ADDED) / (total + ADDED kept)), exact beyond 64 bits; 0 without kept terms."""
    wide = lambda c: c.cast("decimal(38,0)")
    ratio = F.call_function("div", wide(n + ADDED) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + ADDED * kept))
    return F.when(kept > 0, ratio + 1).otherwise(F.lit(0)).cast("long")


def sources(rows: DataFrame, posts: DataFrame) -> DataFrame:
    """(lang, source, no, n_all, size, kept, lang_all, z): every source of each language, numbered from 0,
    with its sums over kept terms, the number of the language's kept terms, and its value of lacking terms."""
    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count("*").alias("size"), F.count_if("lead").alias("leads"))
    every = rows.groupBy("lang", "source").agg(F.lit(1)).select("lang", "source").join(own, ["lang", "source"], "left").na.fill(0, ["n_all", "size", "leads"])
    lang = Window.partitionBy("lang")
    out = every.withColumns({"no": F.row_number().over(lang.orderBy("source")) - 1, "kept": F.sum("leads").over(lang), "lang_all": F.sum("n_all").over(lang), "lang_size": F.sum("size").over(lang), "of": F.count("*").over(lang)})
    return out.withColumn("z", _p(F.lit(0), F.col("n_all"), F.col("kept"))).drop("leads")


def _one_sided(priced: DataFrame, known: DataFrame) -> DataFrame:
    """Sums over one source's terms against the other's value of lacking terms, with the terms that both
    would lack if they had none in common: (lang, g, h, source, item, value), for both orders of a pair."""
    bars = priced.groupBy("lang", "no", "p").agg(F.count("*").alias("m")).groupBy("lang", "no").agg(F.collect_list(F.struct("p", "m")).alias("bars"))
    own = known.join(bars, ["lang", "no"], "left").withColumn("part", F.pmod("no", F.lit(PARTS)))
    other = F.struct(F.col("no").alias("h"), F.col("source").alias("item"), F.col("z").alias("z_h"), F.col("size").alias("size_h"))
    tiles = known.groupBy("lang", F.floor(F.col("no") / TILE).alias("tile")).agg(F.collect_list(other).alias("others")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    none = F.array().cast("array<struct<p:bigint,m:bigint>>")
    one = lambda o: F.aggregate(F.coalesce("bars", none), F.lit(0).cast("long"), lambda s, b: s + b["m"] * F.abs(b["p"] - o["z_h"]))
    met = own.join(tiles, ["lang", "part"]).select("lang", F.col("no").alias("g"), "source", "z", "size", "kept", F.explode(F.filter(F.transform("others", lambda o: F.struct(o["h"].alias("h"), o["item"].alias("item"), o["z_h"].alias("z_h"), o["size_h"].alias("size_h"), one(o).alias("one"))), lambda o: o["h"] != F.col("no"))).alias("o"))
    lacking = (F.col("kept") - F.col("size") - F.col("o.size_h")) * F.abs(F.col("z") - F.col("o.z_h"))
    there = F.struct(F.col("g").alias("g"), F.col("o.h").alias("h"), F.col("source").alias("source"), F.col("o.item").alias("item"), (F.col("o.one") + lacking).alias("value"))
    back = F.struct(F.col("o.h").alias("g"), F.col("g").alias("h"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("item"), F.col("o.one").alias("value"))
    return met.select("lang", F.explode(F.array(there, back)).alias("x")).select("lang", "x.*")


_TILED = "key string, lang string, a int, b int, no array<int>, p array<bigint>, z array<bigint>"


def _overlaps(size: int):
    """For each block of terms and two tiles: what the common terms of each pair of sources correct."""

    def run(batches):
        for _, table in groups(batches, "key"):
            lang, a, b = table.column("lang")[0].as_py(), table.column("a")[0].as_py(), table.column("b")[0].as_py()
            wide = size if a == b else 2 * size
            total, z = np.zeros((wide, wide), np.int64), np.zeros(wide, np.int64)
            common = np.zeros((wide, wide), np.int64)
            for at in range(0, table.num_rows, 256):
                part = table.slice(at, 256)
                no, p, zs = (part.column(c).combine_chunks() for c in ("no", "p", "z"))
                lengths = pc.list_value_length(no).to_numpy()
                row = np.repeat(np.arange(len(lengths)), lengths)
                flat = no.flatten().to_numpy()
                place = flat % size + np.where((flat // size == b) & (a != b), size, 0)
                z[place] = zs.flatten().to_numpy()
                held, has = np.zeros((len(lengths), wide), np.int64), np.zeros((len(lengths), wide), bool)
                held[row, place], has[row, place] = p.flatten().to_numpy(), True
                alone = np.where(has, held, 0)
                for i in np.flatnonzero(has.any(0)).tolist():
                    rows_ = has[:, i]
                    mine, theirs, both = held[rows_, i][:, None], alone[rows_], has[rows_]
                    fix = np.abs(mine - theirs) - np.abs(mine - z) - np.abs(z[i] - theirs)
                    total[i] += np.where(both, fix, 0).sum(0)
                    common[i] += both.sum(0)
            total += common * np.abs(z[:, None] - z)
            i, j = np.nonzero(common)
            away = (i != j) & ((a == b) | ((i < size) != (j < size)))
            i, j = i[away], j[away]
            name = lambda k: (np.where(k < size, a * size, b * size) + k % size).astype(np.int32)
            yield from pa.Table.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(name(i)), pa.array(name(j)), pa.array(total[i, j])], names=["lang", "g", "h", "value"]).to_batches(max_chunksize=1 << 16)

    return run


def _common(priced: DataFrame) -> DataFrame:
    """(lang, g, h, value): corrections of pairs of sources that have a term in common, both orders."""
    n = partitions(priced.sparkSession)
    tile = lambda no: F.floor(no / TILE).cast("int")
    blocks = F.floor(F.col("lang_size") / F.greatest(F.lit(BLOCK_POSTINGS), F.col("of") * F.col("of"))) + 1
    lists = priced.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("no", "p", "z"))).alias("posts"), F.first(blocks).alias("blocks")).where(F.size("posts") > 1)
    tiles = F.array_distinct(F.transform("posts", lambda x: tile(x["no"])))
    pairs = F.flatten(F.transform(tiles, lambda a: F.transform(F.filter(tiles, lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = lists.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "posts", F.explode(pairs).alias("t"))
    own = F.filter("posts", lambda x: (tile(x["no"]) == F.col("t.a")) | (tile(x["no"]) == F.col("t.b")))
    met = met.select(F.concat_ws(":", "t.a", "t.b", "block", "lang").alias("key"), "lang", "t.a", "t.b", own.alias("own"))
    rows = met.select("key", "lang", "a", "b", "own.no", "own.p", "own.z")
    return rows.repartition(n, "key").sortWithinPartitions("key").transform(in_arrow, _overlaps(TILE), "lang string, g int, h int, value long")


def source_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from its others.

    Part `pair` has a row for each other source: the sum over the language's kept terms of the distance
    of their probabilities. Part `term` has the source's own terms that are more probable there than in
    the language, by how much, the first term_ranks of them. Ranks go by value, descending, then by item
    in the order of its bytes. Kept are the terms in at least least_docs of a language's documents.

    Null texts, languages and sources are empty strings; an empty string is a language or source of its
    own. Texts are read whole, however long; a text without a term still makes its source occur. Repeated
    rows are documents of their own; ids are not read. A language with one source has no pairs, one
    without kept terms has pairs of value 0. An empty table gives no rows; further columns, whatever their
    names, are ignored. A source or language may hold most rows: counts are combined in each task first, so
    a term is one row per source after that; what a task holds are two tiles of sources.
    """
    rows = docs.select(text_or_empty(text_col).alias("text"), text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"))
    posts = stash(postings(rows, least_docs))
    known = stash(sources(rows, posts))
    own = known.select("lang", "source", "no", "n_all", "kept", "lang_all", "lang_size", "of", "z")
    priced = posts.join(own, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("n_all"), F.col("kept")))

    parts = _one_sided(priced.select("lang", "no", "p"), known).unionByName(_common(priced), allowMissingColumns=True)
    pairs = parts.groupBy("lang", "g", "h").agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))

    above = priced.select("lang", "source", F.col("term").alias("item"), (F.col("p") - _p(F.col("total"), F.col("lang_all"), F.col("kept"))).alias("value")).where("value > 0")
    terms = above.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= term_ranks)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def audit_sql(least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> str:
    """The same for DuckDB over the table documents: every term of every source."""
    p = lambda n, total: f"(1 + ({UNIT}::hugeint * ({n} + {ADDED})) // ({total} + {ADDED} * v))::bigint"
    return rf"""
WITH rows AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_all FROM kept GROUP BY ALL),
grps AS (SELECT DISTINCT lang, source FROM rows),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS n_all FROM counts GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "coalesce(n_all, 0)")} AS p, {p("total", "lang_all")} AS q
  FROM grps JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN sums USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
sides AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::bigint AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::bigint AS value FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sides s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::int AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::int AS rank FROM p WHERE n > 0 AND p > q QUALIFY rank <= {term_ranks}"""
