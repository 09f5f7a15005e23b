"""The records that share most tokens with each record: a prefix-filtered join of token sets.

Tokens are ordered by how many new records have them, rare ones first. A pair that shares at least c tokens
shares one among the first s - c + 1 of the old record's s, and one among the first t - c + 1 of the new
record's t: only such prefixes are posted and met. c is found per old record from the data: the first
new records of each token's list give a pool, and if so many of the pool as are wanted share c tokens,
records that share fewer cannot be among the best. The pool holds the best of those that share one token, so
the most frequent token of a record never has to be met in full.

Two records whose rarest common token is t share tokens from t on only. So of new records whose lists are equal from t
on, the first are at least as good as all others for every old record that meets them at t: only they are posted under
t. Tokens that nearly all records have are followed by few different rests, so their lists stay short.

Joins are by sort and merge: Spark's estimates know nothing of what a list explodes to, nor how far a file is
compressed, and a table that is broadcast for a low one goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: New records posted under one token that a task pairs with an old record's prefix; longer lists are dealt over parts.
SPLIT = 4096


def _lists(rows: DataFrame, tokens: Column, known: DataFrame, by: str, *more: str) -> DataFrame:
    """Per list, its tokens that are known, rare ones first: toks array<struct<n, id, at, what else is known>>."""
    each = rows.select(by, *more, F.posexplode(tokens).alias("at", "token")).join(known.hint("merge"), "token")
    token = F.struct("n", "id", "at", *[c for c in known.columns if c not in ("n", "id", "token")])
    return each.groupBy(by, *more).agg(F.sort_array(F.collect_list(token)).alias("toks"))


def _prefix(toks: Column, least: Column) -> Column:
    """Tokens of a list that a pair with `least` common ones must meet at."""
    return F.slice(toks, 1, F.greatest(F.size(toks) - least + 1, F.lit(0)))


def leading(news: DataFrame, best: int) -> DataFrame:
    """news: (w, first, toks). Under which tokens a list is posted, with how many tokens stand from there on: (w, id,
    left). Of lists that are equal from a token on, the first `best`; a pair must share two tokens."""
    ids = F.col("toks.id").cast("array<string>")
    rest = lambda i: F.unhex(F.sha2(F.array_join(F.slice(ids, i + 1, F.size(ids)), ","), 256))
    each = F.transform(_prefix(F.col("toks"), F.lit(2)), lambda t, i: F.struct(t["id"].alias("id"), (F.size(ids) - i).alias("left"), rest(i).alias("rest")))
    at = Window.partitionBy("rest").orderBy("first", "w")
    return news.select("w", "first", F.explode(each).alias("t")).select("w", "first", "t.*").withColumn("k", F.row_number().over(at)).where(F.col("k") <= best).select("w", "id", "left")


def posted(olds: DataFrame, news: DataFrame) -> DataFrame:
    """olds: (o, toks, least), news: (w, id, left, m), m being how many are posted under a token. The pairs (o, w)
    that meet with enough tokens left on both sides. A long list is dealt over parts, so no task pairs a whole one."""
    parts = F.greatest(F.ceil(F.col("m") / SPLIT), F.lit(1)).cast("int")
    left = olds.select("o", "least", F.explode(_prefix(F.col("toks"), F.col("least"))).alias("t")).select("o", "least", "t.id", "t.m").where("m is not null")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = news.withColumn("part", F.pmod(F.xxhash64("w"), parts).cast("int"))
    met = left.drop("m").join(right.drop("m").hint("merge"), ["id", "part"]).where(F.col("left") >= F.col("least"))
    return met.select("o", "w").distinct()


def most_shared(old: DataFrame, new: DataFrame, old_pos: str, new_pos: str, tokens: str, best: int, least_share: float = 0.0) -> DataFrame:
    """Of each old record the `best` new ones by the number of common tokens: (old_pos, new_pos, token_score,
    rank). old and new have the columns named: places, and lists of distinct tokens of bounded length.

    Equal scores go by which new record is touched first: by the place, in the old record's list, of the
    first token that both have, then by the new record's place. With least_share, pairs that share less
    than that part of the old record's list may be left out; ranks stay. Records of equal lists are one list:
    of a new one only its first records can be among the best. Empty lists share nothing; records
    of one place are records of their own; nothing is capped.
    """
    a = old.select(F.col(old_pos).alias("old_pos"), F.col(tokens).alias("set"))
    b = new.select(F.col(new_pos).alias("new_pos"), F.array_sort(F.col(tokens)).alias("set"))
    lists = lambda df, name: df.groupBy("set").agg(F.min(df.columns[0]).alias("first")).withColumn(name, F.monotonically_increasing_id())
    olds, news = settled(lists(a, "o")), settled(lists(b, "w"))
    known = settled(news.select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    right = settled(_lists(news, F.col("set"), known, "w", "first"))
    leads = settled(leading(right, best))
    many = settled(leads.groupBy("id").agg(F.count("*").alias("m")))
    left = settled(_lists(olds.withColumn("size", F.size("set")), F.col("set"), known.join(many.hint("merge"), "id", "left"), "o", "size"))

    # The pool: the first lists of each token.
    at = Window.partitionBy("id").orderBy("first", "w")
    lead = right.select("w", "first", F.explode("toks.id").alias("id")).withColumn("k", F.row_number().over(at)).where(F.col("k") <= best).drop("k")
    pool = left.select("o", F.explode("toks").alias("t")).select("o", "t.id", "t.at").join(lead.hint("merge"), "id").groupBy("o", "w").agg(F.count("*").alias("both"), F.min("at").alias("touched"), F.min("first").alias("first"))
    sure = pool.groupBy("o").agg(F.sort_array(F.collect_list("both"), asc=False).alias("both"), F.slice(F.sort_array(F.collect_list(F.struct("touched", "first", "w"))), 1, 2 * best).alias("early"))
    sure = settled(sure.select("o", F.coalesce(F.get("both", F.lit(best - 1)), F.lit(1)).alias("bound"), "early.w"))

    # Of the pool only where one common token may be enough, then at most 2 * best: all others are posted.
    floor = F.ceil(F.col("size") * least_share - 1e-6).cast("int")
    sought = left.join(sure.select("o", "bound").hint("merge"), "o").withColumn("least", F.greatest(F.lit(2), floor, F.col("bound").cast("int")))
    pairs = posted(sought.select("o", "toks", "least"), leads.join(many.hint("merge"), "id")).union(sure.where("bound < 2").select("o", F.explode("w").alias("w"))).distinct()
    common = F.filter(F.col("toks"), lambda t: F.array_contains(F.col("ids"), t["id"]))
    found = pairs.join(left.select("o", "toks").hint("merge"), "o").join(right.select("w", F.col("toks.id").alias("ids")).hint("merge"), "w")
    found = found.select("o", "w", common.alias("both")).select("o", "w", F.size("both").alias("token_score"), F.array_min("both.at").alias("touched"))

    of_list = b.join(news.select("set", "w").hint("merge"), "set").select("w", "new_pos").withColumn("k", F.row_number().over(Window.partitionBy("w").orderBy("new_pos"))).where(F.col("k") <= best).drop("k")
    order = Window.partitionBy("o").orderBy(F.desc("token_score"), "touched", "new_pos")
    top = found.join(of_list.hint("merge"), "w").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return a.join(olds.select("set", "o").hint("merge"), "set").join(top.hint("merge"), "o").select("old_pos", "new_pos", "token_score", "rank")
