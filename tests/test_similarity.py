"""Bounds of the matching-blocks ratio: they prune pairs and lose none."""

import difflib
import random

from pyspark.sql import functions as F

from veritrace.functions import similarity as S
from veritrace.functions import terms
from veritrace.operators import diff


def texts(n, seed):
    rng = random.Random(seed)
    words = "the buffer holds entries of data when register mode is set to 1 and reset clears it, if (x) é ß".split()
    out = []
    for _ in range(n):
        made = [rng.choice(words) for _ in range(rng.choice([0, 1, 5, 12, 60]))]
        out.append(" ".join(made))
        out.append(" ".join(w if rng.random() < 0.85 else rng.choice(words) for w in made))
    return out


def test_early_end_is_exact():
    made = texts(40, 1)
    matcher = difflib.SequenceMatcher(None)
    ended = 0
    for limit in (0.3, 0.65, 0.78, 1.0):
        for b in made[::3]:
            matcher.set_seq2(b)
            for a in made:
                want = round(difflib.SequenceMatcher(None, a, b).ratio(), 4)
                got = S._at_least(a, b, limit, matcher)
                assert got == (want if want >= limit else None)
                ended += got is None
    assert ended > 1000


def test_bounds_hold(spark):
    made = texts(25, 2)
    pairs = spark.createDataFrame([(a, b, round(difflib.SequenceMatcher(None, a, b).ratio(), 4)) for a in made for b in made[::2]], "a string, b string, r double")
    counts = pairs.withColumns({"x": S.character_counts(F.col("a")), "y": S.character_counts(F.col("b"))})
    size = F.length("a"), F.length("b")
    got = counts.select("r", S.ratio_bound(*size).alias("short"), S.ratio_bound(*size, F.col("x"), F.col("y")).alias("kinds")).collect()
    assert all(r.r <= r.kinds <= r.short for r in got)
    assert sum(r.kinds < 0.78 for r in got) > sum(r.short < 0.78 for r in got) > 0


def test_share_of_pairs_that_never_reach_python(spark):
    """On the parts' descriptions: what the bounds stop, and that the rest is as by comparing all."""
    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), "p_size").alias("text"))
    old, new = rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 1")
    pairs = diff.candidates(old, new, "text", "p_partkey")
    text = {r.p_partkey: r.text.lower() for r in rows.collect()}
    every = {(r.old_pos, r.new_pos) for r in pairs.collect()}
    ratio = {p: round(difflib.SequenceMatcher(None, text[p[0]], text[p[1]]).ratio(), 4) for p in every}
    got = {(r.old_pos, r.new_pos): r.similarity for r in diff.scored(pairs, old, new, "text", "p_partkey", 0.78).collect()}
    assert got == {p: s for p, s in ratio.items() if s >= 0.78}
    side = lambda df, p: df.select(F.col("p_partkey").alias(f"{p}_pos"), F.length("text").alias(f"{p}_size"), S.character_counts(F.lower("text")).alias(f"{p}_counts"))
    both = pairs.join(side(old, "old"), "old_pos").join(side(new, "new"), "new_pos")
    left = both.where(S.ratio_bound(F.col("old_size"), F.col("new_size"), F.col("old_counts"), F.col("new_counts")) >= 0.78).count()
    assert left < 0.5 * len(every), (left, len(every))


def test_copies_cost_no_more_pairs_and_change_no_match(spark):
    """50 copies of each text: only the first few of equal old records can be taken, and are compared."""
    texts = ["large ring brand one steel", "large ring brand two steel", "small cold bolt brand one", "old blue plate brand two"]
    rows = [(i, texts[i % 4] + (" new" if i % 8 > 5 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, text string")
    old, new = df.where("(pos div 4) % 2 = 0"), df.where("(pos div 4) % 2 = 1")
    some = diff.contenders(old, "text", "pos")
    assert some.count() == 4 * terms.CANDIDATES
    taken = lambda a: sorted(map(tuple, diff.one_to_one(diff.scored(diff.candidates(a, new, "text", "pos"), a, new, "text", "pos", 0.78)).collect()))
    every = taken(old)
    assert every == taken(some) and len(every) >= terms.CANDIDATES


def test_no_table_is_broadcast_by_an_estimate(spark):
    """A list of tokens explodes to more than Spark's estimate of it says."""
    df = spark.createDataFrame([(i, f"alpha beta gamma word{i % 7}") for i in range(40)], "pos long, text string")
    old, new = df.where("pos % 2 = 0"), df.where("pos % 2 = 1")
    for out in (diff.candidates(old, new, "text", "pos"), diff.one_to_one(diff.similarities(diff.candidates(old, new, "text", "pos"), old, new, "text", "pos", 0.5))):
        assert "BroadcastExchange" not in out._jdf.queryExecution().sparkPlan().toString() and "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def test_a_filter_does_not_score_pairs_again(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("abcd", "zzzz")], "a string, b string")
    out = df.withColumn("s", S.similarity_from(0.5)(F.col("a"), F.col("b"))).where("s is not null")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1 and [r.s for r in out.collect()] == [0.75]
