"""Running values over ranges, texts found by anchors, and unions of ranges, each against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from veritrace.operators import containment, ordering, quality


def document(spark, n=400):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"d{i % 7}", i, rng.choice([None, None, f"h{i}"]), rng.randint(-5, 5)) for i in range(n)]
    rows += [(None, i, None if i % 4 else f"n{i}", 1) for i in range(20)]
    return rows, spark.createDataFrame(rows, "doc string, page int, head string, v int").repartition(5)


@pytest.mark.parametrize("hot_rows", [ordering.HOT_ROWS, 25])
def test_scans_do_not_depend_on_what_is_hot(spark, hot_rows):
    rows, frame = document(spark)
    last, total, top, count = {}, {}, {}, {}
    want = {}
    for doc, page, head, v in sorted(rows, key=lambda r: r[1]):
        last[doc] = head or last.get(doc)
        total[doc], count[doc] = total.get(doc, 0) + v, count.get(doc, 0) + 1
        top[doc] = max(top.get(doc, v), v)
        want[doc, page] = (last[doc] or "Unknown", total[doc], top[doc], count[doc])
    by, order = ["doc"], ["page"]
    out = ordering.carried(frame, F.col("head"), by, order, "section", hot_rows=hot_rows)
    out = ordering.scanned(out, ordering.summing(F.col("v")), by, order, "total", hot_rows)
    out = ordering.scanned(out, ordering.greatest_so_far(F.col("v")), by, order, "top", hot_rows)
    out = ordering.ranked(out, by, order, "n", hot_rows)
    assert {(r.doc, r.page): (r.section, r.total, r.top, r.n) for r in out.collect()} == want


def test_a_hot_document_is_dealt_over_tasks(spark):
    """A document of all rows: no partition of the scan's last stage holds more than a share of it."""
    frame = spark.range(20_000).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("h"), F.col("id"))).alias("head"))
    out = ordering.carried(frame, F.col("head"), ["doc"], ["page"], "section", hot_rows=100)
    assert out.where(F.col("section") != F.concat(F.lit("h"), (F.floor(F.col("page") / 100) * 100).cast("string"))).count() == 0
    parts = ordering.scanned(frame, ordering.summing(F.lit(1)), ["doc"], ["page"], "n", 100).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 10_000


def words(rng, n, few=False):
    return " ".join(rng.choice(["shall", "the", "buffer", "hold", "reset", "é", "x1", "日本", "a-b"] if not few else ["ab", "abab"]) for _ in range(n))


@pytest.mark.parametrize("few", [False, True])
def test_contained_texts(spark, monkeypatch, few):
    rng = random.Random(9)
    pages = [(i, words(rng, rng.choice([0, 0, 1, 3, 400, 2500]), few)) for i in range(40)]
    source = " ".join(t for _, t in pages if t)
    cuts = [source[a : a + n] for n in (1, 2, 5, 7, 8, 9, 20, 31, 32, 33, 100, 9000, 30_000) for a in [rng.randrange(max(1, len(source) - n)) for _ in range(6)]]
    wanted = [c.strip() for c in cuts] + [c[: len(c) // 2] + "Q" + c[len(c) // 2 :] for c in cuts] + [c + "Q" for c in cuts] + ["", None, source, source + " x", "never there", "zz"]
    frame = spark.createDataFrame(pages, "page int, t string").repartition(4)
    got = {r.n for r in containment.contained(frame, spark.createDataFrame([(w,) for w in wanted + wanted[:9]], "n string")).collect()}
    assert got == {w for w in wanted if w and w in source}


def test_anchors_are_few_and_kept_in_parts():
    rng = random.Random(1)
    text = words(rng, 3000)
    at, h = containment.anchors(text, 16, 17)
    assert len(at) < len(text) / 4
    whole = dict(zip(at.tolist(), h.tolist()))
    for a in range(0, 3000, 111):
        for place, x in zip(*(v.tolist() for v in containment.anchors(text[a : a + 60], 16, 17))):
            assert whole[a + place] == x


def test_requirements_over_many_pages(spark):
    pages = spark.createDataFrame([(1, "The  BUFFER shall"), (2, ""), (3, "hold"), (4, "sixteen"), (5, "entries. End")], "page int, text string")
    need = spark.createDataFrame([("the buffer shall hold sixteen entries.",), ("hold entries",), ("end",), (None,)], "text string")
    assert quality.traceable(pages, need).first().value == 50.0
    assert quality.traceable(pages.limit(0), need).first().value == 0.0


def test_page_ranges(spark):
    schema = "pages array<string>, page string, page_start int, page_end int"
    rows = [(["3", "x", "5"], None, None, None), (None, " 4 ", None, None), (None, "-2", None, None), (None, None, 1, 2_000_000_000), (None, None, -5, 2), (None, None, 9, 8), (None, None, None, 7)]
    frame = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in quality.page_ranges(frame).collect()] == [(1, 2_000_000_000)] and quality.covered_count(frame).first().n == 2_000_000_000
    assert quality.covered_count(frame.limit(0)).first().n == 0
    rng = random.Random(3)
    many = [(a := rng.randint(-5, 300), a + rng.choice([-1, 0, 0, 1, 3, 30])) for _ in range(60)]
    got = [tuple(r) for r in quality.merged_ranges(spark.createDataFrame(many, "first long, last long")).orderBy("first").collect()]
    assert {p for a, b in got for p in range(a, b + 1)} == {p for a, b in many for p in range(a, b + 1)}
    assert all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:]))


def test_only_anchors_that_are_asked_for_leave_their_task(spark, monkeypatch):
    """The source's anchors are a tenth of its places; a few texts ask for a few of them."""
    sizes, whole = [], containment.settled
    monkeypatch.setattr(containment, "settled", lambda df: (sizes.append((df.columns, (out := whole(df)).count())), out)[1])
    pages = spark.createDataFrame([(i, " ".join(f"w{(i * 7919 + j * 104729) % 99991}" for j in range(400))) for i in range(60)], "page int, t string")
    text = pages.where("page = 30").first().t[100:400]
    got = containment.contained(pages, spark.createDataFrame([(text,), ("nowhere to be found in any of the pages",)], "n string")).collect()
    assert [r.n for r in got] == [text]
    assert [n for c, n in sizes if c == ["k", "at", "h"]][0] < 200
