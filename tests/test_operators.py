import re

import pytest
from pyspark.sql import functions as F

from veritrace.functions import terms
from veritrace.functions.text import clean, matched_terms, percent, strip
from veritrace.operators import consensus, diff, extraction, lint, linking, metrics, ordering, usage
from veritrace.sources import envelopes, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_mapping_and_rounding(spark):
    spec = spark.createDataFrame([("R1",), ("R2",), ("R3",)], "requirement_id string")
    plan = spark.createDataFrame([("R1",), ("R2",), (None,)], "requirement_id string")
    assert tuple(metrics.rate(metrics.flagged(spec, plan, "requirement_id"), F.col("hit")).first()) == (3, 2, 66.67)
    assert [r[0] for r in linking.unmapped(spec, plan, "requirement_id", "requirement_id").collect()] == ["R3"]
    assert one(spark, percent(F.lit(1), F.lit(0)), percent(F.lit(1), F.lit(800))) == (0.0, 0.13)


@pytest.mark.parametrize(
    ("rows", "evidence", "status"),
    [
        ([], False, "Uncovered"),
        ([], True, "Ambiguous / not yet plannable"),
        ([("covered", True)], False, "Covered"),
        ([("covered", False)], False, "Uncovered"),
        ([("uncovered", True)], False, "Uncovered"),
        ([("covered", True)], True, "Partially covered"),
        ([("covered", True), ("uncovered", False)], False, "Partially covered"),
        ([("covered", False)], True, "Ambiguous / not yet plannable"),
        ([(None, True)], False, "Partially covered"),
    ],
)
def test_status_decisions(spark, rows, evidence, status):
    spec = spark.createDataFrame([("R",)], "requirement_id string")
    tests = spark.createDataFrame([("R", *r) for r in rows], "requirement_id string, label string, complete boolean")
    doubt = spark.createDataFrame([("R",)] if evidence else [], "requirement_id string")
    assert linking.verify(spec, tests, doubt).first()["verified_status"] == status


def test_weights_and_f1(spark):
    rows = spark.createDataFrame([("Covered",), ("Partially covered",), ("Ambiguous / not yet plannable",)], "verified_status string")
    assert tuple(metrics.weighted(rows).first()) == (3, 1.5, 50.0)
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "v string")
    none = a.limit(0)
    assert metrics.multiset_f1(a, a.limit(2), ["v"]).first()["f1"] == metrics.multiset_f1(a.limit(2), a, ["v"]).first()["f1"] == 80.0
    assert metrics.multiset_f1(none, none, ["v"]).first()["f1"] == 100.0
    assert metrics.multiset_f1(a, none, ["v"]).first()["f1"] == 0.0


def test_assessment_defaults(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "requirement_id string")
    found = spark.createDataFrame([("A", "suitable_detail", 0), ("A", "unclear", 1)], "requirement_id string, label string, pos int")
    got = {r.requirement_id: r.label for r in linking.assess(ids("A", "B", "C"), ids("A", "B"), found, "label").collect()}
    assert got == {"A": "suitable_detail", "B": "unclear", "C": "not_mapped"}


def test_text_and_lint(spark):
    assert one(spark, strip(F.lit("\t a \n")), clean(F.lit(" a  -  b\n c "))) == ("a", "a-b c")
    assert one(spark, matched_terms(F.lit("It may be émay optional"), terms.WEAK_WORDS))[0] == ["optional", "may be", "may"]
    rows = spark.createDataFrame([("R1", "The bus shall stall."), ("R2", "It may stall.")], "id string, text string")
    got = {(r.id, r.issue_type) for r in lint.check_language(rows).collect()}
    assert got == {("R2", lint.WEAK), ("R2", lint.MISSING)}
    assert one(spark, lint.source_section(F.lit("REQ_A2_1_003"), F.lit(None).cast("string")))[0] == "A2.1.003"
    prose = F.lit("This chapter describes the interface.")
    assert one(spark, extraction.relevant(prose), extraction.relevant(prose, literal_compat=True)) == (False, True)


def test_ordering(spark):
    rows = spark.createDataFrame([(0, "T"), (1, "T"), (2, None)], "pos int, id string")
    assert [r.unique_id for r in ordering.suffixed(rows, "id", ["pos"]).orderBy("pos").collect()] == ["T", "T_DUP2", "TEST_UNKNOWN"]
    pages = spark.createDataFrame([("d", 0, None, "a"), ("d", 1, "h", "b"), ("d", 2, None, "c"), ("d", 3, "h", "e")], "doc string, page int, head string, text string")
    got = ordering.chunks(pages, F.col("head").isNotNull(), ["doc"], ["page"], "text").orderBy("chunk").collect()
    assert [(r.n_rows, r.text) for r in got] == [(2, "b\nc"), (1, "e")]
    assert ordering.carried(pages, F.col("head"), ["doc"], ["page"], "s").orderBy("page").first()["s"] == "Unknown"
    shifts = spark.createDataFrame([(1, 3), (2, 4), (5, 7), (6, 6)], "a int, b int")
    assert tuple(ordering.most_common_offset(shifts, "a", "b").first()) == (2, 3)


def test_diff(spark):
    rows = lambda *x: spark.createDataFrame(list(enumerate(x)), "pos int, text string")
    old = rows("same text", "same  text", "the buffer holds 16 entries of data", "gone")
    new = rows("SAME TEXT", "the buffer holds 32 entries of data", "fresh")
    assert [tuple(r)[2:] for r in diff.exact_pairs(old, new, "text", "pos").collect()] == [(0, 0)]
    found = diff.scored(diff.candidates(old, new, "text", "pos"), old, new, "text", "pos", 0.78).where("old_pos = 2")
    got = diff.one_to_one(found).withColumn("c", diff.wording_class("old_text", "new_text")).first()
    assert (got.old_pos, got.new_pos, got.c) == (2, 1, "numeric_value_change")
    pairs = spark.createDataFrame([(0, 0, 0.8, 1), (0, 1, 0.9, 1), (1, 1, 0.95, 1), (1, 0, 0.7, 1)], "old_pos int, new_pos int, similarity double, rank int")
    assert {(r.old_pos, r.new_pos) for r in diff.one_to_one(pairs).collect()} == {(1, 1), (0, 0)}


def test_consensus(spark):
    rows = [(1, 0, 5, "S1", 9, "S2", "c", 1), (1, 1, 9, "s2", 5, "S1", "C", 3), (2, 2, 9, " S2", 5, "S1", "c", 2)]
    found = spark.createDataFrame(rows, "reviewer int, pos int, page_a int, section_a string, page_b int, section_b string, category string, rank int")
    key = consensus.finding_key(*[F.col(c) for c in ("page_a", "section_a", "page_b", "section_b", "category")])
    got = consensus.consensus(found, key, "reviewer", F.col("rank"), ["pos"], 2).collect()
    assert [(r.votes, r.pos) for r in got] == [(2, 1)]


def test_usage(spark):
    rows = spark.createDataFrame([(m, 1_000_000, 1_000_000) for m in ("gpt-5.5", "gpt-5.4", "gpt-5.4-mini", "other")], "model string, i long, o long")
    assert [float(r.cost) for r in usage.priced(rows, "model", "i", "o").collect()] == [35.0, 17.5, 5.25, 0.0]
    with pytest.raises(ValueError):
        usage.prioritise(rows, "model", [str(i) for i in range(13)], [])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"table": {"feature_list": [{"requirement_id": "R1"}, 3, {"id": "x"}]}}')
    got = envelopes.records(envelopes.documents(spark, str(tmp_path / "a.json")), "plan").select("pos", envelopes.field("requirement_id"), envelopes.field("id")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, "R1", None), (2, None, "x")]
    groups, patterns = envelopes.parse_terms("[a]\nx\n# no\n[regex_patterns]\np=\\d+")
    assert groups["a"] == ["x"] and patterns == {"p": r"\d+"}
    for bad in ("x", "[a]\n[a]", "[regex_patterns]\nfoo"):
        with pytest.raises(ValueError):
            envelopes.parse_terms(bad)
    sinks.write_csv(spark.createDataFrame([(1, ["a", "b"])], "i int, l array<string>"), str(tmp_path / "out"), ["i", "l", "missing"], single=True)
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines() == ["i,l,missing", '1,"a, b",']


def test_similar_changes_reads_every_part(spark):
    import difflib

    from veritrace.queries import similar_changes

    sf = "/root/testdata/sf0.001"
    rows = {r.p_partkey: f"{r.p_name} {r.p_brand} {r.p_type} size {r.p_size}" for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    words = {i: [w for w in dict.fromkeys(re.findall("[a-z0-9_]+", t.lower())) if len(w) >= 3 and w not in terms.COMMON_TOKENS] for i, t in rows.items()}
    pairs = []
    for a in (i for i in rows if i % 2 == 0):
        both = {b: set(words[a]) & set(words[b]) for b in rows if b % 2}
        shared = sorted((-len(x), min((words[a].index(w) for w in x), default=0), b) for b, x in both.items())
        for rank, (score, _, b) in enumerate(shared[: terms.CANDIDATES]):
            ratio = round(difflib.SequenceMatcher(None, rows[a].lower(), rows[b].lower()).ratio(), 4)
            if score and ratio >= terms.MATCH_LIMITS["requirement"]:
                pairs.append((-ratio, a, rank, b))
    want, used = set(), set()
    for ratio, a, _, b in sorted(pairs):
        if ("old", a) not in used and ("new", b) not in used:
            used |= {("old", a), ("new", b)}
            want.add((a, b, -ratio))
    assert {(r.old_pos, r.new_pos, r.similarity) for r in similar_changes(spark, sf).collect()} == want


def test_one_to_one_has_no_last_round(spark):
    chain = [(i, i + d, 0, 1, 1 - (2 * i + d) / 1000, "", "") for i in range(60) for d in (0, 1)]
    pairs = spark.createDataFrame(chain, "old_pos long, new_pos long, token_score long, rank int, similarity double, old_text string, new_text string")
    assert diff.one_to_one(pairs.withColumn("similarity", 1 - F.col("similarity"))).count() == 60
