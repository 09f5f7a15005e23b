"""Extraction, version diff, quality scores, reports, planning and sources, on the examples they are specified by."""

import json
import re

import pytest
from pyspark.sql import functions as F

from veritrace.functions.similarity import normalized
from veritrace.functions.text import folded, title_case
from veritrace.operators import chapters, consensus, diff, extraction, lint, linking, ordering, planning, quality, traceability, usage, version_diff
from veritrace.plans import coverage
from veritrace.sources import envelopes, paths, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_extraction_of_a_page(spark):
    text = "\n".join([
        "A2.3 Channel signals", "Figure A2.1 shows nothing.", "The source must use one ID. See page 3. However, it may stall.", "The destination:", "Must not:",
        "• wait for READY. • drop data.", "This section describes the bus. When VALID is HIGH the slave accepts data.", "NOTE: Signals are listed in Table A2.4.", "0b01 READ data shall be returned",
    ])
    doc = extraction.document(frame(spark, [("d", 1, text), ("d", 2, "The source must use one  ID.")], "doc string, page int, text string"))
    rows = sorted((r.source_section, r.new_id, r.text) for r in doc["requirements"].collect())
    said = [t for _, _, t in rows]
    assert "The source must use one ID." in said and said.count("The source must use one ID.") == 1
    assert {"The destination: Must not: wait for READY.", "The destination: Must not: drop data."} <= set(said)
    assert not [t for t in said if t.startswith(("See ", "However", "This section"))]
    assert [i for _, i, _ in rows] == [f"REQ_A2_3_{n:03d}" for n in range(1, len(rows) + 1)]
    assert [(r.section_id, r.title, r.parent) for r in doc["sections"].collect()] == [("A2.3", "Channel signals", "A2")]
    assert [tuple(r)[3:] for r in doc["notes"].collect()] == [("NOTE", "NOTE: Signals are listed in Table A2.4.")]
    assert [r.reference for r in doc["cross_references"].orderBy("page", "pos").collect()] == ["Table A2.4"]
    assert "VALID" in {r.acronym for r in doc["acronyms"].collect()} and not {"NOTE", "THE"} & {r.acronym for r in doc["acronyms"].collect()}


def test_extraction_rules(spark):
    heads = ["Channel signals", "channel signals", "Signals.", "March 2024", " ".join(["Word"] * 13), ""]
    assert one(spark, *[extraction.plausible_heading(F.lit(h)) for h in heads]) == (True, False, False, False, False, False)
    cover = "Chapter A2\nOverview\n• A2.1 One\n• A2.2 Two\nA2.3 Three"
    assert one(spark, extraction.cover_page(F.lit(cover)), extraction.cover_page(F.lit("Chapter A2\nA2.1 One"))) == (True, False)
    assert one(spark, *[extraction.valid_section(F.lit(x)) for x in ("A2.1", "2.3", "a2", "A2.")]) == (True, True, False, False)
    table = F.from_json(F.lit(json.dumps([["Name", "Description", "Reset"], ["EN", "Must be set first", "0"], ["X", "free text", "1"], ["Y", "", ""]])), "array<array<string>>")
    assert one(spark, extraction.table_rules(table))[0] == ["EN | Must be set first | 0"]
    assert one(spark, extraction.encoding_rules(F.lit("0b00 INCR burst must wrap 0b01 FIXED nothing 0b10 WRAP It shall stop")))[0] == ["0b00 | INCR | burst must wrap", "0b10 | WRAP | It shall stop"]
    assert one(spark, extraction.without_headings(F.lit("A2.1 Title here\nbody\nTitle here more"), F.array(F.struct(F.lit("A2.1").alias("section_id"), F.lit("Title here").alias("title")))))[0].split() == ["body", "more"]
    layout = F.from_json(F.lit(json.dumps([{"spans": [{"text": "2.3 ", "size": 9.0}, {"text": "Channel Signals", "size": 12.0}]}, {"spans": [{"text": "2.4 Contents ..... 17", "size": 9.0}]}])), "array<struct<spans:array<struct<text:string,size:double>>>>")
    assert [tuple(h) for h in one(spark, extraction.headings_of_layout(layout))[0]] == [("2.3", "Channel Signals", 12.0)]
    rows = frame(spark, [(0, "It shall stall."), (1, "This chapter describes the interface."), (2, "It supports bursts.")], "pos int, text string")
    assert [r.pos for r in extraction.refine(rows).orderBy("pos").collect()] == [0, 2]
    assert tuple(extraction.refinement_counts(rows).first()) == (3, 2, 1)
    with pytest.raises(ValueError, match="1"):
        extraction.refine(frame(spark, [(0, "x"), (1, " "), (2, "y")], "pos int, text string"))
    assert one(spark, extraction.requirement_type(F.lit("The current timing")), extraction.requirement_type(F.lit("x"))) == ("Performance", "Functional")


def test_numbering_without_hot_windows(spark):
    rows = frame(spark, [(i, s) for i, s in enumerate(["A2.1_", None, " ", "A2.1_", "A2.1_", "-"])], "pos int, section string")
    assert [r.new_id for r in ordering.section_ids(rows, "section", ["pos"]).orderBy("pos").collect()] == ["REQ_A2_1_001", "REQ_UNKNOWN_001", "REQ_UNKNOWN_002", "REQ_A2_1_002", "REQ_A2_1_003", "REQ_UNKNOWN_003"]
    many = spark.range(500).select(F.col("id").alias("pos"), (F.col("id") % 3 == 0).alias("k"))
    assert {r.pos: r.n for r in ordering.ranked(many, ["k"], ["pos"]).collect()} == {i: i // 3 + 1 if i % 3 == 0 else i - i // 3 for i in range(500)}
    pairs = frame(spark, [(1, 3), (2, 9), (3, 5), (4, 11), (5, 7), (6, 13)], "a int, b int")
    assert tuple(ordering.most_common_offset(pairs, "a", "b", order="a").first()) == (2, 3)
    assert [r.batch for r in ordering.batches(rows, ["pos"], 4).orderBy("pos").collect()] == [0, 0, 0, 0, 1, 1]


def test_paragraphs():
    assert normalized("memory-\nmanage\u00admentﬁ  x\ny ,z\n\nw FENCE.I  0x10 ") == "memory-managementfi x y,z w FENCE.I 0x10"
    assert normalized(None) == ""


def version(spark, texts, pages=None):
    pages = pages or [1] * len(texts)
    return {"requirements": frame(spark, [(i, t, p, "A1") for i, (t, p) in enumerate(zip(texts, pages), 1)], "pos int, text string, page int, section string")}


def test_version_diff(spark):
    same, old, new = "The source shall keep VALID asserted.", "The buffer holds 16 entries of data at any time", "The buffer holds 32 entries of data at any time"
    a, b = version(spark, [same, old, "Gone entirely here."]), version(spark, ["Brand new sentence.", same, new])
    for v, n in ((a, "1"), (b, "2")):
        v["metadata"] = frame(spark, [("Version", n), ("author", n)], "key string, value string")
        v["sections"] = frame(spark, [(1, "A1", f"Title {n}"), (2, None, "Same"), (3, f"B{n}", "x")], "pos int, id string, title string")
        v["notes"] = frame(spark, [(1, "A note that moves about", int(n), "A1")], "pos int, text string, page int, section string")
        v["tables"] = frame(spark, [(1, "Name | Value\nA | " + n, "Name | Value", 1)], "pos int, table_text string, preview string, page int")
        v["cells"] = frame(spark, [(1, 1, ["Name", "Value"]), (1, 2, ["A", n])], "pos int, row int, cells array<string>")
        v["pages"] = frame(spark, [(i, i + (i > 1) * (n == "2"), f"page {w} says {w} and {w}s") for i, w in enumerate(["zero", "one", "two", "three", "four"])], "pos int, page int, text string")
    got = version_diff.compare(a, b)
    rows = got.orderBy("change_number").collect()
    assert [r.change_id for r in rows] == [f"CHG-{i:04d}" for i in range(1, len(rows) + 1)]
    seen = {(r.area, r.change_type, r.difference_category): r for r in rows}
    assert seen["metadata", "modified", "metadata_change"].identifier == "Version"
    assert {("section", "modified", "numeric_value_change"), ("section", "added", "section_added"), ("section", "removed", "section_removed")} <= set(seen)
    change = seen["requirement", "modified", "numeric_value_change"]
    assert (change.old_value, change.new_value, change.detail) == (old, new, "Changed '16' to '32'") and change.similarity_score > 0.9
    assert {("requirement", "removed", "requirement_removed"), ("requirement", "added", "requirement_added")} <= set(seen)
    assert seen["note", "moved", "note_moved"].detail == "Content unchanged"
    assert seen["table", "modified", "numeric_value_change"].detail == "Cell changed (row 2, col 2)"
    shift = seen["page", "moved", "structural_page_shift"]
    assert (shift.page_shift, shift.old_page, shift.new_page) == (1, "2–4", "3–5")
    areas = [r.area for r in rows]
    assert areas == sorted(areas, key=version_diff.AREAS.index)
    assert {r.bucket: r.n for r in version_diff.report_groups(got).collect()}["page_shifts"] == 1 and version_diff.report_groups(got).count() == 17


def test_table_differences(spark):
    cells = lambda rows: frame(spark, [(1, i, r) for i, r in enumerate(rows, 1)], "pos int, row int, cells array<string>")
    pair = frame(spark, [(1, 1)], "old_pos int, new_pos int")
    diffs = lambda a, b: [tuple(r)[2:] for r in version_diff.table_difference(cells(a), cells(b), pair).collect()]
    assert diffs([["a"], ["b"]], [["a"], ["b"], ["c", "d"]]) == [("Row added", "", "c | d", "Row 3: c | d")]
    assert diffs([["a"], ["b"]], [["a"]]) == [("Row removed", "b", "", "Row 2: b")]
    assert diffs([["a", "b"], ["c", "d"]], [["a", "x"], ["y", "d"]]) == [("2 cells changed", "[row 1, col 2] b\n[row 2, col 1] c", "[row 1, col 2] x\n[row 2, col 1] y", "Row 1: a | x")]
    assert diffs([["a"]], [["a"]]) == []


def test_reports_of_changes(spark, tmp_path):
    a, b = version(spark, ["The value must be 1 `now`."]), version(spark, ["The value must be 2 `now`.", "And | this\nmust hold."])
    got = version_diff.compare(a, b)
    sinks.change_csv(got, str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert lines[0] == ",".join(sinks.CHANGE_COLUMNS) and len(lines) == 3
    sinks.change_json(got, str(tmp_path / "json"))
    rows = [json.loads(x) for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
    assert sum(r["part"] == "changes" for r in rows) == 2 and sum(r["part"] == "grouped" and r["record"] is not None for r in rows) == 2
    sinks.change_markdown(got, str(tmp_path / "r.md"))
    text = (tmp_path / "r.md").read_text()
    assert text.count("<details>") == 2 and text.count("No changes.") == 15 and "🟡 modified" in text
    assert sinks.markdown_table(spark.range(1500)).count("\n") == 1501


def document(spark, **parts):
    empty = {
        "keys": "key string", "pages": "pos int, page_number int, text string", "requirements": "text string, category string, section string", "page_requirements": "text string, category string", "figures": "caption string",
        "page_figures": "page int, caption string", "tables": "page int, csv_file string, caption string", "table_captions": "page int, caption string", "cross_references": "reference string",
        "chunks": "pages array<string>, page string, page_start int, page_end int", "images": "page int",
    }
    return {k: frame(spark, parts.get(k, []), s) for k, s in empty.items()}


def test_quality(spark):
    texts = frame(spark, [(1, "Table 2.1 Signals\nARVALID must rise. See Section 2.3 and mstatus."), (2, "It shall stall the bus\nfor a cycle. Figure 3 x")], "page int, text string")
    doc = document(
        spark, keys=[(k,) for k in ("pages", "requirements", "notes", "other")], pages=[(1, 1, "Table 2.1 Signals\nARVALID must rise. See Section 2.3 and mstatus."), (2, 2, "It shall stall")],
        requirements=[("ARVALID must rise.", "Protocol", "2.3"), ("It shall stall the bus for a cycle.", "Protocol", None), ("never said", None, "x y")], tables=[(1, "t.csv", None), (9, None, "c")], table_captions=[(1, "Table 2.1 Signals")],
        cross_references=[("section 2.3",), ("Table 2.1",)], chunks=[(["1", "x"], None, None, None), (None, None, 2, 3)], figures=[("Figure 1",)], page_figures=[(1, "figure 1 ")], images=[(1,), (1,)],
    )
    c = {r.component: r.value for r in quality.completeness(doc, texts).collect()}
    assert c["required_json_field"] == 25.0 and c["page_coverage"] == 100.0 and c["requirement_recall"] == 100.0 and c["semantic_chunk_coverage"] == 100.0 and c["cross_reference_recall"] == 100.0
    assert {r.component: r.value for r in quality.completeness(doc, texts, literal_compat=True).collect()}["cross_reference_recall"] == 0.0
    assert c["record_field_completeness"] == pytest.approx((500 / 6 + 100 + 75) / 3)
    a = {r.component: r.value for r in quality.accuracy(doc, texts).collect()}
    assert a["requirement_traceability"] == pytest.approx(200 / 3) and a["page_number_accuracy"] == 100.0 and a["axi_signal_fidelity"] == 100.0 and a["riscv_csr_fidelity"] == 0.0
    assert {r.check: r.ok for r in quality.internal_checks(doc).collect()} == {"requirements_match_page_aggregation": False, "section_format_valid": False, "cross_references_resolve": True, "figures_match_page_aggregation": True, "tables_have_valid_pages": False}
    assert a["json_internal_consistency"] == 40.0 and a["category_consistency"] == 50.0
    gold = {r.component: r.value for r in quality.accuracy(doc, texts, doc).collect()}
    assert gold["requirement_f1"] == gold["figure_caption_f1"] == 100.0 and len(gold) == 5
    source = {"page_texts": texts, "tables": frame(spark, [(1, 1)], "page int, n long"), "images": frame(spark, [(1, 1)], "page int, n long")}
    t = {r.component: r.value for r in quality.capture(doc, source, frame(spark, [("t.csv",)], "csv_file string")).collect()}
    assert t["table_caption_f1"] == 100.0 and t["table_file_existence"] == 50.0 and t["table_detection_f1"] == pytest.approx(200 / 3) and t["image_capture_f1"] == pytest.approx(200 / 3)
    scores = frame(spark, [("x", 94.999), ("y", 95.0)], "component string, value double")
    assert [tuple(r) for r in quality.overall({"a": scores}).collect()] == [("a", 95.0, "fail"), ("overall", 95.0, "fail")]
    with pytest.raises(ValueError):
        quality.overall({"a": scores}, 101)
    assert one(spark, quality.category(F.lit("we scan")), quality.scored_category(F.lit("ARVALID pin")), quality.scored_category(F.lit("none"))) == ("Interface", "Protocol", "Functional")
    nested = frame(spark, [(None, None, None, None, 4), (None, None, 7, 7, 5)], "pages array<string>, page string, page_start int, page_end int, page_number int")
    assert {r.page for r in quality.covered_pages(quality.inherited(nested)).collect()} == {4, 7}


def test_traceability(spark):
    plan = frame(spark, [("t1", "R1", None, "x"), ("t2", None, " ", "bare"), ("t3", None, None, "see Table A2.1"), ("t4", None, "A9", "y"), ("t5", None, None, "REQ_NONE_1")], "test_id string, requirement_id string, section string, said string")
    assert tuple(traceability.headline(plan).first()) == (5, 3, 60.0)
    assert {r.test_id: r.traced for r in traceability.traced(plan).collect()} == {"t1": True, "t2": False, "t3": True, "t4": True, "t5": True}
    ids = lambda *x: frame(spark, [(i,) for i in x], "id string")
    known = traceability.source_ids(ids("R1"), ids("A1"), ids("A2.1"), ids(), frame(spark, [(3,)], "page_number int"))
    got = {r.item: r.linked for r in traceability.resolved(plan.select(F.col("test_id").alias("item")), traceability.trace_values(plan, "test_id"), known).collect()}
    assert got == {"t1": True, "t2": False, "t3": True, "t4": False, "t5": False}
    assert tuple(traceability.orphan_rate(plan, "test_id", known).first()) == (5, 3, 60.0)
    assert one(spark, traceability.bare_reference(F.lit(" Table A2.1 ")))[0] == "A2.1"


def test_verified_and_report(spark, tmp_path):
    spec = frame(spark, [("R1", "one"), ("R2", "two"), ("R3", "three"), (None, "four")], "requirement_id string, text string")
    plan = frame(spark, [("R1", "T1", "covered", True, ["R2", "X", "R1"], 0), ("R2", "T2", None, True, [], 1), ("R2", "T3", "uncovered", False, [], 2), ("Q", "T4", "covered", True, [], 3)], "requirement_id string, test_id string, coverage string, complete boolean, supporting_requirement_ids array<string>, pos int")
    edges = frame(spark, [("R3", 0, "E1")], "requirement_id string, pos int, edge_case_id string")
    weak = edges.limit(0).withColumnRenamed("edge_case_id", "word")
    labelled = linking.verified(spec, plan, edges, weak)
    got = {r.requirement_id: r for r in labelled.collect()}
    assert [got[i].verified_coverage_status for i in ("R1", "R2", "R3", None)] == ["Covered", "Partially covered", "Ambiguous / not yet plannable", "Ambiguous / not yet plannable"]
    assert got["R2"].coverage_verification_reason.endswith("because 1 linked row(s) lack complete executable test content; one or more complete tests have no recognised vPlan coverage label.")
    assert got[None].coverage_verification_reason == "Requirement has no identifiable requirement ID." and got["R1"].linked_tests == ["T1"] and got["R3"].linked_edge_cases[0].edge_case_id == "E1"
    support = {r.requirement_id: r for r in linking.supporting_records(labelled, spec.withColumn("pos", F.lit(0))).collect()}
    assert [x.id for x in support["R1"].records] == ["R2"] and support["R1"].invalid == ["X"]
    parts = coverage.final_report(spec, plan, labelled)
    assert tuple(parts["coverage_summary"].first()) == (4, 1, 1, 0, 2, 1) and tuple(parts["coverage_percentages"].first())[:2] == (50.0, 37.5)
    rich = coverage.enriched(parts, coverage.ambiguity_rate(spec, labelled), coverage.granularity_rate(frame(spec.sparkSession, [("suitable_detail",), ("unclear",), ("not_mapped",)], "label string")))
    assert rich["coverage_percentages"].first()["granularity_adequacy"] == 50.0 and rich["coverage_percentages"].first()["ambiguity_uncovered_rate"] == 25.0
    files = coverage.write_report(rich, str(tmp_path))
    assert set(files) == {"coverage_summary", "gap_report", "ambiguity_report", "supporting_metrics"} and spark.read.json(files["gap_report"]).count() == 3
    coverage.coverage_csv(labelled, str(tmp_path / "c.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c.csv")).where("overall_coverage = 37.5").count() == 4


def test_planning(spark):
    assert one(spark, planning.category(F.lit(" don't  stop now")), planning.category(F.lit(None))) == ("Don'T Stop", "Uncategorised")
    assert one(spark, planning.test_name(F.lit("check the AXI4 READY signal, twice/again.")), planning.fallback_name(F.lit("Verify the write response completion signal"), F.lit("x")), planning.fallback_name(F.lit(""), F.lit("edge"))) == ("Check The AXI4 READY Signal Twice/again", "The Write Response Completion Signal", "Edge Verification")
    assert one(spark, planning.usable_name(F.lit("TC_REQ 1")), planning.usable_name(F.lit("Some name")), planning.usable_category(F.lit("general "))) == (False, True, False)
    assert one(spark, planning.scenario(F.lit("Covered")), planning.clarification(F.lit("is Unspecified"), F.lit(True)), planning.file_title(F.lit("/a/" + "0" * 32 + "_axi-spec_requirements_only.json"))) == ("nominal", "Provide the missing signal, timing, configuration, or behavioural detail.", "Axi Spec")
    plan = frame(spark, [(0, "T1", "R1", "nominal", "Check A", "", "", "covered", ["s"], ["r"]), (1, "T2", "R1", "nominal", "check  a", "", "", "covered", ["s"], ["r"]), (2, "T3", "R2", "edge", "x", "Bus Access", "Good Name", "uncovered", ["s"], ["r"])], "pos int, test_id string, requirement_id string, scenario_type string, test_description string, category string, test_name string, coverage string, test_steps array<string>, expected_results array<string>")
    names = frame(spark, [("T1", "Bus Access", "Access Is Checked")], "test_id string, category string, test_name string")
    got = {r.test_id: (r.category, r.test_name, r.priority, r.test_steps) for r in planning.enriched(plan, names).collect()}
    assert got["T1"] == got["T2"] == ("Bus Access", "Access Is Checked", 3, ["s"]) and got["T3"] == ("Uncategorised", "", 3, [])
    assert [r.test_id for r in planning.incomplete_rows(plan.withColumn("test_steps", F.array(F.lit(" ")))).collect()] == ["T1", "T2"]
    legal = frame(spark, [("A", "x"), ("a", "y"), ("B", "z"), ("B", "z")], "category string, subcategory string")
    assert {r.error for r in planning.taxonomy_errors(legal).collect()} == {"duplicate parent", "duplicate subcategory"}
    assert planning.illegal_assignments(frame(spark, [("R", "b", "Z"), ("R", "b", "q")], "requirement_id string, category string, subcategory string"), legal).count() == 1
    ids = lambda *x: frame(spark, [(i,) for i in x], "requirement_id string")
    assert {tuple(r) for r in planning.id_differences(ids("a", "b"), ids("b", "b", "c")).collect()} == {("a", "missing"), ("c", "unexpected"), ("b", "repeated")}
    linked = frame(spark, [("R1", "T1"), ("R1", "T2")], "requirement_id string, test_id string")
    assert {(r.test_id, r.problem) for r in planning.unacknowledged(linked, frame(spark, [("R1", ["T2", "T9"])], "requirement_id string, linked_tests array<string>")).collect()} == {("T1", "missing"), ("T9", "unexpected")}
    rows = frame(spark, [(0, "R1", ["R2", "R1", "X", "R2"])], "pos int, requirement_id string, supporting_requirement_ids array<string>")
    assert planning.within_batch(rows, frame(spark, [("R1",), ("R2",)], "id string")).first()["supporting_requirement_ids"] == ["R2"]
    assert planning.with_text(rows, frame(spark, [(0, "R1", "old"), (1, "R1", "new")], "pos int, id string, text string")).first()["requirement_text"] == "new"
    assert planning.out_of_bounds(frame(spark, [("a", "x"), ("q", "x"), ("a", "")], "k string, t string"), {"k": ["a"]}, {"t": (1, 5)}).count() == 2
    assert one(spark, planning.selector(F.lit("c"), F.lit("Protocol"), F.lit("Data  Transfers")), planning.selector(F.lit(" Old Name"), F.lit("Uncategorised"), F.lit("y"))) == ("protocol::data transfers", "old name")
    assert [r.key for r in planning.keyed(frame(spark, [(1, "a"), (2, "a")], "pos int, k string"), F.col("k")).orderBy("pos").collect()] == ["a", "a:2"]
    assert [r.section for r in planning.only_section(frame(spark, [("A1", None), (" ", "A1")], "source_section string, section string")).collect()] == ["A1"]
    assert json.loads(planning.payloads(ids("R1"), linked.withColumn("pos", F.lit(0)), ["requirement_id"]).first()["payload"])["linked_vplan_items"] == [{"test_id": "T1"}, {"test_id": "T2"}]
    tests = frame(spark, [("P::a",), ("p::A",), ("q",)], "c string")
    assert [r.priority for r in usage.prioritise(tests, "c", ["p::a"], ["Q "]).collect()] == [1, 1, 2]
    for bad in ((["p::a"], []), (["p::a"], ["none"]), (["q"], ["q"])):
        with pytest.raises(ValueError):
            usage.prioritise(tests, "c", *bad)


def test_usage_log(spark, tmp_path):
    agents = [{"agent_name": "", "model_name": "m2", "prompt_tokens": None, "input_tokens": 5, "total_cost": "1.5"}, {"agent_name": "a", "model_name": "m1", "input_tokens": 7}]
    runs = [{"timestamp": "t", "summary": {"agents": agents, "input_tokens": 3, "total_cost": 2}}, {"summary": {}}]
    (tmp_path / "log.json").write_text(json.dumps(runs))
    log = envelopes.documents(spark, str(tmp_path / "log.json")).select(F.posexplode(F.try_variant_get("doc", "$", "array<variant>")).alias("pos", "run"))
    a, b = usage.runs_and_agents(log)
    assert [(r.run_id, r.models_used, r.prompt_tokens, r.total_cost) for r in a.orderBy("run_id").collect()] == [(1, "m1, m2", 3, 2.0), (2, "Unknown model", 0, 0.0)]
    assert {(r.agent_name, r.prompt_tokens, r.total_cost) for r in b.collect()} == {("Unknown agent", 0, 1.5), ("a", 7, 0.0)}
    assert {k: v.count() for k, v in usage.chart_series(a, b).items()} == {"cost_by_run": 2, "tokens_by_run": 2, "cost_by_agent": 2, "tokens_by_agent": 2}
    got = usage.merged(frame(spark, [("1", "2", "1,0", "$1.50"), ("4", None, "5", "x")], "prompt_tokens string, completion_tokens string, total_tokens string, total_cost string")).first()
    assert (got.prompt_tokens, got.completion_tokens, got.total_tokens, float(got.total_cost), got.number_of_batches) == (5, 2, 5, 1.5, 2)
    sinks.usage_csvs(a, b, str(tmp_path / "csv"))


def test_chapters(spark):
    rows = frame(spark, [(0, "1", "The bus shall stall. Figure A1.1", "A1.1", None), (1, "2", "the bus shall stall", "A1.1", "figure"), (2, "3", "Figure A1.2 shows it", "A1.1", None), (3, "4", "x", None, None)], "pos int, id string, text string, source_section string, source_kind string")
    got = chapters.merged_requirements(rows).orderBy("pos").collect()
    assert [(r.original_id, r.new_id, r.n, [e.original_id for e in r.evidence]) for r in got] == [("1", "REQ_A1_1_001", 2, ["2"]), ("4", "REQ_REQ_001", 1, [])]
    assert [r.chapter for r in chapters.chapters(frame(spark, [("A10.1",), ("A2.3",), ("A2",)], "s string"), "s").orderBy("place").collect()] == ["A2", "A10"]
    assert one(spark, chapters.in_chapter(F.lit("A2.1"), "A2"), chapters.in_chapter(F.lit("A21"), "A2"), chapters.section_of_id(F.lit("req_a2_01_003")), chapters.section_of_id(F.lit("x")), chapters.shown_cost(F.lit("1.5")), chapters.shown_cost(F.lit(None).cast("string")), chapters.label(F.lit("a_bc"))) == (True, False, "A2.1", "Other", "$1.5000", "—", "A Bc")
    assert one(spark, chapters.highlighted(F.lit("may be, maybe May"), ["may", "may be"]))[0] == "**may be**, maybe **May**"
    parts = {
        "sections": frame(spark, [("A2", None), ("A2.1", "A2"), ("B1", None)], "id string, parent string"), "headings": frame(spark, [("A2.1", 2), ("B1", 3)], "section_id string, page int"), "pages": frame(spark, [(1, "Chapter A2\nSignals and BUS"), (2, "DMA"), (3, "CPU")], "page int, text string"),
        "requirements": rows.select("id", F.lit("A2.1").alias("source_section")), "tables": frame(spark, [(2,), (3,)], "page int"), "acronyms": frame(spark, [("DMA",), ("CPU",)], "acronym string"),
    }
    assert {k: v.count() for k, v in chapters.chapter_subset(parts, "A2").items()} == {"sections": 2, "headings": 1, "pages": 2, "requirements": 4, "tables": 1, "acronyms": 1}
    assert {(r.chapter, r.title, r.n) for r in chapters.chapter_options(parts["sections"], parts["pages"]).collect()} == {("A2", "Signals and BUS", 2), ("B1", "B1", 1)}
    plan = frame(spark, [("T2", 1, "nominal", "c", "P", "s"), ("T1", 1, "edge", "c", None, None)], "test_id string, priority int, scenario_type string, category string, requirement_category string, requirement_subcategory string")
    assert [r.test_id for r in chapters.faceted(plan, "t", priority=1, scenario_type="all").collect()] == ["T1", "T2"] and chapters.faceted(plan, "", scenario_type="edge").count() == 1
    assert {tuple(r) for r in chapters.category_options(plan).collect()} == {("P", "s", "P::s"), ("Legacy test categories", "c", "c")}
    issues = frame(spark, [("A1", "R1", "weak", ["may"]), ("A1", "R2", "weak", ["can"]), (None, "R3", "m", [])], "source_section string, requirement_id string, issue_type string, matched_words array<string>")
    assert {r.section: len(r.requirements) for r in chapters.grouped_issues(issues).collect()} == {"A1": 2, "Other": 1}
    texts = chapters.requirement_texts(frame(spark, [(0, "R1", "a"), (1, "R1", "b")], "pos int, requirement_id string, text string"), frame(spark, [(0, "R1", "z"), (1, "R2", "y")], "pos int, requirement_id string, requirement_text string"))
    assert {tuple(r) for r in texts.collect()} == {("R1", "b"), ("R2", "y")}


def test_lint_report(spark):
    rows = frame(spark, [("REQ_a2_1_003", "It may stall.", "It may stall."), (None, "No.", None), ("R3", " ", None)], "id string, text string, description string")
    got = lint.language_report(rows)
    seen = {(r.requirement_id, r.source_section, r.issue_type) for r in got.collect()}
    assert seen == {("REQ_a2_1_003", "A2.1.003", lint.WEAK), ("REQ_a2_1_003", "A2.1.003", lint.MISSING), ("UNKNOWN", None, lint.MISSING)}
    assert [r.id for r in lint.flagged(rows, got).collect()] == ["REQ_a2_1_003"]
    assert lint.summary_lines(got, 1)[-1].startswith("... 2 additional")
    assert one(spark, folded(F.lit(" A - b\n")), folded(F.lit("Straße")), title_case(F.lit("don't x1y"))) == ("a - b", "strasse", "Don'T X1Y")


def test_consensus_order(spark):
    rows = frame(spark, [(2, "High", None, "b"), (2, "High", 3, "a"), (3, "Low", 9, "c")], "votes int, confidence string, page_a int, title string")
    assert [r.title for r in consensus.listed(rows).collect()] == ["c", "a", "b"]
    assert consensus.majority(6) == 4
    with pytest.raises(ValueError):
        consensus.majority(3)


def test_files(spark, tmp_path):
    folder = tmp_path / "doc"
    (folder / "t").mkdir(parents=True)
    (folder / "document.json").write_text('{"requirements": [{"id": "REQ_1", "sub": [{"id": "REQ_1"}, {"id": "X"}]}], "tables": [], "edge_cases": [{"id": 3}]}')
    (folder / "t" / "a.csv").write_text("\ufeffName,Value\n ,\nA  b, 1 - 2\n")
    docs = envelopes.documents(spark, str(folder), must_be_object=True)
    assert [r.n for r in envelopes.duplicate_nested_ids(docs).collect()] == [2]
    assert envelopes.records(docs, "strict").count() == 1 and envelopes.records(docs, "evidence").select(envelopes.field("id")).first()[0] == "3"
    with pytest.raises(ValueError):
        envelopes.records(docs, "plan")
    with pytest.raises(FileNotFoundError):
        envelopes.documents(spark, str(tmp_path / "none.json"))
    assert {r.key for r in envelopes.keys(docs).collect()} == {"requirements", "tables", "edge_cases"}
    assert [r.cells for r in envelopes.table_rows(spark, str(folder / "t" / "a.csv")).orderBy("row").collect()] == [["Name", "Value"], ["A b", "1-2"]]
    assert envelopes.table_rows(spark, str(folder / "t" / "b.csv")).count() == 0
    assert paths.contained("/a/b", "c/../d") == "/a/b/d" and paths.contained("/a/b", "../c") == "" and paths.contained("/a/b", "/a/bc") == ""
    assert paths.existing(spark, str(folder), ["t/a.csv", "t/none.csv", "../x"]) == ["t/a.csv"]
    assert paths.by_name(spark, str(tmp_path), "a.csv").endswith("/doc/t/a.csv")
    (folder / "a.csv").write_text("x")
    with pytest.raises(ValueError):
        paths.by_name(spark, str(tmp_path), "a.csv")
    (folder / "document.pdf").write_text("x")
    assert paths.pdf_beside(spark, str(folder / "document.json"), "none.pdf").endswith("document.pdf")
    with pytest.raises(ValueError):
        paths.require(spark, {"a": None})
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        envelopes.documents(spark, str(tmp_path / "list.json"), must_be_object=True)
    groups, _ = envelopes.parse_terms("[a]\nX\nx")
    assert groups == {"a": ["x"]}
    with pytest.raises(ValueError):
        envelopes.require_groups(groups, {"a", "b"})
    with pytest.raises(ValueError):
        envelopes.parse_terms("[regex_patterns]\na=b\na=c")
    tables = frame(spark, [(1, 1, 1, ["a", 'q"']), (1, 1, 2, ["b", None])], "page int, n int, row int, cells array<string>")
    sinks.table_csvs(tables, str(tmp_path / "tables"), "spec")
    assert next((tmp_path / "tables" / "table=spec_table_p1_1").glob("*.txt")).read_text() == '"a","q"""\n"b",""\n'
    assert re.fullmatch(r"\d\d:\d\d[ap]m", one(spark, sinks.stamp()["time_created"])[0])


def test_tied_candidates_match_one_by_one(spark):
    rows = [(i, j, 1, j, 0.9, "", "") for i in range(8) for j in range(8)]
    pairs = frame(spark, rows, "old_pos long, new_pos long, token_score long, rank int, similarity double, old_text string, new_text string")
    assert {(r.old_pos, r.new_pos) for r in diff.one_to_one(pairs).collect()} == {(i, i) for i in range(8)}
