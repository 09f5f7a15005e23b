"""The deterministic part of plan generation: categories, names, batches, checks of returned rows.

What a model returns (taxonomy, assignments, plan rows, edge cases, names, assessments) is an input table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, present, strip, title_case, words
from . import linking
from .ordering import first_seen

UNCATEGORISED = "Uncategorised"
UNUSABLE_CATEGORIES = ["", "uncategorised", "uncategorized", "general", "other", "miscellaneous", "verification", "protocol"]
CLARIFICATIONS = [
    (["implementation-dependent", "implementation dependent"], "Confirm implementation-specific configuration before verification."),
    (["not define observable", "pass/fail"], "Define observable pass/fail criteria for this requirement."),
    (["not specified", "unspecified"], "Provide the missing signal, timing, configuration, or behavioural detail."),
]
_EDGE_CASE, _REVIEW = "Clarify the edge-case behaviour before treating this requirement as fully testable.", "Review requirement wording and provide enough detail for verification."
EDGE_CASE_TYPES_COLUMN = "edge_case_type"


# Names and categories


def category(c: Column) -> Column:
    """At most two words in title case; blank is Uncategorised."""
    return F.coalesce(F.nullif(title_case(F.array_join(F.slice(words(c), 1, 2), " ")), F.lit("")), F.lit(UNCATEGORISED))


def requirement_category(*fields: Column) -> Column:
    """The first filled field, white space collapsed, 80 characters at most; none is Uncategorised."""
    flat = [F.array_join(words(c.cast("string")), " ") for c in fields]
    return F.coalesce(*[F.nullif(F.substring(c, 1, 80), F.lit("")) for c in flat], F.lit(UNCATEGORISED))


def first_filled(values: Column) -> Column:
    """Of an array of strings, the first that is not blank."""
    return F.get(F.filter(values, present), F.lit(0))


def test_name(c: Column) -> Column:
    """At most eight words; words with a digit or in capitals stay, others get a capital."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)[^\w\- /]", ""), r"^[ .\-_/]+|[ .\-_/]+$", "")
    keep = lambda w: w.rlike(r"(?U)\p{Nd}") | ((F.upper(w) == w) & (F.lower(w) != w))
    one = lambda w: F.when(keep(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.array_join(F.transform(F.slice(words(bare), 1, 8), one), " ")


def fallback_name(description: Column, scenario: Column) -> Column:
    """A name from the description, its leading verb left out; else from the scenario."""
    body = F.regexp_replace(strip(F.coalesce(description, F.lit(""))), r"(?i)^(verify|check|confirm|ensure|validate|test)(?:\s+that)?\s+", "")
    return F.coalesce(F.nullif(test_name(body), F.lit("")), F.concat(title_case(F.coalesce(scenario, F.lit("Verification"))), F.lit(" Verification")))


def identifier_like(name: Column, *ids: Column) -> Column:
    low = folded(test_name(name))
    hit = low.rlike(r"^(?:tc|test)[ _-]?(?:req|case|id)(?:[ _-]|$)")
    for i in ids:
        hit = hit | F.coalesce((low == F.lower(strip(i.cast("string")))) & (i.cast("string") != ""), F.lit(False))
    return hit


def usable_category(c: Column) -> Column:
    return ~F.lower(category(c)).isin(UNUSABLE_CATEGORIES)


def usable_name(name: Column, *ids: Column) -> Column:
    return (F.size(words(test_name(name))) >= 2) & ~identifier_like(name, *ids)


def fingerprint(*fields: Column) -> Column:
    """Equal for rows whose fields differ in case and white space only."""
    return F.concat_ws("|", *[folded(c.cast("string")) for c in fields])


def enriched(plan: DataFrame, names: DataFrame, order: str = "pos") -> DataFrame:
    """plan rows with category, test_name and priority 3. Usable ones a row has stay; else those that
    `names` (test_id, category, test_name) gives the first row of its fingerprint; else what the row has, and
    a name from its description. Uncovered rows are cleared. names for one row reach all equal rows."""
    own = usable_category(F.col("category")) & usable_name(F.col("test_name"), F.col("test_id"), F.col("requirement_id"))
    marked = plan.withColumns({"_own": own, "_print": fingerprint(F.col("scenario_type"), F.col("test_description"))})
    lead = first_seen(marked.where("not _own").select("_print", order, "test_id"), F.col("_print"), [order])
    given = lead.join(linking.first_wins(names, ["test_id"], ["category", "test_name"]).select("test_id", F.col("category").alias("_category"), F.col("test_name").alias("_name")), "test_id").select("_print", "_category", "_name")
    out = marked.join(given, "_print", "left")
    some = lambda c: F.nullif(strip(c), F.lit(""))
    bare = F.lower(strip(F.coalesce("coverage", F.lit("")))) == "uncovered"
    kind = F.when(F.col("_own"), category(F.col("category"))).otherwise(F.coalesce(some(F.col("_category")), category(F.col("category"))))
    name = F.when(F.col("_own"), test_name(F.col("test_name"))).otherwise(F.coalesce(some(F.col("_name")), fallback_name(F.col("test_description"), F.col("scenario_type"))))
    from .usage import clear_uncovered

    return clear_uncovered(out.withColumns({"category": F.when(bare, UNCATEGORISED).otherwise(kind), "test_name": F.when(bare, "").otherwise(name), "priority": F.lit(3)}).select(*plan.columns, *[c for c in ("category", "test_name", "priority") if c not in plan.columns]))


# Taxonomy and assignments


def taxonomy_errors(taxonomy: DataFrame) -> DataFrame:
    """taxonomy (category, subcategory). Parents that repeat under other spelling, and subcategories that
    repeat within a parent: (category, subcategory, error). None is a valid taxonomy."""
    flat = taxonomy.select(F.array_join(words(F.col("category")), " ").alias("category"), F.array_join(words(F.col("subcategory")), " ").alias("subcategory"))
    parents = flat.select("category", F.lower("category").alias("k")).distinct().groupBy("k").agg(F.min("category").alias("category"), F.count("*").alias("n")).where("n > 1")
    children = flat.groupBy("category", "subcategory").count().where("count > 1")
    return parents.select("category", F.lit(None).cast("string").alias("subcategory"), F.lit("duplicate parent").alias("error")).union(children.select("category", "subcategory", F.lit("duplicate subcategory")))


def assigned(requirements: DataFrame, assignments: DataFrame, taxonomy: DataFrame, on: str = "id") -> DataFrame:
    """requirements with requirement_category and requirement_subcategory in the taxonomy's spelling;
    without a legal assignment both are Uncategorised."""
    legal = taxonomy.select(F.lower("category").alias("_p"), F.lower("subcategory").alias("_c"), F.col("category").alias("_parent"), F.col("subcategory").alias("_child"))
    got = assignments.select(F.col("requirement_id").alias(on), F.lower("category").alias("_p"), F.lower("subcategory").alias("_c")).join(legal, ["_p", "_c"]).groupBy(on).agg(F.min(F.struct("_parent", "_child")).alias("_a"))
    out = requirements.join(got, on, "left")
    return out.withColumns({"requirement_category": F.coalesce("_a._parent", F.lit(UNCATEGORISED)), "requirement_subcategory": F.coalesce("_a._child", F.lit(UNCATEGORISED))}).drop("_a")


def illegal_assignments(assignments: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Assignments whose parent, or whose subcategory under it, the taxonomy does not have."""
    legal = taxonomy.select(F.lower("category").alias("_p"), F.lower("subcategory").alias("_c"))
    return assignments.withColumns({"_p": F.lower("category"), "_c": F.lower("subcategory")}).join(legal, ["_p", "_c"], "left_anti").drop("_p", "_c")


# Checks of what came back


def id_differences(expected: DataFrame, returned: DataFrame, on: str = "requirement_id") -> DataFrame:
    """(id, problem): missing, unexpected or repeated. None means that each id came back exactly once."""
    a, b = expected.select(F.col(on).cast("string").alias("id")).where("id is not null").distinct(), returned.select(F.col(on).cast("string").alias("id"))
    tag = lambda df, p: df.select("id", F.lit(p).alias("problem"))
    return tag(a.join(b, "id", "left_anti"), "missing").union(tag(b.distinct().join(a, "id", "left_anti"), "unexpected")).union(tag(b.groupBy("id").count().where("count > 1"), "repeated"))


def unacknowledged(linked: DataFrame, assessments: DataFrame) -> DataFrame:
    """linked (requirement_id, test_id), assessments (requirement_id, linked_tests): tests that an assessment
    leaves out or adds: (requirement_id, test_id, problem)."""
    said = assessments.select("requirement_id", F.explode("linked_tests").alias("test_id")).distinct()
    own = linked.select("requirement_id", "test_id").where("test_id is not null").distinct().join(assessments.select("requirement_id").distinct(), "requirement_id", "left_semi")
    keys = ["requirement_id", "test_id"]
    return own.join(said, keys, "left_anti").withColumn("problem", F.lit("missing")).union(said.join(own, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def plan_check(requirements: DataFrame, plan: DataFrame) -> DataFrame:
    """(problem, id, n) of requirements (id) and plan rows (requirement_id, test_id): requirements without a
    row, rows of unknown requirements, repeated test ids, requirements of several tests, rows without an id."""
    filled = lambda df, c: df.select(F.col(c).cast("string").alias("id")).where("id <> ''")
    known, named = filled(requirements, "id"), filled(plan, "requirement_id")
    row = lambda df, problem, n: df.select(F.lit(problem).alias("problem"), "id", n.cast("long").alias("n"))
    many = lambda df: df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    nameless = lambda df, c, p: df.where(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").agg(F.count("*").alias("n")).where("n > 0").select(F.lit(p).alias("problem"), F.lit(None).cast("string").alias("id"), "n")
    one = F.lit(1)
    return (
        row(known.distinct().join(named, "id", "left_anti"), "missing", one).union(row(named.distinct().join(known, "id", "left_anti"), "unexpected", one)).union(row(many(filled(plan, "test_id")), "duplicate_test", F.col("n")))
        .union(row(many(named), "several_tests", F.col("n"))).union(nameless(requirements, "id", "requirement_without_id")).union(nameless(plan, "requirement_id", "row_without_id"))
    )


def nameless_tests(plan: DataFrame, order: str = "pos") -> DataFrame:
    """Places of rows without a test id: a plan that has any is not valid."""
    return plan.where(F.coalesce(F.col("test_id").cast("string"), F.lit("")) == "").select(order)


# Rows and their constraints


def with_text(plan: DataFrame, requirements: DataFrame, columns: dict[str, str] | None = None, on: str = "requirement_id", order: str = "pos") -> DataFrame:
    """plan rows with fields of their requirement (columns: field to new name); absent is empty. Of
    requirements that repeat an id the last one counts."""
    columns = columns or {"text": "requirement_text"}
    last = requirements.where(F.col("id").isNotNull()).groupBy(F.col("id").alias(on)).agg(F.max_by(F.struct(*[F.col(a).alias(b) for a, b in columns.items()]), order).alias("_r"))
    out = plan.join(last, on, "left")
    return out.withColumns({b: F.coalesce(F.col(f"_r.{b}"), F.lit("")) for b in columns.values()}).drop("_r")


def of_batch(edge_cases: DataFrame, batch: DataFrame) -> DataFrame:
    """Edge cases of the requirements of a batch."""
    return edge_cases.join(batch.select(F.col("id").alias("requirement_id")).distinct(), "requirement_id", "left_semi")


def incomplete_rows(plan: DataFrame) -> DataFrame:
    """Rows that are not uncovered and lack a description, a step or a result: not to be accepted."""
    bare = F.lower(strip(F.coalesce("coverage", F.lit("")))) == "uncovered"
    return plan.where(~bare & ~linking.complete_test(F.col("test_description"), F.col("test_steps"), F.col("expected_results")))


def scenario(c: Column, labels: tuple[str, ...] = ("covered", "partially_covered", "uncovered")) -> Column:
    """A coverage label where a scenario belongs becomes nominal."""
    return F.when(F.lower(strip(c)).isin(*labels), "nominal").otherwise(c)


def out_of_bounds(rows: DataFrame, allowed: dict[str, list[str]] | None = None, lengths: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Rows with a value outside of its list, or of a length outside of its bounds (arrays: of elements)."""
    bad = F.lit(False)
    for name, values in (allowed or {}).items():
        bad = bad | ~F.coalesce(F.col(name).isin(values), F.lit(False))
    for name, (low, high) in (lengths or {}).items():
        size = F.size(name) if rows.schema[name].dataType.typeName() == "array" else F.length(name)
        bad = bad | ~F.coalesce(size.between(low, high), F.lit(False))
    return rows.where(bad)


def within_batch(plan: DataFrame, batch: DataFrame, order: str = "pos") -> DataFrame:
    """supporting_requirement_ids cut down to ids of the batch (id), not the row's own, sorted, each once."""
    cited = plan.select(order, "requirement_id", F.explode(F.array_distinct("supporting_requirement_ids")).alias("id")).where(F.col("id").isNotNull() & ~F.col("id").eqNullSafe(F.col("requirement_id")))
    kept = cited.join(batch.select("id").distinct(), "id", "left_semi").groupBy(order).agg(F.array_sort(F.collect_set("id")).alias("_ids"))
    return plan.join(kept, order, "left").withColumn("supporting_requirement_ids", F.coalesce("_ids", F.array().cast("array<string>"))).drop("_ids")


# Reports on plan rows


def clarification(constraints: Column, has_edge_case: Column) -> Column:
    """What an engineer has to clarify: the first rule whose terms occur, then edge cases, then the wording."""
    low, out = F.lower(F.coalesce(constraints, F.lit(""))), F.when(has_edge_case, _EDGE_CASE).otherwise(_REVIEW)
    for found, said in reversed(CLARIFICATIONS):
        hit = F.lit(False)
        for t in found:
            hit = hit | low.contains(t)
        out = F.when(hit, said).otherwise(out)
    return out


def uncovered_report(plan: DataFrame, edge_cases: DataFrame, order: str = "pos") -> DataFrame:
    """Uncovered and partially covered rows with the reason, the clarification and their edge cases."""
    some = edge_cases.where("cast(requirement_id as string) <> ''")
    per = linking.nest(some, "requirement_id", [order], ["edge_case_id", "edge_case_type", "edge_case_description"], "related_edge_cases")
    out = plan.where(F.col("coverage").isin("uncovered", "partially_covered")).join(per, "requirement_id", "left")
    has = F.coalesce(F.size("related_edge_cases") > 0, F.lit(False))
    return out.select("test_id", "requirement_id", "coverage", F.coalesce("test_description", F.lit("")).alias("test_description"), F.col("test_constraints").alias("reason"), clarification(F.col("test_constraints"), has).alias("required_clarification"), "related_edge_cases", order)


def links(plan: DataFrame, order: str = "pos") -> DataFrame:
    """Per requirement its test ids in order, and the sorted distinct ids they cite in support."""
    rows = plan.where("cast(requirement_id as string) <> '' and cast(test_id as string) <> ''")
    cited = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list("supporting_requirement_ids")), lambda x: x != "")))
    return rows.groupBy("requirement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "test_id"))), lambda x: x["test_id"]).alias("test_ids"), cited.alias("supporting_requirement_ids"))


def link_cells(found: DataFrame) -> DataFrame:
    """links as two columns for a CSV file, the second a JSON object with a space after each mark."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)), ", "), F.lit("]"))
    return found.select("requirement_id", F.concat(F.lit('{"test_ids": '), listed("test_ids"), F.lit(', "supporting_requirement_ids": '), listed("supporting_requirement_ids"), F.lit("}")).alias("related_tests"))


# Priorities


def selector(category_: Column, requirement_category_: Column, subcategory: Column) -> Column:
    """What a priority selects a row by: parent::child, or the row's own category without a hierarchy."""
    flat = lambda c: F.array_join(words(F.lower(c)), " ")
    parent, child = strip(F.coalesce(requirement_category_, F.lit(""))), strip(F.coalesce(subcategory, F.lit("")))
    return F.when((parent != "") & (F.lower(parent) != "uncategorised") & (child != ""), flat(F.concat(parent, F.lit("::"), child))).otherwise(flat(F.coalesce(category_, F.lit(""))))


def selectors(plan: DataFrame, by: Column) -> DataFrame:
    return plan.select(by.alias("selector")).where("selector <> ''").distinct()


def priority_order(plan: DataFrame, order: str = "pos") -> DataFrame:
    return plan.orderBy("priority", "test_id", order)


# Names of a plan


def file_title(c: Column) -> Column:
    """A specification's name from its file name."""
    name = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    for pattern in (r"(?i)^[a-f0-9]{32}_", r"(?i)_requirements_only$", r"(?i)_extracted_chapter(?:\(\d+\))?$"):
        name = F.regexp_replace(name, pattern, "")
    return F.coalesce(F.nullif(title_case(F.array_join(words(F.translate(name, "_-", "  ")), " ")), F.lit("")), F.lit("Specification"))


def only_section(requirements: DataFrame) -> DataFrame:
    """(section): the one that all requirements with a section share, else null."""
    some = [F.nullif(strip(F.col(c)), F.lit("")) for c in ("source_section", "section", "section_id") if c in requirements.columns]
    got = requirements.select(F.coalesce(*some).alias("s")).agg(F.count_distinct("s").alias("n"), F.min("s").alias("s"))
    return got.select(F.when(F.col("n") == 1, F.col("s")).alias("section"))


def display_name(name: Column, section: Column) -> Column:
    return F.concat_ws(" ", name, F.when(section != "", F.concat(F.lit("Section "), section)), F.lit("Verification Plan"))


def keyed(rows: DataFrame, key: Column, order: str = "pos") -> DataFrame:
    """rows with `key`; a later row of the same key gets its place behind it."""
    w = Window.partitionBy("key").orderBy(order)
    out = rows.withColumn("key", key).withColumn("_n", F.row_number().over(w))
    return out.withColumn("key", F.when(F.col("_n") == 1, F.col("key")).otherwise(F.concat("key", F.lit(":"), F.col(order).cast("string")))).drop("_n")


def payloads(requirements: DataFrame, linked: DataFrame, fields: list[str], on: str = "requirement_id", order: str = "pos") -> DataFrame:
    """What a reviewer is sent: (on, payload), JSON of the requirement's fields and its plan rows in order."""
    per = linking.nest(linked, on, [order], [c for c in linked.columns if c not in (on, order)], "linked_vplan_items")
    out = requirements.join(per, on, "left")
    return out.select(on, F.to_json(F.struct(F.struct(*fields).alias("requirement"), "linked_vplan_items")).alias("payload"))
