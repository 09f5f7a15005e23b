"""Writing results. All writers are distributed; a report's single file is asked for explicitly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """Columns in order, missing ones empty, arrays joined by a comma and a space, structs as JSON."""
    def cell(name: str):
        if name not in df.columns:
            return F.lit("").alias(name)
        kind = df.schema[name].dataType.typeName()
        c = F.col(name)
        c = F.array_join(c, ", ") if kind == "array" and df.schema[name].dataType.elementType.typeName() == "string" else F.to_json(c) if kind in ("array", "struct", "map") else c
        return F.coalesce(c.cast("string"), F.lit("")).alias(name)

    out = df.select(*map(cell, columns))
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends without reading what is there."""
    df.write.mode("append").json(path)


def cell(value) -> str:
    return str(value if value is not None else "").replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame) -> str:
    """A table of all rows, for frames that a person reads: the caller's frame has few."""
    line = lambda cells: "| " + " | ".join(map(cell, cells)) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, df.toLocalIterator())])


CHANGE_COLUMNS = "change_id area change_type difference_category identifier section page old_page new_page page_shift preview display_title old_value new_value detail similarity similarity_score".split()
_BADGES = {"added": "🟢 added", "removed": "🔴 removed", "modified": "🟡 modified", "moved": "🔵 moved"}


def change_csv(changes: DataFrame, path: str) -> None:
    """Changes in their order as one CSV file of fixed columns; absent values are empty."""
    write_csv(changes.orderBy("change_number"), path, CHANGE_COLUMNS, single=True)


def change_json(changes: DataFrame, path: str) -> None:
    """Counts by area, type and category, changes by report group, and all of them, one JSON record a line:
    (part, heading, label, record). A table of records has no size that one value would have to hold."""
    from ..operators import version_diff as v

    layout = v.report_groups(changes)
    row = F.to_json(F.struct("change_id", *[c for c in CHANGE_COLUMNS if c != "change_id"]))
    none = F.lit(None).cast("string")
    summary = v.counts(changes).select(F.lit("summary").alias("part"), F.col("by").alias("heading"), F.col("value").alias("label"), F.to_json(F.struct("n")).alias("record"))
    grouped = layout.select("heading", "label", "bucket").join(changes.withColumn("bucket", v.bucket(changes)), "bucket", "left").select(F.lit("grouped"), "heading", "label", F.when(F.col("change_id").isNotNull(), row))
    write_json(summary.union(grouped).union(changes.select(F.lit("changes"), none, none, row)), path)


def _fence(text: str) -> str:
    """A fence longer than any run of backticks in the text."""
    import re

    longest = max(map(len, re.findall("`+", text)), default=0)
    mark = "`" * max(3, longest + 1)
    return f"{mark}text\n{text}\n{mark}"


def change_markdown(changes: DataFrame, path: str, title: str = "Version differences") -> None:
    """A report with counts, contents and a folded card per change, in report groups and by page. It is
    written line by line as rows stream in; groups without a change say so."""
    from ..operators import version_diff as v

    groups = v.report_groups(changes).orderBy("place").collect()  # a fixed number of groups
    with open(path, "w", encoding="utf-8") as out:
        print(f"# {title}\n\n{markdown_table(v.counts(changes))}\n\n## Contents\n", file=out)
        for g in groups:
            print(f"- [{g.heading}: {g.label}](#{g.bucket}) ({g.n})", file=out)
        heading = None
        for g in groups:
            if g.heading != heading:
                print(f"\n## {g.heading}", file=out)
                heading = g.heading
            print(f'\n### <a id="{g.bucket}"></a>{g.label}\n', file=out)
            if not g.n:
                print("No changes.", file=out)
                continue
            for r in v.by_page(changes.where(v.bucket(changes) == g.bucket)).toLocalIterator():
                where = ", ".join(f"{n} {x}" for n, x in (("section", r.section), ("page", r.page or r.new_page or r.old_page)) if x)
                print(f"<details><summary>{r.change_id} {_BADGES.get(r.change_type, r.change_type)}: {cell(r.identifier)[:200]}{f' ({where})' if where else ''}</summary>\n", file=out)
                print(f"{r.detail or ''} [{r.difference_category}, similarity {r.similarity}]\n", file=out)
                for label, value in (("Old", r.old_value), ("New", r.new_value)):
                    if value:
                        print(f"{label}:\n\n{_fence(value)}\n", file=out)
                print("</details>\n", file=out)


def table_csvs(tables: DataFrame, folder: str, prefix: str) -> None:
    """tables (page, n, row, cells): a folder per table, <prefix>_table_p<page>_<n>, with its rows as CSV."""
    name = F.concat(F.lit(f"{prefix}_table_p"), F.col("page").cast("string"), F.lit("_"), F.col("n").cast("string"))
    line = F.array_join(F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    tables.withColumn("table", name).repartition("table").sortWithinPartitions("table", "row").select("table", line.alias("value")).write.mode("overwrite").partitionBy("table").text(folder)


def document_json(entities: dict[str, DataFrame], folder: str) -> None:
    """A document as a folder of its entities, one table of JSON records each."""
    for name, df in entities.items():
        write_json(df, f"{folder}/{name}")


def requirements_json(requirements: DataFrame, folder: str) -> None:
    """Refined requirements, and how many there were before."""
    from ..operators import extraction

    write_json(extraction.refine(requirements), f"{folder}/requirements")
    write_json(extraction.refinement_counts(requirements), f"{folder}/refinement_summary", single=True)


def language_json(issues: DataFrame, folder: str, source_file: str | None = None) -> None:
    write_json(issues, f"{folder}/issues")
    write_json(issues.agg(F.count("*").alias("number_of_language_issues")).withColumn("source_file", F.lit(source_file)), f"{folder}/summary", single=True)


def uncovered_json(report: DataFrame, folder: str) -> None:
    """planning.uncovered_report in its two parts, and their numbers."""
    write_json(report.where("coverage = 'uncovered'"), f"{folder}/uncovered_tests")
    write_json(report.where("coverage = 'partially_covered'"), f"{folder}/partially_covered_tests")
    write_json(report.agg(F.count_if(F.col("coverage") == "uncovered").alias("number_of_uncovered_tests"), F.count_if(F.col("coverage") == "partially_covered").alias("number_of_partially_covered_tests")).withColumns(stamp()), f"{folder}/metadata", single=True)


def prioritised_json(plan: DataFrame, folder: str, first: list[str], second: list[str]) -> None:
    """A prioritised plan by priority and test id, and what was selected."""
    write_json(plan.orderBy("priority", "test_id"), f"{folder}/feature_list")
    meta = plan.sparkSession.range(1).select(F.lit(True).alias("prioritised"), F.array(*map(F.lit, first)).alias("priority_1_categories"), (F.array(*map(F.lit, second)) if second else F.array().cast("array<string>")).alias("priority_2_categories"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("prioritised_at"))
    write_json(meta, f"{folder}/metadata", single=True)


def duplicates_text(duplicates: DataFrame, path: str) -> None:
    """duplicates (id, n) as lines of text."""
    duplicates.orderBy("id").select(F.concat("id", F.lit(": "), F.col("n").cast("string"), F.lit(" times")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def usage_csvs(runs: DataFrame, agents: DataFrame, folder: str) -> None:
    write_csv(runs.orderBy("run_id"), f"{folder}/usage_by_run.csv", runs.columns, single=True)
    write_csv(agents.orderBy("run_id"), f"{folder}/usage_by_agent.csv", agents.columns, single=True)


def stamp() -> dict:
    """date_created and time_created as reports have them: November 26 2026, 05:19pm."""
    now = F.current_timestamp()
    return {"date_created": F.date_format(now, "MMMM dd yyyy"), "time_created": F.lower(F.date_format(now, "hh:mma"))}
