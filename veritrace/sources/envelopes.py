"""Reading records from JSON files of several envelopes, and term configurations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json_walk
from ..functions.text import clean

#: Where each reader looks for its list, in order; "$" is the file itself. Fixed: they are the file formats.
ENVELOPES = {
    "plan": ("$", "$.feature_list", "$.table.feature_list", "$.vplan"),
    "verifier": ("$", "$.feature_list", "$.tests"),
    "links": ("$.feature_list", "$.vplan.feature_list"),
    "requirements": ("$", "$.requirements", "$.feature_list"),
    "unwrapped": ("$", "$.requirements"),
    "strict": ("$.requirements",),
    "labelled": ("$.labelled_requirements",),
    "evidence": ("$", "$.feature_list", "$.edge_cases", "$.weak_requirements", "$.flagged_requirements", "$.issues", "$.results"),
    "metadata_items": ("$", "$.requirements", "$.items", "$.spec_items", "$.feature_list"),
    "records": ("$", "$.requirements", "$.items", "$.feature_list", "$.extracted_requirements", "$.records"),
    "viewer": ("$", "$.requirements", "$.vplan", "$.tests", "$.items", "$.edge_cases", "$.results"),
}
#: Readers for which a file without any of their lists is an error, not an empty list.
STRICT = ("plan", "verifier", "links", "requirements", "strict", "labelled")


def documents(spark: SparkSession, path: str, must_be_object: bool = False) -> DataFrame:
    """One row per file: (path, folder, doc), its JSON value; a file that is not JSON has a null value. A
    folder stands for the document.json in it. With must_be_object, other values are an error."""
    from .paths import exists, is_folder

    if "*" not in path:
        path = f"{path.rstrip('/')}/document.json" if is_folder(spark, path) and exists(spark, f"{path.rstrip('/')}/document.json") else path
        if not exists(spark, path):
            raise FileNotFoundError(path)
    out = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    out = out.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    if must_be_object and (bad := rejected(out)):
        raise ValueError(f"not a JSON object: {', '.join(bad)}")
    return out


def rejected(docs: DataFrame, shown: int = 10) -> list[str]:
    """Files (the first of them) that an upload must not have: another suffix, no JSON, no object."""
    bad = ~F.lower("path").endswith(".json") | F.col("doc").isNull() | ~F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    return [r[0] for r in docs.where(bad).select("path").orderBy("path").limit(shown).collect()]


def _list(envelope: str):
    return F.coalesce(*[F.try_variant_get("doc", p, "array<variant>") for p in ENVELOPES[envelope]])


def records(docs: DataFrame, envelope: str) -> DataFrame:
    """Objects of the first list that the envelope's probes find, with their place (pos) in it. A file
    without such a list gives none (viewer: itself), or an error for the readers in STRICT."""
    if envelope in STRICT and (bad := docs.where(_list(envelope).isNull()).select("path").limit(1).collect()):
        raise ValueError(f"{bad[0][0]}: none of {', '.join(ENVELOPES[envelope])} is a list")
    found = F.coalesce(_list(envelope), F.array("doc")) if envelope == "viewer" else _list(envelope)
    rows = docs.select("path", F.posexplode(found).alias("pos", "record"))
    return rows.where(F.schema_of_variant("record").startswith("OBJECT"))


def entity(docs: DataFrame, name: str) -> DataFrame:
    """(path, pos, record) of a top-level list of a whole document; absent is empty."""
    return docs.select("path", F.posexplode(F.try_variant_get("doc", f"$.{name}", "array<variant>")).alias("pos", "record"))


def keys(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.explode(F.json_object_keys(F.to_json("doc"))).alias("key"))


def nested_ids(docs: DataFrame, field_name: str = "id", prefix: str = "REQ_") -> DataFrame:
    """(path, id) of every such field at any depth whose value begins with the prefix."""
    found = docs.select("path", F.explode(json_walk.named(F.to_json("doc"), field_name)).alias("id"))
    return found.where(F.col("id").startswith(prefix))


def duplicate_nested_ids(docs: DataFrame) -> DataFrame:
    return nested_ids(docs).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def field(name: str, kind: str = "string"):
    return F.try_variant_get("record", f"$.{name}", kind).alias(name)


def parse_terms(text: str, regex_sections: tuple[str, ...] = ("regex_patterns",)) -> tuple[dict[str, list[str]], dict[str, str]]:
    """[section] lists of terms, and name=pattern rows in regex sections. A duplicate section, a
    value before the first heading, a repeated pattern name and a malformed or invalid pattern are
    errors. Terms are case-folded and count once."""
    groups: dict[str, list[str]] = {}
    patterns: dict[str, str] = {}
    section = None
    for n, line in enumerate(map(str.strip, text.splitlines()), 1):
        if not line or line.startswith("#"):
            continue
        if head := re.fullmatch(r"\[(.+)\]", line):
            section = head[1].strip()
            if section in groups:
                raise ValueError(f"line {n}: section {section} occurs twice")
            groups[section] = []
        elif section is None:
            raise ValueError(f"line {n}: a value stands before the first section")
        elif section in regex_sections:
            name, eq, pattern = line.partition("=")
            if not eq or not name.strip() or not pattern.strip():
                raise ValueError(f"line {n}: name=pattern is expected")
            re.compile(pattern.strip())
            if name.strip() in patterns:
                raise ValueError(f"line {n}: pattern {name.strip()} occurs twice")
            patterns[name.strip()] = pattern.strip()
        elif (term := line.casefold()) not in groups[section]:
            groups[section].append(term)
    return groups, patterns


def require_groups(groups: dict[str, list[str]], needed: set[str], source: str = "the term file") -> None:
    """An error that names the groups that are missing or empty."""
    if missing := sorted(g for g in needed if not groups.get(g)):
        raise ValueError(f"{source} lacks {', '.join(missing)}")


def table_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV tables as arrays of cleaned cells (path, row from 1, cells), blank rows left out; a byte
    order mark is no text. A path without a file gives no rows."""
    from .paths import exists

    if "*" not in path and not exists(spark, path):
        return spark.createDataFrame([], "path string, row int, cells array<string>")
    raw = spark.read.option("header", False).option("multiLine", True).csv(path)
    cells = F.array(*[clean(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\ufeff"), F.lit(""))) for c in raw.columns])
    rows = raw.select(F.col("_metadata.file_path").alias("path"), cells.alias("cells"), F.monotonically_increasing_id().alias("_at")).where(F.exists("cells", lambda c: c != ""))
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("path").orderBy("_at"))).select("path", "row", "cells")
