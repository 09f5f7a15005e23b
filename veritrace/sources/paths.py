"""Paths of any file system that Spark reads, asked on the driver."""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def contained(folder: str, path: str) -> str:
    """path below folder, or nothing: a document is no authority to read other files. Links are not followed
    here, so folders must not hold links that lead out of them."""
    root = posixpath.normpath(folder)
    full = posixpath.normpath(path if posixpath.isabs(path) else posixpath.join(root, path))
    return full if path and folder and (full == root or full.startswith(root.rstrip("/") + "/")) else ""


def existing(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Those of the names that are files below folder (a document's own table files: as many as it has tables)."""
    return [n for n in names if (full := contained(folder, n)) and exists(spark, full) and not is_folder(spark, full)]


def by_name(spark: SparkSession, folder: str, name: str) -> str:
    """The one file of that name at any depth below folder: none is a LookupError, several a ValueError."""
    if posixpath.basename(name) != name or name in ("", ".", ".."):
        raise LookupError(name)
    p, fs = _path(spark, folder)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next().getPath()
        if f.getName() == name:
            found.append(f.toString())
    if not found:
        raise LookupError(name)
    if len(found) > 1:
        raise ValueError(f"{name}: {len(found)} files have this name")
    return found[0]


def pdf_beside(spark: SparkSession, json_path: str, document_name: str | None) -> str | None:
    """The PDF that a document's JSON was made from: of its name, else of the JSON's, in the same folder."""
    folder, stem = posixpath.dirname(json_path), posixpath.basename(json_path).removesuffix(".json")
    names = [posixpath.basename(document_name)] if document_name else []
    return next((p for n in [*names, f"{stem}.pdf"] if exists(spark, p := f"{folder}/{n}") and not is_folder(spark, p)), None)


def require(spark: SparkSession, paths: dict[str, str | None]) -> None:
    """An error that names what is not given, or not there."""
    if missing := [k for k, v in paths.items() if not v]:
        raise ValueError(f"not given: {', '.join(missing)}")
    if absent := [k for k, v in paths.items() if not exists(spark, v)]:
        raise FileNotFoundError(f"no such file: {', '.join(absent)}")
