"""Pages of PDF files as a Spark data source: (path, page, text, layout, tables, n_tables, n_images).

Decoding needs PyMuPDF on the executors; without it a read is an error. Everything behind this
source starts from page text, so any other decoder's table of pages serves as well.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, page int, text string, layout array<struct<spans: array<struct<text: string, size: double>>>>, tables array<array<array<string>>>, n_tables int, n_images int"
INFO = "path string, title string, author string, subject string, keywords string, creator string, producer string, creationDate string, modDate string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """One partition per file: options path (files joined by commas, on a path that all executors see)."""

    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs PyMuPDF") from e
        with pymupdf.open(partition.path) as pdf:
            for number, page in enumerate(pdf, 1):
                yield (partition.path, number, page.get_text("text"), _layout(page), *_tables(page), _images(page))


def _layout(page):
    lines = [line for block in page.get_text("dict").get("blocks", []) if block.get("type") == 0 for line in block.get("lines", [])]
    return [{"spans": [{"text": s["text"], "size": float(s["size"])} for s in line.get("spans", [])]} for line in lines if line.get("spans")]


def _tables(page):
    """Cells and number of a page's tables; a page whose tables cannot be told has none."""
    try:
        found = page.find_tables().tables
        return [t.extract() for t in found], len(found)
    except Exception:  # the decoder's own errors are of many kinds
        return [], 0


def _images(page) -> int:
    try:
        return len(page.get_images(full=True))
    except Exception:  # as above
        return 0


class PdfPages(DataSource):
    @classmethod
    def name(cls):
        return "pdf_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def pages(spark: SparkSession, *paths: str):
    spark.dataSource.register(PdfPages)
    return spark.read.format("pdf_pages").option("path", ",".join(paths)).load()
