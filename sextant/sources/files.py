"""File sources: whole texts and binaries by path, parsers by extension, and page ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T

Parse = Callable[[bytes], str]


def plain(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def magic_pdf(content: bytes) -> bytes:
    """The content of a PDF file; anything else is an error."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    return content


class Parsers:
    """Parsers by extension: registered ones first, then built-in ones, then the fallback; False turns one off."""

    def __init__(self, fallback: Parse | None = None):
        self.own: dict[str, Parse | bool] = {}
        self.fallback = fallback

    def register(self, extension: str, parser: Parse | bool) -> None:
        self.own[extension.lower().lstrip(".")] = parser

    def get(self, extension: str) -> Parse:
        extension = extension.lower().lstrip(".")
        found = self.own.get(extension, plain if extension in ("txt", "text", "md", "markdown") else self.fallback)
        if not found:
            raise ValueError(f"no parser for .{extension}")
        return found


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, content_type of whole text files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("content_type", T.content_type(F.col("path")))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def parsed(files: DataFrame, parsers: Parsers) -> DataFrame:
    """path, text, error of files (path, content): each by its extension's parser, a failure beside null text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, parsers.get(path.rsplit(".", 1)[-1] if "." in path else "")(bytes(content)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def pages(documents: DataFrame) -> DataFrame:
    """document_id, number, start, end of documents (id, raw) with form feeds between pages."""
    return documents.select(F.col("id").alias("document_id"), F.inline(T.page_ranges(F.col("raw"))))
