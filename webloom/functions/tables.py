"""Table functions for SQL: parts of texts, anchors of pages and links of markdown, one row each, called with LATERAL.

`register` names them text_chunks(text [, size]), page_anchor_rows(html [, most]) and markdown_citations(text [, most]). Their
columns are settled when a query is analysed, where a size or limit that is no positive constant is refused. A null text gives
no rows. Rows go to and from Python in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import html
from .markdown import LINK


INT, TEXT = IntegerType(), StringType()


def _analysed(name: str, number: AnalyzeArgument | None, **columns: DataType) -> AnalyzeResult:
    if number is not None and not (number.isConstantExpression and isinstance(number.value, int) and number.value > 0):
        raise ValueError(f"{name} takes a positive constant")
    schema = StructType()
    for column, kind in columns.items():
        schema = schema.add(column, kind)
    return AnalyzeResult(schema=schema)


class TextChunks:
    """(chunk_index, total_chunks, start, stop, body) in characters; an empty text is one empty part."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analysed("text_chunks", size, chunk_index=INT, total_chunks=INT, start=INT, stop=INT, body=TEXT)

    def eval(self, text: str | None, size: int = 4000) -> Iterator[tuple]:
        if text is not None:
            total = max(1, -(-len(text) // size))
            for k in range(total):
                yield k + 1, total, k * size, min((k + 1) * size, len(text)), text[k * size : (k + 1) * size]


class PageAnchorRows:
    """(pos, href, label, title, rel) of a page's a[href] in its order, labels of at most `most` characters."""

    @staticmethod
    def analyze(source: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analysed("page_anchor_rows", most, pos=INT, href=TEXT, label=TEXT, title=TEXT, rel=ArrayType(TEXT))

    def eval(self, source: str | None, most: int = 200) -> Iterator[tuple]:
        if source is not None:
            for pos, a in enumerate(html.anchors(source, most), 1):
                yield pos, a["href"], a["label"], a["title"], a["rel"]


class MarkdownCitations:
    """(pos, label, ref) of the first `most` links of a markdown text, without those inside a page and of mail, phone, script and data."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analysed("markdown_citations", most, pos=INT, label=TEXT, ref=TEXT)

    def eval(self, text: str | None, most: int = 100) -> Iterator[tuple]:
        pos = 0
        for found in re.finditer(LINK, text or ""):
            label, ref = found.groups()
            if not re.match("#|mailto:|tel:|javascript:|data:", ref):
                pos += 1
                yield pos, " ".join(label.split())[:200], ref
                if pos == most:
                    return


def register(spark: SparkSession) -> None:
    """Makes the table functions callable from the session's SQL."""
    for name, rows in (("text_chunks", TextChunks), ("page_anchor_rows", PageAnchorRows), ("markdown_citations", MarkdownCitations)):
        spark.udtf.register(name, udtf(rows, useArrow=True))
