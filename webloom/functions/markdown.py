"""Markdown measures, tables of contents, sections, chunks, citations and fitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let
from .results import GUIDANCE, format_error
from .urls import canonical_url, join_url

LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
LINK = r"(?<!!)\[([^\]\n]{1,240})\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
MARKER = "\n\n[...truncated...]"


def lines(text: Column) -> Column:
    """As str.splitlines: no last empty line."""
    return let(F.split(text, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quality(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    bar = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"

    def counts(ls: Column) -> Column:
        tables = F.zip_with(ls, F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1))), lambda a, b: a.contains("|") & b.contains("---") & strip(b).rlike(bar))
        fences = F.size(F.filter(ls, lambda x: x.contains("```") & strip(x).startswith("```")))
        return F.struct(
            F.char_length(t).alias("char_count"),
            F.size(ls).alias("line_count"),
            F.size(F.filter(ls, lambda x: x.startswith("#") & x.rlike(r"^#{1,6}\s+\S"))).alias("heading_count"),
            F.regexp_count(t, F.lit(r"\[[^\]]+\]\([^)]+\)")).alias("link_count_markdown"),
            F.size(F.filter(tables, lambda x: F.coalesce(x, F.lit(False)))).alias("table_count"),
            F.ceil(fences / 2).cast("int").alias("code_block_count"),
        )

    return let(lines(t), counts)


def headings(text: Column) -> Column:
    """array of (line, level, title) for H1 to H4; lines count from 1."""
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line"), strip(x).alias("text")))
    found = F.filter(numbered, lambda x: x["text"].rlike(r"^#{1,4}\s+.+$"))
    return F.transform(found, lambda x: F.struct(x["line"].alias("line"), F.length(F.regexp_extract(x["text"], "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract(x["text"], r"^#{1,4}\s+(.+)$", 1)).alias("title")))


#: What a table of contents begins with.
TOC_TITLE, TOC_HINT = "# 📍 页面目录索引 ", "使用 `mode='section', section_id='Section N'` 调取对应章节内容。\n"
NO_TOC_TITLE, NO_TOC_HINT = "# 📍 页面无结构化标题 ", "建议使用 `mode='full'` 阅读全文，或 `mode='chunk', chunk_index=1` 分页阅读。\n"


def toc(text: Column) -> Column:
    """Table of contents: one line a heading, indented by its level, or a note that there are none."""
    text_of = lambda c: c.cast("string")
    size = text_of(F.char_length(text))

    def render(hs: Column) -> Column:
        none = F.concat(F.lit(NO_TOC_TITLE), F.lit("(总字数: "), size, F.lit(" 字符)\n\n"), F.lit(NO_TOC_HINT))
        head = F.concat(F.lit(TOC_TITLE), F.lit("(Total Headings: "), text_of(F.size(hs)), F.lit(", Total Length: "), size, F.lit(" chars)\n"))
        line = lambda h, i: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("- **[Section "), text_of(i + 1), F.lit("]** Line "), text_of(h["line"]), F.lit(": "), h["title"])
        return F.when(F.size(hs) == 0, none).otherwise(F.array_join(F.concat(F.array(head, F.lit(TOC_HINT)), F.transform(hs, line)), "\n"))

    return let(headings(text), render)


def section(text: Column, wanted: Column) -> Column:
    """A section up to the next heading, by the first number in `wanted` or by a part of its title; an error if there is none.

    A text without headings is given whole.
    """
    named = wanted.cast("string")

    def build(hs: Column) -> Column:
        number = F.regexp_extract(named, "([0-9]+)", 1).try_cast("int")
        titled = F.filter(F.transform(hs, lambda h, i: F.when(F.lower(h["title"]).contains(F.lower(named)), i + 1)), lambda i: i.isNotNull())
        at = F.coalesce(F.when((number >= 1) & (number <= F.size(hs)), number), F.get(titled, F.lit(0)))

        def cut(k: Column) -> Column:
            start = F.get(hs, k - 1)["line"]
            ls = lines(text)
            stop = F.coalesce(F.get(hs, k)["line"], F.size(ls) + 1)
            body = F.array_join(F.slice(ls, start, stop - start), "\n")
            head = F.concat(F.lit("--- [Section "), k.cast("string"), F.lit(" / "), F.size(hs).cast("string"), F.lit(": "), F.get(hs, k - 1)["title"], F.lit("] ---\n\n"))
            return F.concat(head, body, F.lit("\n\n--- [End of Section "), k.cast("string"), F.lit("] ---"))

        told = F.concat(F.lit("Section '"), named, F.lit("' not found in document. Available count: "), F.size(hs).cast("string"))
        missing = format_error(F.lit("section-not-found"), told, GUIDANCE)
        return F.when(F.size(hs) == 0, text).when(at.isNull(), missing).otherwise(let(at, cut))

    return let(headings(text), build)


def chunk(text: Column, index: Column, size: int = 4000) -> Column:
    """The n-th part (from 1) of `size` characters with its place; a text that fits is given whole, an index outside is an error."""
    n, said = F.char_length(text), lambda c: c.cast("string")
    total = F.ceil(n / size).cast("int")
    start, stop = (index - 1) * size, F.least(index * size, n)
    place = F.concat(said(index), F.lit("/"), said(total))
    head = F.concat(F.lit("--- [Chunk "), place, F.lit(" (Chars "), said(start), F.lit("-"), said(stop), F.lit(" of "), said(n), F.lit(")] ---\n\n"))
    more = F.when(index < total, F.concat(F.lit("true, next_chunk_index="), said(index + 1))).otherwise("false")
    foot = F.concat(F.lit("\n\n--- [End of Chunk "), place, F.lit(". has_next="), more, F.lit("] ---"))
    told = F.concat(F.lit("Chunk "), said(index), F.lit(" not found. Available chunks: 1-"), said(total))
    outside = format_error(F.lit("chunk-not-found"), told, GUIDANCE)
    return F.when(n <= size, text).when((index < 1) | (index > total), outside).otherwise(F.concat(head, F.substring(text, start + 1, F.lit(size)), foot))


def chunks(text: Column, size: int = 4000) -> Column:
    """array of (index, total, start, stop, body) in characters."""
    n = F.char_length(text)
    total = F.greatest(F.ceil(n / size).cast("int"), F.lit(1))
    return F.transform(
        F.sequence(F.lit(1), total),
        lambda i: F.struct(i.alias("chunk_index"), total.alias("total_chunks"), ((i - 1) * size).alias("start"), F.least(i * size, n).alias("stop"), F.substring(text, (i - 1) * size + 1, F.lit(size)).alias("body")),
    )


def clean(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0000-\u0008\u000b\u000c\u000e-\u001f]", "")
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), r"(?U)[^\S\n]+(?=\n|$)", "")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def citations(text: Column, base: Column, limit: int = 100) -> Column:
    """array of (label, url), the first of each canonical URL."""
    t = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(LINK), F.lit(1)).alias("label"), F.regexp_extract_all(t, F.lit(LINK), F.lit(2)).alias("ref"))
    pairs = F.filter(pairs, lambda x: ~x["ref"].rlike("^(#|mailto:|tel:|javascript:|data:)"))
    full = F.transform(pairs, lambda x: F.struct(F.substring(F.trim(F.regexp_replace(x["label"], r"\s+", " ")), 1, 200).alias("label"), canonical_url(F.when(base == "", x["ref"]).otherwise(join_url(base, x["ref"]))).alias("url")))
    full = F.filter(full, lambda x: x["url"].rlike("^https?://[^/]"))
    urls = F.transform(full, lambda x: x["url"])
    return F.slice(F.filter(full, lambda x, i: F.array_position(urls, x["url"]) == i + 1), 1, limit)


def fit(text: Column, limit: int) -> Column:
    """Cleaned text, cut at the last block boundary in the last 45 % of the budget."""
    return let(clean(text), lambda t: _fitted(t, limit))


def _fitted(t: Column, limit: int) -> Column:
    if limit <= 0:
        return t
    head = F.substring(t, 1, max(0, limit - len(MARKER)))
    last = lambda mark: F.when(head.contains(mark), F.char_length(head) - F.locate(mark[::-1], F.reverse(head)) - len(mark) + 1).otherwise(-1)
    at = F.greatest(*(last(m) for m in ("\n\n", "\n#", "\n- ")))
    cut = F.when(at > limit * 0.55, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+$", ""), F.lit(MARKER)))


def fit_result(text: Column, limit: int = 20000, base: Column | None = None, citations_limit: int = 100) -> Column:
    """Struct of the fitted text, its citations, both sizes and whether it was cut."""
    t = F.coalesce(text, F.lit(""))

    def build(cleaned: Column) -> Column:
        fitted = _fitted(cleaned, limit)
        cut = F.lit(limit > 0) & (F.char_length(cleaned) > limit)
        return let(fitted, lambda f: F.struct(
            f.alias("markdown"), citations(f, F.lit("") if base is None else base, citations_limit).alias("citations"),
            F.char_length(t).alias("original_chars"), F.char_length(f).alias("output_chars"), cut.alias("truncated"),
        ))

    return let(clean(t), build)


def misses_structure(text: Column, hints: Column) -> Column:
    """A markdown text lacks what the page has (hints: struct of heading, table, code, link); an empty one lacks everything."""
    t = F.coalesce(text, F.lit(""))
    return (
        (t == "")
        | (hints["heading"] & ~t.rlike(r"(?m)^#{1,6}\s+\S"))
        | (hints["table"] & ~t.contains("|"))
        | (hints["link"] & ~t.rlike(r"\[[^\]]+\]\([^)]+\)"))
        | (hints["code"] & ~t.contains("```") & ~t.rlike(r"(^|\n)    \S"))
    )
