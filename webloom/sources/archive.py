"""The document archive: frontmatter text files or Parquet, word lists, byte-capped artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strip_frontmatter(text: Column) -> Column:
    """The body after the second `---` line; unchanged without one."""
    at = F.locate("\n---", text, 5)
    body = F.regexp_replace(F.substring(text, at + 4, F.length(text)), "^\n+", "")
    return F.when(text.startswith("---") & (at > 0), body).otherwise(text)


def _scalar(text: Column) -> Column:
    """A plain or quoted value of a head; null for an empty one, `null` or `~`."""
    t = F.trim(text)
    single = F.replace(F.regexp_extract(t, "^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    double = F.replace(F.replace(F.regexp_extract(t, '^"(.*)"$', 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(t.rlike("^'.*'$"), single).when(t.rlike('^".*"$'), double).when(~t.isin("", "null", "~"), t)


def head_lines(text: Column) -> Column:
    """Lines between the two `---` of a document's head; null without one."""
    at = F.locate("\n---", text, 5)
    return F.when(text.startswith("---") & (at > 0), F.split(F.substring(text, F.lit(5), at - 5), "\n"))


def parsed_lines(lines: Column) -> Column:
    """Map of key to array of values, of lines `key: value`, `key: [a, b]` and `key:` with `- item` lines below; broken lines are skipped."""
    start = F.struct(F.lit("").alias("key"), F.array().cast("array<struct<key: string, value: string>>").alias("pairs"))

    def step(a: Column, line: Column) -> Column:
        item, key = line.rlike(r"^\s*- "), F.regexp_extract(line, r"^([A-Za-z_][\w-]*)\s*:(?:\s|$)", 1)
        value = F.trim(F.regexp_replace(line, r"^[^:]*:", ""))
        inner = F.filter(F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), _scalar), lambda x: x.isNotNull())
        values = F.when(value.rlike(r"^\[.*\]$"), inner).otherwise(F.array_compact(F.array(_scalar(value))))
        pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
        more = F.concat(a["pairs"], F.transform(values, lambda v: pair(key, v)))
        listed = F.concat(a["pairs"], F.array(pair(a["key"], _scalar(F.regexp_replace(line, r"^\s*- ", "")))))
        return (
            F.when(item & (a["key"] != ""), F.struct(a["key"].alias("key"), listed.alias("pairs")))
            .when(key != "", F.struct(key.alias("key"), more.alias("pairs")))
            .otherwise(a)
        )

    pairs = F.aggregate(lines, start, step, lambda a: a["pairs"])
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]).alias("value"))))


def frontmatter(text: Column) -> Column:
    """Scalars of a document's head as a map of strings; null without a head."""
    return F.transform_values(parsed_lines(head_lines(text)), lambda k, v: F.get(v, F.lit(0)))


def _written(value: Column) -> Column:
    """A value as a head holds it: quoted where it would not read back as the same text."""
    odd = value.rlike(r"^\s|\s$|^$|^[-?:,\[\]{}#&*!|>'\"%@`]|: | #|:$|^(null|~|true|false|yes|no|on|off)$|^[0-9.+-]+$")
    return F.when(odd, F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(value)


def document_text(fields: dict[str, Column], body: Column) -> Column:
    """A document as text: the head of the fields that are set, then the body."""
    one_line = lambda c: F.regexp_replace(c.cast("string"), r"\s*[\r\n]+\s*", " ")
    lines = [F.concat(F.lit(f"{name}: "), _written(one_line(c))) for name, c in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n\n"), body, F.lit("\n"))


def write_texts(docs: DataFrame, folder: str, fields: list[str], body: str = "body", mode: str = "append") -> None:
    """One text a row, heads and all, as Parquet of (raw_id, text); Spark's committer makes a write whole or absent."""
    docs.select("raw_id", document_text({f: F.col(f) for f in fields}, F.col(body)).alias("text")).write.mode(mode).parquet(folder)


def load_site_rules(spark: SparkSession, folder: str) -> DataFrame:
    """(domain, gear_hint, wait_strategy, selectors, needs_account, needs_proxy, notes, modes) of the `*.yaml` files of a folder that name a domain."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder)
    rows = files.select(parsed_lines(F.split(F.decode("content", "utf-8"), "\r?\n")).alias("r"))
    one = lambda k, default=None: F.coalesce(F.get(F.col("r")[k], F.lit(0)), F.lit(default))
    many = lambda k: F.coalesce(F.col("r")[k], F.array().cast("array<string>"))
    yes = lambda k: F.lower(one(k, "false")).isin("true", "yes", "on", "1")
    return rows.select(
        one("domain").alias("domain"), one("gear_hint").alias("gear_hint"), one("wait_strategy", "domcontentloaded").alias("wait_strategy"), many("selectors").alias("selectors"),
        yes("needs_account").alias("needs_account"), yes("needs_proxy").alias("needs_proxy"), one("notes", "").alias("notes"), many("recommended_extract_modes").alias("modes"),
    ).filter("domain IS NOT NULL")


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_id, blocked, size, metadata, body) of the `*.md` files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name, text = F.regexp_extract("path", r"([^/]+)\.md$", 1), F.decode("content", "utf-8")
    return files.select(F.regexp_replace(name, r"\.BLOCKED$", "").alias("raw_id"), name.endswith(".BLOCKED").alias("blocked"), F.col("length").alias("size"), frontmatter(text).alias("metadata"), strip_frontmatter(text).alias("body"))


def write_raw(docs: DataFrame, folder: str, mode: str = "append") -> None:
    """Parquet archive, split by status."""
    docs.write.mode(mode).partitionBy("status").parquet(folder)


def prefer_blocked(raw: DataFrame, blocked: DataFrame, prefer: bool) -> DataFrame:
    """One metadata row per raw_id from two tables (raw_id, metadata)."""
    r, b = raw.select("raw_id", F.col("metadata").alias("r")), blocked.select("raw_id", F.col("metadata").alias("b"))
    first, second = ("b", "r") if prefer else ("r", "b")
    return r.join(b, "raw_id", "full").select("raw_id", F.coalesce(first, second).alias("metadata"))


def truncate_utf8(text: Column, n_bytes: int) -> Column:
    """At most n bytes, without a torn character at the end."""
    whole = F.encode(text, "utf-8")
    cut = F.decode(F.to_binary(F.hex(F.substring(whole, 1, n_bytes)), F.lit("hex")), "utf-8")
    clean = lambda k: F.hex(F.substring(whole, n_bytes + 1 - k, 1))
    back = F.when(~F.hex(F.substring(whole, n_bytes + 1, 1)).rlike("^[89AB]"), 0).when(~clean(0).rlike("^$") & ~clean(1).rlike("^[89AB]"), 1).when(~clean(2).rlike("^[89AB]"), 2).otherwise(3)
    return F.when(F.octet_length(text) <= n_bytes, text).when(back == 0, cut).otherwise(F.decode(F.substring(whole, F.lit(1), F.lit(n_bytes) - back), "utf-8"))


def load_words(spark: SparkSession, path: str) -> DataFrame:
    """(category, word) of a list: `CAT:word` or a word alone (CUSTOM); blanks and # lines are skipped; longest first."""
    line = F.trim("value")
    coded = line.rlike("^[A-Z_]+:")
    rows = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    return rows.select(F.when(coded, F.substring_index(line, ":", 1)).otherwise("CUSTOM").alias("category"), F.when(coded, F.regexp_replace(line, "^[A-Z_]+:", "")).otherwise(line).alias("word")).orderBy(F.desc(F.length("word")), "word")
