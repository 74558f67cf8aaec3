"""Keyword rules as a table: scopes, matching by joins on the scope, and changes.

rules: (name, include, exclude, regex arrays, case_sensitive, match_position any, title or body, enabled, scope `global` or
`domain:x`, notes, created_at, updated_at). Patterns of `regex` are Java's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let

CHANGEABLE = ("include", "exclude", "regex", "case_sensitive", "match_position", "enabled", "scope", "notes")
#: Characters of rules that are sent to every task at most, and tasks over which a domain's rows are dealt beyond that.
SMALL_CHARS, SALTS = 4_000_000, 64
FIELDS = ("name", "include", "exclude", "regex", "case_sensitive", "match_position")


def listed(rules: DataFrame, scope: str = "") -> DataFrame:
    """Rules of a scope, or all, by name."""
    return (rules.filter(F.col("scope") == scope) if scope else rules).orderBy("name")


def by_scope(rules: DataFrame) -> DataFrame:
    """(scope, rules): the enabled rules of each scope by name, one row a scope."""
    own = rules.filter("enabled").select("scope", F.struct(*FIELDS).alias("rule"))
    return own.groupBy("scope").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def for_domains(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """domains (domain, ...) with `rules`: those of the domain, then the global ones, each by name.

    Rules of up to SMALL_CHARS characters go to every task, so that the rows stay where they are. More are joined by scope and
    one of SALTS numbers that a row's values give it, so that the rows of one domain are dealt over many tasks.
    """
    scopes, none = by_scope(rules), F.array().cast("array<struct<name: string, include: array<string>, exclude: array<string>, regex: array<string>, case_sensitive: boolean, match_position: string>>")
    own = scopes.select(F.col("scope").alias("_scope"), F.col("rules").alias("_own"))
    scope = F.concat(F.lit("domain:"), F.col("domain"))
    if _chars(rules) <= SMALL_CHARS:
        domains = domains.join(F.broadcast(own), scope == F.col("_scope"), "left")
    else:
        hashed = [f.name for f in domains.schema.fields if "map<" not in f.dataType.simpleString()]
        salted = own.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        domains = domains.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
        domains = domains.join(salted, (scope == F.col("_scope")) & (F.col("_salt") == F.col("_n")), "left").drop("_salt", "_n")
    everywhere = scopes.filter("scope = 'global'").select(F.col("rules").alias("_all"))
    return domains.drop("_scope").join(F.broadcast(everywhere), F.lit(True), "left").withColumn("rules", F.concat(F.coalesce("_own", none), F.coalesce("_all", none))).drop("_own", "_all")


def _chars(rules: DataFrame) -> int:
    """Characters of the enabled rules, each string counting as 16 more."""
    length = lambda words: F.coalesce(F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + 16 + F.coalesce(F.char_length(w), F.lit(0))), F.lit(0))
    total = length(F.array(F.col("name").cast("string"), "scope")) + length(F.col("include")) + length(F.col("exclude")) + length(F.col("regex"))
    return rules.filter("enabled").agg(F.sum(total)).first()[0] or 0


def _target(text: Column, position: Column) -> Column:
    head = F.substring_index(text, "\n", 1)
    title = F.trim(F.regexp_replace(head, "^#+", ""))
    rest = F.substring(text, F.char_length(head) + 2, F.char_length(text))
    return F.when(position == "title", title).when(position == "body", rest).otherwise(text)


def _quoted(word: Column) -> Column:
    return F.when(word.contains("'") & ~word.contains('"'), F.concat(F.lit('"'), word, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("\\'")), F.lit("'")))


def failure(text: Column, rules: Column) -> Column:
    """Why the first of an array of rules rejects a text, null if none does; an empty text passes."""

    def reason(r: Column) -> Column:
        fold = lambda c: F.when(r["case_sensitive"], c).otherwise(F.lower(c))
        named = lambda kind: F.concat(F.lit(f"{kind} (rule="), r["name"], F.lit(")"))

        def test(target: Column) -> Column:
            has = lambda w: fold(target).contains(fold(w))
            bad = F.get(F.filter(r["exclude"], has), F.lit(0))
            said = F.concat(F.lit("excluded_keyword: "), _quoted(bad), F.lit(" (rule="), r["name"], F.lit(")"))
            pattern = lambda x: F.rlike(target, F.concat(F.when(r["case_sensitive"], "").otherwise("(?i)"), x))
            return (
                F.when(bad.isNotNull(), said)
                .when((F.size(r["include"]) > 0) & ~F.exists(r["include"], has), named("include_not_matched"))
                .when((F.size(r["regex"]) > 0) & ~F.exists(r["regex"], pattern), named("regex_not_matched"))
            )

        return let(_target(text, r["match_position"]), test)

    first = F.get(F.filter(F.transform(rules, reason), lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")) != "", first)


def filtered(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """docs (domain, text, ...) with `reason`, null for those that pass the rules of their domain and the global ones."""
    return for_domains(docs, rules).withColumn("reason", failure(F.col(text), F.col("rules"))).drop("rules")


def add(rules: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rules, refused): new ones, but for names that are taken; of equal new names one is added."""
    fresh = new.dropDuplicates(["name"]).join(rules.select("name"), "name", "left_anti").withColumn("created_at", now).withColumn("updated_at", now)
    refused = new.join(rules.select("name"), "name", "left_semi").select("name", F.concat(F.lit("keyword rule already exists: "), "name").alias("error"))
    return rules.unionByName(fresh.select(rules.columns)), refused


def update(rules: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes: (name, some of CHANGEABLE; null: unchanged); a rule without any change keeps its time."""
    names = [c for c in changes.columns if c in CHANGEABLE]
    given = changes.select("name", *(F.col(c).alias(f"_{c}") for c in names))
    j = rules.join(given, "name", "left")
    changed = F.coalesce(*(F.when(F.col(f"_{c}").isNotNull(), True) for c in names), F.lit(False)) if names else F.lit(False)
    new = {c: F.coalesce(f"_{c}", c) for c in names} | {"updated_at": F.when(changed, now).otherwise(F.col("updated_at"))}
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in rules.columns))


def delete(rules: DataFrame, names: DataFrame) -> DataFrame:
    return rules.join(names.select("name"), "name", "left_anti")
