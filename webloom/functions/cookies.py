"""Cookie jars as stored JSON: lists of cookies, or an object of names and values from older stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let

#: What a cookie keeps beside name, value, domain and path.
KEPT = ("expires", "httpOnly", "secure", "sameSite")
_TYPE = "struct<name: string, value: string, domain: string, path: string, " + ", ".join(f"{k}: variant" for k in KEPT) + ">"


def _none() -> Column:
    return F.array().cast(f"array<{_TYPE}>")


def _cookie(x: Column, domain: Column) -> Column:
    """A cookie of a variant; null without a name or value. Of `KEPT` what is given stays as it is, a JSON null too."""
    text = lambda key: F.try_variant_get(x, f"$.{key}", "string")
    own = F.struct(
        text("name").alias("name"), text("value").alias("value"), F.coalesce(F.nullif(text("domain"), F.lit("")), domain).alias("domain"), F.coalesce(F.nullif(text("path"), F.lit("")), F.lit("/")).alias("path"),
        *(F.try_variant_get(x, f"$.{key}", "variant").alias(key) for key in KEPT),
    )
    return F.when(F.schema_of_variant(x).startswith("OBJECT") & (own["name"] != "") & own["value"].isNotNull(), own)


def cookies_of_json(text: Column, domain: Column) -> Column:
    """Array of cookies of a stored jar; what has no name or value goes, as does a text that is no list or object.

    Values are texts: numbers and switches as JSON writes them. An object is a jar of names and values, of which only texts count.
    """

    def jar(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        listed = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _cookie(x, domain)), lambda c: c.isNotNull())
        pairs = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string, variant>")), lambda e: (F.schema_of_variant(e["value"]) == "STRING") & (e["key"] != ""))
        plain = [F.lit(None).cast("variant").alias(key) for key in KEPT]
        named = F.transform(pairs, lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], "$", "string").alias("value"), domain.alias("domain"), F.lit("/").alias("path"), *plain))
        return F.coalesce(F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), named), _none())

    return let(F.try_parse_json(text), jar)


def cookie_fresh(cookie: Column, now: Column) -> Column:
    """Not expired at `now` (seconds); without an end, with -1 or one that is no number it stays."""
    text = F.try_variant_get(cookie["expires"], "$", "string")
    end = F.trim(text).try_cast("double")
    return end.isNull() | F.isnan(end) | (end == -1) | (end > now)


def merged_cookies(old: Column, new: Column, now: Column) -> Column:
    """A jar's cookies that have not expired, then new ones; one of the same name, domain and path takes the old one's place."""
    key = lambda c: F.struct(c["name"], c["domain"], c["path"])

    def merged(all_: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(all_, key)), lambda k: F.element_at(F.filter(all_, lambda c: key(c) == k), -1))

    return let(F.concat(F.filter(old, lambda c: cookie_fresh(c, now)), new), merged)


def cookies_json(cookies: Column) -> Column:
    """A jar as it is stored; a part that a cookie lacks is left out."""
    return F.to_json(cookies)
