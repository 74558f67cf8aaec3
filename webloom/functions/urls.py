"""URL algebra as Column builders (RFC 3986 by one pattern; no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let

#: scheme, authority, path, query, fragment.
RFC3986 = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Query keys that begin so are tracking parameters.
TRACKING = r"(?i)^(utm_|fbclid|gclid|ref|source|mc_eid|vero_id|yclid)"
#: Hosts of pages that change fast or slowly, and their lifetimes in seconds.
TTL_FAST, TTL_SLOW, TTL_ELSE = 3600, 604800, 21600


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, RFC3986, group)


def with_scheme(url: Column) -> Column:
    """Trimmed; a bare `a.b/...` becomes https."""
    u = F.trim(url)
    bare = ~u.contains("://") & ~u.startswith("//") & F.split_part(u, F.lit("/"), F.lit(1)).contains(".")
    return F.when(bare, F.concat(F.lit("https://"), u)).otherwise(u)


def clean_query(query: Column) -> Column:
    """Tracking keys dropped, input order kept, values encoded anew."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~decode(F.substring_index(p, "=", 1)).rlike(TRACKING))
    pair = lambda p: F.concat(encode(decode(F.substring_index(p, "=", 1))), F.lit("="), encode(decode(F.when(p.contains("="), F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p))).otherwise(""))))
    return F.array_join(F.transform(pairs, pair), "&")


def canonical_url(url: Column) -> Column:
    def build(u: Column) -> Column:
        scheme = F.lower(F.when(part(u, 1) == "", "https").otherwise(part(u, 1)))
        host = F.lower(part(u, 2))
        host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
        path = F.regexp_replace(part(u, 3), "/+$", "")
        query = F.when(part(u, 4) == "", "").otherwise(clean_query(part(u, 4)))
        return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))

    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "").otherwise(let(with_scheme(url), build))


def domain_of(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(F.lower(part(F.coalesce(url, F.lit("")), 2)), "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def origin_of(url: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2))


def drop_query(url: Column) -> Column:
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    return F.concat(origin_of(url), path)


def url_id(url: Column) -> Column:
    return F.substring(F.sha1(canonical_url(url)), 1, 16)


def remove_dots(url: Column) -> Column:
    """`.` and `..` segments of the path resolved; the rest as it is."""

    def resolve(path: Column) -> Column:
        parts = F.split(F.regexp_replace(path, "^/", ""), "/")
        step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        return let(F.concat(F.lit("/"), F.array_join(kept, "/")), lambda p: F.when(path.rlike(r"/\.\.?$") & ~p.endswith("/"), F.concat(p, F.lit("/"))).otherwise(p))

    rest = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    return F.when(part(url, 3).rlike(r"(^|/)\.\.?(/|$)"), F.concat(origin_of(url), resolve(part(url, 3)), rest)).otherwise(url)


def join_url(base: Column, ref: Column) -> Column:
    """RFC 3986 resolution; dot segments are resolved in relative references only."""
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(part(base, 1), F.lit(":"), ref))
        .when(ref.startswith("/"), remove_dots(F.concat(origin_of(base), ref)))
        .when(ref.startswith("?"), F.concat(drop_query(base), ref))
        .when(ref.startswith("#") | (ref == ""), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .otherwise(remove_dots(F.concat(origin_of(base), folder, ref)))
    )


def ttl_seconds(url: Column) -> Column:
    """Lifetime of a stored page by its host."""
    host = F.lower(part(url, 2))
    return F.when(host.rlike(r"news|blog|medium\.com"), TTL_FAST).when(host.contains("wiki"), TTL_SLOW).otherwise(TTL_ELSE)


def ipv4_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    number = sum((F.get(parts, F.lit(k)).cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0))
    return F.when(host.rlike(r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"), number)


#: Networks that are never fetched (first address, prefix bits).
BLOCKED_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def network_ranges() -> list[tuple[int, int]]:
    ranges = []
    for first, bits in BLOCKED_NETWORKS:
        low = sum(int(x) << (24 - 8 * k) for k, x in enumerate(first.split(".")))
        ranges.append((low, low + (1 << (32 - bits)) - 1))
    return ranges


def blocked_ip(host: Column) -> Column:
    number = ipv4_number(host)
    hit = F.lit(False)
    for low, high in network_ranges():
        hit = hit | number.between(low, high)
    return F.coalesce(hit, F.lit(False))
