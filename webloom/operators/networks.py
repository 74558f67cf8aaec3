"""Addresses against a table of networks of any size, IPv4 and IPv6: a join on prefixes.

An address is 32 hexadecimal digits, IPv4 as the mapped ::ffff:a.b.c.d, so a network is a prefix of so many bits of one space.
Networks are keyed by (bits, prefix); an address is asked for once under each length that occurs in the table (at most 129), so
a range join becomes an equi-join that shuffles addresses times lengths, not addresses times networks. All is expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let

QUAD = r"(?:^|:)([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})$"


def _quad_hex(quad: Column) -> Column:
    """Eight digits of a dotted quad, null if a part is over 255 or begins with a needless zero."""
    parts = F.split(quad, r"\.")
    fine = F.forall(parts, lambda x: x.rlike(r"^(0|[1-9][0-9]{0,2})$") & (x.cast("int") <= 255))
    return F.when(fine, F.lower(F.array_join(F.transform(parts, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")))


def address_hex(address: Column) -> Column:
    """32 lower-case digits of an IPv4 or IPv6 address (brackets and a zone are dropped); null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(address)), r"^\[|\]$", ""), r"%.*$", "")

    def six(text: Column) -> Column:
        quad = F.regexp_extract(text, QUAD, 1)
        tail = _quad_hex(quad)
        plain = F.when(quad == "", text).otherwise(F.concat(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(quad)), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)))
        groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

        def spread(said: Column) -> Column:
            halves = F.split(said, "::")
            left, right = groups(halves[0]), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
            some = F.concat(left, right)
            short = F.size(halves) == 2
            zeros = F.repeat(F.lit("0000"), F.when(short, 8 - F.size(some)).otherwise(0))
            digits = lambda x: F.array_join(F.transform(x, lambda g: F.lpad(g, 4, "0")), "")
            # no group is empty but those of one '::', which stands for one group at least
            shape = said.rlike(r"^[0-9a-f:]+$") & ~said.rlike(r":::|^:[^:]|[^:]:$") & (F.size(halves) <= 2) & F.forall(some, lambda g: F.char_length(g) <= 4)
            return F.when(shape & F.when(short, F.size(some) <= 7).otherwise(F.size(some) == 8), F.concat(digits(left), zeros, digits(right)))

        return let(plain, spread)

    four = F.concat(F.lit("00000000000000000000ffff"), _quad_hex(bare))
    return F.when(bare.contains(":"), let(bare, six)).when(bare.rlike(r"^[0-9.]+$") & (F.size(F.split(bare, r"\.")) == 4), four)


def prefix(digits: Column, bits: Column) -> Column:
    """The first `bits` bits of 32 digits as text: whole digits, and what is left of the next one."""
    rest = bits % 4
    digit = F.conv(F.substring(digits, (F.floor(bits / 4) + 1).cast("int"), F.lit(1)), 16, 10).cast("int")
    cut = F.floor(digit / F.pow(F.lit(2), 4 - rest)).cast("string")
    return F.concat(F.substring(digits, F.lit(1), F.floor(bits / 4).cast("int")), F.when(rest > 0, F.concat(F.lit("."), cut)).otherwise(""))


def network_keys(networks: DataFrame) -> DataFrame:
    """networks (cidr, ...) with `bits` of the common space and `prefix`; rows that are no networks go, bits behind the length do not matter.

    A cidr without a length is one address.
    """
    said = F.split(F.trim("cidr"), "/")
    digits, length = address_hex(said[0]), F.get(said, F.lit(1))
    four = ~said[0].contains(":")
    most = F.when(four, 32).otherwise(128)
    n = F.when(length.isNull(), most).when(length.rlike(r"^[0-9]{1,3}$"), length.cast("int"))
    named = networks.withColumn("_digits", digits).withColumn("bits", F.when((n <= most) & (F.size(said) <= 2), n + F.when(four, 96).otherwise(0)))
    return named.filter("_digits IS NOT NULL AND bits IS NOT NULL").withColumn("prefix", prefix(F.col("_digits"), F.col("bits"))).drop("_digits")


def _pairs(addresses: DataFrame, keys: DataFrame, address: str) -> DataFrame:
    """(_address, bits, name) of each different address and each network that holds it."""
    # at most 129 numbers, and so small enough for the driver
    lengths = sorted(r["bits"] for r in keys.select("bits").distinct().collect())
    asked = addresses.select(F.col(address).alias("_address")).filter(F.col("_address").isNotNull()).distinct().withColumn("_digits", address_hex(F.col("_address"))).filter("_digits IS NOT NULL")
    each = asked.select("_address", "_digits", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("bits"))
    return each.select("_address", "bits", prefix(F.col("_digits"), F.col("bits")).alias("prefix")).join(keys, ["bits", "prefix"])


def matches(addresses: DataFrame, networks: DataFrame, address: str = "address") -> DataFrame:
    """addresses with `networks`: an array of (bits, name) of the networks (cidr, name) that hold the address, the narrowest first.

    Each different address is looked up once; null and malformed addresses are in no network.
    """
    pairs = _pairs(addresses, network_keys(networks).select("bits", "prefix", "name").distinct(), address)
    found = pairs.groupBy("_address").agg(F.sort_array(F.collect_set(F.struct("bits", "name")), asc=False).alias("networks"))
    return addresses.join(found, addresses[address] == found["_address"], "left").drop("_address")


def narrowest(addresses: DataFrame, networks: DataFrame, address: str = "address") -> DataFrame:
    """addresses with `network`: the name of the narrowest network (cidr, name) that holds it (of equal ones the least name), else null."""
    pairs = _pairs(addresses, network_keys(networks).groupBy("bits", "prefix").agg(F.min("name").alias("name")), address)
    found = pairs.groupBy("_address").agg(F.max_by("name", "bits").alias("network"))
    return addresses.join(found, addresses[address] == found["_address"], "left").drop("_address")
