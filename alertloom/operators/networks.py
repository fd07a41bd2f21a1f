"""Network context of addresses: the longest listed network that holds an address.

Addresses and networks become texts of bits, so that a network holds an address if its prefix is the address's.  Each
distinct address is exploded into its prefixes of the lengths that are listed at all (33 and 129 at most) and joined on
equality; nothing is compared pairwise.  Addresses are made distinct first, so that one with a third of all rows meets
the networks once, and the written result is joined back, which lets a hot address's rows be split.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.net import _address, _groups, _v4_tail_as_hex, is_ipv4, is_ipv6
from alertloom.session import stage

BROADCAST_ROWS = 500_000


def _bits(parts: Column, base: int, width: int) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.lpad(F.conv(p, base, 2), width, "0")), "")


def address_bits(c: Column) -> Column:
    """``4`` and 32 bits, or ``6`` and 128 bits; null for what is no address.  Zones are ignored."""
    v4 = F.concat(F.lit("4"), _bits(F.split(c, r"\."), 10, 8))
    v6 = F.concat(F.lit("6"), _bits(F.split(_groups(_v4_tail_as_hex(F.lower(_address(c)))), ":"), 16, 16))
    return F.when(is_ipv4(c), v4).when(is_ipv6(c), v6)


def network_prefixes(networks: DataFrame, cidr: str = "cidr", label: str = "zone") -> DataFrame:
    """``(prefix, label)`` of valid networks; bits behind the prefix do not matter.  Of a network listed twice the lower label counts."""
    parts = F.split(F.trim(F.col(cidr)), "/")
    bits, size = address_bits(parts[0]), F.get(parts, F.lit(1)).try_cast("int")
    sound = bits.isNotNull() & (F.size(parts) == 2) & size.between(0, F.length(bits) - 1)
    rows = networks.where(sound).select(F.substring(bits, F.lit(1), size + 1).alias("prefix"), F.col(label).cast("string").alias("label"))
    return rows.groupBy("prefix").agg(F.min("label").alias("label"))


def with_network(events: DataFrame, networks: DataFrame, address: str = "src_ip", cidr: str = "cidr", label: str = "zone",
                 into: str = "network") -> DataFrame:
    """The events with ``into``: the label of the longest network that holds the address, null without one."""
    listed = stage(network_prefixes(networks, cidr, label), "networks")
    sizes = [r[0] for r in listed.select(F.concat(F.substring("prefix", 1, 1), F.lit(":"), F.length("prefix"))).distinct().collect()]
    found = events.select(F.col(address).alias("_address")).distinct().withColumn("_bits", address_bits(F.col("_address"))).where("_bits is not null")
    own = F.array(*(F.when(F.col("_bits").startswith(s[0]), F.substring("_bits", 1, int(s[2:]))) for s in sorted(sizes))) if sizes else F.array().cast("array<string>")
    prefixes = found.select("_address", F.explode(F.array_compact(own)).alias("prefix"))
    few = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = stage(prefixes.join(F.broadcast(listed) if few else listed, "prefix").groupBy("_address").agg(
        F.max_by("label", F.length("prefix")).alias("_label")), "network-hits")
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = events.join(F.broadcast(hits) if few else hits, events[address] == F.col("_address"), "left")
    return joined.select(*events.columns, F.col("_label").alias(into))
