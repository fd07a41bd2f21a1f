"""IP text checks and canonical forms, as JVM-side expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9a-fA-F]{1,4}"


def is_ipv4(c: Column) -> Column:
    return c.rlike(rf"^{_V4}\z")


def _address(c: Column) -> Column:
    return F.substring_index(c, "%", 1)


def is_ipv6(c: Column) -> Column:
    """Eight groups, or fewer with one '::'; the tail may be dotted IPv4; a zone may follow."""
    # A dotted tail counts as two groups.
    hexed = F.regexp_replace(_address(c), rf"{_V4}\z", "0:0")
    full = hexed.rlike(rf"^{_H}(?::{_H}){{7}}\z")
    short = hexed.rlike(rf"^(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*)?\z")
    groups = F.size(F.array_remove(F.split(hexed, ":"), ""))
    return (full | (short & (groups <= 7))) & (~c.contains("%") | c.rlike(r"^[^%]+%[^%]+\z"))


def is_ip(c: Column) -> Column:
    return F.when(is_ipv4(c), True).otherwise(is_ipv6(c))


def _v4_tail_as_hex(addr: Column) -> Column:
    quad = F.split(F.regexp_extract(addr, rf"({_V4})\z", 1), r"\.")
    pair = [F.lower(F.hex(quad[i].cast("int") * 256 + quad[i + 1].cast("int"))) for i in (0, 2)]
    head = F.regexp_replace(addr, rf"{_V4}\z", "")
    return F.when(addr.rlike(rf"{_V4}\z"), F.concat(head, pair[0], F.lit(":"), pair[1])).otherwise(addr)


def _groups(addr: Column) -> Column:
    """The eight colon-joined groups of an IPv6 address without zone, leading zeros dropped."""
    halves = F.split(addr, "::")
    left = F.array_remove(F.split(halves[0], ":"), "")
    right = F.array_remove(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), "")
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)).cast("int"))
    joined = F.array_join(F.concat(left, zeros, right), ":")
    return F.regexp_replace(joined, "(^|:)0+(?=[0-9a-f])", "$1")


def _squeeze(flat: Column) -> Column:
    """Colon-joined groups with the first longest run of two or more zeros as '::'."""
    for n in range(8, 1, -1):  # after one replacement no shorter run is looked for
        flat = F.regexp_replace(flat, rf"^(?!.*::)(|.*?:)0(?::0){{{n - 1}}}(|:.*)$", "$1::$2")
    return F.regexp_replace(flat, ":{3,}", "::")


def canonical_ip(c: Column) -> Column:
    """IPv4 unchanged; IPv6 lower case, leading zeros dropped, first longest zero run as '::'."""
    v6 = _squeeze(_groups(_v4_tail_as_hex(F.lower(_address(c)))))
    zone = F.when(c.contains("%"), F.concat(F.lit("%"), F.substring_index(c, "%", -1))).otherwise("")
    return F.when(~c.contains(":"), c).when(is_ipv6(c), F.concat(v6, zone)).otherwise(c)


def defang(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("[.]"))
