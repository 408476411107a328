"""Socket addresses as column expressions: validity and one spelling per address, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9A-Fa-f]{1,4}"


def _ipv6_pattern() -> str:
    """Every text form of RFC 4291: eight groups, one ``::`` for one or more of them, a dotted tail for the last two."""
    forms = [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{IPV4}"]
    for left in range(8):
        head = rf"{_H}(?::{_H}){{{left - 1}}}" if left else ""
        right = 7 - left
        tail = rf"(?:{_H}(?::{_H}){{0,{right - 1}}})?" if right else ""
        forms.append(f"{head}::{tail}")
        if left <= 5:
            forms.append(rf"{head}::(?:{_H}:){{0,{5 - left}}}{IPV4}")
    return "(?:" + "|".join(forms) + ")"


IPV6 = _ipv6_pattern()


def is_ipv4(address: Column) -> Column:
    """Four decimal numbers 0-255 without leading zeros; null counts as no address."""
    return F.coalesce(address.rlike(rf"\A{IPV4}\z"), F.lit(False))


def is_ipv6(address: Column) -> Column:
    """A plain IPv6 address, without brackets, port, prefix length or zone; null counts as no address."""
    return F.coalesce(address.rlike(rf"\A{IPV6}\z"), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body applied to a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grouped(text: Column) -> Column:
    """The eight groups of a valid address in lower case, as hexadecimal numbers without leading zeros."""
    tail = F.regexp_extract(text, rf"({IPV4})\z", 1)

    def widened(octets: Column) -> Column:
        octet = lambda i: F.try_element_at(octets, F.lit(i)).try_cast("int")
        pair = lambda a, b: F.lower(F.hex((octet(a) * 256 + octet(b)).cast("bigint")))
        return F.concat(F.regexp_extract(text, r"\A(.*:)", 1), pair(1, 2), F.lit(":"), pair(3, 4))

    plain = F.when(tail != "", let(F.split(tail, r"\."), widened)).otherwise(text)

    def filled(p: Column) -> Column:
        side = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
        right = F.when(F.contains(p, F.lit("::")), side(F.substring_index(p, "::", -1))).otherwise(F.array().cast("array<string>"))
        whole = lambda lr: F.concat(lr["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(lr["l"]) - F.size(lr["r"]))), lr["r"])
        return let(F.struct(side(F.substring_index(p, "::", 1)).alias("l"), right.alias("r")), whole)

    return F.transform(let(plain, filled), lambda g: F.regexp_replace(g, r"\A0+(?=.)", ""))


def _folded(groups: Column) -> Column:
    byte = lambda i, high: F.floor(F.conv(groups[i], 16, 10).cast("int") / 256 if high else F.conv(groups[i], 16, 10).cast("int") % 256).cast("string")
    dotted = F.concat(F.lit("::ffff:"), F.concat_ws(".", byte(6, True), byte(6, False), byte(7, True), byte(7, False)))

    def cut(flags: Column) -> Column:
        start = F.coalesce(*[F.nullif(F.locate("0" * n, flags), F.lit(0)) for n in range(8, 1, -1)])
        run = lambda at: F.length(F.regexp_extract(F.substring(flags, at, F.lit(8)), r"\A0+", 0))
        short = lambda at: F.concat(F.array_join(F.slice(groups, F.lit(1), at - 1), ":"), F.lit("::"), F.array_join(F.slice(groups, at + run(at), F.lit(8)), ":"))
        return let(start, lambda at: F.when(at.isNull(), F.array_join(groups, ":")).otherwise(short(at)))

    mapped = F.array_join(F.slice(groups, 1, 6), ":") == "0:0:0:0:0:ffff"
    return F.when(mapped, dotted).otherwise(let(F.array_join(F.transform(groups, lambda g: F.when(g == "0", "0").otherwise("1")), ""), cut))


def shortest_ipv6(address: Column) -> Column:
    """RFC 5952 spelling of a valid IPv6 address; anything else comes back trimmed and in lower case, null stays null.

    A dotted tail is rewritten as two groups and ``::`` is expanded, so that all spellings meet in one list of eight
    numbers; the leftmost of the longest runs of two or more zero groups is then folded. Addresses below
    ``::ffff:0:0/96`` keep the dotted tail, as the RFC recommends for this prefix.
    """
    return let(F.lower(F.trim(address)), lambda text: F.when(is_ipv6(text), let(_grouped(text), _folded)).otherwise(text))
