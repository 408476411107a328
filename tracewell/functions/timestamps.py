"""Times as programs write them, as UTC epoch milliseconds.

An ordered cascade of anchored patterns: the first that fits the whole text decides, and its parts are checked
strictly (an impossible date or time names no instant). What the text leaves open comes from the source's
defaults: its time zone and its year; a zone may have any name of the time-zone database. Local times that occur twice
or never follow a named policy (:class:`LocalPolicy`). Everything is column expressions and runs inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.addresses import let

# Month and weekday names as programs write them.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
WEEKDAYS = "mon tue wed thu fri sat sun"

_MON = "(" + "|".join(m.capitalize() for m in MONTHS.split()) + ")[a-z]*"
_DAY = "(?:" + "|".join(d.capitalize() for d in WEEKDAYS.split()) + ")[a-z]*"
_ZONE = r"([Zz]|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5})?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_NAMED = r"(?:\[([A-Za-z0-9_+/-]+)\]?)?"

#: (pattern, template) in order; a template puts the groups into year|month|day|hour|minute|second|fraction|zone|named zone.
CASCADE: list[tuple[str, str]] = [
    (rf"(\d{{4}})[-/](\d{{2}})[-/](\d{{2}})(?:[Tt ]\s*{_CLOCK})?\s*{_ZONE}{_NAMED}", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?\s*{_ZONE}{_NAMED}", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:[Tt, ]\s*{_CLOCK})?\s*{_ZONE}{_NAMED}", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(\d{{1,2}})/{_MON}/(\d{{4}})(?:[: ]{_CLOCK})?\s*{_ZONE}{_NAMED}", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(?:{_DAY},?\s+)?(\d{{1,2}})[ -]+{_MON}[ -]+(\d{{4}})(?:\s+{_CLOCK})?\s*{_ZONE}{_NAMED}", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(?:{_DAY},?\s+)?{_MON}\s+(\d{{1,2}})\s+{_CLOCK}\s+(?:([A-Za-z]{{1,5}}|[+-]\d{{2}}:?\d{{2}})\s+)?(\d{{4}})", "$8|$1|$2|$3|$4|$5|$6|$7|"),
    (rf"(?:{_DAY},?\s+)?{_MON}\s+(\d{{1,2}})(?:\s+{_CLOCK})?\s*{_ZONE}{_NAMED}", "|$1|$2|$3|$4|$5|$6|$7|$8"),
]

#: A bare number counts in the unit that puts it into these years.
EPOCH_FROM, EPOCH_TO = 1640995200, 1798761600
_AROUND = r"[\s \"'`\[\](){}<>“”‘’«»]+"
#: More names than the time-zone database has mean that the lookup is not one of sources.
MOST_ZONES = 2000


@cache
def zone_names() -> list[str]:
    """Every name of the time-zone database that both sides know, the driver's and the JVM's."""
    jvm = getattr(SparkSession.active(), "_jvm", None)
    known = available_timezones() - {"Factory", "localtime"}
    return sorted(known & set(jvm.java.time.ZoneId.getAvailableZoneIds()) if jvm else known)


def zone_abbreviations(names: list[str], first: int = 2000, last: int = 2037) -> dict[str, int]:
    """``zone|abbreviation`` -> seconds east of UTC, in the meaning nearest to the years of the data."""
    found: dict[str, int] = {}
    for name in names:
        try:
            zone = ZoneInfo(name)
        except (ValueError, OSError, KeyError):
            continue
        for year in [*range(2022, 2027), *range(2021, first - 1, -1), *range(2027, last + 1)]:
            for step in range(0, 365, 7):
                at = (datetime(year, 1, 1, tzinfo=UTC) + timedelta(days=step)).astimezone(zone)
                short = at.tzname() or ""
                if short.isalpha():
                    found.setdefault(f"{name}|{short.upper()}", int(at.utcoffset().total_seconds()))
    return found


@dataclass(frozen=True)
class LocalPolicy:
    """What a local time means that clocks show twice (``earlier``, ``later`` or ``none``) or never (``forward`` by the gap
    or ``none``)."""

    twice: str = "earlier"
    never: str = "forward"

    def __post_init__(self) -> None:
        if self.twice not in ("earlier", "later", "none") or self.never not in ("forward", "none"):
            raise ValueError(f"no such policy: {self}")

    def apply(self, instant: Column, wall: Column, zone: Column) -> Column:
        """instant: the earlier one, or the one moved forward; wall: the local time read as UTC; all in milliseconds."""
        if self == LocalPolicy():
            return instant
        shown = lambda at: F.when(at.isNotNull(), F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(at), zone)))
        # clocks that show a time twice go back within three hours of the first
        again = lambda e: e + (shown(e) - e) - (shown(e + 3 * 3_600_000) - e - 3 * 3_600_000)
        is_twice = lambda e: (again(e) > e) & (shown(again(e)) == wall)
        out = {"earlier": lambda e: e, "later": lambda e: F.when(is_twice(e), again(e)).otherwise(e), "none": lambda e: F.when(~is_twice(e), e)}[self.twice]
        return let(instant, (lambda e: F.when(shown(e) == wall, out(e))) if self.never == "none" else out)


def _epoch(text: Column) -> Column:
    number = F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(38,9)")
    fits = lambda scale: (number >= F.lit(EPOCH_FROM * scale)) & (number < F.lit(EPOCH_TO * scale))
    cut = lambda c: F.floor(c).cast("bigint")
    return F.when(fits(1), cut(number * 1000)).when(fits(10**3), cut(number)).when(fits(10**6), cut(number / 1000)).when(fits(10**9), cut(number / 1000000))


def _instant(parts: Column, zone: Column, year: Column, offsets: Column, policy: LocalPolicy) -> Column:
    at = lambda i: F.nullif(F.try_element_at(parts, F.lit(i)), F.lit(""))
    num = lambda i, default: F.coalesce(at(i).try_cast("int"), F.lit(default))
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS.split()]), F.lower(F.substring(at(2), 1, 3)))
    month = F.coalesce(at(2).try_cast("int"), named.cast("int"))
    y = F.coalesce(at(1).try_cast("int"), F.when(at(1).isNull(), year))
    millis = F.rpad(F.substring(F.coalesce(at(7), F.lit("")), 1, 3), 3, "0").cast("int")
    written = F.upper(F.regexp_replace(F.coalesce(at(8), F.lit("")), r"\A(?i:UTC|GMT)(?=[+-])", ""))
    sign = F.when(F.startswith(written, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(written, r"[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    numeric = F.when(written.rlike(r"\A[+-]") & (minutes <= 18 * 60) & (F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) < 60), sign * minutes * 60)
    own = F.coalesce(zone, F.lit("UTC"))
    offset = F.when(written.isin("Z", "UTC", "GMT", "UT"), F.lit(0)).when(written.rlike(r"\A[+-]"), numeric).otherwise(F.try_element_at(offsets, F.concat(own, F.lit("|"), written)))
    sound = (num(4, 0) <= 23) & (num(5, 0) <= 59) & (num(6, 0) <= 59)
    wall = lambda where: F.unix_millis(F.try_make_timestamp(y, month, num(3, 0), num(4, 0), num(5, 0), num(6, 0).cast("decimal(16,6)"), where)) + millis
    local = F.coalesce(at(9), own)
    known = local.isin(zone_names())  # more than ten literals become one hash set
    return F.when(sound, F.when(written != "", wall(F.lit("UTC")) - offset.cast("bigint") * 1000).when(known, policy.apply(wall(local), wall(F.lit("UTC")), local)))


def epoch_millis(text: Column, zone: Column, year: Column, offsets: Column, policy: LocalPolicy = LocalPolicy()) -> Column:
    """The instant a text names, as epoch milliseconds UTC; null where it names none.

    zone: the source's zone name, null for UTC; year: stands in for a missing one; offsets: a map column of
    :func:`zone_abbreviations`. Quotes, brackets and blanks around the text do not
    count. Finer digits than milliseconds are cut off.
    """

    def cascade(t: Column) -> Column:
        canon = None
        for pattern, template in CASCADE:
            anchored = rf"\A{pattern}\z"
            form = F.regexp_replace(t, anchored, template)
            canon = F.when(t.rlike(anchored), form) if canon is None else canon.when(t.rlike(anchored), form)
        parsed = let(F.split(canon, r"\|", -1), lambda p: _instant(p, zone, year, offsets, policy))
        return F.when(t.rlike(r"\A\d+(?:[.,]\d+)?\z"), _epoch(t)).otherwise(parsed)

    return let(F.regexp_replace(text, rf"\A{_AROUND}|{_AROUND}\z", ""), cascade)


def normalise(rows: DataFrame, text: str, sources: DataFrame, key: str = "file", out: str = "ts_ms", policy: LocalPolicy = LocalPolicy()) -> DataFrame:
    """Adds ``out``: the instant that column ``text`` names, with zone and year from ``sources`` by ``key``.

    sources: key, tz_name, log_year, one row per key (of several the smallest holds). A key that sources lacks means
    UTC and no year; so does a null key. Null, empty and unreadable texts give null. A zone name that the database
    lacks leaves local times without an instant. Repeated rows stay repeated; an empty table gives an empty one; a
    column already named like ``out`` is replaced.
    """
    defaults = sources.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(F.col("tz_name").alias("z"), F.col("log_year").alias("y"))).alias("__d"))
    names = [r[0] for r in sources.select("tz_name").where("tz_name IS NOT NULL").distinct().limit(MOST_ZONES + 1).collect()]
    if len(names) > MOST_ZONES:
        raise ValueError(f"sources has more than {MOST_ZONES} time-zone names")
    table = zone_abbreviations(sorted({"UTC", *names}))
    offsets = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    kept = [F.col(f"`{c}`") for c in rows.columns if c != out]
    instant = epoch_millis(F.col(text), F.col("__d.z"), F.col("__d.y"), offsets, policy)
    return rows.join(defaults, rows[key] == defaults["__key"], "left").select(*kept, instant.alias(out))
