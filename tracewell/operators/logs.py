"""The log domain as column expressions: level, source and time of a line, predicates, context, paging, statistics.

Everything is built-in functions, so a filter stays next to the scan and inside generated code. Columns are kept
nullable (null is unknown); 0 and ``unknown`` appear only where a report asks for them.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from dataclasses import fields as fields_of
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.errors import UsageError
from tracewell.functions.addresses import let
from tracewell.report import check_schema, to_json

# Levels in order, and the widths in seconds that a histogram's buckets can have.
LEVEL_ORDER = ["trace", "debug", "info", "warn", "error", "fatal", "unknown"]
BUCKET_SECONDS = [60, 300, 900, 3600, 86400]
MOST_BUCKETS = 60

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAMES = {"trace": ["trace"], "debug": ["debug"], "info": ["info"], "warn": ["warn", "warning"], "error": ["err", "error"], "fatal": ["crit", "critical", "fatal"]}


def ascii_lower(text: Column) -> Column:
    """Lower case for ASCII letters only; everything else stays as it is."""
    return F.translate(text, _UPPER, _LOWER)


def level_named(word: Column) -> Column:
    """The level that a word names, null for any other word."""
    names = F.create_map(*[F.lit(x) for level, words in _NAMES.items() for w in words for x in (w, level)])
    return F.try_element_at(names, ascii_lower(word))


def severity_level(number: Column) -> Column:
    """The level of a syslog severity: the three lowest bits count."""
    levels = ["fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug"]
    return F.get(F.array(*[F.lit(x) for x in levels]), number.bitwiseAND(7))


def level_rank(level: Column) -> Column:
    """Place in the order of levels; unknown comes last and has to be left out where only severity counts."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), level).cast("int") - 1, F.lit(6))


def _digits(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def json_object(raw: Column) -> Column:
    """The top-level fields of a line that is a JSON object, values as text or JSON text; null for any other line."""
    text = F.trim(raw, F.lit(" \t\r\n"))
    return F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")) & F.try_parse_json(text).isNotNull(), F.from_json(text, "map<string,string>"))


def field(fields: Column, *names: str) -> Column:
    """The value of the first field, in sorted key order, whose name is one of the given ones, letter case aside."""
    entries = F.array_sort(F.map_entries(fields))
    hits = F.filter(entries, lambda e: ascii_lower(e["key"]).isin([n.lower() for n in names]))
    return F.try_element_at(hits, F.lit(1))["value"]


_WORDS = "|".join(n for names in _NAMES.values() for n in sorted(names, key=len, reverse=True))
#: What can state a level, at its leftmost place: a priority at the head or after a tag, PRIORITY=, a pair, a name in
#: brackets or before a colon, a bare name at the head or after a leading date and time.
_STATED = (
    r"\A<(?:1[0-8]\d|19[01]|\d{1,2})>|(?<=:\s)<[0-7]>|(?<!\S)PRIORITY=[0-7](?!\S)"
    rf"|(?i)(?<!\S)(?:level|lvl|severity)=[\"',;]*(?:{_WORDS})[\"',;]*(?!\S)"
    rf"|(?<!\S)[\[(<][\[\]()<>:]*(?:{_WORDS})[\[\]()<>:]*[\])>]:?(?!\S)|(?<!\S)[\[\]()<>:]*(?:{_WORDS})[\[\]()<>:]*:(?!\S)"
    rf"|\A(?:\d{{4}}-\d{{2}}-\d{{2}}\S*\s+|\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\S*\s+)?(?:{_WORDS})(?!\S)"
)


def stated_level(raw: Column) -> Column:
    """The leftmost statement of a level within the first eight words of a line, empty where there is none."""
    return F.regexp_extract(F.regexp_extract(F.trim(raw, F.lit(" \t\r\n")), r"\A(?:\S+\s+){0,7}\S+", 0), _STATED, 0)


def level_of(stated: Column) -> Column:
    """The level that a statement names."""
    number = F.regexp_extract(stated, r"(?:<|PRIORITY=)(\d+)", 1)
    name = F.regexp_extract(stated, r"([A-Za-z]+)[^A-Za-z]*\z", 1)
    return F.when(stated != "", F.when(number != "", severity_level(number.try_cast("int"))).otherwise(level_named(name)))


def detect_level(raw: Column) -> Column:
    """The level a text line states within its first eight words; null if it states none."""
    return level_of(stated_level(raw))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns added that are worked out once a row, whatever filters and projections follow: a generator of one
    row is no projection that the optimizer could copy into its consumers."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def strip_priority(raw: Column) -> Column:
    """A line without the syslog priority, and version, at its head."""
    return F.regexp_replace(F.ltrim(raw), r"\A<\d{1,3}>(?:\d\s)?\s*", "")


def syslog_source(raw: Column) -> Column:
    """The program of ``<time> host program[pid]:``, null where the line has no such head or names a level there."""
    time = r"(?:[A-Z][a-z]{2}\s++\d{1,2}\s++\d{2}:\d{2}:\d{2}\S*+|\d{4}-\d{2}-\d{2}T\S++|\d{4}-\d{2}-\d{2}(?:\s++\d{2}:\d{2}:\d{2}\S*+)?)"
    host = r"(?![A-Z][a-z]{2}\s+\d|\d{4}-|\[)\S++(?<!:)"
    tag = F.nullif(F.regexp_extract(raw, rf"\A\s*+(?:<\d{{1,3}}>(?:\d\s)?\s*+)?(?:{time}\s++)?{host}\s++([A-Za-z0-9_./-]++)(?:\[\d*+\])?:(?:\s|\z)", 1), F.lit(""))
    return F.when(level_named(tag).isNull(), tag)


_ISO = r"\A\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)?)?\z"


def _civil(text: Column) -> Column:
    """Milliseconds of an ISO date and time, UTC where it has no offset; null where it is none."""
    zoned = F.substring(text, 17, 50).rlike("[Zz+-]")
    # a time of hours and minutes gets its seconds, which a cast needs
    plain = F.regexp_replace(F.translate(text, ",z", ".Z"), r"\A(.{10}[T ]\d{2}:\d{2})(?!:)", "$1:00")
    full = F.when(zoned, plain).when(F.length(text) == 10, F.concat(plain, F.lit("T00:00:00Z"))).otherwise(F.concat(plain, F.lit("Z")))
    return F.when(text.rlike(_ISO), F.unix_millis(full.try_cast("timestamp")))


def parse_bound(text: Column) -> Column:
    """A bound of time as epoch milliseconds: with an offset, without one (UTC), or a date alone (midnight UTC)."""
    return _civil(F.trim(text))


def extract_timestamp(raw: Column, year: int | Column) -> Column:
    """The time of a line as epoch milliseconds, null where none can be told.

    An object's ts, time or timestamp (a number counts milliseconds), else its journal time in microseconds; else a
    date and time or a date at the line's head, or a syslog time, to which ``year`` is added.
    """
    year = F.lit(year) if isinstance(year, int) else year
    return let(raw, lambda t: let(json_object(t), lambda o: F.when(o.isNotNull(), object_time(t, o)).otherwise(text_time(t, year))))


def object_time(raw: Column, o: Column) -> Column:
    """The time of a line that is an object, by its fields."""

    def of(value: Column) -> Column:
        number = F.when(value.rlike(r"\A-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z"), F.floor(value.try_cast("double")).cast("bigint"))
        is_text = F.regexp_extract(F.trim(raw), r'(?i)"(?:ts|time|timestamp)"\s*:\s*(")', 1) != ""
        own = F.when(is_text, _civil(value)).otherwise(F.coalesce(value.try_cast("bigint"), number))
        micros = field(o, "__REALTIME_TIMESTAMP").try_cast("bigint")
        return F.when(value.isNotNull(), own).otherwise(F.floor(micros / 1000).cast("bigint"))

    return let(field(o, "ts", "time", "timestamp"), of)


_HEAD = r"\A\s*(?:<\d{1,3}>(?:\d\s)?\s*)?"


def time_token(raw: Column) -> Column:
    """The date and time at the head of a line as written, after a priority; empty where there is none."""
    return F.regexp_extract(raw, _HEAD + r"(\d{4}-\d{2}-\d{2}T\S+|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\S*|\d{4}-\d{2}-\d{2}(?=\s|\z)|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d{1,2} \d{2}:\d{2}:\d{2})", 1)


def token_time(token: Column, year: Column) -> Column:
    """The instant of such a token; the year stands in for a syslog time's missing one."""
    written = F.concat(year.cast("string"), F.lit(" "), F.regexp_replace(token, " +", " "), F.lit(" Z"))
    return F.when(token == "", F.lit(None).cast("bigint")).when(token < ":", _civil(token)).otherwise(F.unix_millis(F.try_to_timestamp(written, F.lit("yyyy MMM d HH:mm:ss X"))))


def text_time(raw: Column, year: Column) -> Column:
    """The time at the head of a line of text."""
    return token_time(time_token(raw), year)


RECORD_COLUMNS = ("ts_ms", "level", "source", "message", "fields")


def parse_records(lines: DataFrame, year: int, raw: str = "raw", columns: tuple[str, ...] = RECORD_COLUMNS) -> DataFrame:
    """Adds ts_ms, level, source, message and fields to lines, replacing columns of these names; or only those of them that
    ``columns`` names, for what is not asked for is not worked out.

    lines: the named text column; others pass through. A null text is an empty line; colours don't count. Unknown stays null.
    """
    known = ["level", "severity", "priority", "msg", "message", "source", "logger", "component", "service", "syslog_identifier", "_comm", "ts", "time", "timestamp", "__realtime_timestamp"]

    def numeric(v: Column) -> Column:
        return F.coalesce(level_named(v), F.when(v.rlike(r"\A[0-7]\z"), severity_level(v.try_cast("int"))))

    kept = [c for c in lines.columns if c not in RECORD_COLUMNS]
    text = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"\x1b\[[0-9;]*[A-Za-z]", "")
    objects = F.startswith(F.ltrim(F.col("__t")), F.lit("{"))
    # first the few matches that a line costs, once; then what they say, once
    df = once(lines.select(*[F.col(f"`{c}`") for c in kept]), __t=text)
    matches = {"__w": ("level", stated_level), "__k": ("ts_ms", time_token), "__q": ("source", syslog_source)}
    df = once(df, __o=F.when(objects, json_object(F.col("__t"))), **{m: f(F.col("__t")) for m, (c, f) in matches.items() if c in columns})
    o = F.col("__o")
    named = lambda *n: F.nullif(field(o, *n), F.lit(""))
    by = lambda of_object, of_text: F.when(o.isNotNull(), of_object).otherwise(of_text)
    told = dict(
        ts_ms=lambda: by(object_time(F.col("__t"), o), token_time(F.col("__k"), F.lit(year))),
        level=lambda: by(F.coalesce(let(field(o, "severity"), numeric), let(field(o, "level"), numeric), let(field(o, "priority"), numeric)), level_of(F.col("__w"))),
        source=lambda: by(F.coalesce(named("source", "logger", "component", "service"), named("SYSLOG_IDENTIFIER"), named("_COMM")), F.col("__q")),
        message=lambda: by(F.coalesce(named("msg", "message"), F.col("__t")), F.col("__t")),
        fields=lambda: F.when(o.isNotNull(), F.map_filter(o, lambda k, v: ~ascii_lower(k).isin(known))),
    )
    return once(df, **{c: told[c]() for c in RECORD_COLUMNS if c in columns}).drop("__t", "__o", "__w", "__k", "__q")


@dataclass(frozen=True)
class LogFilter:
    """What lines to keep. An empty or blank query keeps all. Bounds are inclusive; lines without level or time count
    as outside unless ``include_unknown``; a least level of ``unknown`` keeps only lines without one."""

    query: str | None = None
    regex: str | None = None
    min_level: str | None = None
    since_ms: int | None = None
    until_ms: int | None = None
    source: str | None = None
    include_unknown: bool = False

    def __post_init__(self) -> None:
        if self.min_level is not None and self.min_level not in LEVEL_ORDER:
            raise UsageError(f"no such level: {self.min_level}")
        if self.since_ms is not None and self.until_ms is not None and self.since_ms > self.until_ms:
            raise UsageError("the first time is after the last")
        if self.regex is not None:
            # the pattern runs in the JVM, so it is the JVM that must know it
            spark = SparkSession.getActiveSession()
            if spark is not None and hasattr(spark, "_jvm"):
                try:
                    spark._jvm.java.util.regex.Pattern.compile(self.regex)
                except Exception as e:  # noqa: BLE001 - a Java exception behind the gateway
                    raise UsageError(f"invalid pattern: {self.regex}") from e

    def level_ok(self, level: Column) -> Column:
        if self.min_level is None:
            return F.lit(True)
        known = level.isNotNull() & (level != "unknown")
        if self.min_level == "unknown":
            return ~known
        return F.coalesce(F.when(known, level_rank(level) >= LEVEL_ORDER.index(self.min_level)), F.lit(self.include_unknown))

    def level_possible(self, raw: Column) -> Column:
        """What every line with a level of ``min_level`` or above shows in its text: a name of such a level, or a form that
        states one by number. It costs little and is checked at the scan, so only such lines are parsed."""
        if self.include_unknown or self.min_level in (None, "unknown") or LEVEL_ORDER.index(self.min_level) < LEVEL_ORDER.index("warn"):
            return F.lit(True)
        names = [n for x in LEVEL_ORDER[LEVEL_ORDER.index(self.min_level) : -1] for n in _NAMES[x]]
        low = F.lower(raw)
        has = lambda text, part: F.contains(text, F.lit(part))
        out = has(raw, "\x1b") | has(raw, "\\u") | has(low, "severity") | has(low, "priority") | has(raw, "<") & raw.rlike(r"<\d") | has(low, "level") & low.rlike(r"level\W{1,5}[0-7]")
        for n in names:
            if not any(other != n and other in n for other in names):  # a name in another one is enough
                out = out | has(low, n)
        return out

    def time_ok(self, ts_ms: Column) -> Column:
        if self.since_ms is None and self.until_ms is None:
            return F.lit(True)
        low = ts_ms >= self.since_ms if self.since_ms is not None else F.lit(True)
        high = ts_ms <= self.until_ms if self.until_ms is not None else F.lit(True)
        return F.when(ts_ms.isNull(), self.include_unknown).otherwise(low & high)

    def text_ok(self, raw: Column) -> Column:
        out = contains_insensitive(raw, self.query) if self.query and self.query.strip() else F.lit(True)
        return out & raw.rlike(self.regex) if self.regex else out

    def source_ok(self, source: Column) -> Column:
        return F.coalesce(source == self.source, F.lit(False)) if self.source is not None else F.lit(True)

    def condition(self, raw: str = "raw", level: str = "level", ts_ms: str = "ts_ms", source: str = "source", from_text: bool = False) -> Column:
        """The whole predicate; text comes first, so Catalyst can evaluate it at the scan. ``from_text`` says that the levels
        are those that :func:`parse_records` read from this text, so text that can have no such level is left out there."""
        possible = self.level_possible(F.col(raw)) if from_text else F.lit(True)
        return self.text_ok(F.col(raw)) & possible & self.time_ok(F.col(ts_ms)) & self.level_ok(F.col(level)) & self.source_ok(F.col(source))


def contains_insensitive(text: Column, needle: str) -> Column:
    """Substring test in which only ASCII letters match in either case; an empty needle is in every text."""
    return F.contains(ascii_lower(text), F.lit(needle.translate(str.maketrans(_UPPER, _LOWER))))


def rejected_by_unknown(df: DataFrame, keep: LogFilter) -> DataFrame:
    """(unknown_level, unknown_timestamp): rows that pass all else but have no level, or no time; level goes first."""
    text = keep.text_ok(F.col("raw")) & keep.source_ok(F.col("source"))
    no_level = F.col("level").isNull() | (F.col("level") == "unknown")
    by_level = text & keep.time_ok(F.col("ts_ms")) & no_level & ~keep.level_ok(F.col("level"))
    by_time = text & keep.level_ok(F.col("level")) & F.col("ts_ms").isNull() & ~keep.time_ok(F.col("ts_ms"))
    return df.agg(F.count_if(by_level).alias("unknown_level"), F.count_if(by_time & ~by_level).alias("unknown_timestamp"))


def with_context(lines: DataFrame, match: Column, before: int, after: int, stretch: int = 100_000) -> DataFrame:
    """Matching lines and up to ``before`` and ``after`` lines around each, once, within one file; adds ``is_match``.

    lines: file, line_no and what ``match`` reads; rows without line_no are left out. Neighbours are by the order of line
    numbers, which may have gaps; repeated rows of a number are one line. A file is worked on in stretches, each with
    copies of the lines just outside it, so that a large file meets many tasks: lines are first counted off by stretches
    of numbers, of which only the counts meet by file, then cut by their places.
    """
    block = lambda n: F.floor(n / F.lit(stretch))
    df = lines.where("line_no IS NOT NULL").withColumn("__m", F.coalesce(match, F.lit(False))).withColumn("__c", block(F.col("line_no")))
    earlier = Window.partitionBy("__f").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(F.col("file").alias("__f"), F.col("__c").alias("__k")).agg(F.count_distinct("line_no").alias("__n"))
    counts = counts.withColumn("__past", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    within = df.withColumn("__r", F.dense_rank().over(Window.partitionBy("file", "__c").orderBy("line_no")))
    df = within.join(counts, F.col("file").eqNullSafe(F.col("__f")) & (F.col("__c") == F.col("__k"))).withColumn("__at", F.col("__past") + F.col("__r") - 1).drop("__f", "__k", "__c", "__r", "__past")
    # a line is also seen by the stretches that it can be context for, or whose lines can be context for it
    blocks = F.sequence(block(F.greatest(F.col("__at") - F.lit(after), F.lit(0))), block(F.col("__at") + F.lit(before)))
    spread = df.withColumn("__b", F.explode(blocks))
    w = Window.partitionBy("file", "__b").orderBy("__at").rangeBetween(-after, before)
    near = spread.withColumn("__near", F.max("__m").over(w))
    own = near.where((F.col("__b") == block(F.col("__at"))) & F.col("__near"))
    return own.withColumn("is_match", F.col("__m")).drop("__m", "__at", "__b", "__near")


def default_year(now: datetime | None = None) -> int:
    """The year of times written without one: the current one in UTC."""
    return (now or datetime.now(UTC)).year


def checked_year(year: int) -> int:
    """A year that a filter may name; any other is a usage error."""
    if not 1 <= year <= 9999:
        raise UsageError(f"no such year: {year}")
    return year


def bound_ms(text: str) -> int:
    """A bound of time as epoch milliseconds, as :func:`parse_bound` reads it; a usage error if it is none."""
    bare = text.strip()
    if not re.match(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}|$)", bare):
        raise UsageError(f"no such time: {text}")
    try:
        at = datetime.fromisoformat(bare.replace(",", "."))
    except ValueError as e:
        raise UsageError(f"no such time: {text}") from e
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def first_matches(lines: DataFrame, keep: LogFilter, limit: int, after: int = 0, order: str = "input") -> DataFrame:
    """The first ``limit`` matching lines over all inputs, in the order of inputs and lines, each with the lines of its own
    input that follow within ``after`` numbers, as far as they go on from the last match.

    lines: ``order`` (the input's place), line_no and what the filter reads. is_match tells matches from context. The
    limit is the feature; the lines within reach are found by the limit's last match, not by gathering any input."""
    hits = lines.where(keep.condition()).select(order, "line_no").orderBy(order, "line_no").limit(limit)
    near = hits.select(F.col(order).alias("__o"), F.explode(F.sequence(F.col("line_no"), F.col("line_no") + F.lit(after))).alias("__l"), F.col("line_no").alias("__m"))
    wanted = near.groupBy("__o", "__l").agg(F.max(F.col("__l") == F.col("__m")).alias("is_match"))
    return lines.join(wanted, (F.col(order) == F.col("__o")) & (F.col("line_no") == F.col("__l"))).drop("__o", "__l")


def as_jsonl(records: DataFrame) -> DataFrame:
    """(line): one JSON object a record, keys in the order of the columns, null fields included; written with ``write.text``."""
    return records.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]), {"ignoreNullFields": "false"}).alias("line"))


def strict_text(raw: Column) -> Column:
    """Bytes as text where they are UTF-8, null where they are not."""
    return F.try_validate_utf8(raw.cast("string"))


def lossy_text(raw: Column) -> Column:
    """Bytes as text, what is no UTF-8 replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of a total order; the paging itself is the feature."""
    return df.orderBy(*order).offset(offset).limit(limit)


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each file, by line number, with all rows of each; numbers may have gaps. Rows without line_no are
    left out. Each task hands on only its own last n lines of a file."""
    w = Window.partitionBy("file").orderBy(F.desc("line_no"))
    return lines.where("line_no IS NOT NULL").withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") <= n).drop("__r")


def inspect(lines: DataFrame) -> DataFrame:
    """(file, total_lines, lossy_lines)."""
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("total_lines"), F.count_if(F.col("lossy")).alias("lossy_lines"))


def level_counts(records: DataFrame) -> DataFrame:
    """(level, lines), unknown included."""
    return records.groupBy(F.coalesce("level", F.lit("unknown")).alias("level")).agg(F.count(F.lit(1)).alias("lines"))


def span(records: DataFrame) -> DataFrame:
    """(total, first_ms, last_ms, unknown_ts) of the records, in one pass."""
    return records.agg(F.count(F.lit(1)).alias("total"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count_if(F.col("ts_ms").isNull()).alias("unknown_ts"))


def pick_bucket(first_ms: int | None, last_ms: int | None) -> int:
    """The narrowest width, in seconds, that gives at most sixty buckets; an hour where no line has a time."""
    if first_ms is None or last_ms is None:
        return 3600
    seconds = (last_ms - first_ms) // 1000 + 1
    return next((b for b in BUCKET_SECONDS if seconds // b <= MOST_BUCKETS), BUCKET_SECONDS[-1])


def bucket_start(ts_ms: Column, seconds: Column | int) -> Column:
    """Start of a time's bucket in epoch seconds; floors also before 1970."""
    width = F.lit(seconds) if isinstance(seconds, int) else seconds
    s = F.floor(ts_ms / 1000).cast("bigint")
    return s - F.pmod(s, width)


def histogram(records: DataFrame, seconds: int | None = None) -> DataFrame:
    """(bucket_start, total, warn_or_higher): non-empty buckets of equal width, by :func:`pick_bucket` unless given.

    Lines are read once: counted by minute first, of which every width is a multiple, then put together. The number of
    minutes grows with the time that is covered, not with the lines. Records without a time are in no bucket; without a
    level they are not warnings.
    """
    timed = records.where("ts_ms IS NOT NULL")
    rank = level_rank(F.col("level"))
    serious = F.coalesce((rank >= 3) & (rank <= 5), F.lit(False))
    minutes = timed.groupBy(bucket_start(F.col("ts_ms"), BUCKET_SECONDS[0]).alias("__m")).agg(F.count(F.lit(1)).alias("total"), F.count_if(serious).alias("warn_or_higher"), F.min("ts_ms").alias("__a"), F.max("ts_ms").alias("__b"))
    if seconds is None:
        whole = Window.partitionBy(F.lit(0))
        reach = F.floor((F.max("__b").over(whole) - F.min("__a").over(whole)) / 1000) + 1
        minutes = minutes.withColumn("__s", reach)
        width = F.lit(BUCKET_SECONDS[-1])
        for b in reversed(BUCKET_SECONDS[:-1]):
            width = F.when(F.floor(F.col("__s") / b) <= MOST_BUCKETS, F.lit(b)).otherwise(width)
    elif seconds % BUCKET_SECONDS[0] == 0:
        width = F.lit(seconds)
    else:
        return timed.groupBy(bucket_start(F.col("ts_ms"), seconds).alias("bucket_start")).agg(F.count(F.lit(1)).alias("total"), F.count_if(serious).alias("warn_or_higher"))
    start = (F.col("__m") - F.pmod(F.col("__m"), width)).cast("bigint")
    return minutes.groupBy(start.alias("bucket_start")).agg(F.sum("total").alias("total"), F.sum("warn_or_higher").alias("warn_or_higher"))


def rfc3339(ts_ms: Column) -> Column:
    """Seconds precision, UTC."""
    return F.date_format(F.timestamp_millis(F.floor(ts_ms / 1000).cast("bigint") * 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'")


SESSION_SCHEMA = "tracewell.log-session/v1"


def save_session(keep: LogFilter, inputs: list[str], year: int | None = None) -> str:
    """A filter and its inputs as a document."""
    return to_json({"schema": SESSION_SCHEMA, "filter": asdict(keep), "inputs": inputs, "year": year}, pretty=True)


def load_session(text: str) -> tuple[LogFilter, list[str], int | None]:
    """The filter, inputs and year of such a document; another schema is an error, fields that are missing keep defaults."""
    doc = check_schema(json.loads(text), SESSION_SCHEMA)
    known = {f.name for f in fields_of(LogFilter)}
    return LogFilter(**{k: v for k, v in doc.get("filter", {}).items() if k in known}), doc.get("inputs", []), doc.get("year")
