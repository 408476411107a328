"""Delimited feeds: typed rows on one side, rows that cannot become a record, with their reason, on the other.

Rows are read permissively under an explicit schema, with the raw text of what the reader finds corrupt retained.
Only rows that the reader calls corrupt, or whose quoting or control characters a permissive reader might have
smoothed over, are taken apart again, exactly, by quoting, count and value checks. All of it is column
expressions: one narrow pass, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.addresses import is_ipv4, is_ipv6, let
from tracewell.functions.shell import first_word_is_option, splits_into_words

CORRUPT = "_corrupt_record"

SOCKET_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("local_address", T.StringType()),
        T.StructField("local_port", T.IntegerType()),
        T.StructField("remote_address", T.StringType()),
        T.StructField("remote_port", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("inode", T.LongType()),
        T.StructField("uid", T.LongType()),
        T.StructField("tx_queue", T.LongType()),
        T.StructField("rx_queue", T.LongType()),
        T.StructField("unix_path", T.StringType()),
    ]
)
COMMAND_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("directory", "file", "command", "output")])

# The states a socket entry can have.
STATES = ["ESTABLISHED", "SYN_SENT", "SYN_RECV", "FIN_WAIT1", "FIN_WAIT2", "TIME_WAIT", "CLOSE", "CLOSE_WAIT", "LAST_ACK", "LISTEN", "CLOSING", "UNKNOWN"]

_READER = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
_BLANK = r"[ \t]*"
#: Inside quotes a comma is written as these two private-use characters while a row is split; the first of them itself as the other pair.
_MARK, _COMMA, _ITSELF = "\ue000", "\ue000\ue001", "\ue000\ue002"


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t"))


def _segments(raw: Column) -> Column:
    """The row cut at every quote: even places lie outside quotes, odd ones inside; an empty even one is a doubled quote."""
    return F.split(raw, '"', -1)


def broken_quoting(raw: Column) -> Column:
    """True where a quoted field is never closed, text follows a closing quote, or a quote stands inside a bare field."""

    def broken(parts: Column) -> Column:
        outside = lambda x, i: F.when(i % 2 == 1, True).when(i == 0, x.rlike(rf"(?s)\A(?:.*,)?{_BLANK}\z")).when(i == F.size(parts) - 1, x.rlike(rf"(?s)\A{_BLANK}(?:,.*)?\z")).otherwise((x == "") | x.rlike(rf"(?s)\A{_BLANK},(?:.*,)?{_BLANK}\z"))
        return (F.size(parts) % 2 == 0) | ~F.forall(F.transform(parts, outside), lambda ok: ok)

    return F.contains(raw, F.lit('"')) & let(_segments(raw), broken)


def fields(raw: Column) -> Column:
    """The fields of a row whose quoting is sound, unquoted and without the blanks around them."""
    escape = lambda x: F.replace(x, F.lit(_MARK), F.lit(_ITSELF))
    masked = F.array_join(F.transform(_segments(raw), lambda x, i: F.when(i % 2 == 1, F.replace(escape(x), F.lit(","), F.lit(_COMMA))).otherwise(escape(x))), '"')
    bare = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    show = lambda x: F.replace(F.replace(x, F.lit(_COMMA), F.lit(",")), F.lit(_ITSELF), F.lit(_MARK))
    return F.transform(F.split(masked, ",", -1), lambda x: show(bare(_trim(x))))


def _exact(schema: T.StructType, parts: Column) -> Column:
    at = lambda i: F.try_element_at(parts, F.lit(i + 1))
    typed = lambda f, i: F.nullif(at(i), F.lit("")) if isinstance(f.dataType, T.StringType) else F.trim(at(i)).try_cast(f.dataType)
    return F.struct(*[typed(f, i).alias(f.name) for i, f in enumerate(schema.fields)])


def _blank_to_null(schema: T.StructType, rec: Column) -> Column:
    return F.struct(*[(F.nullif(rec[f.name], F.lit("")) if isinstance(f.dataType, T.StringType) else rec[f.name]).alias(f.name) for f in schema.fields])


def _bad_address(kind: Column, address: Column) -> Column:
    return F.when(F.startswith(kind, F.lit("unix")), ~F.coalesce(address == "unix", F.lit(False))).when(kind.isin("tcp", "udp"), ~is_ipv4(address)).when(kind.isin("tcp6", "udp6"), ~is_ipv6(address)).otherwise(False)


def _bad_command(command: Column) -> Column:
    def bad(text: Column) -> Column:
        control = text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
        return (F.trim(text, F.lit(" \t\r\n")) == "") | control | ~splits_into_words(text) | first_word_is_option(text)

    return let(F.coalesce(command, F.lit("")), bad)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + f", {CORRUPT} string"


def classify(rows: DataFrame, raw: str = "raw", feed: str = "feed") -> DataFrame:
    """Adds ``reason`` (null for a usable row), ``socket`` and ``command`` (the typed record) and ``corrupt_raw``.

    rows: any table with the two named string columns; further columns pass through unchanged, and columns already
    named like an added one are replaced. ``reason`` is the first that applies of broken_quoting, column_count,
    invalid_local_address, invalid_state, invalid_command. A null or empty raw text has no fields or one, so
    its reason is column_count. A number that cannot be read leaves a null in an otherwise usable record. A feed that
    is null or neither ``sockets`` nor ``compile_commands`` has no layout: only its quoting is judged and no record is
    built. Repeated rows stay repeated; an empty table gives an empty one.
    """
    is_socket, is_command = F.coalesce(F.col(feed) == "sockets", F.lit(False)), F.coalesce(F.col(feed) == "compile_commands", F.lit(False))

    def permissive(row: Column) -> Column:
        return F.struct(F.when(is_socket, F.from_csv(row, _ddl(SOCKET_SCHEMA), _READER)).alias("s"), F.when(is_command, F.from_csv(row, _ddl(COMMAND_SCHEMA), _READER)).alias("c"))

    def judge(row: Column, read: Column) -> Column:
        corrupt = read["s"][CORRUPT].isNotNull() | read["c"][CORRUPT].isNotNull()
        corrupt = F.coalesce(corrupt, F.lit(False))
        # A reader may trim control characters and smooth over quotes: such rows are taken apart by the exact rules.
        doubtful = row.isNull() | corrupt | row.rlike(r'["\x00-\x1f\x7f-\x9f]') | (row == "") | ~(is_socket | is_command)
        apart = lambda broken: F.when(broken, F.lit(None).cast("array<string>")).otherwise(F.coalesce(fields(row), F.array().cast("array<string>")))
        exact = lambda broken: let(apart(broken), lambda f: verdict(broken, f, _exact(SOCKET_SCHEMA, f), _exact(COMMAND_SCHEMA, f), corrupt))
        plain = verdict(F.lit(False), F.lit(None).cast("array<string>"), _blank_to_null(SOCKET_SCHEMA, read["s"]), _blank_to_null(COMMAND_SCHEMA, read["c"]), corrupt)
        return F.when(doubtful, let(F.coalesce(broken_quoting(row), F.lit(False)), exact)).otherwise(plain)

    def verdict(broken: Column, parts: Column, socket: Column, command: Column, corrupt: Column) -> Column:
        return let(F.struct(F.when(is_socket, socket).alias("socket"), F.when(is_command, command).alias("command")), lambda rec: F.struct(reason(broken, parts, rec).alias("reason"), rec["socket"].alias("socket"), rec["command"].alias("command"), corrupt.alias("corrupt")))

    def reason(broken: Column, parts: Column, rec: Column) -> Column:
        width = F.when(is_socket, len(SOCKET_SCHEMA.fields)).when(is_command, len(COMMAND_SCHEMA.fields))
        return (
            F.when(broken, "broken_quoting")
            .when(parts.isNotNull() & (F.size(parts) != width), "column_count")
            .when(is_socket & _bad_address(F.coalesce(rec["socket"]["kind"], F.lit("")), rec["socket"]["local_address"]), "invalid_local_address")
            .when(is_socket & ~F.coalesce(rec["socket"]["state"], F.lit("")).isin(STATES), "invalid_state")
            .when(is_command & _bad_command(rec["command"]["command"]), "invalid_command")
        )

    judged = let(F.regexp_replace(F.col(raw), r"\r\z", ""), lambda row: let(permissive(row), lambda read: judge(row, read)))
    added = {"reason", "socket", "command", "corrupt_raw"}
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in added]
    keep = lambda name: F.when(F.col("__j.reason").isNull(), F.col(f"__j.{name}")).alias(name)
    return rows.withColumn("__j", judged).select(*kept, F.col("__j.reason").alias("reason"), keep("socket"), keep("command"), F.when(F.col("__j.corrupt"), F.col(raw)).alias("corrupt_raw"))


def usable_sockets(rows: DataFrame) -> DataFrame:
    """The typed socket records, beside the other columns of their rows."""
    df = classify(rows).where("reason IS NULL AND socket IS NOT NULL")
    return df.select(*[c for c in rows.columns if c not in SOCKET_SCHEMA.fieldNames()], "socket.*")


def usable_commands(rows: DataFrame) -> DataFrame:
    """The typed compile-command records, beside the other columns of their rows."""
    df = classify(rows).where("reason IS NULL AND command IS NOT NULL")
    return df.select(*[c for c in rows.columns if c not in COMMAND_SCHEMA.fieldNames()], "command.*")


def unusable(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Each unusable row's key and reason, once."""
    return classify(rows).where("reason IS NOT NULL").select(key, "reason").distinct()
