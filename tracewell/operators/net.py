"""The socket domain: kernel tables decoded, owners, listeners, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.addresses import let, shortest_ipv6
from tracewell.operators.diff import only_in

# State codes of the kernel in order from 01, order of kinds, kinds of unix sockets.
TCP_STATES = ["ESTABLISHED", "SYN_SENT", "SYN_RECV", "FIN_WAIT1", "FIN_WAIT2", "TIME_WAIT", "CLOSE", "CLOSE_WAIT", "LAST_ACK", "LISTEN", "CLOSING"]
KIND_ORDER = ["tcp", "tcp6", "udp", "udp6", "unix_stream", "unix_dgram", "unix_seqpacket"]
UNIX_KINDS = {"0001": "unix_stream", "0002": "unix_dgram", "0005": "unix_seqpacket"}
WILDCARDS = ["0.0.0.0", "::", "*"]
SENSITIVE_PORTS = [22, 23, 3306, 5432, 6379, 27017]


def ipv4_from_hex(text: Column) -> Column:
    """Eight hexadecimal digits in the host's (little-endian) order as a dotted address; null for anything else."""
    byte = lambda i: F.conv(F.substring(text, i, 2), 16, 10)
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{8}\z"), F.concat_ws(".", byte(7), byte(5), byte(3), byte(1)))


def ipv6_from_hex(text: Column) -> Column:
    """Four little-endian words as the shortest text form; null for anything else."""
    pair = lambda i: F.substring(text, i, 2)
    groups = [F.concat(pair(8 * w + a), pair(8 * w + b)) for w in range(4) for a, b in ((7, 5), (3, 1))]
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{32}\z"), shortest_ipv6(F.concat_ws(":", *groups)))


def port_from_hex(text: Column) -> Column:
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{1,4}\z"), F.conv(text, 16, 10).cast("int"))


def address_port(text: Column) -> Column:
    """A struct of address and port from ``HEX:PORT``; the raw text and port 0 where it cannot be read."""
    host, port = F.substring_index(text, ":", 1), port_from_hex(F.substring_index(text, ":", -1))
    address = F.coalesce(ipv4_from_hex(host), ipv6_from_hex(host))
    good = address.isNotNull() & port.isNotNull()
    return F.struct(F.when(good, address).otherwise(text).alias("address"), F.when(good, port).otherwise(0).alias("port"))


def tcp_state(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in TCP_STATES]), F.conv(code, 16, 10).try_cast("int") - 1), F.lit("UNKNOWN"))


def parse_inet(lines: DataFrame, kind: str | Column = "kind") -> DataFrame:
    """Rows of the kernel's tcp, tcp6, udp and udp6 tables (raw text, kind); headers and short rows are skipped."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    df = lines.withColumn("__p", F.split(F.trim("raw"), r"\s+")).where((F.size("__p") >= 10) & F.get("__p", F.lit(0)).rlike(r"\A\d+:\z"))
    p = lambda i: F.get("__p", F.lit(i))
    queue = lambda i: F.conv(F.get(F.split(p(4), ":"), F.lit(i)), 16, 10).cast("bigint")
    df = df.withColumn("__l", let(p(1), address_port)).withColumn("__r", let(p(2), address_port))
    return df.select(
        kind.alias("kind"), F.col("__l.address").alias("local_address"), F.col("__l.port").alias("local_port"), F.col("__r.address").alias("remote_address"), F.col("__r.port").alias("remote_port"),
        tcp_state(p(3)).alias("state"), p(9).try_cast("bigint").alias("inode"), p(7).try_cast("bigint").alias("uid"), queue(0).alias("tx_queue"), queue(1).alias("rx_queue"), F.lit(None).cast("string").alias("unix_path"),
    )


def parse_unix(lines: DataFrame) -> DataFrame:
    """Rows of the kernel's table of unix sockets; a path is kept as it stands, blanks included."""
    shape = r"\A\S+:\s+\S+\s+\S+\s+\S+\s+(\S+)\s+(\S+)\s+(\d+)(?: (.*))?\z"
    got = lambda i: F.regexp_extract("raw", shape, i)
    kind = F.coalesce(*[F.when(got(1) == k, v) for k, v in UNIX_KINDS.items()], F.lit("unix_stream"))
    df = lines.where(F.col("raw").rlike(shape))
    none = F.lit(None)
    return df.select(kind.alias("kind"), F.lit("unix").alias("local_address"), F.lit(0).alias("local_port"), F.lit("").alias("remote_address"), F.lit(0).alias("remote_port"), F.when(got(2) == "01", "LISTEN").when(got(2) == "03", "ESTABLISHED").otherwise("UNKNOWN").alias("state"), got(3).cast("bigint").alias("inode"), F.lit(0).cast("bigint").alias("uid"), F.lit(0).cast("bigint").alias("tx_queue"), F.lit(0).cast("bigint").alias("rx_queue"), F.when(got(4) != "", got(4)).otherwise(none).alias("unix_path"))


def with_owners(sockets: DataFrame, owners: DataFrame, unreadable: list[int] = ()) -> DataFrame:
    """Sockets with pid, comm and owner_state. owners: inode, pid, fd, comm; the lowest pid, then fd, holds. A socket
    with an inode and no owner is ``owner_unknown`` where its user's processes could not be read, else ``orphan``."""
    first = owners.where("inode IS NOT NULL AND inode <> 0").groupBy("inode").agg(F.min(F.struct("pid", "fd", "comm")).alias("__o"))
    j = sockets.join(first, "inode", "left")
    lost = F.col("__o").isNull() & (F.coalesce("inode", F.lit(0)) != 0)
    state = F.when(lost & F.col("uid").isin(list(unreadable)) if unreadable else F.lit(False), "owner_unknown").when(lost, "orphan")
    return j.select(*sockets.columns, F.col("__o.pid").alias("pid"), F.col("__o.comm").alias("comm"), state.alias("owner_state"))


def total_order() -> list[Column]:
    """Order of a report: kind, local and remote end, path, inode."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")), F.lit(99))
    return [rank.asc(), F.asc("local_address"), F.asc("local_port"), F.asc("remote_address"), F.asc("remote_port"), F.asc_nulls_first("unix_path"), F.asc("inode")]


def is_listener() -> Column:
    udp = F.col("kind").isin("udp", "udp6") & ((F.col("remote_port") == 0) | F.col("remote_address").isin(WILDCARDS)) & (F.col("local_port") != 0)
    return F.coalesce((F.col("state") == "LISTEN") & ~F.startswith("kind", F.lit("unix")) | udp, F.lit(False))


def summary(sockets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of sockets, listeners, established, waiting, orphaned, of unknown owner, and unix ones."""
    owner = F.col("owner_state") if "owner_state" in sockets.columns else F.lit(None).cast("string")
    tcp = F.col("kind").isin("tcp", "tcp6")
    return sockets.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(is_listener()).alias("listeners"), F.count_if(tcp & (F.col("state") == "ESTABLISHED")).alias("established"), F.count_if(F.col("state") == "TIME_WAIT").alias("time_wait"), F.count_if(owner == "orphan").alias("orphans"), F.count_if(owner == "owner_unknown").alias("owner_unknown"), F.count_if(F.startswith("kind", F.lit("unix"))).alias("unix_sockets"))


def diff_reports(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(change, keys, kind, local_address, local_port, remote_address, remote_port): listeners and connections that are
    new or gone; repeated rows of one side are all kept. Without keys each side is the report of one host; reports of
    many hosts need the column that tells these apart."""
    listen = lambda df: df.where(is_listener()).select(*keys, "kind", "local_address", "local_port", F.lit("").alias("remote_address"), F.lit(0).alias("remote_port"))
    linked = lambda df: df.where(F.col("state") == "ESTABLISHED").select(*keys, "kind", "local_address", "local_port", "remote_address", "remote_port")
    ends = [*keys, "kind", "local_address", "local_port", "remote_address", "remote_port"]
    out = None
    for name, rows in (("listener", listen), ("connection", linked)):
        for change, x, y in (("new", after, before), ("closed", before, after)):
            part = only_in(rows(x), rows(y), ends).select(F.lit(f"{change}_{name}").alias("change"), *ends)
            out = part if out is None else out.unionByName(part)
    return out


def exposed(sockets: DataFrame) -> DataFrame:
    """Listeners on sensitive ports that any address can reach."""
    return sockets.where(is_listener() & F.col("local_address").isin(WILDCARDS) & F.col("local_port").isin(SENSITIVE_PORTS))


def without_unix(sockets: DataFrame) -> DataFrame:
    """The sockets that are no unix ones; summaries are of what is left."""
    return sockets.where(~F.coalesce(F.startswith("kind", F.lit("unix")), F.lit(False)))


def waiting_delta(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and time_wait_delta: how many more sockets wait after than before; a side without rows counts as none."""
    count = lambda df, n: df.where("state = 'TIME_WAIT'").select(*keys, F.lit(n).alias("n"))
    return count(before, -1).unionByName(count(after, 1)).groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("time_wait_delta"))


#: Services that should not listen on every address.
SENSITIVE_SERVICES = {22: "SSH", 23: "Telnet", 3306: "MySQL", 5432: "PostgreSQL", 6379: "Redis", 27017: "MongoDB"}


def checks(sockets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, category, name, status and message: one row each for the overview, sensitive listeners on every address and
    sockets without an owner. sockets: as from :func:`with_owners`. Sockets whose owner could not be read are no fault."""
    names = F.create_map(*[F.lit(x) for p, n in SENSITIVE_SERVICES.items() for x in (p, n)])
    open_ = is_listener() & F.col("local_address").isin(*WILDCARDS, "") & F.col("local_port").isin(SENSITIVE_PORTS)
    # at most as many names as there are sensitive ports
    per = sockets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_listener()).alias("listeners"), F.count_if(F.col("owner_state") == "orphan").alias("orphans"), F.count_if(F.col("owner_state") == "owner_unknown").alias("unread"),
        F.array_sort(F.collect_set(F.when(open_, F.concat(names[F.col("local_port")], F.lit(":"), F.col("local_port").cast("string"))))).alias("exposed"),
    )
    row = lambda name, status, message: F.struct(F.lit("network").alias("category"), F.lit(name).alias("name"), status.alias("status"), message.alias("message"))
    rows = F.array(
        row("overview", F.lit("pass"), F.concat(F.col("total").cast("string"), F.lit(" sockets, "), F.col("listeners").cast("string"), F.lit(" listeners"))),
        row("exposed_listeners", F.when(F.size("exposed") > 0, "warn").otherwise("pass"), F.array_join("exposed", ", ")),
        row("orphans", F.when(F.col("orphans") > 0, "warn").otherwise("pass"), F.concat(F.col("orphans").cast("string"), F.lit(" without owner, "), F.col("unread").cast("string"), F.lit(" unread"))),
    )
    return per.select(*keys, F.inline(rows))
