"""Host health: capacities, mounts, search paths, roll-up and comparison of checks. Thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Grades, mildest first; file systems that hold no data; thresholds (percent free, and GiB on large volumes).
GRADES = ["skip", "pass", "warn", "fail"]
PSEUDO = ["proc", "sysfs", "tmpfs", "devtmpfs", "devpts", "cgroup", "cgroup2", "pstore", "bpf", "tracefs", "debugfs", "securityfs", "configfs", "fusectl", "hugetlbfs", "mqueue", "autofs", "binfmt_misc", "ramfs", "nsfs", "efivarfs", "rpc_pipefs", "squashfs"]
GIB = 1 << 30
LIMITS = {"fail_percent": 5, "warn_percent": 15, "fail_total": 10 * GIB, "fail_free": GIB, "warn_total": 32 * GIB, "warn_free": 5 * GIB}


def grade_rank(grade: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(g) for g in GRADES]), grade).cast("int"), F.lit(0))


def capacity_grade(total: Column, free: Column, inodes: Column | None = None, free_inodes: Column | None = None, limits: dict = LIMITS) -> Column:
    """The worse of the grades by space and by inodes; absolute limits hold on large volumes only."""
    percent = F.when(total > 0, free * 100 / total)
    space = F.when((percent < limits["fail_percent"]) | (total >= limits["fail_total"]) & (free < limits["fail_free"]), 4).when((percent < limits["warn_percent"]) | (total >= limits["warn_total"]) & (free < limits["warn_free"]), 3).otherwise(2)
    if inodes is not None:
        p = F.when(inodes > 0, free_inodes * 100 / inodes)
        space = F.greatest(space, F.when(p < limits["fail_percent"], 4).when(p < limits["warn_percent"], 3).otherwise(2))
    return F.element_at(F.array(*[F.lit(g) for g in GRADES]), space)


def unescape_octal(text: Column) -> Column:
    """``\\040`` and the like as the characters they stand for."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\[0-7]{3}|[^\\]+|\\"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"\A\\[0-7]{3}\z"), F.char(F.conv(F.substring(p, 2, 3), 8, 10).cast("bigint"))).otherwise(p)), "")


def parse_mounts(lines: DataFrame) -> DataFrame:
    """(device, mount_point, fs_type, options) of mounts that hold data: no pseudo file systems, none that are read-only,
    overlays only at the root."""
    p = F.split(F.trim("raw"), r"\s+")
    df = lines.select(unescape_octal(F.get(p, F.lit(0))).alias("device"), unescape_octal(F.get(p, F.lit(1))).alias("mount_point"), F.get(p, F.lit(2)).alias("fs_type"), F.split(F.coalesce(F.get(p, F.lit(3)), F.lit("")), ",").alias("options"))
    return df.where(F.col("fs_type").isNotNull() & ~F.col("fs_type").isin(PSEUDO) & ~F.array_contains("options", "ro") & ((F.col("fs_type") != "overlay") | (F.col("mount_point") == "/")))


def one_per_volume(mounts: DataFrame, volume: str = "fsid") -> DataFrame:
    """One mount a volume: the root if it is among them, else the first by name; mounts without a volume all stay."""
    w = Window.partitionBy(volume).orderBy(F.col("mount_point") != "/", "mount_point")
    ranked = mounts.where(F.col(volume).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return ranked.unionByName(mounts.where(F.col(volume).isNull()))


def search_path_checks(paths: DataFrame) -> DataFrame:
    """(place, entry, problem) of a search path's text: empty and relative entries."""
    spread = paths.select(F.posexplode(F.split("value", ":", -1)).alias("place", "entry"))
    return spread.withColumn("problem", F.when(F.col("entry") == "", "empty").when(~F.startswith("entry", F.lit("/")), "relative")).where("problem IS NOT NULL")


def overall(checks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each grade and the worst one; what was skipped does not count unless all was."""
    counts = [F.count_if(F.col("status") == g).alias(f"{g}_count") for g in GRADES]
    return checks.groupBy(*keys).agg(*counts, F.element_at(F.array(*[F.lit(g) for g in GRADES]), F.greatest(F.max(grade_rank(F.col("status"))), F.lit(1))).alias("overall"))


def diff_checks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, name, before_status, after_status, change): regressed, improved, added or removed; a skip ranks as a pass."""
    side = lambda df, p: df.groupBy("category", "name").agg(F.max_by("status", grade_rank(F.col("status"))).alias(f"{p}_status"))
    j = side(before, "before").join(side(after, "after"), ["category", "name"], "full_outer")
    rank = lambda c: F.greatest(grade_rank(F.col(c)), F.lit(2))
    change = F.when(F.col("before_status").isNull(), "added").when(F.col("after_status").isNull(), "removed").when(rank("after_status") > rank("before_status"), "regressed").when(rank("after_status") < rank("before_status"), "improved")
    return j.withColumn("change", change).where("change IS NOT NULL")


def preload_checks(lines: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, category, name, status, message): a warning for each host whose list of preloaded libraries names any.

    lines: host, line of that list; hosts: host. Blank lines and those that begin with ``#`` name nothing."""
    text = F.trim("line")
    named = lines.where((text != "") & ~F.startswith(text, F.lit("#"))).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("first"))
    status = F.when(F.col("n") > 0, "warn").otherwise("pass")
    message = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" preloaded, such as "), F.col("first"))).otherwise("")
    return hosts.select("host").distinct().join(named, "host", "left").select("host", F.lit("security").alias("category"), F.lit("preload").alias("name"), status.alias("status"), message.alias("message"))


def path_checks(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """(host, place, entry, problem): entries of search paths that are empty or the current folder, relative, or folders that
    anyone may write to. paths: host, value; folders: host, path, mode (permission bits)."""
    entries = paths.select("host", F.posexplode(F.split("value", ":", -1)).alias("place", "entry"))
    modes = folders.groupBy("host", F.col("path").alias("entry")).agg(F.max(F.col("mode").bitwiseAND(2)).alias("__open"))
    j = entries.join(modes, ["host", "entry"], "left")
    problem = F.when(F.col("entry").isin("", "."), "current_folder").when(~F.startswith("entry", F.lit("/")), "relative").when(F.col("__open") > 0, "world_writable")
    return j.select("host", "place", "entry", problem.alias("problem")).where("problem IS NOT NULL")


def service_checks(units: DataFrame, cycles: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(host, category, name, status, message): cycles fail, diagnostics warn, a host without units is skipped.

    units: host, unit (null for a host without any); cycles: host; diagnostics: host, diagnostic."""
    per = units.groupBy("host").agg(F.count("unit").alias("units"))
    counted = lambda df, n: df.groupBy("host").agg(F.count(F.lit(1)).alias(n))
    j = per.join(counted(cycles, "cycles"), "host", "left").join(counted(diagnostics.where("diagnostic IS NOT NULL"), "diagnostics"), "host", "left").fillna(0)
    number = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    row = lambda name, status, message: F.struct(F.lit("services").alias("category"), F.lit(name).alias("name"), status.alias("status"), message.alias("message"))
    rows = F.array(
        row("ordering_cycles", F.when(F.col("units") == 0, "skip").when(F.col("cycles") > 0, "fail").otherwise("pass"), number("cycles", " cycles")),
        row("unit_files", F.when(F.col("units") == 0, "skip").when(F.col("diagnostics") > 0, "warn").otherwise("pass"), number("diagnostics", " diagnostics")),
    )
    return j.select("host", F.inline(rows))
