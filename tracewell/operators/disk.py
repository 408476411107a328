"""The file-system domain: trees as parent-pointer tables, size rollups, duplicates, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def own_sizes(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """Nodes with the sizes that count: of the names of one inode only the first has any, by ``walk`` (a tree's order, depth
    first) where there is one, else by node id; nodes without an inode always count. A hot inode's names are ranked by a
    minimum, not gathered."""
    order = order or ("walk" if "walk" in nodes.columns else "node_id")
    has = (F.coalesce("device", F.lit(0)) != 0) | (F.coalesce("inode", F.lit(0)) != 0)
    first = nodes.where(has & (F.col("nlink") > 1)).groupBy("device", "inode").agg(F.min(order).alias("__first"))
    counted = F.col("__first").isNull() | (F.col("__first") == F.col(order))
    return nodes.join(first, ["device", "inode"], "left").withColumn("counted", counted).withColumn("own_size", F.when(counted, F.col("size")).otherwise(0)).withColumn("own_allocated", F.when(counted, F.col("allocated")).otherwise(0)).drop("__first")


def rollup(nodes: DataFrame, path: str = "rel_path", size: str = "own_size", extra: tuple[str, ...] = ()) -> DataFrame:
    """(path, total_size, entries and sums of ``extra``): every ancestor of every node, the root being ``''``, with
    the sums over all below and itself. Partial sums are made before the shuffle, so the root is no hot key."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    spread = nodes.select(F.explode(ancestors).alias("path"), F.col(size).alias("__s"), *[F.col(c).alias(f"__{c}") for c in extra])
    return spread.groupBy("path").agg(F.sum("__s").alias("total_size"), F.count(F.lit(1)).alias("entries"), *[F.sum(f"__{c}").alias(f"total_{c}") for c in extra])


def children(nodes: DataFrame, parent_id: int) -> DataFrame:
    return nodes.where(F.col("parent_id") == parent_id).orderBy("node_id")


def largest(nodes: DataFrame, n: int = 10, size: str = "total_size", name: str = "path") -> DataFrame:
    """The top n by size, ties by name."""
    return nodes.orderBy(F.desc(size), F.asc(name)).limit(n)


def _digests(files: DataFrame, key: str, content: str, size: str | None, inode: tuple[str, ...]) -> DataFrame:
    length = F.col(size) if size else F.length(content)
    who = F.concat_ws(":", *[F.col(c).cast("string") for c in inode]) if inode else F.col(key).cast("string")
    return files.where(F.col(content).isNotNull()).select(F.col(key).alias("file"), length.alias("size"), who.alias("__who"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def duplicates(files: DataFrame, key: str = "path", content: str = "content", size: str | None = None, inode: tuple[str, ...] = ()) -> DataFrame:
    """(size, sha256, first_file, copies, reclaimable): groups of equal contents under different names and inodes.

    Contents are digested where they are read, so only digests and names are shuffled, and a group of any number of files
    is one row of partial sums. Names of one inode are one copy. :func:`duplicate_files` tells the members.
    """
    one = _digests(files, key, content, size, inode).groupBy("size", "sha256", "__who").agg(F.min("file").alias("file"))
    groups = one.groupBy("size", "sha256").agg(F.min("file").alias("first_file"), F.count(F.lit(1)).alias("copies"))
    return groups.where("copies > 1").withColumn("reclaimable", (F.col("copies") - 1) * F.col("size"))


def duplicate_files(files: DataFrame, key: str = "path", content: str = "content", size: str | None = None, inode: tuple[str, ...] = ()) -> DataFrame:
    """(size, sha256, file): every file of a group of :func:`duplicates`, one row each."""
    groups = duplicates(files, key, content, size, inode).select("size", "sha256")
    return _digests(files, key, content, size, inode).join(groups, ["size", "sha256"], "left_semi").select("size", "sha256", "file").distinct()


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rel_path, before_size, after_size, change): files added, removed, grown or shrunk."""
    j = before.select("rel_path", F.col("size").alias("before_size")).join(after.select("rel_path", F.col("size").alias("after_size")), "rel_path", "full_outer")
    change = F.when(F.col("before_size").isNull(), "added").when(F.col("after_size").isNull(), "removed").when(F.col("after_size") > F.col("before_size"), "grown").when(F.col("after_size") < F.col("before_size"), "shrunk")
    return j.withColumn("change", change).where("change IS NOT NULL")


def root_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(size_delta, allocated_delta, node_delta) of two trees."""
    total = lambda df, p: own_sizes(df).agg(F.sum("own_size").alias(f"{p}s"), F.sum("own_allocated").alias(f"{p}a"), F.count(F.lit(1)).alias(f"{p}n"))
    return total(before, "b").crossJoin(total(after, "a")).select((F.col("as") - F.col("bs")).alias("size_delta"), (F.col("aa") - F.col("ba")).alias("allocated_delta"), (F.col("an") - F.col("bn")).alias("node_delta"))  # one row each


def snapshot_rows(nodes: DataFrame) -> DataFrame:
    """A snapshot's rows: names and paths also as hexadecimal bytes, children in order of their names."""
    w = Window.partitionBy("parent_id").orderBy("name")
    return nodes.withColumn("name_hex", F.lower(F.hex(F.encode("name", "UTF-8")))).withColumn("path_hex", F.lower(F.hex(F.encode("rel_path", "UTF-8")))).withColumn("place", F.row_number().over(w))
