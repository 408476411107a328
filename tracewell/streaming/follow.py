"""Following a growing log, and histograms of a stream."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tracewell.operators.logs import LogFilter, level_rank, parse_records


class FollowSource(DataSource):
    """Lines appended to one file. Options: path, from_start (else only what comes after the start), most_bytes a poll.

    The offset is the file's identity, the place in it, the line number and a count of replacements; it never passes
    the last line end, so a line that is still being written is read again. A file that was replaced or cut is read
    from its start, as a new ``epoch``; a missing file is an empty poll."""

    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return "file string, epoch int, line_no bigint, raw string, lossy boolean"

    def simpleStreamReader(self, schema) -> "FollowReader":
        return FollowReader(dict(self.options))


class FollowReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most = options["path"], int(options.get("most_bytes", 16 << 20))
        self.from_start = options.get("from_start", "true") == "true"

    def initialOffset(self) -> dict:
        if not self.from_start and os.path.exists(self.path):
            s = os.stat(self.path)
            with open(self.path, "rb") as f:
                data = f.read()
            return {"dev": s.st_dev, "ino": s.st_ino, "at": data.rfind(b"\n") + 1, "line": data.count(b"\n"), "epoch": 0}
        return {"dev": 0, "ino": 0, "at": 0, "line": 0, "epoch": 0}

    def _rows(self, start: dict, end: int | None) -> tuple[list[tuple], dict]:
        try:
            s = os.stat(self.path)
        except OSError:
            return [], start
        new = start["ino"] and (s.st_dev, s.st_ino) != (start["dev"], start["ino"]) or s.st_size < start["at"]
        place = {"dev": s.st_dev, "ino": s.st_ino, "at": 0, "line": 0, "epoch": start["epoch"] + 1} if new else start | {"dev": s.st_dev, "ino": s.st_ino}
        with open(self.path, "rb") as f:
            f.seek(place["at"])
            data = f.read(self.most if end is None else end - place["at"])
        whole = data[: data.rfind(b"\n") + 1]
        if not whole and len(data) >= self.most and end is None:  # a line longer than a poll
            with open(self.path, "rb") as f:
                f.seek(place["at"])
                line = f.readline()
            whole = line if line.endswith(b"\n") else b""
        rows = []
        for line in whole.split(b"\n")[:-1]:
            line = line.removesuffix(b"\r")
            text = line.decode("utf-8", "replace")
            rows.append((self.path, place["epoch"], place["line"] + len(rows) + 1, text, text.encode() != line))
        return rows, place | {"at": place["at"] + len(whole), "line": place["line"] + len(rows)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._rows(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start, end["at"])[0])


def follow(spark: SparkSession, path: str, from_start: bool = True) -> DataFrame:
    """A stream of the lines of one growing file."""
    spark.dataSource.register(FollowSource)
    return spark.readStream.format("follow").option("path", path).option("from_start", str(from_start).lower()).load()


def filtered(lines: DataFrame, keep: LogFilter, year: int) -> DataFrame:
    """The batch filter over a stream; it holds no state."""
    return parse_records(lines, year).where(keep.condition())


def stream_histogram(records: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(bucket_start, total, warn_or_higher) by tumbling windows. Lines later than the watermark are left out, which a
    batch histogram does not do: a stream has to forget its windows."""
    serious = F.coalesce((level_rank(F.col("level")) >= 3) & (level_rank(F.col("level")) <= 5), F.lit(False))
    timed = records.where("ts_ms IS NOT NULL").withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("total"), F.count_if(serious).alias("warn_or_higher")).select(F.unix_timestamp("window.start").alias("bucket_start"), "total", "warn_or_higher")
