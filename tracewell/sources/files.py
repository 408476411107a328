"""Files as tables: logs with line numbers, trees of entries, whole texts; guards for what may be read."""

from __future__ import annotations

import gzip
import glob as _glob
import json
import os
import re
import shutil
import stat
import sys
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewell.errors import InputChanged, InvalidInput, LimitExceeded, UsageError
from tracewell.functions.glob import python_glob
from tracewell.operators.units import SUFFIXES
from tracewell.report import check_schema

MOST_DECODED = 512 << 20
_CHUNK = 4 << 20


def expand_inputs(inputs: list[str]) -> list[str]:
    """Files of a list in order: names, ``-`` once, and patterns for the last part of a path, sorted; a pattern that
    matches nothing is an error."""
    out: list[str] = []
    for item in inputs:
        if item == "-":
            if "-" in out:
                raise UsageError("standard input can be named once")
            out.append(item)
        elif "*" in item or "?" in item:
            folder, _, name = item.rpartition("/")
            shape = python_glob(name)
            found = sorted(e for e in os.listdir(folder or ".") if shape.match(e))
            if not found:
                raise UsageError(f"nothing matches {item}")
            out += [os.path.join(folder, e) for e in found]
        else:
            out.append(item)
    return out


def spool(stream, most: int = MOST_DECODED) -> str:
    """A stream copied to a temporary file, for reading as a table; beyond the limit an error."""
    handle, path = tempfile.mkstemp(suffix=".log")
    size = 0
    with os.fdopen(handle, "wb") as out:
        while piece := stream.read(1 << 20):
            size += len(piece)
            if size > most:
                os.unlink(path)
                raise LimitExceeded(f"more than {most} bytes")
            out.write(piece)
    return path


def _lines(path: str) -> Iterator[bytes]:
    """Lines of a plain or compressed file, without their ends; a last line without an end counts, an empty file has none."""
    opened = gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")
    decoded = 0
    with opened as f:
        for line in f:
            decoded += len(line)
            if path.endswith(".gz") and decoded > MOST_DECODED:
                raise LimitExceeded(f"{path} decodes to more than {MOST_DECODED} bytes")
            yield line.removesuffix(b"\n").removesuffix(b"\r")


def read_logs(spark: SparkSession, inputs: list[str], by_stretch: int = 64 << 20) -> DataFrame:
    """(file, line_no, byte_offset, raw, lossy): every line of files that all workers see, numbered from 1.

    A plain file is cut into stretches of bytes, each read by a task of its own from the first line that begins in it;
    the lines of each stretch are counted in a first narrow pass, so numbers need no ordering of the data. Compressed
    files cannot be cut. Bytes that are no UTF-8 become replacement characters and are flagged, never dropped.
    """
    pieces = []
    for place, path in enumerate(expand_inputs(inputs)):
        if path == "-":
            path = spool(sys.stdin.buffer)
        size = os.path.getsize(path)
        step = size or 1 if path.endswith(".gz") else by_stretch
        pieces += [(place, path, k, a, min(a + step, size)) for k, a in enumerate(range(0, max(size, 1), step))]
    parts = spark.createDataFrame(pieces, "input int, file string, piece int, first long, last long").repartition(max(1, len(pieces)), "file", "piece")

    def walk(path: str, first: int, last: int) -> Iterator[tuple[int, bytes]]:
        if path.endswith(".gz"):
            at = 0
            for line in _lines(path):
                yield at, line
                at += len(line) + 1
            return
        with open(path, "rb") as f:
            if first:
                f.seek(first - 1)
                f.readline()
            while (at := f.tell()) < last and (line := f.readline()):
                yield at, line.removesuffix(b"\n").removesuffix(b"\r")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            n = [sum(1 for _ in walk(r["file"], r["first"], r["last"])) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["file"] for r in rows]), pa.array([r["piece"] for r in rows], pa.int32()), pa.array(n, pa.int64())], names=["file", "piece", "n"])

    before: dict[tuple[str, int], int] = {}
    total: dict[str, int] = {}
    for r in sorted(parts.mapInArrow(count, "file string, piece int, n long").collect(), key=lambda r: (r["file"], r["piece"])):  # one row a stretch
        before[(r["file"], r["piece"])] = total.get(r["file"], 0)
        total[r["file"]] = total.get(r["file"], 0) + r["n"]
    offsets = [(f, p, n) for (f, p), n in before.items()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                number, held = r["before"], []

                def flush(held: list, r: dict = r) -> pa.RecordBatch:
                    texts = [h[2].decode("utf-8", "replace") for h in held]
                    lossy = ["�" in t and t.encode() != h[2] for t, h in zip(texts, held, strict=True)]
                    return pa.RecordBatch.from_arrays([pa.array([r["input"]] * len(held), pa.int32()), pa.array([r["file"]] * len(held)), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(texts), pa.array(lossy)], names=["input", "file", "line_no", "byte_offset", "raw", "lossy"])

                for at, line in walk(r["file"], r["first"], r["last"]):
                    number += 1
                    held.append((number, at, line))
                    if len(held) >= 10_000:
                        yield flush(held)
                        held = []
                if held:
                    yield flush(held)

    numbered = parts.join(spark.createDataFrame(offsets, "file string, piece int, before long"), ["file", "piece"])
    return numbered.select("input", "file", "piece", "first", "last", "before").mapInArrow(read, "input int, file string, line_no long, byte_offset long, raw string, lossy boolean")


def expand_reports(path: str) -> list[str]:
    """The report files that an input names: a file, the ``*.xml`` of a folder by name, or a pattern of file names. An input
    that names none is a usage error."""
    if os.path.isdir(path):
        found = sorted(_glob.glob(os.path.join(_glob.escape(path), "*.xml")))
    else:
        found = [path] if os.path.isfile(path) else sorted(p for p in _glob.glob(path) if os.path.isfile(p))
    if not found:
        raise UsageError(f"no reports: {path}")
    return found


def whole_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content) of files below a folder, by name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


class TreeSource(DataSource):
    """File-system entries below ``path``: one row each, links not followed, one partition a top-level entry.

    Options: path, max_entries (an error beyond it), exclude (patterns, comma-separated), one_file_system."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "rel_path string, parent_path string, name string, depth int, kind string, size bigint, allocated bigint, device bigint, inode bigint, nlink bigint, mtime_ns bigint, error string"

    def reader(self, schema) -> "TreeReader":
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.most = options["path"], int(options.get("max_entries", 1_000_000))
        self.exclude = [p for p in options.get("exclude", "").split(",") if p]
        self.one = options.get("one_file_system", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise UsageError(f"{self.root} is no folder")
        return [InputPartition("")] + [InputPartition(n) for n in sorted(os.listdir(self.root))]

    def _excluded(self, rel: str, name: str) -> bool:
        return any(bool(python_glob(p).match(rel if "/" in p else name)) if re.search(r"[*?/]", p) else p == name for p in self.exclude)

    def _row(self, rel: str) -> tuple:
        name, parent = os.path.basename(rel), os.path.dirname(rel) if rel else None
        depth = rel.count("/") + 1 if rel else 0
        try:
            s = os.lstat(os.path.join(self.root, rel))
        except OSError as e:
            return rel, parent, name, depth, "unknown", 0, 0, 0, 0, 0, 0, type(e).__name__
        kind = "dir" if stat.S_ISDIR(s.st_mode) else "symlink" if stat.S_ISLNK(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
        return rel, parent, name, depth, kind, 0 if kind == "dir" else s.st_size, s.st_blocks * 512, s.st_dev, s.st_ino, s.st_nlink, s.st_mtime_ns, None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            yield self._row("")
            return
        device = os.lstat(self.root).st_dev
        stack, n = [partition.value], 0
        while stack:
            rel = stack.pop()
            if self._excluded(rel, os.path.basename(rel)):
                continue
            row = self._row(rel)
            if self.one and row[7] not in (0, device):
                continue
            n += 1
            if n > self.most:
                raise LimitExceeded(f"more than {self.most} entries below {partition.value}")
            if row[4] == "dir":
                try:
                    stack += [f"{rel}/{e}" for e in sorted(os.listdir(os.path.join(self.root, rel)), reverse=True)]
                except OSError as e:
                    row = (*row[:11], type(e).__name__)
            yield row


def read_tree(spark: SparkSession, path: str, exclude: list[str] = (), max_entries: int = 1_000_000, one_file_system: bool = False) -> DataFrame:
    """Entries below a folder that all workers see, with node_id, parent_id and ``walk``, whose order is that of a
    depth-first walk by names."""
    from pyspark.sql import functions as F

    spark.dataSource.register(TreeSource)
    rows = spark.read.format("tree").options(path=path, exclude=",".join(exclude), max_entries=str(max_entries), one_file_system=str(one_file_system).lower()).load()
    # an id that follows the path needs no global order: it is the path's digest
    return rows.withColumn("walk", F.split("rel_path", "/")).withColumn("node_id", F.xxhash64("rel_path")).withColumn("parent_id", F.when(F.col("parent_path").isNotNull(), F.xxhash64("parent_path")))


KINDS = "venv systemd junit directory elf bundle unit junit_file compile_db snapshot strace log".split()
_SNIFF = 65536
_STRACE = re.compile(r"^(?:\[pid\s+\d+\]\s+|\d+\s+)?(?:[\d:.]+\s+)?(?:[a-z0-9_]+\(.*\)\s+=\s|<\.\.\. \w+ resumed>|\+\+\+ |--- SIG|[a-z0-9_]+\(.*<unfinished \.\.\.>)")


def detect(path: str) -> str:
    """What kind of input a path is; the first that fits of folders by their marks, magic numbers, and content."""
    if os.path.isdir(path):
        names = os.listdir(path)
        if "pyvenv.cfg" in names:
            return "venv"
        if any(n.endswith(tuple(SUFFIXES)) for n in names):
            return "systemd"
        return "junit" if names and all(n.endswith(".xml") for n in names) else "directory"
    with open(path, "rb") as f:
        head = f.read(_SNIFF)
    if head[:4] == b"\x7fELF":
        return "elf"
    if head[:2] == b"\x1f\x8b":
        import tarfile

        try:
            with tarfile.open(path) as t:
                return "bundle" if "manifest.json" in (t.next() or tarfile.TarInfo()).name else "log"
        except (tarfile.TarError, OSError, EOFError):
            return "log"
    if path.endswith(tuple(SUFFIXES)):
        return "unit"
    text = head.decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    if re.match(r"(?:<\?xml[^>]*\?>\s*)?(?:<!--.*?-->\s*)*<testsuites?[\s/>]", text, re.S):
        return "junit_file"
    if text.startswith("[") and re.search(r'"directory"\s*:', text) and re.search(r'"file"\s*:', text):
        return "compile_db"
    if text.startswith("{") and re.search(r'"schema"\s*:\s*"[\w.]+/v\d+"', text):
        return "snapshot"
    lines = [x for x in text.splitlines()[:200] if x.strip()]
    return "strace" if lines and sum(bool(_STRACE.match(x)) for x in lines) * 2 > len(lines) else "log"


class ReadPolicy:
    """Folders that may be read; without any, all may."""

    def __init__(self, roots: list[str] = ()) -> None:
        self.roots = [os.path.realpath(r) for r in roots]

    def check(self, path: str) -> str:
        real = os.path.realpath(path)
        if self.roots and not any(real == r or real.startswith(r.rstrip("/") + "/") for r in self.roots):
            raise UsageError(f"{path} lies outside the folders that may be read")
        return real


class StableFile:
    """A regular file that must not change between opening and the end of reading."""

    def __init__(self, path: str, policy: ReadPolicy | None = None) -> None:
        self.path = (policy or ReadPolicy()).check(path)
        before = os.stat(self.path)
        if not stat.S_ISREG(before.st_mode):
            raise InvalidInput(f"{path} is no regular file")
        self.fd = os.open(self.path, os.O_RDONLY | os.O_NONBLOCK | getattr(os, "O_CLOEXEC", 0))
        self.identity = self._identity(os.fstat(self.fd))
        if self.identity[:2] != self._identity(before)[:2]:
            os.close(self.fd)
            raise InputChanged(f"{path} was replaced while it was opened")

    @staticmethod
    def _identity(s: os.stat_result) -> tuple:
        return s.st_dev, s.st_ino, s.st_mode, s.st_size, s.st_mtime_ns, s.st_ctime_ns

    def read(self) -> bytes:
        with os.fdopen(os.dup(self.fd), "rb") as f:
            data = f.read()
        self.verify()
        return data

    def verify(self) -> None:
        if self._identity(os.fstat(self.fd)) != self.identity:
            raise InputChanged(f"{self.path} changed while it was read")

    def __enter__(self) -> "StableFile":
        return self

    def __exit__(self, *_: object) -> None:
        os.close(self.fd)


def read_snapshot(path: str, schema: str, version: int | None = None) -> dict:
    """A JSON document of the expected schema."""
    with StableFile(path) as f:
        try:
            return check_schema(json.loads(f.read()), schema, version)
        except (ValueError, AttributeError) as e:
            raise InvalidInput(f"{path}: {e}") from e


def read_unit_dirs(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, drop-ins, folder dependencies) of unit folders, earlier folders going before later ones.

    files: unit, path, precedence, content, masked, alias_of; drop-ins: unit, conf, path, precedence, content, masked;
    dependencies: unit, key, target. Folders that are missing are skipped; if all are, that is an error."""
    units, drops, deps = [], [], []
    if not any(os.path.isdir(f) for f in folders):
        raise UsageError("no unit folder exists")
    for rank, folder in enumerate(folders):
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            path = os.path.join(folder, name)
            if name.endswith(".d") and os.path.isdir(path):
                for conf in sorted(c for c in os.listdir(path) if c.endswith(".conf")):
                    p = os.path.join(path, conf)
                    drops.append((name[:-2], conf, p, rank, _text(p), os.path.realpath(p) == "/dev/null"))
            elif name.endswith((".wants", ".requires")) and os.path.isdir(path):
                unit, _, key = name.rpartition(".")
                deps += [(unit, key.capitalize(), e) for e in sorted(os.listdir(path))]
            elif name.endswith(tuple(SUFFIXES)):
                real = os.path.realpath(path)
                alias = os.path.basename(real) if os.path.islink(path) and real != "/dev/null" and os.path.basename(real) != name else None
                units.append((name, path, rank, _text(path), real == "/dev/null", alias))
    return (
        spark.createDataFrame(units, "unit string, path string, precedence int, content string, masked boolean, alias_of string"),
        spark.createDataFrame(drops, "unit string, conf string, path string, precedence int, content string, masked boolean"),
        spark.createDataFrame(deps, "unit string, key string, target string"),
    )


def _text(path: str) -> str:
    try:
        with open(path, "rb") as f:
            return f.read(1 << 20).decode("utf-8", "replace")
    except OSError:
        return ""


def read_venv(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(metadata texts, distributions) of a virtual environment: (env, text), and (env, name, top_level, record)."""
    if not os.path.exists(os.path.join(folder, "pyvenv.cfg")):
        raise UsageError(f"{folder} is no virtual environment")
    texts, dists = [], []
    for info in sorted(_glob.glob(os.path.join(folder, "lib", "*", "site-packages", "*.dist-info"))):
        texts.append((folder, _text(os.path.join(info, "METADATA"))))
        dists.append((folder, os.path.basename(info).split("-")[0], _text(os.path.join(info, "top_level.txt")) or None, _text(os.path.join(info, "RECORD")) or None))
    return spark.createDataFrame(texts, "env string, text string"), spark.createDataFrame(dists, "env string, name string, top_level string, record string")


def editable_packages(folder: str) -> list[tuple[str, str]]:
    """(normalised name, source folder) of packages that an environment takes from a folder of sources: those whose
    ``direct_url.json`` names a local folder, and the projects in folders that a ``.pth`` file adds to the path."""
    found: set[tuple[str, str]] = set()
    normal = lambda n: re.sub(r"[-_.]+", "-", n).lower()
    for site in sorted(_glob.glob(os.path.join(folder, "lib", "*", "site-packages"))):
        for info in sorted(_glob.glob(os.path.join(site, "*.dist-info"))):
            try:
                told = json.loads(_text(os.path.join(info, "direct_url.json")) or "{}")
            except ValueError:
                continue
            url = told.get("url", "") if isinstance(told, dict) else ""
            if isinstance(url, str) and url.startswith("file://") and (told.get("dir_info") or {}).get("editable"):
                found.add((normal(os.path.basename(info).split("-")[0]), url.removeprefix("file://").rstrip("/")))
        for pth in sorted(_glob.glob(os.path.join(site, "*.pth"))):
            for line in _text(pth).splitlines():
                # lines that import something run code and name no folder
                if line.strip() and not line.startswith(("#", "import ", "import\t")):
                    path = os.path.normpath(os.path.join(site, line.strip()))
                    for source in (path, os.path.dirname(path)) if os.path.basename(path) == "src" else (path,):
                        found |= {(n, source) for n in own_packages(source)}
    return sorted(found)


def own_packages(project: str) -> list[str]:
    """Names that a project gives itself in its build files."""
    found = []
    for name, shape in (("pyproject.toml", r'(?m)^\s*name\s*=\s*["\']([^"\']+)'), ("setup.cfg", r"(?m)^\s*name\s*=\s*(\S+)"), ("setup.py", r'\bname\s*=\s*["\']([^"\']+)')):
        found += re.findall(shape, _text(os.path.join(project, name)))[:1]
    return sorted({re.sub(r"[-_.]+", "-", n).lower() for n in found})


def process_sockets(spark: SparkSession, proc: str = "/proc") -> tuple[DataFrame, list[int]]:
    """((inode, pid, fd, comm), users whose processes could not be read)."""
    rows, unreadable = [], set()
    for pid in sorted((int(p) for p in os.listdir(proc) if p.isdigit())):
        base = os.path.join(proc, str(pid))
        try:
            links = sorted(os.listdir(os.path.join(base, "fd")), key=lambda x: int(x) if x.isdigit() else 0)
        except OSError:
            try:
                unreadable.add(os.stat(base).st_uid)
            except OSError:
                pass
            continue
        comm = _text(os.path.join(base, "comm")).strip()
        for fd in links:
            try:
                m = re.fullmatch(r"socket:\[(\d+)\]", os.readlink(os.path.join(base, "fd", fd)))
            except OSError:
                continue
            if m:
                rows.append((int(m[1]), pid, int(fd), comm))
    return spark.createDataFrame(rows, "inode long, pid int, fd int, comm string"), sorted(unreadable)


def free_space(path: str) -> dict[str, int]:
    s = os.statvfs(path)
    return {"total": s.f_blocks * s.f_frsize, "free": s.f_bavail * s.f_frsize, "inodes": s.f_files, "free_inodes": s.f_favail, "used": shutil.disk_usage(path).used}
