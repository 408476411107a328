"""Bundles: tar archives of reports with a manifest; reading, verifying, comparing, writing, extracting."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import tarfile
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.errors import InvalidInput, LimitExceeded, UsageError
from tracewell.functions.redact import redact_json, redact_text
from tracewell.report import to_json

SCHEMA = "tracewell.bundle/v1"
MOST_ENTRIES, MOST_BYTES = 4096, 512 << 20
MOST_MESSAGES, MESSAGE_BYTES, ALL_MESSAGE_BYTES = 128, 4096, 65536
TAIL_BYTES = 8 << 20


def safe_name(name: str) -> bool:
    """Whether an entry's name stays below the folder it is written to."""
    return bool(name) and not name.startswith("/") and "\\" not in name and "\0" not in name and ".." not in name.split("/") and "" not in name.rstrip("/").split("/")


def read_entries(data: bytes) -> Iterator[tuple[str, bytes, str | None]]:
    """(name, content, problem) of each entry; anything but a regular file, and passing a limit, is a problem, and so is
    a damaged archive, after what could be read."""
    total = n = 0
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as stream, tarfile.open(fileobj=stream, mode="r|") as archive:
            for member in archive:
                n += 1
                total += member.size
                if n > MOST_ENTRIES or total > MOST_BYTES:
                    yield member.name, b"", "limit_exceeded"
                    return
                if not member.isreg():
                    yield member.name, b"", "not_regular"
                elif not safe_name(member.name):
                    yield member.name, b"", "unsafe_name"
                else:
                    yield member.name, archive.extractfile(member).read(), None
            while stream.read(1 << 20):  # the trailer is checked at the end
                pass
    except (OSError, EOFError, tarfile.TarError) as e:
        yield "", b"", f"damaged: {type(e).__name__}"


def scan(files: DataFrame, contents: bool = False) -> DataFrame:
    """(bundle, place, name, size, sha256, problem, content) of archives (path, content)."""
    schema = "bundle string, place int, name string, size bigint, sha256 string, problem string, content binary"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(path, i, n, len(c), hashlib.sha256(c).hexdigest(), p, c if contents or n == "manifest.json" else None) for i, (n, c, p) in enumerate(read_entries(data or b""))]
                if rows:
                    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return files.select("path", "content").mapInArrow(over, schema)


def manifest_sources(entries: DataFrame) -> DataFrame:
    """(bundle, schema, name, size, sha256): what each bundle's manifest says it holds."""
    form = "schema string, sources array<struct<path:string,size:bigint,sha256:string>>"
    m = entries.where("name = 'manifest.json'").select("bundle", F.from_json(F.decode("content", "UTF-8"), form).alias("m"))
    return m.select("bundle", F.col("m.schema").alias("schema"), F.explode_outer("m.sources").alias("s")).select("bundle", "schema", F.col("s.path").alias("name"), F.col("s.size").alias("size"), F.lower("s.sha256").alias("sha256"))


def verify_rows(entries: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("bundle",)) -> DataFrame:
    """keys, name and verdict of every entry: ok, tampered, missing, unexpected or duplicate.

    entries and manifest: keys, name, size, sha256; the manifest's own entry is left out by the caller."""
    by = [*keys, "name"]
    have = entries.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("size").alias("__size"), F.min("sha256").alias("__sha"))
    said = manifest.where("name IS NOT NULL").select(*by, "size", "sha256").dropDuplicates(by).withColumn("__said", F.lit(True))
    j = have.join(said, by, "full_outer")
    same = (F.col("__size") == F.col("size")) & (F.lower("__sha") == F.lower("sha256"))
    verdict = F.when(F.col("__said").isNull(), "unexpected").when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "duplicate").when(F.coalesce(same, F.lit(False)), "ok").otherwise("tampered")
    return j.select(*by, verdict.alias("verdict"))


def verify(entries: DataFrame) -> DataFrame:
    """(bundle, name, verdict) of scanned archives, with rows of an empty name for what ails a bundle as a whole."""
    content = entries.where("problem IS NULL AND name <> 'manifest.json'")
    rows = verify_rows(content, manifest_sources(entries))
    counts = entries.groupBy("bundle").agg(F.count_if(F.col("name") == "manifest.json").alias("n"), F.max("problem").alias("p"))
    heads = manifest_sources(entries).groupBy("bundle").agg(F.min("schema").alias("schema"), F.count("name").alias("sources"))
    whole = counts.join(heads, "bundle", "left").select("bundle", F.lit("").alias("name"), F.when(F.col("p").isNotNull(), F.col("p")).when(F.col("n") != 1, "manifest_count").when(~F.col("schema").eqNullSafe(F.lit(SCHEMA)), "schema_mismatch").when(F.coalesce("sources", F.lit(0)) == 0, "no_sources").alias("verdict"))
    return rows.unionByName(whole.where("verdict IS NOT NULL"))


def diff_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): entries of one bundle only, and entries whose contents differ."""
    side = lambda df, p: df.groupBy("name").agg(F.min(F.lower("sha256")).alias(p))
    j = side(before, "b").join(side(after, "a"), "name", "full_outer")
    return j.select("name", F.when(F.col("b").isNull(), "only_in_candidate").when(F.col("a").isNull(), "only_in_baseline").when(F.col("a") != F.col("b"), "changed").alias("change")).where("change IS NOT NULL")


def bounded_messages(messages: DataFrame, keys: tuple[str, ...] = ("bundle",), text: str = "message", order: str = "seq") -> DataFrame:
    """Diagnostics cut to what a manifest holds: so many messages, so long each, so long in all; ``truncated`` says where
    anything was cut. The cut is the feature: it bounds a report, not data."""
    w = Window.partitionBy(*keys).orderBy(order)
    short = utf8_cut(F.col(text), MESSAGE_BYTES)
    df = messages.withColumn("__long", F.octet_length(text) > MESSAGE_BYTES).withColumn(text, short)
    df = df.withColumn("__n", F.row_number().over(w)).withColumn("__sum", F.sum(F.octet_length(text)).over(w))
    kept = (F.col("__n") <= MOST_MESSAGES) & (F.col("__sum") <= ALL_MESSAGE_BYTES)
    lost = F.max(~kept | F.col("__long")).over(Window.partitionBy(*keys))
    return df.withColumn("truncated", lost).where(kept).drop("__n", "__sum", "__long")


def utf8_cut(text: Column, most: int) -> Column:
    """The longest head of a text within so many bytes of UTF-8, never half a character."""
    head = F.substring(F.encode(text, "UTF-8"), 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(F.make_valid_utf8(head.cast("string")), "�+$", ""))


def tail_on_line(data: bytes, most: int = TAIL_BYTES) -> bytes:
    """The end of a log within so many bytes, from the start of a line."""
    if len(data) <= most:
        return data
    cut = data.find(b"\n", len(data) - most - 1)
    return data[cut + 1 :] if cut >= 0 else data[-most:]


def create(path: str, artifacts: dict[str, bytes], host: dict | None = None, diagnostics: list[str] = (), redact: bool = False, force: bool = False) -> dict:
    """Writes an archive and returns its manifest. At least one artifact; safe and distinct names; limits are checked
    first; the archive appears whole or not at all, and replaces another only if forced."""
    if not artifacts:
        raise UsageError("a bundle needs at least one source")
    if bad := [n for n in artifacts if not safe_name(n) or n == "manifest.json"]:
        raise UsageError(f"unusable names: {bad[:5]}")
    if os.path.exists(path) and not force:
        raise UsageError(f"{path} exists")
    if redact:
        artifacts = {n: (redact_json(c.decode("utf-8", "replace")) if n.endswith(".json") else redact_text(c.decode("utf-8", "replace"))).encode() for n, c in artifacts.items()}
    if len(artifacts) + 1 > MOST_ENTRIES or sum(map(len, artifacts.values())) > MOST_BYTES:
        raise LimitExceeded("too many or too large artifacts")
    manifest = {"schema": SCHEMA, "host": host or {}, "redacted": redact, "diagnostics": list(diagnostics)[:MOST_MESSAGES], "sources": [{"path": n, "size": len(c), "sha256": hashlib.sha256(c).hexdigest()} for n, c in sorted(artifacts.items())]}
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as z, tarfile.open(fileobj=z, mode="w") as archive:
            for name, content in [("manifest.json", to_json(manifest, pretty=True).encode()), *sorted(artifacts.items())]:
                info = tarfile.TarInfo(name)
                info.size = len(content)
                archive.addfile(info, io.BytesIO(content))
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
    return manifest


def checked_entries(data: bytes) -> dict[str, bytes]:
    """An archive's contents, if each is what its manifest says; an error otherwise."""
    out: dict[str, bytes] = {}
    for name, content, problem in read_entries(data):
        if problem or name in out:
            raise InvalidInput(problem or f"duplicate entry {name}")
        out[name] = content
    manifest = json.loads(out.pop("manifest.json", b"{}"))
    said = {s["path"]: s for s in manifest.get("sources", [])}
    if manifest.get("schema") != SCHEMA or not said or said.keys() != out.keys() or any(hashlib.sha256(c).hexdigest() != said[n]["sha256"] or len(c) != said[n]["size"] for n, c in out.items()):
        raise InvalidInput("the bundle is not what its manifest says")
    return out


def extract(data: bytes, folder: str, force: bool = False) -> list[str]:
    """Writes a verified archive's entries below a folder; never through a link, and over a file only if forced."""
    contents = checked_entries(data)
    targets = {n: os.path.join(folder, n) for n in contents}
    for name, target in targets.items():
        here = folder
        for part in name.split("/"):
            here = os.path.join(here, part)
            if os.path.islink(here):
                raise InvalidInput(f"{here} is a link")
        if os.path.exists(target) and not force:
            raise UsageError(f"{target} exists")
    for name, target in targets.items():
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(contents[name])
    return sorted(targets)


def collect(collectors: dict[str, object]) -> tuple[dict[str, bytes], list[str]]:
    """Artifacts of collectors (name -> callable); one that fails is a diagnostic, not the end; all failing is an error."""
    artifacts, diagnostics = {}, []
    for name, run in sorted(collectors.items()):
        try:
            artifacts[name] = run()
        except Exception as e:  # noqa: BLE001 - any collector may fail in any way
            diagnostics.append(f"{name}: {type(e).__name__}: {e}"[:MESSAGE_BYTES])
    if not artifacts:
        raise UsageError("no source could be collected: " + "; ".join(diagnostics))
    return artifacts, diagnostics


# The entries that hold a domain's report, by section.
SECTIONS = {"disk": "disk_tree", "abi": "abi_report", "test": "test_run", "trace": "trace_snapshot", "sys": "sys_snapshot", "build": "build_graph", "env": "env_report", "net": "net_report", "doctor": "doctor"}
#: What tells rows of a section's report from each other; the rest of a row is compared.
SECTION_KEYS = {
    "disk": ["rel_path"], "abi": ["path", "name"], "test": ["identity"], "trace": ["syscall"], "sys": ["unit", "section", "key"], "build": ["file"], "env": ["norm_name"],
    "net": ["kind", "local_address", "local_port", "remote_address", "remote_port"], "doctor": ["category", "name"],
}


def section_rows(entries: DataFrame, keys: tuple[str, ...] = ("bundle",)) -> DataFrame:
    """keys, section, row_key and row of the reports in bundles: documents that are lists of objects, or hold one under
    ``rows``. entries: keys, name, content (text). A document that cannot be read gives one row with a null row_key."""
    name = F.regexp_extract("name", r"\A(?:\./)*reports/([^/]+)\.json\z", 1)
    section = F.create_map(*[F.lit(x) for s, n in SECTIONS.items() for x in (n, s)])[name]
    told = entries.withColumn("section", section).where("section IS NOT NULL")
    text = F.col("content").cast("string")
    read = F.coalesce(F.from_json(text, "array<map<string,string>>"), F.from_json(F.get_json_object(text, "$.rows"), "array<map<string,string>>"))
    by = F.create_map(*[x for s, k in SECTION_KEYS.items() for x in (F.lit(s), F.array(*[F.lit(c) for c in k]))])[F.col("section")]
    rows = told.select(*keys, "section", by.alias("__by"), F.explode_outer(read).alias("__r"))
    key = F.when(F.col("__r").isNotNull(), F.array_join(F.transform("__by", lambda k: F.coalesce(F.col("__r")[k], F.lit(""))), "|"))
    row = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("__r", lambda k, v: ~F.array_contains("__by", k))))))
    return rows.select(*keys, "section", key.alias("row_key"), row.alias("row"))


def diff_sections(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, section, row_key and change (added, removed, changed, or incomplete for a section that only one side has or that
    could not be read, with a null row_key). before and after: rows of :func:`section_rows`, one bundle for each of keys."""
    by = [*keys, "section"]
    side = lambda df, p: df.where("row_key IS NOT NULL").groupBy(*by, "row_key").agg(F.max("row").alias(p), F.lit(True).alias(f"__{p}"))
    state = lambda df, p: df.groupBy(*by).agg(F.bool_and(F.col("row_key").isNotNull()).alias(f"__{p}_read"))
    states = state(before, "b").join(state(after, "a"), by, "full_outer")
    whole = states.where("__b_read AND __a_read").select(*by)
    j = side(before, "b").join(side(after, "a"), [*by, "row_key"], "full_outer").join(whole, by, "left_semi")
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(~F.col("b").eqNullSafe(F.col("a")), "changed")
    found = j.select(*by, "row_key", change.alias("change")).where("change IS NOT NULL")
    return found.unionByName(states.where("NOT coalesce(__b_read, false) OR NOT coalesce(__a_read, false)").select(*by, F.lit(None).cast("string").alias("row_key"), F.lit("incomplete").alias("change")))
