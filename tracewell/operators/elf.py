"""The binary-interface domain: ELF files into headers, dependencies and dynamic symbols; comparison with a verdict."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.diff import COMPATIBILITY

# Codes of the format.
MACHINES = {3: "x86", 8: "mips", 20: "powerpc", 21: "powerpc64", 22: "s390", 40: "arm", 50: "ia64", 62: "x86_64", 183: "aarch64", 243: "riscv", 258: "loongarch"}
TYPES = {0: "NONE", 1: "REL", 2: "EXEC", 3: "DYN", 4: "CORE"}
SYMBOL_TYPES = {0: "NOTYPE", 1: "OBJECT", 2: "FUNC", 3: "SECTION", 4: "FILE", 5: "COMMON", 6: "TLS", 10: "IFUNC"}
BINDINGS = {0: "LOCAL", 1: "GLOBAL", 2: "WEAK", 10: "UNIQUE"}
VISIBILITIES = {0: "DEFAULT", 1: "INTERNAL", 2: "HIDDEN", 3: "PROTECTED"}
_PT_LOAD, _PT_DYNAMIC, _PT_INTERP = 1, 2, 3
_NEEDED, _HASH, _STRTAB, _SYMTAB, _STRSZ, _SONAME, _RPATH, _RUNPATH, _GNU_HASH, _VERSYM, _VERDEF, _VERDEFNUM, _VERNEED, _VERNEEDNUM = 1, 4, 5, 6, 10, 14, 15, 29, 0x6FFFFEF5, 0x6FFFFFF0, 0x6FFFFFFC, 0x6FFFFFFD, 0x6FFFFFFE, 0x6FFFFFFF


class ElfFile:
    """A parsed file, read through program headers, so section headers may be stripped."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"\x7fELF" or len(data) < 52:
            raise ValueError("no ELF file")
        self.data, self.wide, self.order = data, data[4] == 2, "<" if data[5] == 1 else ">"
        kind, machine = self.read("HH", 16)
        self.header = {"class": "ELF64" if self.wide else "ELF32", "endian": "little" if self.order == "<" else "big", "type": TYPES.get(kind, str(kind)), "machine": MACHINES.get(machine, str(machine))}
        phoff = self.read("Q", 32)[0] if self.wide else self.read("I", 28)[0]
        size, count = self.read("HH", 54 if self.wide else 42)
        self.segments = []
        for i in range(count):
            at = phoff + i * size
            if self.wide:
                t, _, off, vaddr, _, filesz = self.read("IIQQQQ", at)
            else:
                t, off, vaddr, _, filesz = self.read("IIIII", at)
            self.segments.append((t, off, vaddr, filesz))
        self.dynamic: list[tuple[int, int]] = []
        for t, off, _, filesz in self.segments:
            if t == _PT_DYNAMIC:
                step = 16 if self.wide else 8
                for at in range(off, min(off + filesz, len(data) - step + 1), step):
                    tag, value = self.read("qQ" if self.wide else "iI", at)
                    if tag == 0:
                        break
                    self.dynamic.append((tag & 0xFFFFFFFF, value))
        self.tags = {t: v for t, v in reversed(self.dynamic)}
        start = self.offset(self.tags.get(_STRTAB, -1))
        self.strings = data[start : start + self.tags.get(_STRSZ, 0)] if start is not None else b""

    def read(self, form: str, at: int) -> tuple:
        return struct.unpack_from(self.order + form, self.data, at)

    def offset(self, vaddr: int) -> int | None:
        return next((off + vaddr - v for t, off, v, n in self.segments if t == _PT_LOAD and v <= vaddr < v + n), None)

    def text(self, at: int) -> str:
        end = self.strings.find(b"\0", at)
        return self.strings[at : end if end >= 0 else len(self.strings)].decode("utf-8", "replace") if 0 <= at < len(self.strings) else ""

    def named(self, tag: int) -> list[str]:
        return [self.text(v) for t, v in self.dynamic if t == tag]

    def interpreter(self) -> str | None:
        return next((self.data[off : off + n].split(b"\0")[0].decode("utf-8", "replace") for t, off, _, n in self.segments if t == _PT_INTERP), None)

    def _symbol_count(self) -> int:
        if (at := self.offset(self.tags.get(_HASH, -1))) is not None:
            return self.read("II", at)[1]
        if (at := self.offset(self.tags.get(_GNU_HASH, -1))) is None:
            return 0
        buckets, first, bloom, _ = self.read("IIII", at)
        table = at + 16 + bloom * (8 if self.wide else 4)
        last = max(self.read(f"{buckets}I", table), default=0)
        if last < first:
            return first
        chain = table + buckets * 4
        while not self.read("I", chain + (last - first) * 4)[0] & 1:
            last += 1
        return last + 1

    def versions(self) -> tuple[dict[int, str], list[str], list[str]]:
        """(name by index, ``library:version`` that are needed, versions that are defined)."""
        names: dict[int, str] = {}
        needed, defined = [], []
        at = self.offset(self.tags.get(_VERNEED, -1))
        for _ in range(self.tags.get(_VERNEEDNUM, 0) if at is not None else 0):
            _, count, file, aux, following = self.read("HHIII", at)
            a = at + aux
            for _ in range(count):
                _, _, index, name, step = self.read("IHHII", a)
                names[index & 0x7FFF] = self.text(name)
                needed.append(f"{self.text(file)}:{self.text(name)}")
                a += step
                if not step:
                    break
            at += following
            if not following:
                break
        at = self.offset(self.tags.get(_VERDEF, -1))
        for _ in range(self.tags.get(_VERDEFNUM, 0) if at is not None else 0):
            _, flags, index, _, _, aux, following = self.read("HHHHIII", at)
            name = self.text(self.read("I", at + aux)[0])
            names[index & 0x7FFF] = name
            if not flags & 1:
                defined.append(name)
            at += following
            if not following:
                break
        return names, sorted(needed), sorted(defined)

    def symbols(self) -> list[dict]:
        start = self.offset(self.tags.get(_SYMTAB, -1))
        if start is None:
            return []
        versions, _, _ = self.versions()
        versym = self.offset(self.tags.get(_VERSYM, -1))
        out = []
        for i in range(1, self._symbol_count()):
            if self.wide:
                name, info, other, section, _, size = self.read("IBBHQQ", start + i * 24)
            else:
                name, _, size, info, other, section = self.read("IIIBBH", start + i * 16)
            text = self.text(name)
            if not text:
                continue
            index = self.read("H", versym + 2 * i)[0] if versym is not None else 0
            version = versions.get(index & 0x7FFF) if index & 0x7FFF > 1 else None
            mark = "" if not version else f"@{version}" if index & 0x8000 or section == 0 else f"@@{version}"
            out.append({"identity": text + mark, "size": size, "binding": BINDINGS.get(info >> 4, str(info >> 4)), "visibility": VISIBILITIES[other & 3], "symbol_type": SYMBOL_TYPES.get(info & 15, str(info & 15)), "defined": section != 0})
        return out


_SYMBOL = "array<struct<identity:string,size:bigint,binding:string,visibility:string,symbol_type:string,defined:boolean>>"
_REPORT = f"binary string, status string, class string, endian string, type string, machine string, dynamic boolean, soname string, interpreter string, needed array<string>, rpath array<string>, runpath array<string>, needs_versions array<string>, own_versions array<string>, symbols {_SYMBOL}"


def inspect_file(binary: str, data: bytes) -> dict:
    """A report of one file; status ``ok``, ``non-elf`` or ``malformed``. Names stay as the linker knows them: C++ and
    Rust names are not demangled, and debugging information is not read."""
    out = {"binary": binary, "status": "ok", "symbols": []}
    try:
        f = ElfFile(data)
        split = lambda tag: [p for v in f.named(tag) for p in v.split(":") if p]
        _, needs, own = f.versions()
        return out | f.header | {"dynamic": bool(f.dynamic), "soname": next(iter(f.named(_SONAME)), None), "interpreter": f.interpreter(), "needed": f.named(_NEEDED), "rpath": split(_RPATH), "runpath": split(_RUNPATH), "needs_versions": needs, "own_versions": own, "symbols": f.symbols()}
    except ValueError:
        return out | {"status": "non-elf"}
    except (struct.error, IndexError):
        return out | {"status": "malformed"}


def inspect(files: DataFrame) -> DataFrame:
    """Reports of files (path, content); what is no ELF file keeps a row that says so."""
    symbol = pa.list_(pa.struct([("identity", pa.string()), ("size", pa.int64()), ("binding", pa.string()), ("visibility", pa.string()), ("symbol_type", pa.string()), ("defined", pa.bool_())]))
    names = "binary status class endian type machine dynamic soname interpreter needed rpath runpath needs_versions own_versions symbols".split()
    kinds = {"dynamic": pa.bool_(), "symbols": symbol} | {n: pa.list_(pa.string()) for n in ("needed", "rpath", "runpath", "needs_versions", "own_versions")}

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reports = [inspect_file(p, c or b"") for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in reports], kinds.get(n, pa.string())) for n in names], names=names)

    return files.select("path", "content").mapInArrow(over, _REPORT)


def symbol_table(reports: DataFrame) -> DataFrame:
    """(binary, identity, size, binding, visibility, symbol_type, defined)."""
    return reports.select("binary", F.inline("symbols"))


def vtables(symbols: DataFrame) -> DataFrame:
    """Exported tables of virtual functions, by the mangled prefix."""
    return symbols.where(F.col("defined") & F.startswith("identity", F.lit("_ZTV")))


def diff_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(identity, change, what, verdict) of dynamic symbols of two sides.

    A removed export, another type or another size of a data symbol is incompatible; a new export and a change of
    imports or binding only is compatible."""
    keep = lambda df, p: df.select("identity", *[F.col(c).alias(f"{p}_{c}") for c in ("size", "binding", "symbol_type", "defined")]).dropDuplicates(["identity"])
    j = keep(before, "b").join(keep(after, "a"), "identity", "full_outer")
    b, a = F.coalesce("b_defined", F.lit(False)), F.coalesce("a_defined", F.lit(False))
    both = b & a
    data = F.col("a_symbol_type").isin("OBJECT", "COMMON", "TLS")
    what = F.filter(F.array(F.when(both & (F.col("b_symbol_type") != F.col("a_symbol_type")), "type"), F.when(both & (F.col("b_binding") != F.col("a_binding")), "binding"), F.when(both & data & (F.col("b_size") != F.col("a_size")), "size")), lambda x: x.isNotNull())
    change = F.when(b & ~a, "removed").when(~b & a, "added").when(~b & ~a & F.col("b_defined").isNull(), "import_added").when(~b & ~a & F.col("a_defined").isNull(), "import_removed").when(both & (F.size("what") > 0), "changed")
    verdict = F.when((F.col("change") == "removed") | F.array_contains("what", "type") | F.array_contains("what", "size"), COMPATIBILITY[2]).otherwise(COMPATIBILITY[0])
    return j.withColumn("what", what).withColumn("change", change).where("change IS NOT NULL").withColumn("verdict", verdict).select("identity", "change", "what", "verdict")


def diff_headers(before: DataFrame, after: DataFrame) -> DataFrame:
    """(what, before_value, after_value, verdict) of two reports of one row each: header and dependencies.

    Another class, byte order, machine, type, linkage or own name, and a version no longer defined, is incompatible;
    other libraries, search paths and needed versions are uncertain. Reports that are not ok are uncertain."""
    text = lambda c: F.array_join(c, ",") if c in ("needed", "rpath", "runpath", "needs_versions", "own_versions") else F.col(c).cast("string")
    facts = ["status", "class", "endian", "machine", "type", "dynamic", "soname", "needed", "rpath", "runpath", "needs_versions", "own_versions"]
    long = lambda df, p: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), text(c).alias(f"{p}_value")) for c in facts])).alias("x")).select("x.*")
    j = long(before, "before").join(long(after, "after"), "what").where(~F.col("before_value").eqNullSafe(F.col("after_value")))
    lost = F.size(F.array_except(F.split("before_value", ","), F.split("after_value", ","))) > 0
    verdict = F.when(F.col("what").isin("class", "endian", "machine", "type", "dynamic", "soname"), COMPATIBILITY[2]).when((F.col("what") == "own_versions") & lost, COMPATIBILITY[2]).otherwise(COMPATIBILITY[1])
    return j.withColumn("verdict", verdict)
