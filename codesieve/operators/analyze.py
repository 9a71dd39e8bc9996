"""The analysis of a sample: digests, strings, indicators, packer, archive; and what is written of treated samples."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import native
from . import detect
from .archive import cookie, entries, member, pyc_header, rdata_udf

INDICATORS = "struct<`sus words`: array<string>, urls: array<string>, ips: array<string>>"
# Type codes of an archive's entries and what they are.
KINDS = {"s": "script", "m": "module", "M": "package", "z": "modules", "Z": "modules", "b": "binary", "x": "data", "d": "dependency", "o": "option", "n": "link"}
# First numbers of compiled code, by the version of Python up to the next one.
PYC_MAGIC = [(62211, "2.7"), (3131, "3.0"), (3151, "3.1"), (3180, "3.2"), (3230, "3.3"), (3310, "3.4"), (3350, "3.5"), (3379, "3.6"), (3394, "3.7"), (3413, "3.8"), (3425, "3.9"), (3439, "3.10"), (3495, "3.11"), (3531, "3.12"), (3571, "3.13")]
# First bytes by which a text counts as compiled code.
PYC_STARTS = (b"\x55\x0d", b"\x0d\x0d", b"\x16\x0d", b"\x33\x0d", b"\x42\x0d", b"\x61\x0d", b"\x6f\x0d")
PY2EXE_MAGIC = 0x78563412
ENTRY = T.StructType([T.StructField("entry_no", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("type", "kind", "name", "status")), T.StructField("content", T.BinaryType())])
PYC = T.StructType([T.StructField("magic", T.IntegerType()), T.StructField("python", T.StringType()), T.StructField("header_size", T.IntegerType()), T.StructField("has_hash", T.BooleanType()), T.StructField("mtime", T.LongType()), T.StructField("source_size", T.LongType())])
SCRIPT = T.StructType([T.StructField("optimize", T.IntegerType()), T.StructField("unbuffered", T.IntegerType()), T.StructField("archive_name", T.StringType()), T.StructField("code", T.BinaryType())])


def is_pyc(name: Column, content: Column) -> Column:
    """Compiled code by its name or its first bytes."""
    start = F.substring(content, 1, 2)
    known = F.lit(False)
    for b in PYC_STARTS:
        known = known | (start == F.lit(bytearray(b)))
    return F.coalesce(F.endswith(name, F.lit(".pyc")), F.lit(False)) | F.coalesce(known, F.lit(False))


def python_of(magic: int) -> str | None:
    """The version of Python that a first number belongs to: the last one that began at or below it."""
    if magic > 62000:
        return "2.7" if magic == 62211 else None
    return next((v for m, v in reversed(PYC_MAGIC) if m <= magic < 4000 and m < 62000), None)


def parse_pyc(data: bytes) -> tuple | None:
    """(first number, Python, bytes of the header, is it checked by hash, time, size of the source), or None."""
    if len(data) < 8 or data[2:4] != b"\r\n":
        return None
    magic = struct.unpack_from("<H", data)[0]
    python = python_of(magic)
    if python is None:
        return None
    version = tuple(map(int, python.split(".")))
    size = len(pyc_header(magic, version))
    if len(data) < size:
        return None
    if version >= (3, 7):
        flags, mtime, source = struct.unpack_from("<III", data, 4)
        return magic, python, size, bool(flags & 1), None if flags & 1 else mtime, None if flags & 1 else source
    mtime = struct.unpack_from("<I", data, 4)[0]
    return magic, python, size, False, mtime, struct.unpack_from("<I", data, 8)[0] if version >= (3, 3) else None


@F.udf(returnType=PYC)
def pyc_udf(content):
    return None if content is None else parse_pyc(bytes(content))


def resource(data: bytes, name: str = "PYTHONSCRIPT") -> bytes | None:
    """Contents of a named resource of a PE file, or None: its section's tree of types, names and languages is walked."""
    try:
        at = struct.unpack_from("<I", data, 60)[0]
        if data[:2] != b"MZ" or data[at : at + 4] != b"PE\0\0":
            return None
        n, optional = struct.unpack_from("<H12xH", data, at + 6)
        sections = [struct.unpack_from("<8sIIII", data, at + 24 + optional + 40 * k) for k in range(n)]
        base = next(s for s in sections if s[0].rstrip(b"\0") == b".rsrc")
        raw = data[base[4] : base[4] + base[3]]

        def children(place: int):
            named, by_id = struct.unpack_from("<HH", raw, place + 12)
            for k in range(named + by_id):
                key, to = struct.unpack_from("<II", raw, place + 16 + 8 * k)
                label = None
                if key >> 31:
                    size = struct.unpack_from("<H", raw, key & 0x7FFFFFFF)[0]
                    label = raw[(key & 0x7FFFFFFF) + 2 :][: 2 * size].decode("utf-16-le", "replace")
                yield label, to

        todo, depth = [(0, False)], 0
        while todo and depth < 64:
            depth += 1
            place, found = todo.pop()
            for label, to in children(place):
                hit = found or label == name
                if to >> 31:
                    todo.append((to & 0x7FFFFFFF, hit))
                elif hit:
                    address, size = struct.unpack_from("<II", raw, to)
                    return raw[address - base[2] :][:size]
    except (struct.error, StopIteration, IndexError):
        return None
    return None


def py2exe_script(data: bytes) -> tuple | None:
    """(optimize, unbuffered, archive name, code) of a PYTHONSCRIPT resource, or None. The code stays marshalled."""
    if len(data) < 16:
        return None
    magic, optimize, unbuffered, size = struct.unpack_from("<4i", data)
    end = data.find(b"\0", 16)
    if magic != PY2EXE_MAGIC or end < 0:
        return None
    return optimize, unbuffered, data[16:end].decode("utf-8", "replace"), data[end + 1 : end + 1 + size]


@F.udf(returnType=SCRIPT)
def py2exe_udf(content):
    found = None if content is None else resource(bytes(content))
    return None if found is None else py2exe_script(found)


def extracted(data: bytes):
    """The entries of an archive with their contents, as the type codes say: scripts and modules get the header of compiled
    code (that of the first module which brings its own), options and dependencies are listed without contents. Names are data,
    never paths. status: ok, damaged, listed."""
    c = cookie(data)
    if c is None:
        return
    listed = list(entries(data))
    version = tuple(map(int, c["python"].split(".")))
    head = None
    for _, position, packed, _, flag, kind, _ in listed:
        if kind in "mM" and head is None:
            body = member(data, position, packed, flag)
            head = body[:4] if body and body[2:4] == b"\r\n" else None
    magic = struct.unpack("<H", head[:2])[0] if head else next((m for m, v in PYC_MAGIC if v == c["python"]), 0)
    for k, position, packed, _, flag, kind, name in listed:
        what = KINDS.get(kind, "data")
        if what in ("option", "dependency"):
            yield k, kind, what, name, "listed", None
            continue
        body = member(data, position, packed, flag)
        if body is None:
            yield k, kind, what, name, "damaged", None
            continue
        if what in ("script", "module", "package") and body[2:4] != b"\r\n":
            body = pyc_header(magic, version) + body
        yield k, kind, what, name, "ok", body


@F.udtf(returnType=ENTRY)
class ArchiveEntries:
    """SELECT s.id, t.* FROM samples s, LATERAL archive_entries(s.content) t"""

    def eval(self, content: bytes):
        if content is not None:
            yield from extracted(bytes(content))


def module_names(data: bytes) -> tuple[str, list[bytes]] | None:
    """(first bytes of its code's header, inflated bodies) of an archive of modules: its table is marshalled and never read,
    so bodies are found by their zlib streams, which lie one after the other from byte 12 on."""
    import zlib

    if data[:4] != b"PYZ\0" or len(data) < 12:
        return None
    toc = struct.unpack_from("!i", data, 8)[0]
    at, out = 17 if data[12:17] == b"\0" * 5 else 12, []
    while at < min(toc, len(data)):
        unpacker = zlib.decompressobj()
        try:
            body = unpacker.decompress(data[at:toc])
        except zlib.error:
            break
        if not unpacker.eof:
            break
        out.append(body)
        at = toc - len(unpacker.unused_data)
    return data[4:8].hex(), out


def indicators_json(text: Column) -> Column:
    return F.to_json(native.indicators(text))


def indicators_from_json(text: Column) -> Column:
    return F.from_json(text, INDICATORS)


def analyze(samples: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """samples with digests, printable strings, indicators (JSON), packer, pyc and the number of archived entries: one pass."""
    raw = F.col(content).cast("binary")
    text = F.make_valid_utf8(raw.cast("string"))

    @F.udf("int")
    def n_entries(b):
        return None if b is None else sum(1 for _ in entries(bytes(b)))

    return samples.withColumns({
        "hashes": F.struct(*(c.alias(k) for k, c in native.hashes(raw).items())),
        "strings": native.printable_runs(text),
        "indicators": indicators_json(text),
        "packer": detect.packer(rdata_udf(raw)),
        "is_pyc": is_pyc(F.col(name), raw),
        "n_entries": n_entries(raw),
    })


# Sinks ----------------------------------------------------------------------------------------------------------------


def annotated(text: Column, engines: Column, score: Column) -> Column:
    """A cleaned program below a comment that says how it was treated."""
    return F.concat_ws("\n", F.concat(F.lit("# Engines used: "), F.array_join(engines, ", ")), F.concat(F.lit("# Triage Score: "), F.format_number(score, 1)), text)


def cleaned_name(path: Column) -> Column:
    """<stem>-cleaned.py, without the folder."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.concat(stem, F.lit("-cleaned.py"))


def write_cleaned(df: DataFrame, out: str, path: str = "path", text: str = "cleaned", beside: bool = False) -> None:
    """Writes cleaned programs as a table of (file, text); beside: file keeps the sample's folder. Names are data, never paths."""
    folder = F.regexp_extract(path, r"^(.*[/\\])?", 1) if beside else F.lit("")
    df.select(F.concat(folder, cleaned_name(F.col(path))).alias("file"), F.col(text).alias("text")).write.parquet(out)


def write_entries(samples: DataFrame, out: str, key: str = "path", content: str = "content") -> None:
    """Writes the extracted entries of all samples as a table by the sample's key."""
    rows = samples.select(F.col(key).alias("_key"), F.col(content).alias("_content"))
    rows.lateralJoin(ArchiveEntries(F.col("_content").outer())).select(F.col("_key").alias(key), *ENTRY.fieldNames()).write.parquet(out)


def write_checksums(files: DataFrame, out: str, key: str = "rel_path", sha: str = "sha256") -> None:
    """Writes a manifest as JSON rows, in order of the files' names."""
    files.select(F.col(key).alias("rel_path"), F.col(sha).alias("sha256")).sort("rel_path").write.json(out)
