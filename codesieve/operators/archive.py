"""Bytes of packed executables: the read-only data section, and the table of contents of an appended archive."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import types as T
from pyspark.sql.functions import udf, udtf

from .evaluate import Unknown, inflate

# The archive's cookie.
MAGIC = b"MEI\014\013\012\013\016"
OLD, NEW = "!8siiii", "!8sIIii64s"
TOC = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("schema_version", "python_version")),
        T.StructField("entry_no", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in ("position", "compressed_size", "size")),
        T.StructField("is_compressed", T.IntegerType()),
        *(T.StructField(c, T.StringType()) for c in ("type", "name")),
    ]
)


def rdata(data: bytes) -> bytes | None:
    """Contents of the sections whose name has .rdata, or None if the file is no PE."""
    try:
        at = struct.unpack_from("<I", data, 60)[0]
        if data[:2] != b"MZ" or data[at : at + 4] != b"PE\0\0":
            return None
        n, optional = struct.unpack_from("<H12xH", data, at + 6)
        out = b""
        for k in range(n):
            name, size, place = struct.unpack_from("<8s8xII", data, at + 24 + optional + 40 * k)
            if b".rdata" in name:
                out += data[place : place + size]
        return out
    except struct.error:
        return None


def cookie(data: bytes) -> dict | None:
    """Where the archive begins, where its table is and for which Python it was made; None without a cookie."""
    at = data.rfind(MAGIC)
    if at < 0:
        return None
    new = data[at + 24 : at + 88].lower().find(b"python") >= 0
    if len(data) < at + (88 if new else 24):
        return None
    _, length, toc, toc_length, version = struct.unpack_from(OLD if not new else "!8sIIii", data, at)
    tail = len(data) - at - (88 if new else 24)
    start = len(data) - tail - length
    if start < 0 or toc < 0 or toc_length < 0:
        return None
    major, minor = divmod(version, 100 if version >= 100 else 10)
    return {"schema": "2.1+" if new else "2.0", "python": f"{major}.{minor}", "start": start, "toc": start + toc, "toc_length": toc_length}


def entries(data: bytes):
    """(index, position, compressed size, size, flag, type, name) of each entry; a bad name becomes entry_<n>."""
    c = cookie(data)
    if c is None:
        return
    at, end, k = c["toc"], min(len(data), c["toc"] + c["toc_length"]), 0
    while at + 18 <= end:
        size, position, packed, plain, flag, kind = struct.unpack_from("!iIIIBc", data, at)
        if size < 18:
            return
        try:
            name = data[at + 18 : at + size].rstrip(b"\0").decode() or f"entry_{k}"
        except UnicodeDecodeError:
            name = f"entry_{k}"
        yield k, c["start"] + position, packed, plain, flag, kind.decode("latin-1"), name
        at, k = at + size, k + 1


def member(data: bytes, position: int, packed: int, flag: int) -> bytes | None:
    """The whole contents of an entry; None if it is damaged, cut off or inflates beyond 256 MiB."""
    raw = data[position : position + packed]
    if len(raw) < packed:
        return None
    try:
        return inflate(raw, zlib.decompressobj(), 256 << 20) if flag == 1 else raw
    except (zlib.error, Unknown):
        return None


@udtf(returnType=TOC)
class ArchiveToc:
    """SELECT s.id, t.* FROM samples s, LATERAL archive_toc(s.content) t"""

    def eval(self, content: bytes):
        if content is None:
            return
        data = bytes(content)
        c = cookie(data)
        for k, position, packed, plain, flag, kind, name in entries(data):
            yield c["schema"], c["python"], k, position, packed, plain, flag, kind, name


@udf(returnType=T.BinaryType())
def rdata_udf(content):
    return None if content is None else rdata(bytes(content))


def pyc_header(magic: int, version: tuple[int, int]) -> bytes:
    """Header of compiled code without flags and times: 8, 12 or 16 bytes by version."""
    head = struct.pack("<H", magic) + b"\r\n"
    return head + bytes(12 if version >= (3, 7) else 8 if version >= (3, 3) else 4)
