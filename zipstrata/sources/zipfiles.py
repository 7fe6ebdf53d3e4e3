"""Zip catalogues: archives as rows of bytes in, entries as rows out.

The directory is read from the end of the archive; compressed bytes never leave
the task, only their digest does, so no later shuffle carries content.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import divine
from ..functions.kernels import kernel
from ..schemas import ENTRY

#: The records' signatures, and how far from its end an archive's directory end is looked for.
END, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
END_WITHIN = 32768
UTF8_FLAG = 1 << 11


class ZipError(ValueError):
    """The bytes are no archive of the understood kind."""


class Entry(NamedTuple):
    path: bytes
    method: int
    crc32: int
    csize: int
    usize: int
    utf8: bool
    local_off: int
    data_off: int

    @property
    def is_deflate(self) -> bool:
        return self.method == 8 and self.csize != self.usize


def _unpack(form: str, content: bytes, at: int, what: str) -> tuple:
    try:
        return struct.unpack_from(form, content, at)
    except struct.error:
        raise ZipError(f"{what} at {at} is cut off") from None


def directory(content: bytes, within: int = END_WITHIN) -> tuple[int, int, int]:
    """(entries, offset, length) of the central directory."""
    start = max(0, len(content) - within)
    at = content.rfind(END, start)
    if at < 0:
        raise ZipError(f"no end of directory in the last {within} bytes")
    n, length, offset = _unpack("<10xHII", content, at, "directory end")
    if n == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        raise ZipError("zip64 archives aren't understood")
    return n, offset, length


def entries(content: bytes, within: int = END_WITHIN) -> list[Entry]:
    """All entries by rising local offset; data offsets come from the local headers' own lengths."""
    n, at, length = directory(content, within)
    bound = at
    found = []
    for _ in range(n):
        sig, flags, method, crc, csize, usize, name, extra, comment, local = _unpack("<4s4xHH4xIIIHHH8xI", content, at, "directory entry")
        if sig != CENTRAL:
            raise ZipError(f"no directory entry at {at}")
        path = content[at + 46 : at + 46 + name]
        if len(path) < name:
            raise ZipError("an entry's name is cut off")
        at += 46 + name + extra + comment
        found.append((local, path, method, crc, csize, usize, bool(flags & UTF8_FLAG)))
    found.sort(key=lambda x: x[0])
    out = []
    for k, (local, path, method, crc, csize, usize, utf8) in enumerate(found):
        sig, name, extra = _unpack("<4s22xHH", content, local, "local header")
        if sig != LOCAL:
            raise ZipError(f"no local header at {local}")
        data = local + 30 + name + extra
        if data + csize > (found[k + 1][0] if k + 1 < n else bound):
            raise ZipError(f"the entry at {local} runs into what follows it")
        out.append(Entry(path, method, crc, csize, usize, utf8, local, data))
    return out


def path_text(path: bytes, utf8: bool) -> str:
    return path.decode("utf-8" if utf8 else "cp437", "replace")


def read_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(pair_id, content) of files; the name without its ending tells the pair."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("pair_id"), "content")


def catalog(archives: DataFrame, with_params: bool = False, strict: bool = True) -> DataFrame:
    """One row per entry of archives (pair_id, content); with_params finds the deflate settings too.

    An archive that can't be read fails the job, or with strict=False yields no rows
    (see unreadable()).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for b in batches:
            for pair, cell in zip(b.column(0).to_pylist(), b.column(1)):
                content = cell.as_py()
                try:
                    found = entries(content or b"")
                except ZipError:
                    if strict:
                        raise
                    continue
                rows = []
                for e in found:
                    data = content[e.data_off : e.data_off + e.csize]
                    p = divine(data) if with_params and e.is_deflate else None
                    rows.append((pair, e.path, path_text(e.path, e.utf8), e.method, e.crc32, e.csize, e.usize, e.utf8, e.local_off, e.data_off, hashlib.sha256(data).hexdigest(), p and dict(zip(("level", "strategy", "nowrap"), p))))
                kinds = [pa.string(), pa.binary(), pa.string(), pa.int32(), *[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 2, pa.string(), pa.struct([("level", pa.int32()), ("strategy", pa.int32()), ("nowrap", pa.bool_())])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names)

    return archives.select("pair_id", "content").mapInArrow(run, ENTRY)


def stored_entries(archives: DataFrame) -> DataFrame:
    """(pair_id, local_off, stored): each entry's bytes as they stand in its archive, cut out where the archive lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pair, cell in zip(b.column(0).to_pylist(), b.column(1)):
                content = cell.as_py() or b""
                for some in itertools.batched(entries(content), 64):
                    parts = [content[e.data_off : e.data_off + e.csize] for e in some]
                    yield pa.RecordBatch.from_arrays([pa.array([pair] * len(parts)), pa.array([e.local_off for e in some], pa.int64()), pa.array(parts, pa.binary())], ["pair_id", "local_off", "stored"])

    return archives.select("pair_id", "content").mapInArrow(run, "pair_id string, local_off long, stored binary")


def archive_error(content):
    """Column: why an archive can't be read; null if it can."""

    def error(c):
        try:
            entries(bytes(c or b""))
        except ZipError as e:
            return str(e)
        return None

    return kernel(error, "string")(content)


def unreadable(archives: DataFrame) -> DataFrame:
    """(pair_id, error) of archives that catalog(strict=False) leaves out."""
    return archives.select("pair_id", archive_error("content").alias("error")).filter("error is not null")


def byte_range(content, offset, length):
    """Column: length bytes of a binary column from offset (0-based)."""
    return F.substring(content, F.lit(offset).cast("int") + 1 if isinstance(offset, int) else offset.cast("int") + 1, F.lit(length).cast("int") if isinstance(length, int) else length.cast("int"))
