"""Archive versions made from a documents table, for queries and tests.

Every document is an entry of the old and of the new version of archive
'a<id div entries>'.  In the new version some entries have moved, some have other
content, some are stored instead of deflated or the other way round.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut_lineage
from ..functions.codec import deflate
from ..functions.kernels import kernel
from .tables import dealt_by, table
from .zipfiles import CENTRAL, END, LOCAL, UTF8_FLAG

MOVED, CHANGED = "doc_id % 7 = 0", "doc_id % 5 = 0"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _cells(side: str, entries: int) -> dict[str, Column]:
    new = side == "new"
    return {
        "pair_id": F.expr(f"concat('a', doc_id div {entries})"),
        "doc_id": F.col("doc_id"),
        "path": F.expr(f"concat(if({new} and {MOVED}, 'moved/', 'doc/'), doc_id)"),
        "content": F.expr(f"concat(coalesce(text, ''), if({new} and {CHANGED}, ' v2', ''))"),
        "level": F.expr(f"if(doc_id % {6 if new else 4} = 0, 0, 6)"),
    }


def contents(docs: DataFrame, side: str, entries: int = 1000) -> DataFrame:
    """(pair_id, doc_id, path, content, level) of the old or new version."""
    return docs.select(*(c.alias(name) for name, c in _cells(side, entries).items()))


def entries(docs: DataFrame, side: str) -> DataFrame:
    """A catalogue without zip bytes: a deflated entry counts as half its content's size, every thirteenth is of another method, every eleventh has no known settings."""
    d = contents(docs, side).withColumn("method", F.expr("if(doc_id % 13 = 0, 12, if(level = 0, 0, 8))")).withColumn("usize", F.octet_length("content").cast("long"))
    params = F.when((F.col("doc_id") % 11 != 0) & (F.col("level") > 0), F.struct(F.lit(6).alias("level"), F.lit(0).alias("strategy"), F.lit(True).alias("nowrap")))
    return d.select(
        "pair_id", "path", "method", F.crc32(F.col("content").cast("binary")).alias("crc32"),
        F.expr("if(method = 0, usize, usize - usize div 2)").alias("csize"), "usize", F.col("doc_id").alias("local_off"),
        F.md5(F.concat_ws("#", "content", "method")).alias("digest"), params.alias("params"),
    )


def spans(docs: DataFrame, side: str = "old") -> DataFrame:
    """(pair_id, path, offset, length, usize, is_deflate, local_off): entries laid one behind the other, 40 bytes between."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("pair_id").orderBy("local_off")
    e = entries(docs, side)
    return e.select("pair_id", "path", (F.sum(F.col("csize") + 40).over(w) - F.col("csize")).alias("offset"), F.col("csize").alias("length"), "usize", ((F.col("method") == 8) & (F.col("csize") != F.col("usize"))).alias("is_deflate"), "local_off")


def archive_lengths(docs: DataFrame, side: str = "old") -> DataFrame:
    return entries(docs, side).groupBy("pair_id").agg((F.sum(F.col("csize") + 40) + 100).alias("length"))


def zip_bytes(rows) -> bytes:
    """Zip archive of (path, content, level); level 0 is stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, content, level in rows:
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            z.writestr(info, content, zipfile.ZIP_DEFLATED if level else zipfile.ZIP_STORED, level or None)
    return out.getvalue()


def zipped(rows: DataFrame, newest_first: bool) -> DataFrame:
    """(pair_id, content): a zip archive of each pair's rows (pair_id, doc_id, path, content, level)."""
    make = kernel(lambda rows: zip_bytes([(r["path"], r["content"].encode(), r["level"]) for r in rows]), "binary")
    listed = dealt_by(rows, "pair_id").groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "path", "content", "level")), asc=not newest_first).alias("rows"))
    return listed.select("pair_id", make("rows").alias("content"))


def both_zips(rows) -> tuple[bytes, bytes]:
    """zip_bytes() of the old and, in reverse, of the new version of rows (old and new path, content, new content or None where it is the same, old and new level).

    What both versions deflate is deflated once.
    """

    def entry(content: bytes, level: int) -> tuple:
        return 8 if level else 0, zlib.crc32(content), len(content), deflate(content, level) if level else content

    old, new = [], []
    for old_path, new_path, content, changed, old_level, new_level in rows:
        first = entry(content, old_level)
        old.append((old_path, *first))
        new.append((new_path, *(first if changed is None and new_level == old_level else entry(content if changed is None else changed, new_level))))
    return written(old), written(new[::-1])


def written(entries) -> bytes:
    """Zip archive of (path, method, crc32, plain size, bytes as they are stored), as zipfile lays it out."""
    out, directory, at = [], [], 0
    for path, method, crc, size, data in entries:
        name = path.encode()
        common = (0 if path.isascii() else UTF8_FLAG, method, 0, 33, crc, len(data), size, len(name), 0)
        out += [struct.pack("<4s2B4H3I2H", LOCAL, 20, 0, *common), name, data]
        directory += [struct.pack("<4s4B4H3I5H2I", CENTRAL, 20, 3, 20, 0, *common, 0, 0, 0, 0o600 << 16, at), name]
        at += 30 + len(name) + len(data)
    listed = b"".join(directory)
    return b"".join([*out, listed, struct.pack("<4s4H2IH", END, 0, 0, len(entries), len(entries), len(listed), at, 0)])


def both_archives(docs: DataFrame, entries: int = 50, ending: str = "") -> tuple[DataFrame, DataFrame]:
    """archives() of the old and new version, with an ending behind each content; documents are dealt once, and what is made is written."""
    old, new = _cells("old", entries), _cells("new", entries)
    make = kernel(lambda rows: both_zips([(r["old_path"], r["new_path"], (r["content"] + ending).encode(), None if r["changed"] is None else (r["changed"] + ending).encode(), r["old_level"], r["new_level"]) for r in rows]), "struct<old:binary,new:binary>")
    row = {"doc_id": old["doc_id"], "old_path": old["path"], "new_path": new["path"], "content": old["content"], "changed": F.when(new["content"] != old["content"], new["content"]), "old_level": old["level"], "new_level": new["level"]}
    dealt = dealt_by(docs.select(old["pair_id"].alias("pair_id"), F.struct(*(c.alias(name) for name, c in row.items())).alias("row")), "pair_id")
    made = cut_lineage(dealt.groupBy("pair_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("pair_id", make("rows").alias("zips")))
    return tuple(made.select("pair_id", F.col(f"zips.{side}").alias("content")) for side in ("old", "new"))


def archives(docs: DataFrame, side: str, entries: int = 50) -> DataFrame:
    """(pair_id, content): zip archives of at most `entries` documents; the new ones list them in reverse."""
    return zipped(contents(docs, side, entries), side == "new")
