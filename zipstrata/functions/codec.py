"""Deflate codecs, the search for deflate settings, delta-friendly blobs and their inverse, deflate fingerprints."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..schemas import PARAMS
from .kernels import kernel

Params = tuple[int, int, bool]

#: Order in which settings are tried: strategy -> levels, most usual first.
SEARCH = {0: (6, 9, 1, 4, 2, 3, 5, 7, 8), 1: (6, 9, 4, 5, 7, 8), 2: (1,)}


def deflate(data: bytes, level: int = -1, strategy: int = 0, nowrap: bool = True) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15 if nowrap else 15, 8, strategy)
    return c.compress(data) + c.flush()


def inflate(data: bytes, nowrap: bool = True) -> bytes:
    """Inflated bytes; zlib.error if the stream is broken, incomplete or followed by other bytes."""
    d = zlib.decompressobj(-15 if nowrap else 15)
    out = d.decompress(data) + d.flush()
    if not d.eof or d.unused_data:
        raise zlib.error("the stream isn't whole or has bytes behind it")
    return out


def _makes(data: bytes, plain: bytes, level: int, strategy: int, nowrap: bool) -> bool:
    """Whether these settings make data from plain; gives up at the first differing piece."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15 if nowrap else 15, 8, strategy)
    at = 0
    for i in range(0, len(plain), 32768):
        out = c.compress(plain[i : i + 32768])
        if data[at : at + len(out)] != out:
            return False
        at += len(out)
    return data[at:] == c.flush()


def divine(data: bytes) -> Params | None:
    """Settings that made these deflated bytes, or None; wrapped streams come second."""
    for nowrap in (True, False):
        try:
            plain = inflate(data, nowrap)
        except zlib.error:
            continue
        for strategy, levels in SEARCH.items():
            for level in levels:
                if _makes(data, plain, level, strategy, nowrap):
                    return level, strategy, nowrap
    return None


def uncompress_ranges(content: bytes, ranges: Iterable[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """Delta-friendly blob with the ranges inflated, and where they lie in it."""
    out, inverse, at, size = [], [], 0, 0
    for offset, length in ranges:
        if offset < at or offset + length > len(content):
            raise ValueError(f"range {offset}+{length} overlaps or lies outside")
        plain = inflate(content[offset : offset + length])
        size += offset - at
        inverse.append((size, len(plain)))
        out += [content[at:offset], plain]
        size += len(plain)
        at = offset + length
    return b"".join([*out, content[at:]]), inverse


def recompress_ranges(blob: bytes, ranges: Iterable[tuple[int, int, int, int, bool]]) -> bytes:
    """Inverse of uncompress_ranges: ranges (offset, length, level, strategy, nowrap) of the blob are deflated, the rest copied."""
    out, at = [], 0
    for offset, length, level, strategy, nowrap in ranges:
        if offset < at or offset + length > len(blob):
            raise ValueError(f"range {offset}+{length} overlaps or lies outside")
        out += [blob[at:offset], deflate(blob[offset : offset + length], level, strategy, nowrap)]
        at = offset + length
    return b"".join([*out, blob[at:]])


def deflate_column(data, level: int = -1, strategy: int = 0, nowrap: bool = True):
    return kernel(lambda x: None if x is None else deflate(bytes(x), level, strategy, nowrap), "binary")(data)


def inflate_column(data, nowrap: bool = True):
    return kernel(lambda x: None if x is None else inflate(bytes(x), nowrap), "binary")(data)


def divine_column(data):
    return kernel(lambda x: None if x is None else divine(bytes(x)), PARAMS)(data)


def delta_friendly_column(content, ranges):
    """Binary column with the ranges (array<struct<offset,length>>) inflated."""
    return kernel(lambda c, r: None if c is None else uncompress_ranges(bytes(c), [(x["offset"], x["length"]) for x in r or ()])[0], "binary")(content, ranges)


# Text and rule of the corpus that tells deflate implementations apart,
# and the SHA-256 of its deflated bytes by (wrapped or not, strategy, level from 1).
CORPUS_TEXT = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt "
    "ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation "
    "ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in "
    "reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. "
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt "
    "mollit anim id est laborum."
)
CORPUS_PREFIXES = 135
FINGERPRINTS = {
    (True, 0): (
        "5e0ae60766a04b0c9ef1f677ae4ba4a83a6bc112ce3761b41b270af08821804e",
        "9b392414e62afcc64200cc39955ff75d1254f56c67bf2eb05d62f63b677080fc",
        "ce272e7f72232e80b5d00d7333a5bdd6e9d7e34268d49c5fe9bdfedba6fc0d54",
        "a8a3b59d42fe257766926d46818422216a043c8c37bb69492d9bab3bd4d6b07a",
        "49280186dd6683ae92ef25e239d7c0e2b7a4fd0e2b7dfadc8846f5157aa6aed9",
        "bec508de691537047e338825828db16308cc8dc93e22386c8eeb0bc14c4c5f45",
        "6daf3724aed1f67c7d1f6404166b5dbea1f2fc42192f20813910271bc8c40e75",
        "08cd258637bb146d33ef550fc60baaa855902837758d6489802f3b1ece6ea7f1",
        "5ea67964bb124b436130dfbbd2e36fb2b08992423be188a8edfbb8550e8bfefb",
    ),
    (True, 1): (
        "5e0ae60766a04b0c9ef1f677ae4ba4a83a6bc112ce3761b41b270af08821804e",
        "9b392414e62afcc64200cc39955ff75d1254f56c67bf2eb05d62f63b677080fc",
        "ce272e7f72232e80b5d00d7333a5bdd6e9d7e34268d49c5fe9bdfedba6fc0d54",
        "6283bb35a97f4657b6aab0b0a7f218947965f135838926df295037fdca816746",
        "42594bbcf7fa83f74cdf35839debaae25e4655070fdf1fc67539de0a90f59afe",
        "1db82cae52b0bb88cf3a21cdec183c1dab8074b1d1f4341b9e9b18b1ace5a778",
        "5d0d53667944dc447b52e58b0e91e303b5662f92a085ab5a1f4b62eeab8900ef",
        "c6cdfbe16b1e530e91fd3ac1dbb2a9b2f5b3ccee5ddf92769ea349fc60fd560e",
        "f4e93a15b50c568d39785c12d373104272009bcd71028dbf0faa85441eb5130d",
    ),
    (True, 2): (
        "2297dbc0a5498c9a7a89519f401936e910ddb82c9b477e7aa407a4c2bf523dbd",
    ),
    (False, 0): (
        "5e06d9c9280e5b9b4832c0894e2f930f606665169ad2ac093df544e70fac4136",
        "f1c2fe9b4189c03a5ae0b1a1db51875d334fb21144e08e9c527644d66ef39797",
        "49998ee364d2668eb5a2cadf40feaa78c0c081337141ad15f7fb2a7843c833b8",
        "6911a5b04664b00b2bba72d7ba9e1d5a73b390f2cf4b20618580c13a5825fc17",
        "417f5fd21438ffb739a681af9a20eed29dd9da63e8a540415b9ec6199495e6db",
        "9a4bcc9afd8547784aff6283cafd69f46893d5131bd798fbad92dc52ca946522",
        "592ad846a99693b2f1092bac6a3bf2cf5ac562a9b38ebe34c46cbf2ddd3c13aa",
        "8d4b91929384dfd7a0dda6b6e0410de7c4c109167047d694cf36b46e68dd8d5f",
        "36bacacc32707e6498269a04d2b2cd30990ac4b0717ee4a9e4badbb6ca5fb7ea",
    ),
    (False, 1): (
        "5e06d9c9280e5b9b4832c0894e2f930f606665169ad2ac093df544e70fac4136",
        "f1c2fe9b4189c03a5ae0b1a1db51875d334fb21144e08e9c527644d66ef39797",
        "49998ee364d2668eb5a2cadf40feaa78c0c081337141ad15f7fb2a7843c833b8",
        "2bd9ae26fe933102ed46ef2bf8e82d62e0104d9d1cce73a8b46df8a238fd32f8",
        "6410581a92808f97f695e796c2963cb6e111af1ec7b7e7d155dcb601192dd80a",
        "50571149806edb22b7f3a3ba52168644dd99de444e813df7e186817ccc204c01",
        "7a41b9549bcc651d3d219e7aaf3f74beefea238caf1560036cd299d62be6531b",
        "29da81b218ff50e69819375d2c008a648309dd9a0fc18683d675ce523cff744f",
        "4ce8c7903e526e2a36db168c5cf9af0b90155850899ea26ad77d6daaa7b395c3",
    ),
    (False, 2): (
        "e3cc7200f308fa7756f02bebbf5046e58a4a2a7e8f1c9ea1708b96d4e1033666",
    ),
}


def corpus() -> bytes:
    text = CORPUS_TEXT.encode()
    return b"".join(text[:n] for n in range(CORPUS_PREFIXES))


def baseline() -> list[tuple[int, int, bool, str]]:
    """(level, strategy, nowrap, sha256) of the 38 settings."""
    return [(level, strategy, nowrap, sha) for (nowrap, strategy), hashes in FINGERPRINTS.items() for level, sha in enumerate(hashes, 1)]


def fingerprints(spark: SparkSession, known: list[tuple] | None = None) -> DataFrame:
    """(level, strategy, nowrap, sha256, expected) as the executors' own zlib makes them; known: other expectations than baseline()."""
    rows = spark.createDataFrame(known or baseline(), "level int, strategy int, nowrap boolean, expected string")
    own = kernel(lambda level, strategy, nowrap: hashlib.sha256(deflate(corpus(), level, strategy, nowrap)).hexdigest(), "string")
    return rows.withColumn("sha256", own("level", "strategy", "nowrap"))


def incompatible(spark: SparkSession, known: list[tuple] | None = None) -> DataFrame:
    """Settings whose deflate differs from the baseline on the executors."""
    return fingerprints(spark, known).filter("sha256 <> expected")


def is_compatible(spark: SparkSession) -> bool:
    return incompatible(spark).isEmpty()
