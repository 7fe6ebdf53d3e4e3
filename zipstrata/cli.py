"""Command line: generate and apply patches of two archives, or explain what a patch would hold.

    python -m zipstrata.cli generate --old A --new B --patch P [--trl N] [--dfobsl N]
    python -m zipstrata.cli apply --old A --new B --patch P
    python -m zipstrata.cli explain --old A --new B [--trl N] [--dfobsl N] [--json]

--trl limits the bytes recompressed when the patch is applied, --dfobsl the size of
the delta-friendly old blob.  For many pairs at once use operators.engine on a table.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.codec import is_compatible
from .operators import engine
from .plans import explain, limits


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Patches between archives")
    parser.add_argument("command", choices=["generate", "apply", "explain"])
    parser.add_argument("--old", required=True)
    parser.add_argument("--new", required=True)
    parser.add_argument("--patch")
    parser.add_argument("--trl", type=int)
    parser.add_argument("--dfobsl", type=int)
    parser.add_argument("--json", action="store_true")
    a = parser.parse_args(argv)
    if a.command != "explain" and not a.patch:
        parser.error(f"{a.command} needs --patch")
    if a.command == "apply" and (a.trl is not None or a.dfobsl is not None):
        parser.error("limits have no meaning when a patch is applied")
    return a


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("zipstrata").getOrCreate()
    if not is_compatible(spark):
        raise SystemExit("deflate on the executors differs from the known one; patches wouldn't be portable")

    def archive(path: str):
        return spark.createDataFrame([("pair", bytearray(Path(path).read_bytes()))], "pair_id string, content binary")

    old = archive(a.old)
    if a.command == "apply":
        patches = archive(a.patch).withColumnRenamed("content", "patch")
        Path(a.new).write_bytes(bytes(engine.apply(old, patches).first()["content"]))
        return 0
    new = archive(a.new)
    modifiers = [] if a.trl is None else [limits.total_recompression(a.trl)]
    if a.dfobsl is not None:
        modifiers.append(limits.old_blob_size(a.dfobsl, old.select("pair_id", F.octet_length("content").alias("length"))))
    if a.command == "generate":
        Path(a.patch).write_bytes(bytes(engine.generate(old, new, *modifiers).first()["patch"]))
        return 0
    found = explain.explain_archives(old, new, *modifiers)
    report = (explain.legacy_json_report if a.json else explain.text_report)(found).first()
    print(report["report"] if report else "")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
