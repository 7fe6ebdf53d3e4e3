"""Patches between archives: plan, generate, apply; many pairs at once.

The plan is relational and moves no content.  Content is joined to a pair's
finished plan once and handled by one Python stage a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut_lineage
from ..functions.bindiff import apply_delta, write_delta
from ..functions.codec import recompress_ranges, uncompress_ranges
from ..functions.kernels import kernel
from ..plans import layout
from ..plans.matching import plan_pairs
from ..sources.patchfiles import read_patch, write_patch
from ..sources.tables import dealt_by
from ..sources.zipfiles import catalog


def patch_plan(old: DataFrame, new: DataFrame, *modifiers) -> DataFrame:
    """Classified pairs of entries of archives (pair_id, content); modifiers rewrite them in turn.

    Archives are read, and deflate settings searched, once: the catalogues are written.
    """
    return plan_pairs(cut_lineage(catalog(old)), cut_lineage(catalog(new, with_params=True)), *modifiers)


def make_patch(old: bytes, new: bytes, old_ops: list[tuple], new_ops: list[tuple]) -> bytes:
    """new_ops: (offset, length, level, strategy, nowrap) in the new archive."""
    old_blob, _ = uncompress_ranges(old, old_ops)
    new_blob, places = uncompress_ranges(new, [op[:2] for op in new_ops])
    again = [(*place, *op[2:]) for place, op in zip(places, new_ops)]
    return write_patch(len(old_blob), old_ops, again, len(new_blob), write_delta(old_blob, new_blob))


def use_patch(old: bytes, patch: bytes) -> bytes:
    """The new archive."""
    plan = read_patch(patch)
    old_blob, _ = uncompress_ranges(old, plan.old_ops)
    if len(old_blob) != plan.df_old_size:
        raise ValueError("the old archive isn't the one that the patch was made for")
    delta = patch[plan.delta_at : plan.delta_at + plan.delta_len]
    return recompress_ranges(apply_delta(old_blob, delta), plan.new_ops)


def generate(old: DataFrame, new: DataFrame, *modifiers) -> DataFrame:
    """(pair_id, patch) from archives (pair_id, content)."""
    spans = cut_lineage(layout.ranges(patch_plan(old, new, *modifiers)))
    sides = {s: layout.as_arrays(spans.filter(F.col("side") == s).select("pair_id", "offset", "length", "params.*"), "level", "strategy", "nowrap").withColumnRenamed("ops", f"{s}_ops") for s in ("old", "new")}
    contents = [dealt_by(side.select("pair_id", F.col("content").alias(name)), "pair_id") for side, name in ((old, "__old"), (new, "__new"))]
    rows = contents[0].join(contents[1], "pair_id").join(sides["old"], "pair_id", "left").join(sides["new"], "pair_id", "left")

    def make(a, b, old_ops, new_ops):
        return make_patch(bytes(a), bytes(b), [(x["offset"], x["length"]) for x in old_ops or ()], [(x["offset"], x["length"], x["level"], x["strategy"], x["nowrap"]) for x in new_ops or ()])

    return rows.select("pair_id", kernel(make, "binary")("__old", "__new", "old_ops", "new_ops").alias("patch"))


def apply(old: DataFrame, patches: DataFrame) -> DataFrame:
    """(pair_id, content) of the new archives."""
    use = kernel(lambda a, p: use_patch(bytes(a), bytes(p)), "binary")
    return dealt_by(old.select("pair_id", F.col("content").alias("__old")), "pair_id").join(patches, "pair_id").select("pair_id", use("__old", "patch").alias("content"))


def write_files(frame: DataFrame, folder: str, column: str) -> DataFrame:
    """Write each row's bytes to folder/<pair_id>; (pair_id, length) of what was written.

    folder must be shared by all executors; a file appears under its name when it is whole.
    """
    import os

    def run(batches):
        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for pair, cell in zip(b.column(0).to_pylist(), b.column(1)):
                at = os.path.join(folder, pair)
                with open(f"{at}.{os.getpid()}.part", "wb") as f:
                    f.write(cell.as_py())
                os.replace(f.name, at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c.as_py()) for c in b.column(1)], pa.int64())], ["pair_id", "length"])

    return frame.select("pair_id", column).mapInArrow(run, "pair_id string, length long")
