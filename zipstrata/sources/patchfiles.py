"""The patch container: writer, reader and columns for both."""

from __future__ import annotations

import struct
from typing import NamedTuple

from ..functions.kernels import kernel
from ..schemas import PLAN

#: Identifier of the format, kind of the only delta, number of the deflate window.
IDENTIFIER, BSDIFF, WINDOW = b"GFbFv1_0", 0, 0
_MOST = (1 << 63) - 1


class PatchError(ValueError):
    """The bytes are no valid patch."""


class Plan(NamedTuple):
    df_old_size: int
    old_ops: list[tuple[int, int]]
    new_ops: list[tuple[int, int, int, int, bool]]
    old_off: int
    old_len: int
    new_off: int
    new_len: int
    delta_len: int
    delta_at: int


def write_patch(df_old_size: int, old_ops, new_ops, df_new_size: int, delta: bytes) -> bytes:
    """old_ops: (offset, length); new_ops: (offset, length, level, strategy, nowrap)."""
    out = [IDENTIFIER, struct.pack(">iqi", 0, df_old_size, len(old_ops))]
    out += [struct.pack(">qq", *op) for op in old_ops]
    out.append(struct.pack(">i", len(new_ops)))
    out += [struct.pack(">qqbbbb", offset, length, WINDOW, level, strategy, nowrap) for offset, length, level, strategy, nowrap in new_ops]
    out.append(struct.pack(">ibqqqqq", 1, BSDIFF, 0, df_old_size, 0, df_new_size, len(delta)))
    return b"".join([*out, delta])


def read_patch(patch: bytes) -> Plan:
    """Everything but the delta's bytes, which begin at delta_at."""
    if patch[:8] != IDENTIFIER:
        raise PatchError("bad identifier")
    at = 12

    def take(form: str) -> tuple:
        nonlocal at
        try:
            found = struct.unpack_from(f">{form}", patch, at)
        except struct.error:
            raise PatchError("the patch is cut off") from None
        at += struct.calcsize(f">{form}")
        return found

    def want(ok: bool, what: str) -> None:
        if not ok:
            raise PatchError(f"bad {what}")

    def in_order(op: tuple, end: int) -> int:
        want(op[0] >= 0 and op[1] >= 0 and op[0] + op[1] <= _MOST, "range")
        want(op[0] >= end, "order of ranges")
        return op[0] + op[1]

    size, n = take("qi")
    want(size >= 0, "size of the delta-friendly old blob")
    want(n >= 0, "number of ranges")
    old_ops, new_ops, end = [], [], 0
    for _ in range(n):
        old_ops.append(take("qq"))
        end = in_order(old_ops[-1], end)
    (n,), end = take("i"), 0
    want(n >= 0, "number of ranges")
    for _ in range(n):
        offset, length, window, level, strategy, nowrap = take("qqbbbb")
        end = in_order((offset, length), end)
        want(window == WINDOW, "window")
        want(1 <= level <= 9, "level")
        want(0 <= strategy <= 2, "strategy")
        want(nowrap in (0, 1), "wrapping")
        new_ops.append((offset, length, level, strategy, bool(nowrap)))
    (n,) = take("i")
    want(n == 1, "number of deltas")
    kind, *regions, delta_len = take("bqqqqq")
    want(kind == BSDIFF, "kind of delta")
    want(min(*regions, delta_len) >= 0, "delta region")
    return Plan(size, old_ops, new_ops, *regions, delta_len, at)


def read_patch_column(patch):
    """The plan of a patch as a struct; an invalid patch fails the job."""
    return kernel(lambda p: None if p is None else read_patch(bytes(p)), PLAN)(patch)


def try_read_patch_column(patch):
    """struct<plan, error>: the plan is null and the error says why if a patch is invalid."""

    def read(p):
        try:
            return (read_patch(bytes(p)), None) if p is not None else (None, None)
        except PatchError as e:
            return None, str(e)

    return kernel(read, f"struct<plan:{PLAN},error:string>")(patch)
