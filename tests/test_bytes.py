"""Kernels: deltas, GDIFF, deflate, the patch container, zip directories."""

import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zipstrata.functions import bindiff as b
from zipstrata.functions import codec as c
from zipstrata.sources import patchfiles as p
from zipstrata.sources import zipfiles as z
from zipstrata.sources.versions import zip_bytes

#: Texts and the control entries (diff, extra, seek) that any delta of this format has for them.
GOLDEN = [
    ("aa", "aa", [(2, 0, 0)]),
    ("aaa", "aaa", [(0, 0, 0), (3, 0, 0)]),
    ("aa", "bb", [(0, 2, 0)]),
    ("aazzzbbb", "aaayyyyybbb", [(2, 6, 3), (3, 0, 0)]),
    ("zzzbb", "abb", [(0, 3, 0)]),
    ("@@012345@ab@de@ghijklm", "#012$45%^&abcdefghijklm", [(0, 1, 2), (6, 3, 1), (13, 0, 0)]),
    ("@ab@de@ghijklm@@012345", "#012$45%^&abcdefghijklm", [(0, 1, 16), (6, 3, -21), (13, 0, 0)]),
    ("012345678901234567890nexus9nexus5nexus6", "567@9n1x3s56exus6", [(0, 0, 5), (4, 0, 17), (13, 0, 0)]),
    ("aaazzzbbbbbbbb", "bb@bb@bbaaabbb", [(0, 8, 0), (3, 0, 3), (3, 0, 0)]),
    ("aaaaaaaaaaazzzbbb", "aaabbbaa@aa@aa", [(0, 0, 0), (3, 0, 11), (3, 8, 0)]),
    ("abcdefghi", "ab@def@hi", [(0, 0, 0), (9, 0, 0)]),
]


@pytest.mark.parametrize("old,new,entries", GOLDEN)
def test_delta_entries(old, new, entries):
    o, n = old.encode(), new.encode()
    assert [e[:3] for e in b.delta_entries(o, n, b.naive_matches(o, n))] == entries


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=70), st.text("abc", max_size=70), st.sampled_from([0, 1, 16]))
def test_delta_round_trip(old, new, least):
    o, n = old.encode(), new.encode()
    assert b.apply_delta(o, b.write_delta(o, n, least)) == n


def plain_longest(old, new, at):
    """(start, length) by the definition: of the suffix not below new[at:] and the one before it, the one that agrees longer."""
    order = sorted(range(len(old) + 1), key=lambda i: old[i:])
    above = next((k for k, i in enumerate(order) if old[i:] >= new[at:]), len(order))
    above = min(max(above, 1), len(order) - 1) if old else 0
    n = {k: b.common_prefix(old, order[k], new, at) for k in (above, max(above - 1, 0))}
    k = max(above - 1, 0) if n[max(above - 1, 0)] > n[above] else above
    return order[k], n[k]


def plain_matches(old, new, least, budget=1 << 26):
    """The rule of matches(), one place after the other."""
    at = diagonal = 0
    while at < len(new):
        seen = 0
        while at < len(new):
            start, n = plain_longest(old, new, at)
            agree = sum(0 <= k + diagonal < len(old) and old[k + diagonal] == new[k] for k in range(at, at + n))
            seen += n
            if n > agree + least or seen >= budget:
                yield start, at
                diagonal, at = start - at, at + n
                break
            at += n if n and n == agree else 1


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=30))
def test_suffixes_and_longest_match(old, new):
    assert b.suffix_array(old).tolist() == sorted(range(len(old) + 1), key=lambda i: old[i:])
    start, length = b.Matcher(old, new).longest(0, len(new)) if new else ([], [])
    for at, (s, n) in enumerate(zip(start, length)):
        assert (s, n) == plain_longest(old, new, at)
        assert n == max(b.common_prefix(old, i, new, at) for i in range(len(old) + 1))


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=90), st.text("abc", max_size=90), st.sampled_from([0, 1, 3, 16]), st.sampled_from([1 << 26, 5, 40]))
def test_matches_by_the_rule(old, new, least, budget):
    o, n = old.encode(), new.encode()
    assert list(b.matches(o, n, least, budget)) == list(plain_matches(o, n, least, budget))


def test_matches_of_edited_texts_by_the_rule():
    rng = random.Random(2)
    for k in range(25):
        words = [bytes(rng.choice(b"abcdefg\0\xff") for _ in range(rng.randint(1, 9))) for _ in range(30)]
        old = b" ".join(rng.choice(words) for _ in range(80))
        new = bytearray(old)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(new))
            new[i : i + rng.randint(0, 20)] = old[rng.randrange(len(old)) :][: rng.randint(0, 40)]
        assert list(b.matches(old, bytes(new), k % 5 * 4)) == list(plain_matches(old, bytes(new), k % 5 * 4))


def test_unrelated_bytes_take_linear_time():
    import time

    rng = random.Random(9)
    old, new = rng.randbytes(1 << 20), rng.randbytes(1 << 20)
    began = time.process_time()
    delta = b.write_delta(old, new)
    assert time.process_time() - began < 10  # some 2 s on an idle machine
    assert b.apply_delta(old, delta) == new


def test_suffixes_of_long_random_bytes():
    rng = random.Random(1123458)
    for n in (10_000, 30_000):
        data = bytes(rng.choice(b"ab") for _ in range(n))
        s = b.suffix_array(data).tolist()
        assert sorted(s) == list(range(n + 1))
        assert all(data[i : i + 200] <= data[j : j + 200] for i, j in zip(s, s[1:]))


def test_edited_text_has_a_small_delta():
    rng = random.Random(5)
    old = " ".join(str(rng.random()) for _ in range(2000)).encode()
    new = old[:9000] + b"another passage" + old[9100:] + old[:500]
    delta = b.write_delta(old, new)
    assert b.apply_delta(old, delta) == new
    assert len(zlib.compress(delta)) < 600


@pytest.mark.parametrize("n", [0, 1, -1, 255, -(2**31), 2**31 - 1, 2**63 - 1, -(2**63) + 1])
def test_numbers(n):
    assert b.unpack_long(b.pack_long(n)) == n


def test_bad_deltas():
    good = b.write_delta(b"old bytes that stay", b"old bytes that stay, and more")
    assert b.apply_delta(b"old bytes that stay", good, 29) == b"old bytes that stay, and more"
    with pytest.raises(b.DeltaError):
        b.unpack_long(bytes(7) + b"\x80")
    bad = [b"X" + good[1:], good[:16], good[:30], good[:-1], b.MAGIC + b.pack_long(-1), b.MAGIC + b.pack_long(2**31)]
    bad += [b.MAGIC + b.pack_long(5) + b"".join(map(b.pack_long, e)) + bytes(5) for e in [(6, 0, 0), (0, 6, 0), (-1, 6, 0), (5, 0, 40), (5, 0, -9), (40, 0, 0)]]
    for d in bad:
        with pytest.raises(b.DeltaError):
            b.apply_delta(b"old bytes that stay", d)
    with pytest.raises(b.DeltaError):
        b.apply_delta(b"old bytes that stay", good, 28)


#: Magic, opcodes and widths of the GDIFF format.
def test_gdiff():
    assert b.apply_gdiff(b"ABCDEFG", b.GDIFF_MAGIC + b"\xf9\0\0\x02" + b"\x02XY" + b"\xf9\0\x02\x02" + b"\xf9\0\x01\x02" + b"\x02DE" + b"\0") == b"ABXYCDBCDE"
    forms = {249: ">HB", 250: ">HH", 251: ">Hi", 252: ">iB", 253: ">iH", 254: ">ii", 255: ">qi"}
    patch = b.GDIFF_MAGIC + b"".join(bytes([op]) + struct.pack(f, i, 2) for i, (op, f) in enumerate(forms.items())) + b"\0"
    assert b.apply_gdiff(b"ABCDEFGHIJ", patch) == b"ABBCCDDEEFFGGH"
    for n in (1, 246, 247, 300, 70_000):
        head = bytes([n]) if n <= 246 else b"\xf7" + struct.pack(">H", n) if n < 65536 else b"\xf8" + struct.pack(">i", n)
        assert b.apply_gdiff(b"", b.GDIFF_MAGIC + head + b"x" * n + b"\0") == b"x" * n
    assert b.apply_gdiff(b"ABC", b.GDIFF_MAGIC + b"\x01x\0", 5) == b"x"
    for patch in (b"", b"\xd1\xff\xd1\xff\x05\0", b.GDIFF_MAGIC, b.GDIFF_MAGIC + b"\x05ab", b.GDIFF_MAGIC + b"\xf9\0\x02\x02\0", b.GDIFF_MAGIC + b"\xfb\0\0" + struct.pack(">i", -1), b.GDIFF_MAGIC + b"\x03abc\0"):
        with pytest.raises(b.DeltaError):
            b.apply_gdiff(b"ABC", patch, 2)


@pytest.mark.parametrize("nowrap", [True, False])
@pytest.mark.parametrize("strategy", [0, 1, 2])
@pytest.mark.parametrize("level", range(1, 10))
def test_settings_are_found(level, strategy, nowrap):
    data = c.deflate(c.corpus(), level, strategy, nowrap)
    found = c.divine(data)
    assert found is not None and found[2] == nowrap
    assert c.deflate(c.corpus(), *found) == data
    if strategy != 2:
        assert found[0] == level
        assert found[1] == (strategy if level > 3 else 0)


def test_junk_has_no_settings():
    good = c.deflate(c.corpus(), 6)
    for data in (b"", b"junk", good[:-3], good + b"x", b"junk" + good[4:]):
        assert c.divine(data) is None


def test_fingerprints_of_this_machine():
    assert len(c.corpus()) == 9045
    rows = c.baseline()
    assert len(rows) == 38
    assert all(hashlib.sha256(c.deflate(c.corpus(), level, strategy, nowrap)).hexdigest() == sha for level, strategy, nowrap, sha in rows)


def test_blobs_round_trip():
    parts = [b"head", c.deflate(b"one" * 99, 6), b"between", c.deflate(b"two" * 50, 9), b"tail"]
    data = b"".join(parts)
    ranges = [(4, len(parts[1])), (4 + len(parts[1]) + 7, len(parts[3]))]
    blob, places = c.uncompress_ranges(data, ranges)
    assert blob == b"head" + b"one" * 99 + b"between" + b"two" * 50 + b"tail"
    assert places == [(4, 297), (308, 150)]
    assert c.recompress_ranges(blob, [(*places[0], 6, 0, True), (*places[1], 9, 0, True)]) == data
    assert c.uncompress_ranges(data, []) == (data, [])
    for bad in ([(4, 10**6)], [(9, 5), (3, 2)]):
        with pytest.raises((ValueError, zlib.error)):
            c.uncompress_ranges(data, bad)


def patch_bytes(**change) -> bytes:
    x = {"identifier": b"GFbFv1_0", "size": 100, "old": [(1, 5), (9, 2)], "new": [(2, 7, 0, 6, 0, 1), (20, 1, 0, 9, 2, 0)], "n_old": None, "n_new": None, "n": 1, "kind": 0, "regions": (0, 100, 0, 90), "delta_len": 3, "delta": b"abc"} | change
    out = x["identifier"] + struct.pack(">iqi", 0, x["size"], len(x["old"]) if x["n_old"] is None else x["n_old"])
    out += b"".join(struct.pack(">qq", *o) for o in x["old"]) + struct.pack(">i", len(x["new"]) if x["n_new"] is None else x["n_new"])
    out += b"".join(struct.pack(">qqbbbb", *o) for o in x["new"])
    return out + struct.pack(">ibqqqqq", x["n"], x["kind"], *x["regions"], x["delta_len"]) + x["delta"]


def test_patch_container():
    good = p.write_patch(100, [(1, 5), (9, 2)], [(2, 7, 6, 0, True), (20, 1, 9, 2, False)], 90, b"abc")
    assert good == patch_bytes()
    plan = p.read_patch(good)
    assert plan.old_ops == [(1, 5), (9, 2)] and plan.new_ops == [(2, 7, 6, 0, True), (20, 1, 9, 2, False)]
    assert good[plan.delta_at : plan.delta_at + plan.delta_len] == b"abc"


@pytest.mark.parametrize("change", [
    {"identifier": b"GFbFv1_1"}, {"size": -1}, {"n_old": -1}, {"n_new": -1}, {"old": [(9, 2), (1, 5)]}, {"old": [(1, 9), (9, 2)]}, {"old": [(-1, 2)]}, {"old": [(1, -2)]}, {"old": [(2**62, 2**62 + 9)]},
    {"new": [(20, 1, 0, 6, 0, 1), (2, 7, 0, 6, 0, 1)]}, {"new": [(2, 7, 1, 6, 0, 1)]}, {"new": [(2, 7, 0, 0, 0, 1)]}, {"new": [(2, 7, 0, 10, 0, 1)]}, {"new": [(2, 7, 0, 6, 3, 1)]}, {"new": [(2, 7, 0, 6, -1, 1)]}, {"new": [(2, 7, 0, 6, 0, 2)]},
    {"n": 0}, {"n": 2}, {"kind": 1}, {"regions": (-1, 0, 0, 0)}, {"regions": (0, -1, 0, 0)}, {"regions": (0, 0, -1, 0)}, {"regions": (0, 0, 0, -1)}, {"delta_len": -1},
])
def test_bad_patches(change):
    with pytest.raises(p.PatchError):
        p.read_patch(patch_bytes(**change))


def test_patches_cut_off():
    good = patch_bytes()
    for n in range(0, len(good) - 3):
        with pytest.raises(p.PatchError):
            p.read_patch(good[:n])


def test_zip_directory_agrees_with_zipfile():
    rows = [("b.txt", b"stored", 0), ("a/ä.txt", b"deflated " * 50, 6), ("empty", b"", 0)]
    content = zip_bytes(rows)
    with zipfile.ZipFile(io.BytesIO(content)) as f:
        infos = {i.filename: i for i in f.infolist()}
    found = z.entries(content)
    assert [z.path_text(e.path, e.utf8) for e in found] == [r[0] for r in rows]
    for e in found:
        i = infos[z.path_text(e.path, e.utf8)]
        assert (e.method, e.crc32, e.csize, e.usize, e.local_off) == (i.compress_type, i.CRC, i.compress_size, i.file_size, i.header_offset)
    assert [e.is_deflate for e in found] == [False, True, False]
    assert zlib.decompress(content[found[1].data_off :][: found[1].csize], -15) == rows[1][1]


def test_zip_errors():
    content = zip_bytes([("a", b"x" * 100, 6), ("b", b"y", 0)])
    for bad in (b"", b"no archive", content[:-30], content.replace(z.CENTRAL, b"XXXX"), content.replace(z.LOCAL, b"XXXX"), content + bytes(40_000)):
        with pytest.raises(z.ZipError):
            z.entries(bad)
    with pytest.raises(z.ZipError):
        z.directory(content[:-12] + b"\xff" * 12)
    assert z.path_text(b"\x84", False) == "ä" and z.path_text("ä".encode(), True) == "ä"
