"""The walk over matches by searching: the same matches as by the suffix array, without one where deltas are of the usual kind."""

import random

import pytest

from zipstrata.functions import bindiff as b
from zipstrata.sources.versions import zip_bytes


def by_suffixes(old, new, least=b.MIN_MATCH, budget=b.MATCH_BUDGET):
    return list(b._dense_matches(old, new, least, budget))


@pytest.fixture
def no_suffixes(monkeypatch):
    """No suffix array may be made."""

    def fail(data):
        raise AssertionError("a suffix array is made")

    return lambda: monkeypatch.setattr(b, "suffix_array", fail)


def texts(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(20, 300))).encode() for _ in range(n)]


def test_archives_padded_with_blanks(no_suffixes):
    """each run of blanks was judged letter by letter, with a suffix array over all of them."""
    docs = texts(40)
    pad = b" " * 200
    old = zip_bytes([(f"doc/{k}", d + pad, 0) for k, d in enumerate(docs)])
    new = zip_bytes([(f"doc/{k}", d + (b" v2" if k % 5 == 0 else b"") + pad, 0) for k, d in reversed(list(enumerate(docs)))])
    want = by_suffixes(old, new)
    no_suffixes()
    assert list(b.matches(old, new)) == want and len(want) > 40


def test_many_places_of_a_match():
    """A match that stands in old more often than places are compared one by one, at all lengths; the place follows from the order of suffixes."""
    rng = random.Random(7)
    for n in range(1, 80):
        passage = bytes(rng.choice(b"xyz") for _ in range(17 + n))
        old = b"".join(passage + bytes([rng.choice(b"ABC")]) + rng.randbytes(3) for _ in range(40))
        new = b"start" + passage + b"B" + passage[:-1] + b"?" + passage
        assert list(b.matches(old, new)) == by_suffixes(old, new)
    spread = b"".join(b"the same passage, often" + bytes([k % 256, k // 256]) for k in range(3000))  # more places than are put in order
    assert list(b.matches(spread, b"-the same passage, often-")) == by_suffixes(spread, b"-the same passage, often-")


def test_searching_agrees_with_suffixes():
    rng = random.Random(11)
    for k in range(400):
        letters = rng.choice([b"ab", b"abc  ", b" ", b"abcdefgh \0\xff"])
        words = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(8)]
        old = b" ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        new = bytearray(old if k % 2 else b" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))))
        for _ in range(rng.randint(0, 8)):
            i = rng.randint(0, len(new))
            new[i : i + rng.randint(0, 60)] = old[rng.randint(0, len(old)) :][: rng.randint(0, 90)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        least, budget = rng.choice([16, 16, 8, 3, 0, 30]), rng.choice([1 << 26, 1 << 26, 1, 50, 5000])
        assert list(b.matches(old, bytes(new), least, budget)) == by_suffixes(old, bytes(new), least, budget)


def test_patches_are_made_once(spark, monkeypatch):
    """both branches of patch_ranges made the patches, and a column chained to them made them once more."""
    from zipstrata import proofs

    plans, cut = [], proofs.cut_lineage
    monkeypatch.setattr(proofs, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    plans.append(proofs.patch_ranges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    calls = [line for plan in plans for line in plan.splitlines() if "EvalPython" in line and "make(__old" in line]
    assert len(calls) == 1 and calls[0].count("make(__old") == 1


def test_usual_changes_need_no_suffixes(no_suffixes):
    """texts with themselves, and with something put before and behind."""
    docs = texts(12, 5) + [b"line repeated\n" * 300, b"x" * 5000]
    no_suffixes()
    for d in docs:
        assert list(b.matches(d, d)) == [] and list(b.matches(d, d, budget=1)) == [(0, 0)]
        assert b.apply_delta(d, b.write_delta(d, b"version 2: " + d + b" (2)")) == b"version 2: " + d + b" (2)"


def test_explained_costs_need_no_suffixes(no_suffixes):
    """the delta of a changed entry."""
    from zipstrata.functions.codec import deflate
    from zipstrata.plans.explain import _changed_cost

    docs = texts(12, 6)
    no_suffixes()
    for d in docs:
        assert _changed_cost(deflate(d, 6), deflate(d + b" v2", 6), True, True) < 90
        assert _changed_cost(deflate(d, 6), d + b" v2", True, False) < 90


def test_patches_of_archives_need_no_suffixes(no_suffixes):
    """F8: the delta of two archives that list their entries the other way round."""
    from zipstrata.operators import engine

    docs = texts(30, 8)
    old = zip_bytes([(f"doc/{k}", d, 0) for k, d in enumerate(docs)])
    new = zip_bytes([(f"doc/{k}", d + b" v2" * (k % 5 == 0), 0) for k, d in reversed(list(enumerate(docs)))])
    no_suffixes()
    patch = engine.make_patch(old, new, [], [])
    assert engine.use_patch(old, patch) == new


def test_letters_without_a_match_are_passed_at_once(monkeypatch):
    """F8: where new has nothing of old, every letter that agreed with the diagonal by chance was judged, and sixteen places behind it."""
    rng = random.Random(9)
    old = rng.randbytes(30000)
    new = old[:9000] + bytes(rng.choice(old) for _ in range(20000)) + old[9000:20000] + rng.randbytes(3000)
    calls, holds = [], b._Finder.holds
    monkeypatch.setattr(b._Finder, "holds", lambda self, begin, end: (calls.append(begin), holds(self, begin, end))[1])
    assert list(b.matches(old, new)) == by_suffixes(old, new)
    assert len(calls) < 400
