"""Groups of similar documents and the pipeline's stage, against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from test_operators import ROWS, brute_components

import corpus_pipeline
from zipstrata.llm import similar


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(words, places, tag):
    return " ".join(f"{tag}{i}" if i in places else w for i, w in enumerate(words))


def rows():
    r = random.Random(11)
    out = list(ROWS)
    for d in range(12):  # pairs on either side of 0.8, a chain, many copies that differ at one end
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 200))]
        out += [(1000 + 100 * d + k, edited(base, set(r.sample(range(len(base)), k % 5)), f"x{k}y")) for k in range(10)]
    base = [f"v{i}" for i in range(60)]
    out += [(5000 + k, " ".join([*base, f"end{k}"])) for k in range(40)]
    return out + [(6000 + k, " ".join(base[:8]) + f" own{k} " + " ".join(f"z{k}q{i}" for i in range(30))) for k in range(40)]


def as_sets(roots):
    """Groups as sets of places, from each place's root."""
    groups = defaultdict(set)
    for k, root in enumerate(roots):
        groups[root].add(k)
    return {frozenset(g) for g in groups.values()}


def brute_groups(sets):
    """The same for all pairs; a place's root is the first of its group."""
    return brute_components([(k, s) for k, s in enumerate(sets)], near)


@pytest.mark.parametrize("common,crowd", [(3, 3), (200, 200), (200, 5)])
def test_similar_groups(spark, common, crowd):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {(r["id"], r["tie"]): r["root"] for r in similar.similar_groups(docs, common=common, crowd=crowd).collect()}
    key = lambda i, t: (-(2**63) if i is None else i, np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64) if t is not None else 42)
    assert as_sets(got[key(i, t)] for i, t in data) == as_sets(brute_groups([shingles(t) for _, t in data]))


def brute_kept(data):
    """(id, text) that stay: of each group the least (id, hash of the text), null ids last."""
    signed = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    best = {}
    for (i, t), root in zip(data, brute_groups([shingles(t) for _, t in data])):
        place = (i is None, -(2**63) if i is None else i, signed(t))
        best[root] = min(best.get(root, (place, (i, t))), (place, (i, t)), key=lambda x: x[0])
    return sorted((x for _, x in best.values()), key=repr)


def test_one_row_of_each_group_stays(spark):
    """Null ids, ids that repeat with other texts, copies of both, extra columns with the names that are used inside."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(2, b), (5, a), (5, b), (5, b), (None, a), (None, a), (None, c), (None, c + " more"), (7, None), (8, ""), (None, None), (9, c + " " + b), (9, c + " " + b)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in data], "doc_id long, text string, id long, tie long, id_key long").repartition(3)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == brute_kept(data)
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_stage_drops_copies_of_similarity_08(spark):
    data = [(i, t) for i, t in rows() if i is not None and i >= 1000 and i != 10**15]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    least = brute_components([(i, shingles(t)) for i, t in data], near)
    assert {r[0] for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()} == set(least)
