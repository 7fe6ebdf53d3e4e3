"""Different windows that agree in half of their hash are no repeats."""

import hashlib
import random

import numpy as np
from test_operators import brute_removal, pairs

from zipstrata.llm import substrings


def test_windows_alike_in_32_bits_stay(spark):
    grams = [" ".join(f"g{s}w{i}" for i in range(8)).encode() for s in range(20_000)]
    hashes = substrings.windows(np.arange(len(grams)), grams, 8, 8)[2]
    gram = grams[int(hashes.argmin())].decode()
    r = random.Random(5)
    word = lambda: f"c{r.randrange(10**6)}"
    texts = [" ".join([*(word() for _ in range(12)), gram, *(word() for _ in range(12))]) for _ in range(40_000)]
    doc, _, own, least = substrings.windows(np.arange(len(texts)), [t.encode() for t in texts], 20, 8)
    mine = np.flatnonzero(least == hashes.min())
    mine = mine[np.argsort(own[mine])]
    alike = np.flatnonzero(own[mine][1:] >> np.uint64(32) == own[mine][:-1] >> np.uint64(32))
    found = sorted({int(doc[mine[i + d]]) for i in alike for d in (0, 1)})
    assert len(found) >= 4
    rows = [(i, texts[i]) for i in found]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pairs(substrings.removal_digests(docs), "n_words", "n_removed", "kept_sha256")
    assert got == {i: (n, g, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, k) in zip(rows, brute_removal(rows, 20))}
    assert not any(g[1] for g in got.values())


def test_a_gram_of_few_windows_a_chunk_is_hot(spark):
    """Some 26 windows a chunk, over many chunks."""
    grams = [" ".join(f"g{s}w{i}" for i in range(8)).encode() for s in range(20_000)]
    gram = grams[int(substrings.windows(np.arange(len(grams)), grams, 8, 8)[2].argmin())].decode()
    text = lambda k: " ".join(" ".join([*(f"a{k}b{j}c{i}" for i in range(12)), gram, *(f"d{k}e{j}f{i}" for i in range(12))]) for j in range(2))
    docs = spark.createDataFrame([(k, text(k)) for k in range(8)], "doc_id long, text string").repartition(8, "doc_id").cache()
    chunks = docs.rdd.glom().filter(lambda x: len(x) > 0).count()
    assert chunks > 3
    rows = substrings._rows(docs, "doc_id", "text")
    assert len(substrings.hot_grams(rows, 20, 8, 150, *substrings.extent(rows))) == 1


def test_a_gram_spread_thinly_over_all_chunks_is_hot(spark, monkeypatch):
    """Once a text, a text a chunk: no chunk and no task holds many of its windows."""
    monkeypatch.setattr(substrings, "_CHUNK", 10)
    monkeypatch.setattr(substrings, "_COUNTED", 100)
    grams = [" ".join(f"g{s}w{i}" for i in range(8)).encode() for s in range(20_000)]
    gram = grams[int(substrings.windows(np.arange(len(grams)), grams, 8, 8)[2].argmin())].decode()
    text = lambda k: " ".join([*(f"a{k}c{i}" for i in range(12)), gram, *(f"d{k}f{i}" for i in range(12))])
    data = [(k, text(k)) for k in range(300)] + [(1000 + k, text(k)) for k in range(0, 300, 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(20)
    rows = substrings._rows(docs, "doc_id", "text")
    hot = substrings.hot_grams(rows, 20, 8, 2000, *substrings.extent(rows))
    assert len(hot) == 1  # 300 texts * 13 windows
    got = pairs(substrings.removal_digests(docs, hot_windows=2000), "n_words", "n_removed", "kept_sha256")
    assert got == {i: (n, g, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, k) in zip(data, brute_removal(data, 20))}


def test_rows_that_share_an_id(spark):
    """Null and repeated ids with different texts: each row loses what its own windows repeat, and nothing else."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    data = [(None, a), (None, b), (7, a + " more"), (7, b), (7, b), (8, "x " + a), (9, a), (None, None), (3, ""), (7, " ".join(f"c{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in data], "doc_id long, text string, id_key int, Tie int, spans int").repartition(3)
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    want = [(i, kept.decode() if removed else t) for (i, t), (_, removed, kept) in zip(data, brute_removal(data, 20))]
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in out.collect()])) == sorted(map(repr, want))
    digests = [(r["doc_id"], r["kept_sha256"]) for r in substrings.removal_digests(docs).collect()]
    assert sorted(map(repr, digests)) == sorted(repr((i, hashlib.sha256(k).hexdigest())) for (i, _), (_, _, k) in zip(data, brute_removal(data, 20)))
