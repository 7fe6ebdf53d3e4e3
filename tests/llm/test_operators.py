"""The corpus operators on small fixtures with awkward rows, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from zipstrata.llm import bpe, htmltext, licenses, packing, quality, simhash, substrings, syncmers, tokencounts, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(VOCABULARY) + r.choice([" ", " ", " ", ", ", ".\n", "  "]) for _ in range(n))


SHARED = prose(60, 99)
TEXTS = [
    None, "", " ", "\n\t ", "one", "two words", "Ünïcode ’tis ½² 日本語 🙂's नमस्ते", "<|endoftext|> a<|endoftext|>", "it's we'RE 'r don''t",
    *(prose(n, n) for n in (5, 30, 55, 120, 400)), prose(120, 120), prose(120, 120), prose(60, 1) + SHARED + prose(40, 2), SHARED + prose(80, 3), prose(10, 4) + SHARED,
    "again and again " * 40, "x" * 5000, prose(9000, 5), prose(120, 120).replace("\n", "\n\n"), "A B c d\x1ce\x85f　g  h \n i",
]
ROWS = [*enumerate(TEXTS), (3, "\n\t "), (None, "a row without an id"), (10**15, prose(70, 8)), (-5, prose(70, 9))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", "src", 0, t, i) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, fp long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def pairs(df, *columns):
    """Rows by id; rows that share an id must agree."""
    out = {}
    for r in df.collect():
        row = tuple(r[c] for c in columns)
        assert out.setdefault(r["doc_id"], row) == row
    return out


def test_bpe(docs, empty, library):
    got = pairs(bpe.round_trip_digests(docs, BYTE), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in ROWS:
        ids = library[BYTE].encode(t or "", add_special_tokens=False).ids
        back = library[BYTE].decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), t
    encoded = bpe.encode_documents(docs, BYTE)
    assert pairs(bpe.decode_documents(encoded, BYTE), "text") == {i: (t or "",) for i, t in ROWS}
    assert bpe.round_trip_digests(empty, BYTE).count() == 0


def test_bpe_of_odd_spaces(library):
    own = bpe.ForcedBoundaryBPE(BYTE, max_entries=50)
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "é", " ", " ", "\n", "\t", "'", "s", "1", " ", "　", "!", "日", "<|endoftext|>"]) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    assert [bytes(x) for x in own.encode_many(texts)] == [b"".join(i.to_bytes(4, "little") for i in library[BYTE].encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing(docs, empty, library):
    packed = packing.pack(docs, BYTE, with_ids=True)
    rows = packed.collect()
    want = defaultdict(list)
    for i, t in ROWS:
        want[i].append(library[BYTE].encode(t or "", add_special_tokens=False).ids + [0])
    total = sum(len(x) for xs in want.values() for x in xs)
    assert sum(r["length"] for r in rows) == total
    for i, texts in want.items():
        own = [r for r in rows if r["doc_id"] == i]
        assert sorted((r["start"], r["length"]) for r in own for _ in [0]) and sum(r["length"] for r in own) == sum(map(len, texts))
        for r in own:
            piece = next(x for x in texts if len(x) == r["doc_tokens"])[r["start"] : r["start"] + r["length"]]
            assert r["ids"] == piece and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) * 1024 - total <= (len(by_sequence) + packing.WASTE) * 1024 // packing.WASTE + 2 * 1024  # 1/64 of full sequences, and the last ones
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 1024)
    assert packing.pack(empty, BYTE).count() == 0


def test_packing_past_int(docs, monkeypatch):
    """Ids of sequences that don't fit an int, as class 1 has from 2^21 sequences of 1024 on."""
    near, first, pieces = packing.pack(docs, BYTE).collect(), 3_000_000, packing._pieces
    assert any(r["class"] == 1 for r in near) and any(r["sequence_id"] % 1024 + 1 != r["class"] for r in near)  # some last sequences are laid together
    monkeypatch.setattr(packing, "_pieces", lambda *a: pieces(*a).withColumn("number", F.col("number") + F.when(F.col("class") == 1, first).otherwise(0)))
    far = packing.pack(docs, BYTE).collect()
    assert max(r["sequence_id"] for r in far) >= 2**31
    moved = [r.asDict() | {"sequence_id": r["sequence_id"] + first * 1024 * (r["class"] == 1)} for r in near]
    assert sorted(map(str, moved)) == sorted(str(r.asDict()) for r in far)


def test_packing_classes():
    for rest, parts in enumerate(packing.cuts(1024)):
        assert sum(n for n, _ in parts) == rest
        for n, k in parts:
            assert 1024 // (k + 1) < n <= 1024 // k and (1024 // k - n) * packing.WASTE <= 1024 // k


def brute_fingerprint(t, width=3):
    import xxhash

    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(items, near):
    """Least id reachable by near links, of each (id, value)."""
    group = list(range(len(items)))
    for a, b in itertools.combinations(range(len(items)), 2):
        if near(items[a][1], items[b][1]) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, items):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in group]


def test_simhash(docs, empty):
    got = pairs(simhash.near_duplicates(docs), "fingerprint", "component_id")
    items = [(i, brute_fingerprint(t)) for i, t in ROWS]
    for (i, f), c in zip(items, brute_components(items, lambda a, b: (a ^ b).bit_count() <= 2)):
        assert got[i] == (f"{f:016x}", c)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_chains_and_crowds(spark):
    """Links through chains, and a crowd of near fingerprints at the same anchors, against all pairs."""
    import numpy as np

    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base[:20]:
        for _ in range(12):
            f ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(f)
    crowd = r.getrandbits(64)
    fps |= {crowd ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(2500)}
    fps = np.array(sorted(fps), np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= 2) + a + 1:
            x, y = find(a), find(int(b))
            parent[max(x, y)] = min(x, y)
    signed = fps.view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    for blocks, hot in ((("golay23", "golay23"), 10**6), (("golay23", "golay23"), 100), (("golay23", "golay23", "hamming15"), 10**6), (("hamming7",), 10**6), (("hamming7",), 1)):
        if hot < 10**6:
            assert len(simhash.hot_anchors(distinct, 2, blocks, hot, len(fps), 3)) > 0
        roots = {r["u"]: r["v"] for r in simhash.components(simhash.links(distinct, 2, blocks, hot)).collect()}
        groups = defaultdict(set)
        for i, x in enumerate(signed):
            groups[find(i)].add(roots.get(x, x))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_covering_codes():
    for name in simhash.CODES:
        n, check, _, _, by_excess = simhash._code(name, 2)
        start, words = by_excess[0]
        assert len(words) == 1 << check and (start[1:] - start[:-1] == 1).all()  # perfect: one leader a syndrome


def test_token_counts(docs, empty, library):
    got = pairs(tokencounts.token_counts(docs, WORD, limit=100), "n_bytes", "n_tokens", "over_limit")
    for i, t in ROWS:
        n = len(library[WORD].encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 100), t
    assert tokencounts.token_counts(empty, WORD).count() == 0


def test_prefix_counts(docs, library):
    """Counts and what fits, at every prefix, against the library; special strings whole and cut short, too."""
    counter = tokencounts.PrefixCounter(WORD)
    marked = ["hello <|endoftext|> world", "a!!<|startoftext|>!!b <|endoftext|><|endoftext|>", "<|endoftext|>", "x<|endoftext|", "it's<|endoftext|>'s Ünï", "<|<|startoftext|>|>"]
    for t in [t[:160] for _, t in ROWS if t] + marked:
        p = counter.prefixes(t)
        counts = p.counts()
        assert counts == [len(library[WORD].encode(p.text[:i], add_special_tokens=False).ids) for i in range(len(p.text) + 1)], t
        assert counts[-1] == counter.count(t) and len(p.text) == counter.counted(t)[1]
        for budget in range(max(counts) + 2):
            assert p.fits(budget) == max(i for i, n in enumerate(counts) if n <= budget), (t, budget)
    row = tokencounts.prefix_counts(docs.filter("doc_id = 10"), WORD, (3,)).first()
    assert row["counts"][-1] == counter.count(TEXTS[10]) and len(row["fits"]) == 1
    for r in tokencounts.token_counts(docs, WORD, limit=100).collect():
        if r["doc_id"] is not None and r["doc_id"] in range(len(TEXTS)) and r["doc_id"] != 3:
            p = counter.prefixes(TEXTS[r["doc_id"]])
            n = r["fits"]
            assert p.count_at(n) <= 100 and (n == len(p.text) or p.count_at(n + 1) > 100)


def brute_statistics(t):
    t = t or ""
    w = WORDS.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeats = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeats), n < 50 or 100 * len(repeats) > 50 * n


def test_quality_statistics(docs, empty):
    extra = docs.unionByName(docs.limit(1).select(F.lit(777).cast("long").alias("doc_id"), F.lit("#a b c |\n a b c\n#a b c |\n\na b c d a b c % &").alias("text"), *docs.columns[2:]))
    got = pairs(quality.judged(extra, []), "__q_words", "__q_chars", "__q_symbols", "__q_dup_lines", "__q_repeats", "__q_base_failed")
    for i, t in [*ROWS, (777, "#a b c |\n a b c\n#a b c |\n\na b c d a b c % &")]:
        assert got[i] == brute_statistics(t), t
    assert quality.keep_good(empty, []).count() == 0
    assert quality.keep_good(docs, []).columns == docs.columns


def test_decision_list(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = {"symbols_per_char": r.random(900), "upper_per_char": r.random(900), "n_words": r.random(900)}
    bad = (x["symbols_per_char"] > 0.8) | (x["upper_per_char"] > 0.7) & (x["n_words"] < 0.5)
    rules = quality.learn(x, bad)
    found = np.zeros(900, bool)
    for rule in rules:
        found |= quality._covers(rule, x, 900)
    assert (found == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(900, bool)) == [] and quality.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []
    good, junk = prose(200, 20), " ".join(w + "%%%" for w in prose(200, 21).split())
    d = spark.createDataFrame([(i, junk + str(i) if i % 4 == 0 else good + str(i)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rules = quality.fit(d, labels)
    assert {r["doc_id"] for r in quality.keep_good(d, rules).collect()} == {i for i in range(80) if i % 4}
    plan = quality.judged(d, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_syncmers(spark, docs, empty):
    rows = syncmers.edited_fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    order = sorted((i for i, _ in ROWS if i is not None), reverse=True)
    text = dict(ROWS)
    by_text = {}
    for r in rows:
        t = text[r["doc_id"]] or ""
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        ids = [*order, None]
        at = max(k for k, i in enumerate(ids) if i == r["doc_id"])
        if r["doc_id"] != 3:  # a repeated row: either comes next
            after = text[ids[(at + 1) % len(ids)]] or ""
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), r["doc_id"]
    assert len(set(by_text.values())) >= len(by_text) - 4  # white space alone makes no word
    assert syncmers.edited_fingerprints(empty).count() == 0
    one = syncmers.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_next_document_over_many_blocks(spark):
    ids = random.Random(2).sample(range(-10**12, 10**12), 700)
    d = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(4)
    rows = syncmers.with_next(d, "doc_id", F.lit(0), ["text"], rows_a_block=3).collect()
    ids.sort(reverse=True)
    assert {r["doc_id"]: r["next_text"] for r in rows} == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1])}


def test_next_document_of_odd_ids(spark, monkeypatch):
    """An id far from the others, no ids at all, one id for all: no block gets large, and every row has its next."""
    r = random.Random(3)
    for ids in ([*range(600), 10**18, -(10**18)], [None] * 500, [7] * 500, [*([None] * 200), *range(200), *([9] * 200)]):
        data = [(i, f"t{k}") for k, i in enumerate(ids)]
        r.shuffle(data)
        d = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
        sizes = []
        rows = syncmers.with_next(d, "doc_id", F.xxhash64("text"), ["text"], rows_a_block=5)
        got = {x["text"]: x["next_text"] for x in rows.collect()}
        signed = spark.createDataFrame(data, "doc_id long, text string").select("text", F.xxhash64("text").alias("h"))
        h = {x["text"]: x["h"] for x in signed.collect()}
        order = [t for _, t in sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), h[x[1]]))]
        assert got == dict(zip(order, order[1:] + order[:1]))
        keyed = d.withColumn("k", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("id"), F.xxhash64("text").alias("tie")))
        cuts = syncmers._cuts(keyed.select("k"), len(ids) // 5)
        sizes = [x["count"] for x in keyed.groupBy(syncmers._block_of(cuts, F.col("k")).alias("b")).count().collect()]
        assert max(sizes) < 60 and len(sizes) > len(ids) // 15


def brute_sketch(t, size=64):
    """(sketch, anchors) word by word."""
    import struct

    import xxhash

    def chain(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed)
        return struct.unpack("<q", struct.pack("<Q", seed))[0]

    h = [chain([w]) for w in WORDS.findall(t)]
    s = [chain(h[i : i + 2]) for i in range(len(h) - 1)]
    found = []
    for i in range(len(s) - 3):
        if s.index(min(s[i : i + 4]), i) in (i, i + 3) or s[i + 3] == min(s[i : i + 4]):
            found.append((i, (chain([s[i], s[i + 2], h[i + 4]]) & (1 << 64) - 1) >> 33))
    whole = [(chain([t]) & (1 << 64) - 1) >> 33]
    return sorted({x for _, x in found})[:size] or whole, found


def test_syncmers_against_plain_python(docs):
    anchors = pairs(syncmers.anchors(docs), "anchors")
    order = sorted(ROWS, key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(docs).collect()}

    def likeness(a, b):
        least = sorted(set(a) | set(b))[:64]
        return len(set(a) & set(b) & set(least)) / len(least)

    for k, (i, t) in enumerate(order):
        sketch, found = brute_sketch(t or "")
        assert [(x["at"], x["hash"]) for x in anchors[i][0]] == found
        assert got[i]["fingerprint"] == "".join(f"{x:08x}" for x in sketch)
        after = order[(k + 1) % len(order)][1] or ""
        if i != 3:  # a repeated row: either comes next
            n = len(t or "")
            edited, _ = brute_sketch((t or "")[: n - n // 2] + after[: n // 2])
            assert got[i]["edited_fingerprint"] == "".join(f"{x:08x}" for x in edited)
            assert got[i]["near_edited"] == likeness(sketch, edited) and got[i]["near_next"] == likeness(sketch, brute_sketch(after)[0])


def test_syncmers_are_context_free(spark):
    middle = prose(60, 30)
    d = spark.createDataFrame([(1, prose(40, 31) + middle + prose(40, 32)), (2, prose(15, 33) + middle), (3, prose(100, 34))], "doc_id long, text string")
    s = {r["doc_id"]: set(r["s"]) for r in syncmers.with_sketch(d, "text", "s", 1000).collect()}
    assert len(s[1] & s[2]) > 20 and not s[1] & s[3]


def test_licenses(docs, empty):
    got = pairs(licenses.license_scan(docs), "n_words", "n_base", "base_labels", "score")
    low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in ROWS:
        assert got[i][0] == len(low.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))
    assert licenses.license_scan(empty).count() == 0
    a = licenses._automaton()
    assert licenses.scan("x CC-BY cc by\n(General  Public--License) All rights\nreserved.", a)[:5] == (11, 4, 1, 8, "cc-by,gpl,reserved")
    assert licenses.scan("xcc by accby", a)[1] == 0
    labels = licenses.scan("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nAll rights reserved", a)[5]
    assert labels == "apache-2.0,gpl-2.0-only with classpath-exception-2.0,mit,reserved"


def test_license_expressions():
    e = lambda s: licenses.evaluate(licenses.parse_expression(s))
    assert licenses.parse_expression("a OR b AND c WITH d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert e("(a or b) and c") == [frozenset("ac"), frozenset("bc")]
    assert e("((a))") == [frozenset("a")]
    for bad in ("", "a b", "or a", "a and", "(a", "a)", "()", "a (b)"):
        with pytest.raises(ValueError):
            licenses.parse_expression(bad)


def test_html(spark):
    trees = htmltext.fit(spark.createDataFrame([], "page_id long, url string, html string"))
    page = "<html><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class='sidebar'><p>Related stories</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>ly put&nbsp;words\n here that go on for a while<p>Second<br>line of the text, also long enough<!-- no --></article><script>var a='<p>x</p>'</script><footer>&copy; me</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<>><p"), (1, "u", page), (None, "u", page)], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(pages, trees).collect()]
    text = "Title & more First boldly put words here that go on for a while Second line of the text, also long enough"
    assert [g for g in got if g[0] in (1, None)] == [(1, text, len(text))] * 2 + [(None, text, len(text))]
    assert [g[1] for g in got if g[0] in (2, 3)] == ["", ""]
    assert htmltext.extract(pages.limit(0), trees).count() == 0
    r = random.Random(77)
    right = 0
    for _ in range(100):
        p = htmltext.Page(htmltext.template(r))
        right += p.text(htmltext.decode(p.parent, trees.log_odds(p.features()))) == p.text(htmltext.template_labels(p))
    assert right >= 85


def test_decoding_is_the_best_consistent_choice():
    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(60):
        n = 9
        parent = [0, *(int(r.integers(0, i)) for i in range(1, n))]
        z = r.normal(size=n)
        value = lambda o: sum(z[i] for i in range(1, n) if o[i])  # noqa: E731, B023
        best = max(value(o) for o in itertools.product([True], *[[False, True]] * (n - 1)) if all(not o[i] or o[parent[i]] for i in range(1, n)))
        open_ = htmltext.decode(parent, z)
        assert all(not open_[i] or open_[parent[i]] for i in range(1, n)) and abs(value(open_) - best) < 1e-9


def test_toxicity(spark, docs, empty):
    bad = ["vilest", "rotten", "cursed"]
    r = random.Random(6)

    def text(i, toxic):
        words = prose(120, 1000 + i).split(" ")
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "ly"]))
        return " ".join(words)

    rows = [(i, text(i, i % 5 == 0)) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    scored = {x["doc_id"]: x for x in toxicity.score_documents(d, model).collect()}
    assert all((scored[i]["score"] >= 0.7) == (i % 5 == 0) for i in range(400, 600))
    for i in range(400, 600, 5):
        assert any(b in rows[i][1].lower()[scored[i]["worst_start"] : scored[i]["worst_end"]] for b in bad)
    assert {x["doc_id"] for x in toxicity.drop_toxic(d, model).collect()} == {i for i in range(600) if i % 5}
    assert all(0 <= x["score"] <= 1 for x in toxicity.score_documents(docs, model).collect())
    assert toxicity.score_documents(empty, model).count() == 0 and toxicity.drop_toxic(docs, model).columns == docs.columns
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert 0 <= toxicity.fit(d, few).score("a text")[0] < 0.7
    held = spark.range(50).select(toxicity.learnable("id").alias("l"), "id").collect()
    assert all(x["l"] == (zlib.crc32(str(x["id"]).encode()) % 3 != 1) for x in held)


def brute_removal(rows, width):
    """n_words, n_removed, kept words of each row; documents come by id (null first), then by the hash of the text."""
    import numpy as np
    import xxhash

    at = lambda i, t: (-(2**63) if i is None else i, int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64)))
    words = [(at(i, t), (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            first[k] = min(first.get(k, (i, a)), (i, a))
    out = []
    for i, w in words:
        gone = {j for a in range(len(w) - width + 1) if first[tuple(w[a : a + width])] < (i, a) for j in range(a, a + width)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("width,hot", [(20, 100_000), (20, 1), (9, 1)])
def test_substrings(docs, empty, width, hot, monkeypatch):
    monkeypatch.setattr(substrings, "_CHUNK", 4000)
    got = pairs(substrings.removal_digests(docs, width, hot_windows=hot), "n_words", "n_removed", "kept_sha256")
    for (i, t), (n, removed, kept) in zip(ROWS, brute_removal(ROWS, width)):
        assert got[i] == (n, removed, hashlib.sha256(kept).hexdigest()), (i, t)
    assert sum(g[1] for g in got.values()) > 100
    cleaned = pairs(substrings.remove_repeats(docs, width, hot_windows=hot), "text")
    for (i, t), (_, removed, kept) in zip(ROWS, brute_removal(ROWS, width)):
        assert cleaned[i] == ((kept.decode() if removed else t),)
    assert substrings.removal_digests(empty, width).count() == 0 and substrings.remove_repeats(docs, width).columns == docs.columns


def test_rolling_hash_is_that_of_the_words():
    import numpy as np

    ids, texts = np.array([1, 2]), [b" a b c d e f", b"x a b c d e f y"]
    doc, start, own, least = substrings.windows(ids, texts, 4, 2)
    assert list(zip(doc.tolist(), start.tolist())) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]
    assert own[:3].tolist() == own[4:7].tolist() and least[:3].tolist() == least[4:7].tolist() and len(set(own.tolist())) == 5
