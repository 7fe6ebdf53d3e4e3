"""The pipeline and the registered queries at the smallest scale, against plain Python."""

import hashlib
import os
import zlib
from collections import defaultdict

import pytest
from test_operators import BYTE, ROWS, brute_removal, brute_statistics
from test_similar import brute_kept

import corpus_pipeline
from zipstrata.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_stages_against_plain_python(spark, tmp_path, documents):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "toxicity":
            model = toxicity.fit(docs, labels, learn=toxicity.learnable())
            rows = [(i, t) for i, t in rows if model.score(t)[0] < 0.7]
        elif name == "quality":
            rules = quality.fit(docs, labels)
            passed = [(i, t) for i, t in rows if not brute_statistics(t)[5]]
            verdicts = {r["doc_id"]: r["__q_kept"] for r in quality.judged(docs, rules).collect()}
            rows = [(i, t) for i, t in passed if verdicts[i]]
        elif name == "near_dedup":
            rows = brute_kept(rows)  # five-word shingles, a similarity of 0.8 or more
        elif name == "substring_dedup":
            rows = [(i, kept.decode() if removed else t) for (i, t), (_, removed, kept) in zip(rows, brute_removal(rows, 20))]
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
            assert got == {i: (t, len(t)) for i, t in rows}, name
    library, want = Tokenizer.from_file(BYTE), {}
    for i, t in rows:
        want[i] = library.encode(t, add_special_tokens=False).ids + [0]
    pieces = defaultdict(list)
    for r in docs.collect():
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == want.keys()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in want[i][at : at + r["length"]]))
            at += r["length"]
        assert at == len(want[i])


def test_run_is_the_stages(spark, tmp_path):
    """run() gives what the stages give one after the other, each written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    got, want = (sorted(tuple(r) for r in d.select(*columns).collect()) for d in (corpus_pipeline.run(spark, SF), docs))
    assert got == want and len({r[0] for r in got}) > 50


def awkward(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    data = [*ROWS, (None, a), (None, b), (70, a + " and more of it"), (70, b), (70, b), (71, "x " + a), (72, None), (72, ""), (73, b + " c " + a)]
    rows = [(i, t, "xx", "src", None if t is None else len(t), "own", 1) for i, t in data]
    return data, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, tie int").repartition(3).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    """Null, repeated and shared ids, null and empty texts, extra columns with names used inside, an empty table."""
    data, docs = awkward(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0
    if name == "packing":
        assert out.select("doc_id").distinct().count() == len({i for i, _ in data})
        return
    assert out.columns == docs.columns == empty.columns and {r["spans"] for r in out.collect()} <= {"own"}
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    if name == "near_dedup":
        assert got == sorted(brute_kept(data), key=repr)
    elif name == "substring_dedup":
        assert got == sorted(((i, kept.decode() if removed else t) for (i, t), (_, removed, kept) in zip(data, brute_removal(data, 20))), key=repr)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    elif name == "quality":
        assert all(not brute_statistics(t)[5] for _, t in got) and set(got) <= set(data)
    else:
        assert len(got) == len(data)  # nothing toxic here


def test_queries_keep_their_contracts(spark, documents):
    columns = {
        1: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 2: "doc_id fingerprint component_id", 3: "doc_id n_bytes n_tokens over_limit",
        4: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 5: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        6: "doc_id n_words n_base first_word last_word base_labels labels score", 7: "doc_id n_tokens ids_sha256 decoded_sha256", 8: "page_id url text n_chars", 9: "doc_id held_out score predicted",
        10: "doc_id n_words n_removed kept_sha256",
    }
    found = {int(n.split("_")[0][2:]): f for n, f in queries.QUERIES.items()}
    assert found.keys() == columns.keys()
    for n, f in found.items():
        df = f(spark, SF)
        assert set(columns[n].split()) <= set(df.columns), n
        if n not in (1, 8):
            assert df.count() == len(documents), n
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found[10](spark, SF).collect()}
    assert removed == {i: (n, g, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, k) in zip(documents, brute_removal(documents, 20))}


def test_main_text_of_all_pages(spark):
    """Pages of the table mark their article; the trees must find just that."""
    import html
    import re

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.QUERIES["op8_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", re.sub(r"<!--.*?-->", "", inner, flags=re.S)))
        text = " ".join(html.unescape(inner).split())
        assert got[r["page_id"]] == (text, len(text))
