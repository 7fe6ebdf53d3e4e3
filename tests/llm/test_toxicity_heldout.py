"""Toxicity on the tables: documents that weren't learned from, long clean texts, spans."""

import os
import random
import zlib

import numpy as np
import pytest

from zipstrata.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def learned(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, learn=toxicity.learnable())
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    held = [(r["text"], marked[r["doc_id"]]) for r in docs.select("doc_id", "text").collect() if marked.get(r["doc_id"]) is not None]
    return model, held


def test_held_out_recall_and_false_alarms(learned):
    model, held = learned
    predicted = [(model.score(t)[0] >= 0.7, y) for t, y in held]
    toxic = [p for p, y in predicted if y]
    clean = [p for p, y in predicted if not y]
    assert len(toxic) > 100 and np.mean(toxic) >= 0.9
    assert len(clean) > 1000 and np.mean(clean) <= 0.005


def test_clean_sentences_do_not_add_up(learned):
    """Clean documents that weren't learned from, laid together to 2000 sentences."""
    model, held = learned
    clean = [t or "" for t, y in held if not y and model.score(t)[0] < 0.7]
    r = random.Random(3)
    for _ in range(10):
        r.shuffle(clean)
        n, parts = 0, []
        while n < 2000:
            parts.append(clean[len(parts)])
            n += sum(1 for _ in toxicity.sentence_words(parts[-1]))
        assert model.score("\n".join(parts))[0] < 0.7


def test_one_bad_sentence_is_enough_at_any_length():
    r = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("ase", "ilo", "unt", "epp", "ora")]
    sentence = lambda bad="": " ".join(r.choice(words) for _ in range(8)) + f" {bad}."
    texts = [" ".join(sentence() for _ in range(r.randint(1, 12))) for _ in range(400)] + [" ".join([*(sentence() for _ in range(r.randint(1, 12))), sentence("vilest")]) for _ in range(60)]
    model = toxicity.train(texts, [0] * 400 + [1] * 60)
    long = [sentence() for _ in range(3000)]
    assert model.score(" ".join(long))[0] < 0.1
    long[1700] = long[1700].replace(".", " vilest.")
    score, start, end, _ = model.score(" ".join(long))
    assert score >= 0.7 and "vilest" in " ".join(long)[start:end]


def test_spans_are_in_the_text_as_it_stands():
    model = toxicity.Model({"vile": 5.0}, -3.0, toxicity.Clean())
    text = "İİİİ İstanbul first. Something VILE here! Then more."
    _, start, end, _ = model.score(text)
    assert text[start:end].strip() == "Something VILE here"


def test_training_and_scoring_share_their_features():
    """Two words that share a beginning give it once to a sentence, in scoring as in training."""
    model = toxicity.Model({"vil*": 2.0}, -3.0, toxicity.Clean())
    assert model.score("vilest viler")[0] == model.score("vilest")[0] > model.score("mild")[0]
