"""Cuts at forced byte pairs, against the vocabulary and the library."""

import random

import numpy as np
import pytest
from test_operators import BYTE, ROWS

from zipstrata.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.ForcedBoundaryBPE(BYTE, max_entries=200)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def test_forced_pairs_are_in_no_token(own):
    inside = {(t[i], t[i + 1]) for t in own.token_bytes for i in range(len(t) - 1)}
    assert all(own.forced[a, b] == ((a, b) not in inside) for a in range(256) for b in range(256))


def test_pre_tokens_are_cut_within(own, library):
    """Pieces make up the pre-token, every cut is a forced pair, and ids of pieces are those of the whole."""
    cuts = 0
    texts = [" 20261128", "日本語の文章です", "नमस्ते", "привет", "...!?%%%&&&", " 1a2b", "ﬁx", "🙂🙂", "\t\t\t", "ÄÖÜß"]
    for text in texts:
        ids = []
        for t in own.pre_tokens(text):
            pieces = own.cut_forced(t)
            assert b"".join(pieces) == t
            assert all(own.forced[a[-1], b[0]] for a, b in zip(pieces, pieces[1:]))
            cuts += len(pieces) - 1
            ids += [i for p in pieces for i in np.frombuffer(own._merged(p), "<u4").tolist()]
        assert ids == library.encode(text, add_special_tokens=False).ids
    assert cuts > 15


def test_random_texts(own, library):
    """Letters, digits, punctuation, white space and scripts in any order; the small dictionaries are emptied many times."""
    r = random.Random(8)
    kinds = ["abcdefgh", "éßñøŒž", "0123456789", ".,;:!?'\"()[]{}%&$#", " ", "  ", "\n", "\t", "\xa0", "　", "日本語文章", "приветмир", "नमस्तेदुनिया", "🙂👍", "ﬁﬂ", "́", "'s", "'ll", "<|endoftext|>", "\x00", "\x85", "²½", "Ⅷ", "שלום", "한국어"]
    texts = []
    for _ in range(3000):
        parts = []
        for _ in range(r.randint(0, 14)):
            k = r.choice(kinds)
            parts.append(k if len(k) <= 3 or k[0] == "<" else "".join(r.choice(k) for _ in range(r.randint(1, 9))))
        texts.append("".join(parts))
    texts += [t or "" for _, t in ROWS]
    for t, got in zip(texts, own.encode_many(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
