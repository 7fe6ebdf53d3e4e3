"""Licence scans: one Aho-Corasick automaton for notice phrases and identifier tags, a shunting-yard parser for expressions.

A text becomes its words (A-Z lower-cased; runs of ASCII letters, digits and
non-ASCII bytes), joined by single spaces, so that phrases match as words stand, whatever
is between them.  The automaton reads every text once, from end to end.  Where
it meets the words of an identifier tag, the licence expression behind each tag is
read from the original text, parsed with the precedence WITH over AND over OR
and evaluated: identifiers under AND all apply, those under OR are a choice, and labels are all of them.
The parser goes forward once and stops where an expression can't go on, at the line's end or at the next tag.

Edge cases: null and empty texts have no words, no places, empty labels, null
first and last word, score 0; of an expression with something behind it (prose, or an operator that
lacks its right side) the longest beginning that parses counts; where none does (a bracket is left open) the
identifiers read so far count, under no structure; a word counts as an identifier by its form (see is_named);
repeated rows are rows of their own; texts of any length are read
whole; other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases: label and how sure the phrase is (0 to 1).
NOTICES = {
    "apache license": ("apache", 0.9),
    "apache license version 2 0": ("apache-2.0", 0.99),
    "boost software license": ("bsl-1.0", 0.95),
    "cc by nc": ("cc-by-nc", 0.95),
    "cc by nd": ("cc-by-nd", 0.95),
    "cc by sa": ("cc-by-sa", 0.95),
    "cc0": ("cc0", 0.9),
    "creative commons": ("cc", 0.8),
    "creative commons attribution": ("cc-by", 0.95),
    "creative commons zero": ("cc0", 0.95),
    "dedicated to the public domain": ("public-domain", 0.9),
    "eclipse public license": ("epl", 0.95),
    "gnu affero general public license": ("agpl", 0.99),
    "gnu free documentation license": ("gfdl", 0.95),
    "gnu general public license version 2": ("gpl-2.0", 0.99),
    "gnu general public license version 3": ("gpl-3.0", 0.99),
    "gnu lesser general public license": ("lgpl", 0.99),
    "gnu library general public license": ("lgpl", 0.99),
    "isc license": ("isc", 0.9),
    "mit license": ("mit", 0.95),
    "mozilla public license": ("mpl", 0.95),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.99),
}
BASE_SURE = {"cc-by": 0.9, "gpl": 0.95, "reserved": 0.7}
TAG = "spdx license identifier"
TAG_SURE = 0.99

_TAG = re.compile(r"spdx-license-identifier[^\S\r\n]*:", re.I)
_LINE_END = re.compile(r"[\r\n]")
_PART = re.compile(r"[^\S\r\n]*([()]|[A-Za-z0-9.+:-]+)")
_TIGHTNESS = {"or": 1, "and": 2, "with": 3}
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Identifiers of one word without digits that are often written in small letters.
PLAIN = frozenset("apache artistic beerware blessing curl diffmark dvipdfm gnuplot isc libpng libtiff magaz mit mplus ncsa none openssl postgresql psfrag psutils python ruby snprintf unlicense vim xinetd xlock xpp zlib".split())


def is_named(part: str, in_prose: bool) -> bool:
    """Whether a part has the form of an identifier: one of PLAIN, or with a digit, or with capitals.

    in_prose (behind an operator in small letters, which a sentence may have too): capitals only will do.
    """
    if part.lower() in PLAIN or any(c.isdigit() for c in part):
        return True
    return len(part) > 1 and part.isupper() if in_prose else part != part.lower()


class Parser:
    """Shunting-yard parser of a licence expression, fed part by part; it knows the last place where what it has read is complete."""

    def __init__(self):
        self.out: list[str] = []  # postfix
        self.waiting: list[str] = []  # operators and open brackets
        self.before = ""  # kind of the last part: "", "id", "exception", ")", "(", or the operator
        self.open = 0
        self.complete: tuple[int, tuple[str, ...]] | None = None

    def feed(self, part: str) -> bool:
        """Take the next part; False, and nothing has changed, if it can't come next."""
        low = part.lower()
        operand = self.before in ("id", "exception", ")")
        if low in _TIGHTNESS:
            if not operand or low == "with" and self.before != "id":
                return False
            while self.waiting and self.waiting[-1] != "(" and _TIGHTNESS[self.waiting[-1]] >= _TIGHTNESS[low]:
                self.out.append(self.waiting.pop())
            self.waiting.append(low)
            self.before = low
        elif part == "(":
            if operand or self.before == "with":
                return False
            self.waiting.append(part)
            self.before = part
            self.open += 1
        elif part == ")":
            if not operand or not self.open:
                return False
            while self.waiting[-1] != "(":
                self.out.append(self.waiting.pop())
            self.waiting.pop()
            self.before = part
            self.open -= 1
        elif operand:
            return False
        else:
            self.out.append(low)
            self.before = "exception" if self.before == "with" else "id"
        if not self.open and self.before in ("id", "exception", ")"):
            self.complete = len(self.out), tuple(self.waiting)  # three operators at most wait outside brackets
        return True

    def postfix(self) -> list[str]:
        """Of the longest complete beginning; empty if there is none."""
        if self.complete is None:
            return []
        n, waiting = self.complete
        return self.out[:n] + list(waiting[::-1])


def parse_expression(text: str) -> list[str]:
    """Postfix form of a whole licence expression; ValueError if it isn't one."""
    parser = Parser()
    for m in _PART.finditer(text):
        if not parser.feed(m[1]):
            raise ValueError(f"{m[1]} can't come here")
    if parser.open or parser.before not in ("id", "exception", ")"):
        raise ValueError("the expression breaks off")
    return parser.postfix()


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """The choices an expression offers: each the identifiers that apply together ("gpl-2.0 with classpath-exception" is one).

    There may be exponentially many; labels don't need them (see identifiers).
    """
    stack: list[list[frozenset[str]]] = []
    for part in postfix:
        if part not in _TIGHTNESS:
            stack.append([frozenset([part])])
            continue
        right, left = stack.pop(), stack.pop()
        if part == "or":
            stack.append(list(dict.fromkeys(left + right)))
        elif part == "with":
            stack.append([frozenset(f"{a} with {b}" for a in x for b in y) for x in left for y in right])
        else:
            stack.append(list(dict.fromkeys(x | y for x in left for y in right)))
    return stack[0]


def identifiers(postfix: list[str]) -> set[str]:
    """All identifiers (and WITH pairs) of an expression's choices, without making the choices."""
    stack: list[set[str]] = []
    for part in postfix:
        if part not in _TIGHTNESS:
            stack.append({part})
            continue
        right, left = stack.pop(), stack.pop()
        if part == "with":
            stack.append({f"{a} with {b}" for a in left for b in right})  # one of each
        else:
            large, small = (left, right) if len(left) >= len(right) else (right, left)
            large |= small
            stack.append(large)
    return stack[0] if stack else set()


def read_expression(text: str, at: int, end: int) -> set[str]:
    """Identifiers of the expression that begins at a place."""
    parser, operator = Parser(), ""
    while m := _PART.match(text, at, end):
        part = m[1].rstrip(".:-") or "."
        if part.lower() in _TIGHTNESS:
            operator = part
        elif part not in "()" and not (operator.isupper() or is_named(part, in_prose=bool(operator))):
            break
        if not parser.feed(part):
            break
        at = m.end()
        if part != m[1]:  # a full stop or colon ends it
            break
    if parser.complete:
        return identifiers(parser.postfix())
    return {x for x in parser.out if x not in _TIGHTNESS}


def tag_labels(text: str) -> set[str]:
    """Identifiers of all tagged expressions of a text."""
    found: set[str] = set()
    tags = list(_TAG.finditer(text))
    for m, after in zip(tags, [*tags[1:], None]):
        end = after.start() if after else len(text)
        line = _LINE_END.search(text, m.end(), end)
        found |= read_expression(text, m.end(), line.start() if line else end)
    return {x.replace(",", " ") for x in found}


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None, automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score) of one text."""
    words = (text or "").encode().translate(_TO_WORDS).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    n_base, first, last, base, sure, tagged = 0, None, None, set(), {}, False
    for end, phrase in automaton.iter(joined):
        if phrase in BASE:
            at = end - len(phrase) - 1  # of the space before it
            n_base += 1
            first = at if first is None else min(first, at)
            last = at if last is None else max(last, at)
            base.add(BASE[phrase])
            sure[BASE[phrase]] = max(sure.get(BASE[phrase], 0), BASE_SURE[BASE[phrase]])
        if phrase in NOTICES:
            label, p = NOTICES[phrase]
            sure[label] = max(sure.get(label, 0), p)
        tagged |= phrase == TAG
    if tagged:
        sure |= dict.fromkeys(tag_labels(text), TAG_SURE)
    if first is not None:
        first, last = joined.count(" ", 0, first), joined.count(" ", 0, last)
    score = 1 - float(np.prod([1 - p for p in sure.values()])) if sure else 0.0
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(sure)), score


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            found = [scan(t.as_py(), automaton) for t in b.column(1)]
            columns = list(zip(*found)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns, kinds)], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices and tags of all documents."""
    return license_scan(table(spark, sf_dir, "documents"))
