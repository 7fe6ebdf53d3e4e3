"""Tags, expressions and places of licence notices."""

import random
import re
import time

from test_operators import ROWS

from zipstrata.llm import licenses


def test_tags_on_consecutive_lines():
    tag = "SPDX-License-Identifier: "
    assert licenses.scan(f"{tag}MIT\n{tag}Apache-2.0\r\n{tag}ISC", licenses._automaton())[5] == "apache-2.0,isc,mit"
    assert licenses.tag_labels(f"{tag}MIT\nplain words in a line\n\n{tag}(GPL-2.0-only OR\xa0BSD-3-Clause)\n# end") == {"mit", "gpl-2.0-only", "bsd-3-clause"}
    assert licenses.tag_labels(f"{tag}MIT {tag}Zlib") == {"mit", "zlib"}
    assert licenses.tag_labels(f"{tag}\n{tag}MIT") == {"mit"}


def test_all_identifiers_of_many_choices():
    tag = "SPDX-License-Identifier: "
    assert licenses.tag_labels(tag + "(" + " OR ".join(f"a{i}" for i in range(65)) + ") AND b") == {"b", *(f"a{i}" for i in range(65))}
    assert licenses.tag_labels(tag + " AND ".join(f"(x{i} OR y{i})" for i in range(40))) == {f"{c}{i}" for c in "xy" for i in range(40)}
    assert licenses.identifiers(licenses.parse_expression("(a OR b) AND c WITH d")) == {"a", "b", "c with d"}


def test_prose_behind_an_expression():
    tag = "SPDX-License-Identifier: "
    for text, want in [
        ("MIT and other words", {"mit"}), ("MIT and Other words", {"mit"}), ("MIT AND other", {"mit", "other"}), ("mit or gpl-2.0", {"mit", "gpl-2.0"}), ("(MIT OR Apache-2.0", {"mit", "apache-2.0"}),
        ("MIT OR", {"mit"}), ("MIT. And more", {"mit"}), ("see the LICENSE file", set()), ("MIT */ GPL-2.0", {"mit"}), ("", set()), ("()", set()), (") MIT", set()), ("GPL-2.0-only WITH Classpath-exception-2.0.", {"gpl-2.0-only with classpath-exception-2.0"}),
        ("(MIT OR ISC) WITH x-1", {"mit", "isc"}), ("MIT WITH (a1 OR b1)", {"mit"}), ("((MIT) AND (ISC", {"mit", "isc"}), ("LicenseRef-Own", {"licenseref-own"}), ("MIT MIT", {"mit"}),
    ]:
        assert licenses.tag_labels(tag + text) == want, text


def test_long_lines_take_linear_time():
    tag = "SPDX-License-Identifier: "
    texts = [tag + "MIT " + "and other words " * 35_000, tag * 20_000, (tag + "MIT ") * 20_000, tag + "(" * 100_000, tag + " OR ".join(f"a{i}" for i in range(50_000)), tag + "(a1 OR " * 30_000, tag + "a1 WITH b1 AND " * 30_000]
    for t in texts:
        began = time.process_time()
        licenses.tag_labels(t)
        assert time.process_time() - began < 1, t[:60]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_places(text):
    """(n_words, n_base, first_word, last_word, base labels) by trying every word."""
    words = words_of(text)
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_places_against_brute_force(spark):
    """Fixture rows and random ones of the phrases' own words."""
    r = random.Random(5)
    parts = ["cc", "by", "CC BY", "CC-BY", "general", "public", "license", "General Public License", "all rights", "reserved", "All rights\nreserved", "é", "日本", "x", "sa", "mit license", "1", ".", "-"]
    rows = [(i, t) for i, t in ROWS] + [(10_000 + k, r.choice(["", " "]).join("".join([r.choice(parts), r.choice([" ", " ", "-", ".", "\n", ""])]) for _ in range(r.randint(0, 60)))) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in licenses.license_scan(docs).collect()}
    seen = 0
    for k, (_, t) in enumerate(rows):
        x = got[k]
        want = brute_places(t)
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == want, t
        line = f" {' '.join(words_of(t))} "
        notices = {label for phrase, (label, _) in licenses.NOTICES.items() if f" {phrase} " in line}
        assert set(filter(None, x["labels"].split(","))) == set(filter(None, want[4].split(","))) | notices
        seen += want[1]
    assert seen > 200
