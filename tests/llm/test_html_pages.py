"""Broken pages in linear time; extraction of pages that weren't learned from."""

import html
import os
import re
import time

import pytest

from zipstrata.llm import htmltext

SF = "/root/testdata/sf0.1"


def test_broken_pages_take_linear_time():
    n = 60_000
    pages = ["<a " * n, "<a '" * n, '<a "' * n + ">", "<a \"x\" " * n + "'>'", "<" * n, "<!" * n, "<!--" * n, "</" * n, "<p" * n + ">", "<script>" * n, "<b>" * n, "<div>" * n + "</p>" * n, "<div>" * n + "<li>x" * n, "<p>x" * n, "&" * n, "<a href='>' x=\">\">t</a>" * (n // 10)]
    for p in pages:
        began = time.process_time()
        page = htmltext.Page(p)
        page.features()
        assert time.process_time() - began < 8, p[:30]


def test_tags_end_outside_quotes():
    t = list(htmltext.tokens("a<b x='>' y=\">\">c</b ><!-- <i> --><br/><3 <i 'open>x</i><script>1<b>2</script>z<q"))
    assert [x[2] for x in t] == ["b", "/b", "", "br", "i", "/i", ""]


@pytest.fixture(scope="module")
def held(spark):
    """Trees, and 300 pages that they haven't seen, with the text of their article."""
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    trees = htmltext.fit(pages)
    from zipstrata.llm.common import bounded_sample

    seen = {r[0] for r in bounded_sample(pages.select("page_id").distinct(), "page_id", 300).collect()}
    return trees, [r["html"] for r in pages.orderBy("page_id").collect() if r["page_id"] not in seen][:300]


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", re.sub(r"<!--.*?-->", "", inner, flags=re.S)))
    return " ".join(html.unescape(inner).split())


def test_held_out_pages(held):
    trees, pages = held
    right = sum(htmltext.main_text(p, trees) == article(p) for p in pages)
    assert len(pages) == 300 and right >= 297


def test_held_out_pages_without_article_tags(held):
    """The same with the telling element made a plain one."""
    trees, pages = held
    right = sum(htmltext.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>"), trees) == article(p) for p in pages)
    assert right >= 0.85 * len(pages)
