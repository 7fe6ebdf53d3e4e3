"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A tolerant parser makes each page a list of element nodes (text that stands
beside elements in a container is a node of its own).  Gradient-boosted
regression trees on the logistic loss give every node the log odds of being open, that
is of belonging to the main text or leading to it, from features of the node, its subtree,
its ancestors and its siblings.  Decoding picks the set of open nodes with the
largest sum of log odds under the rule that a child of a shut node is shut: one
pass up sums each subtree's gain, one pass down opens what gains.  So a paragraph
can't be kept inside a dropped menu, nor a container dropped around kept text.

The trees are trained on the driver from a bounded sample: `max_pages` pages
of the table (`max_bytes` in all) that mark their article by its element, and `templates` generated
pages, whose labels are known as they are made and which have the furniture that
the table lacks (sidebars, notices, adverts and forms within articles, reader comments).

Edge cases: null, empty and text-free pages have the empty text; unclosed and
stray tags, comments and scripts without an end are taken as browsers do, roughly; pages of any
length are read whole, in time in proportion to it, however broken; repeated rows are rows of their own; an empty table
trains on templates alone and gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, table, training_texts

_TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile("[>\"']")
#: Elements whose content is no markup, with what ends them.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea svg iframe".split()}
DEPTH = 512  # elements that are open at once, as in browsers; deeper ones become siblings
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|data-main)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul button".split())
CONTAINER = frozenset("article aside body center div fieldset footer form header html main nav section td".split())
#: Tag -> tags of which an open one is ended by it, as long as none of the third column lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role that tell of furniture, and of the main text.
FURNITURE = frozenset("ad ads advert advertisement adsbygoogle banner bar breadcrumb breadcrumbs button comment comments consent contact contentinfo cookie cookies copyright disclaimer disqus footer form header legal links login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related replies respond rail search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar topbar widget".split())
MAIN = frozenset("article articlebody body content entry main page post story text".split())
_HEAD = ("nav header footer aside form".split(), "button input select label option legend".split(), "h1 h2 h3 h4 h5 h6".split(), ["p"], "ul ol dl menu".split(), "li dt dd".split(), ["a"], "article main".split(), "div section".split(), "td th tr table tbody".split(), "head title".split(), ["#text"])
_GROUP = {t: i for i, group in enumerate(_HEAD) for t in group}
FEATURES = 24


def tokens(html: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, tag, attributes) of every tag; an end tag begins with "/", comments, declarations and raw elements have the tag "".

    The position never goes back: a tag ends at the first ">" outside quotes.  Where
    quotes leave it without an end, they aren't heeded from there on, and behind the last ">" there are no tags.
    """
    last, at, quotes = html.rfind(">"), 0, True
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        if html.startswith("<!--", start):
            at = html.find("-->", start + 4)
            at = len(html) if at < 0 else at + 3
            yield start, at, "", ""
            continue
        if start > last:  # only a comment can come yet
            at = html.find("<!--", start)
            if at < 0:
                return
            continue
        if html[start + 1 : start + 2] in ("!", "?"):
            at = html.find(">", start) + 1
            yield start, at, "", ""
            continue
        name = _TAG_NAME.match(html, start + 1)
        if name is None:
            at = start + 1
            continue
        tag, inside = name[0].lower(), name.end()
        if tag[0] == "/" or tag in _RAW or not quotes:
            end = html.find(">", inside)
        else:
            end = inside
            while m := _TAG_STOP.search(html, end):
                if m[0] == ">":
                    end = m.start()
                    break
                end = html.find(m[0], m.end()) + 1
                if not end:
                    m = None
                    break
            if m is None:
                quotes, end = False, html.find(">", inside)
        at = end + 1
        if tag in _RAW:
            close = _RAW[tag].search(html, at)
            at = close.end() if close else len(html)
            yield start, at, "", ""
        else:
            yield start, at, tag, html[inside:end]


class Page:
    """Nodes of a page in document order: tag, parent, attribute words; and the text as (node, string, starts a block)."""

    def __init__(self, html: str | None):
        self.tag, self.parent, self.words, self.marked = ["#page"], [0], [frozenset()], [False]
        self.texts: list[tuple[int, str, bool]] = []
        html, at, fresh = html or "", 0, True
        stack = [0]
        for start, end, tag, attributes in tokens(html):
            if start > at:
                fresh = self._text(html[at:start], stack[-1], fresh)
            at = end
            if not tag:
                continue
            if tag[0] != "/":
                if tag in BLOCK or tag == "br":
                    fresh = True
                if tag in VOID:
                    continue
                self._make_room(tag, stack)
                words, marked = self._words(attributes)
                node = self._node(tag, stack[-1], words, marked)
                if len(stack) < DEPTH:
                    stack.append(node)
            else:
                tag = tag[1:]
                if tag in BLOCK:
                    fresh = True
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if tag not in BLOCK and self.tag[stack[k]] in CONTAINER:
                        break  # an inline end doesn't close a container
        if at < len(html):
            self._text(html[at:], stack[-1], fresh)

    def _node(self, tag: str, parent: int, words: frozenset = frozenset(), marked: bool = False) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.marked.append(marked)
        return len(self.tag) - 1

    def _text(self, raw: str, node: int, fresh: bool) -> bool:
        text = entities.unescape(raw) if "&" in raw else raw
        if not text.strip():
            if self.texts and text and not fresh:
                self.texts.append((self.texts[-1][0], " ", False))
            return fresh
        if self.tag[node] in CONTAINER:
            node = self._node("#text", node)
        self.texts.append((node, text, fresh))
        return False

    @staticmethod
    def _words(attributes: str) -> tuple[frozenset, bool]:
        if not attributes or attributes.isspace():
            return frozenset(), False
        found, marked = set(), False
        for m in _ATTRIBUTE.finditer(attributes):
            marked |= m[1] == "data-main"
            found.update(_NAME.findall((m[2] or "").lower()))
        return frozenset(found), marked

    def _make_room(self, tag: str, stack: list[int]) -> None:
        """End elements that can't hold tag."""
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t == "p":
                    del stack[k:]
                    break
                if t in BLOCK:
                    break
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t in ended:
                    del stack[k:]
                    break
                if t in bounds:
                    break

    def features(self) -> np.ndarray:
        """A row of FEATURES numbers for each node."""
        n = len(self.tag)
        own, linked = [0] * n, [0] * n
        for node, text, _ in self.texts:
            own[node] += len(text)
        parent, tag = self.parent, self.tag
        chars, links, nodes, paragraphs, items = own[:], [0] * n, [1] * n, [0] * n, [0] * n
        children, alike = [0] * n, {}
        for i in range(n - 1, 0, -1):
            p, t = parent[i], tag[i]
            if t == "a":
                links[i] = chars[i]
            elif t == "p":
                paragraphs[i] += 1
            elif t == "li":
                items[i] += 1
            chars[p] += chars[i]
            links[p] += links[i]
            nodes[p] += nodes[i]
            paragraphs[p] += paragraphs[i]
            items[p] += items[i]
            children[p] += 1
            alike[p, t] = alike.get((p, t), 0) + 1
        depth, bad, good, in_bad_tag, in_good_tag = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        rows = []
        whole = max(chars[0], 1)
        for i in range(n):
            p, t, w = parent[i], tag[i], self.words[i]
            b, g = (len(w & FURNITURE), len(w & MAIN)) if w else (0, 0)
            group = _GROUP.get(t, 12)
            if i:
                depth[i] = depth[p] + 1
                bad[i], good[i] = bad[p] + b, good[p] + g
                in_bad_tag[i] = in_bad_tag[p] or group in (0, 1, 10)
                in_good_tag[i] = in_good_tag[p] or group == 7
            c = chars[i]
            rows.append((group, b, g, bad[i], good[i], in_bad_tag[i], in_good_tag[i], depth[i], c, own[i], c / nodes[i], links[i] / (c or 1), nodes[i], paragraphs[i], items[i], children[i], children[p], alike.get((p, t), 1), c / (chars[p] or 1), chars[p], links[p] / (chars[p] or 1), paragraphs[p], c / whole, i / n))
        return np.array(rows, np.float32)

    def text(self, open_: np.ndarray) -> str:
        """Text of open nodes; blocks are joined by one space, white space within is one space."""
        out = []
        for node, text, fresh in self.texts:
            if open_[node]:
                out.append(" " + text if fresh else text)
            else:
                out.append(" ")
        return " ".join("".join(out).split())


class Trees:
    """Gradient-boosted regression trees of fixed depth on the logistic loss."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 48, least: float = 2.0, ridge: float = 1.0) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # bin <= k: x <= edges[k]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(p / (1 - p)))
        z = np.full(len(y), base)
        inner = (1 << depth) - 1
        features, thresholds, leaves = [], [], []
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = q - y, q * (1 - q)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at = np.zeros(len(y), np.int64)  # place in the level
            for level in range(depth):
                width = 1 << level
                gain = np.zeros(width)
                total_g, total_h = np.bincount(at, g, width), np.bincount(at, h, width)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    m = len(e) + 1
                    cell = at * m + binned[:, j]
                    left_g = np.cumsum(np.bincount(cell, g, width * m).reshape(width, m), axis=1)[:, :-1]
                    left_h = np.cumsum(np.bincount(cell, h, width * m).reshape(width, m), axis=1)[:, :-1]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    s = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                    s[(left_h < least) | (right_h < least)] = 0
                    k = s.argmax(axis=1)
                    better = np.flatnonzero(s[np.arange(width), k] > gain + 1e-9)
                    gain[better] = s[better, k[better]]
                    feature[width - 1 + better] = j
                    threshold[width - 1 + better] = e[k[better]]
                node = width - 1 + at
                at = 2 * at + (x[np.arange(len(y)), feature[node]] > threshold[node])
            leaf = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge)
            z += leaf[at]
            features.append(feature)
            thresholds.append(threshold)
            leaves.append(leaf)
        return cls(base, np.stack(features), np.stack(thresholds).astype(np.float32), np.stack(leaves))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for level in range(depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (x[rows, feature[node]] > threshold[node])
            z += leaf[at]
        return z


def decode(parent: list[int], z: np.ndarray) -> np.ndarray:
    """Open nodes with the largest sum of log odds in which no open node has a shut parent."""
    gain = np.clip(z, -8, 8).tolist()
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    open_ = np.zeros(len(gain), bool)
    open_[0] = True
    for i in range(1, len(gain)):
        open_[i] = gain[i] > 0 and open_[parent[i]]
    return open_


def template(rng: random.Random) -> str:
    """A made-up page whose main text is below elements with the attribute data-main."""

    def say(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioustnrlm") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))).capitalize() + rng.choice(".,!;")

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def box(kind: str, inner: str) -> str:
        tag, names = {
            "nav": ("nav div ul", "nav menu navbar main-menu topbar breadcrumb"),
            "header": ("header div", "header masthead site-header page-header"),
            "footer": ("footer div", "footer site-footer copyright legal contentinfo"),
            "side": ("aside div", "sidebar widget side-bar related links recommended right-rail"),
            "ad": ("div ins aside section", "ad ads advert advertisement banner sponsored promo ad-slot"),
            "notice": ("div section", "notice cookie cookie-banner consent disclaimer popup newsletter"),
            "form": ("form div", "form signup newsletter search contact-form login subscribe"),
            "comments": ("section div ol", "comments comment-list replies disqus responses comment"),
            "share": ("div ul", "share social sharing tags meta"),
        }[kind]
        tag, name = rng.choice(tag.split()), rng.choice(names.split())
        plain = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        return f"<{tag}>{inner}</{tag}>" if plain else f'<{tag} {rng.choice(["class", "id"])}="{name} x{rng.randint(1, 9)}">{inner}</{tag}>'

    def furniture(kind: str) -> str:
        if kind in ("nav", "side", "share"):
            return box(kind, rng.choice(["", f"<h3>{say(1, 3)}</h3>"]) + links(rng.randint(2, 9)))
        if kind == "header":
            return box(kind, f"<h2>{say(1, 4)}</h2>" + rng.choice(["", f"<p>{say(3, 8)}</p>", furniture("nav")]))
        if kind == "form":
            return box(kind, f"<label>{say(1, 3)}</label><input name=q><p>{say(3, 9)}</p><button>{say(1, 2)}</button>")
        if kind == "comments":
            return box(kind, f"<h3>{say(1, 3)}</h3>" + "".join(f'<div class="comment"><b>{say(1, 2)}</b><p>{say(5, 60)}</p></div>' for _ in range(rng.randint(1, 6))))
        return box(kind, rng.choice([say(2, 25), f"<p>{say(2, 30)}</p>", f'<p>{say(3, 9)} <a href="/x">{say(1, 3)}</a></p>', "&copy; " + say(3, 9)]))

    def block(i: int) -> str:
        a = ' data-main=""'
        kind = rng.random()
        if kind < 0.7:
            inner = say(1, 120)
            if rng.random() < 0.3:
                inner = f'<b{a}>{say(1, 5)}</b> {inner} <a{a} href="/y">{say(1, 4)}</a> {say(1, 9)}'
            return f"<p{a}>{inner}" + rng.choice(["</p>", "</p>", ""])
        if kind < 0.8:
            return f"<h2{a}>{say(1, 8)}</h2>"
        if kind < 0.9:
            return f"<ul{a}>" + "".join(f"<li{a}>{say(2, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        return f"<blockquote{a}>{say(5, 40)}</blockquote>"

    blocks = [f'<h1 data-main="">{say(1, 10)}</h1>'] + [block(i) for i in range(rng.choice([1, 2, 4, 8, 16, 30]))]
    for kind in ("ad", "share", "form", "side", "comments", "notice", "footer"):
        if rng.random() < 0.25:
            blocks.insert(rng.randint(1, len(blocks)), "</p>" + furniture(kind))
    tag, attribute = rng.choice([("article", ""), ("main", ""), ("article", ' class="post"'), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="post-body entry"'), ("section", ' class="story"'), ("div", ' class="article-text"'), ("div", "")])
    # Only the blocks are marked; the page's own article is not a mark.
    content = f"<{tag}{attribute}>" + "".join(blocks) + f"</{tag}>"
    before = [furniture(k) for k in ("header", "nav", "ad", "notice", "side") if rng.random() < 0.6]
    after = [furniture(k) for k in ("comments", "side", "form", "ad", "notice", "footer") if rng.random() < 0.6]
    inner = "".join(before) + content + "".join(after)
    if rng.random() < 0.5:
        inner = f'<div class="{rng.choice(["page", "wrapper", "container", "site", "layout"])}">{inner}</div>'
    return f"<html><head><title>{say(2, 8)}</title><style>p{{}}</style></head><body>{inner}</body></html>"


def template_labels(page: Page) -> np.ndarray:
    """Marked nodes, the text in them, and what leads to them."""
    n = len(page.tag)
    y = np.array(page.marked)
    for i in range(1, n):
        if page.tag[i] == "#text" and y[page.parent[i]]:
            y[i] = True
    for i in np.flatnonzero(y).tolist():
        while i and not y[page.parent[i]]:
            i = page.parent[i]
            y[i] = True
    y[0] = True
    return y


def article_labels(page: Page) -> np.ndarray | None:
    """Nodes of the page's only article, without furniture elements in it, and those above it; None if there are more or none."""
    roots = [i for i, t in enumerate(page.tag) if t == "article"]
    if len(roots) != 1:
        return None
    y = np.zeros(len(page.tag), bool)
    i = roots[0]
    y[i] = True
    for k in range(i + 1, len(y)):
        p = page.parent[k]
        y[k] = y[p] and _GROUP.get(page.tag[k]) not in (0, 1) and not page.words[k] & FURNITURE
    while i:
        i = page.parent[i]
        y[i] = True
    return y


def fit(pages: DataFrame, max_pages: int = 300, templates: int = 500, max_bytes: int = 64 << 20, html_col: str = "html", id_col: str = "page_id", seed: int = 1) -> Trees:
    """Trees from at most max_pages pages of max_bytes in all, by a hash of their id, and from templates."""
    ids = bounded_sample(pages.select(id_col).filter(F.col(id_col).isNotNull()).distinct(), id_col, max_pages)
    x, y = [], []
    for _, html, _ in training_texts(pages, ids.withColumn("label", F.lit(1)), id_col, html_col, max_pages, max_bytes):
        page = Page(html)
        of = article_labels(page)
        if of is not None:
            x.append(page.features())
            y.append(of)
    rng = random.Random(seed)
    for _ in range(templates):
        page = Page(template(rng))
        x.append(page.features())
        y.append(template_labels(page))
    return Trees.train(np.concatenate(x), np.concatenate(y).astype(np.float64))


def main_text(html: str | None, trees: Trees) -> str:
    page = Page(html)
    return page.text(decode(page.parent, trees.log_odds(page.features())))


def extract(pages: DataFrame, trees: Trees, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of every row; no shuffle.  Some dozen pages' nodes are scored at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            for begin in range(0, b.num_rows, 32):
                some = [Page(h.as_py()) for h in b.column(b.num_columns - 1).slice(begin, 32)]
                x = [p.features() for p in some]
                z = np.split(trees.log_odds(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
                texts += [p.text(decode(p.parent, o)) for p, o in zip(some, z)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html_col).mapInArrow(run, f"{kinds}, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
