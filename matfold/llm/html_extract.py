"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements (inline elements only matter for
links and white space; scripts, styles and the like never give text; an open
head ends where anything begins that cannot be in a head).
Every node has features of its subtree (text, tags, density, share of links),
its tag and attribute tokens, its depth and place, and its siblings.  A
gradient-boosted tree model gives each node the log odds of being main text.

Decoding: a node can only be kept if its parent is.  Over all such choices the
one of the highest sum of log odds (weighted by the node's own text) is taken,
by one pass from the leaves and one from the root.  So no kept node sits in a
dropped one.

The model is trained on a bounded sample of the distinct pages themselves, labelled by
what their markup says outright (article and main against nav, footer, aside,
telling class and id tokens).  Each sample page is also used with menus,
sidebars, notices, adverts, forms and comments made of its own text put in,
and with names hidden (elements renamed to div, attributes dropped), so that
the trees learn text features besides names.
"""

from __future__ import annotations

import html
import re
import warnings
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm.common import column_type, lists, prepare, saved

# Names of HTML elements by their role, and telling attribute tokens.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea title iframe svg math object select button canvas video audio noframes noembed xmp datalist".split())
RAW = frozenset("script style textarea title iframe noframes noembed xmp noscript".split())
HEAD = frozenset("head title meta link script style base basefont bgsound noscript template".split())
BAD_TAGS = frozenset("nav header footer aside menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
CONTROLS = frozenset("button select textarea fieldset legend".split())
ENDS_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
BAD_WORDS = frozenset("""ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice
alert nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar side rail widget related recommended share sharing social footer header masthead
comment comments commentlist disqus reply replies respond discussion form login signup subscribe newsletter search toolbar copyright legal disclaimer tags skip""".split())
GOOD_WORDS = frozenset("article main content post entry story body text prose".split())
# end of fixed values

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOPS = re.compile("[>\"']")
ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
#: Added to the log odds in decoding: losing main text counts more than a short extra block.
MARGIN = 1.0

FEATURES = ["text", "own_text", "tags", "density", "link_share", "depth", "start", "parent_share", "siblings", "place", "same_siblings", "sibling_text",
            "sentences", "blocks", "bad_tag", "good_tag", "bad_words", "good_words", "in_bad", "in_good", "paragraph", "heading", "item", "form", "in_form", "controls"]


@dataclass
class Dom:
    """The block elements of a page, parents before children, and its blocks of text."""
    tag: list[str]
    parent: list[int]
    bad: list[int]
    good: list[int]
    tags: list[int]
    own: list[int]
    link: list[int]
    ends: list[int]
    first: list[int]
    n_blocks: list[int]
    blocks: list[tuple[int, str]]
    controls: list[int]


def attribute_words(attrs: str) -> tuple[int, int]:
    """(telling-bad, telling-good) tokens among class, id and role."""
    bad = good = 0
    for m in ATTR.finditer(attrs):
        words = set(WORD.findall(CAMEL.sub(r"\1 \2", m[1] or m[2] or m[3] or "").lower()))
        bad += len(words & BAD_WORDS)
        good += len(words & GOOD_WORDS)
    return bad, good


class Tags:
    """Finds where a page's tags end, in linear time whatever is left open in it.

    A tag ends at the first ``>`` outside quotes.  The places of all ``>`` and
    quotes are listed once; a quote from which a search has failed fails again.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.stops = [m.start() for m in STOPS.finditer(page)]
        self.last = page.rfind(">")
        self.dead: set[int] = set()
        self.final = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Place behind the ``>`` that ends a tag whose attributes begin at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        opened = []
        k = bisect_left(self.stops, at)
        while k < len(self.stops):
            place = self.stops[k]
            c = self.page[place]
            if c == ">":
                return place + 1
            if place in self.dead or place >= self.final[c]:
                break
            opened.append(place)
            k = bisect_left(self.stops, self.page.find(c, place + 1) + 1)
        self.dead.update(opened)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(begin, end, slash, name, attributes) of the next tag, comment or declaration from ``at``; no name for the latter two."""
        page = self.page
        while (begin := page.find("<", at)) >= 0:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else len(page), "", "", ""
            if page[begin + 1:begin + 2] in ("!", "?"):
                end = page.find(">", begin + 2)
                return begin, end + 1 if end >= 0 else len(page), "", "", ""
            m = NAME.match(page, begin)
            end = self.end(m.end()) if m else -1
            if end >= 0:
                return begin, end, m[1], m[2], page[m.end():end - 1]
            at = begin + 1
        return None


def parse(page: str) -> Dom:
    """Element tree and text blocks of a page; unclosed elements end where their parent does."""
    d = Dom(["#page"], [-1], [0], [0], [0], [0], [0], [0], [0], [0], [], [0])
    stack: list[tuple[str, int]] = [("#page", 0)]  # (tag, node that its text belongs to)
    where: dict[str, list[int]] = defaultdict(list)  # places of each tag in the stack, and those of block elements
    where["#page"], outer = [0], [0]
    piece: list[str] = []  # raw text of the block that is open
    links, silent, chars = 0, 0, 0
    linked: list[tuple[bool, str]] = []

    def flush(node: int) -> None:
        nonlocal chars
        if not piece:
            return
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            n = len(text)
            in_links = sum(len(t) for a, t in linked if a)
            whole = sum(len(t) for _, t in linked)
            d.blocks.append((node, text))
            d.own[node] += n
            d.link[node] += min(n, round(n * in_links / whole)) if whole else 0
            d.ends[node] += sum(text.count(c) for c in ".!?")
            d.n_blocks[node] += 1
            if d.n_blocks[node] == 1:
                d.first[node] = chars
            chars += n
        piece.clear()
        linked.clear()

    def pop() -> None:
        nonlocal links, silent
        tag, node = stack.pop()
        where[tag].pop()
        if tag not in INLINE:
            outer.pop()
        if tag in SILENT:
            silent -= 1
        if tag == "a":
            links -= 1
        elif tag not in INLINE:
            flush(node)

    def push(tag: str, node: int) -> None:
        where[tag].append(len(stack))
        if tag not in INLINE:
            outer.append(len(stack))
        stack.append((tag, node))

    def end_head() -> None:
        if where["head"]:
            place = where["head"][-1]
            while len(stack) > place:
                pop()

    at, tags = 0, Tags(page)
    while found := tags.next(at):
        begin, end, slash, name, attrs = found
        if begin > at and not silent:
            text = page[at:begin]
            if stack[-1][0] == "head" and text.strip():
                end_head()
            piece.append(text)
            linked.append((links > 0, text))
        at = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            place = where[tag][-1] if where[tag] else 0
            if not place:
                if tag == "p" or tag == "br":
                    piece.append(" ")
                continue
            if tag in INLINE and outer[-1] > place:
                continue  # an inline end tag does not close blocks
            while len(stack) > place:
                pop()
            continue
        if tag not in HEAD and not silent:
            end_head()
        if tag in INLINE:
            d.tags[stack[-1][1]] += 1
            d.controls[stack[-1][1]] += tag == "label"
            if tag in ("br", "wbr", "img"):
                if tag == "br" and not silent:
                    piece.append(" ")
                continue
            if tag == "a":
                links += 1
            push(tag, stack[-1][1])
            continue
        # a block element ends an open paragraph, and an item the item before it
        for i in reversed(outer):
            t = stack[i][0]
            if not i:
                break
            if t == "p" or t == tag and tag in ENDS_ITSELF or (tag, t) in (("dt", "dd"), ("dd", "dt"), ("td", "th"), ("th", "td")):
                while len(stack) > i:
                    pop()
                break
            if t not in ("li", "dt", "dd", "td", "th", "tr") or tag in ENDS_ITSELF and t in ENDS_ITSELF[tag]:
                break
        flush(stack[-1][1])
        parent = stack[-1][1]
        if tag in VOID:
            d.tags[parent] += 1
            d.controls[parent] += tag == "input"
            continue
        bad, good = attribute_words(attrs) if "=" in attrs else (0, 0)
        d.tag.append(tag)
        d.parent.append(parent)
        d.bad.append(bad)
        d.good.append(good)
        for x in (d.own, d.link, d.ends, d.n_blocks):
            x.append(0)
        d.tags.append(1)
        d.controls.append(int(tag in CONTROLS))
        d.first.append(chars)
        push(tag, len(d.tag) - 1)
        if tag in SILENT:
            silent += 1
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, max(at, tags.last + 1))
                at = close.end() if close else len(page)
                pop()
    if at < len(page) and not silent:
        text = page[at:]
        piece.append(text)
        linked.append((links > 0, text))
    while stack:
        pop()
    return d


def features(d: Dom) -> np.ndarray:
    """One row of ``FEATURES`` per node."""
    n = len(d.tag)
    parent = d.parent
    text, tags, link, ends, blocks, controls = (list(x) for x in (d.own, d.tags, d.link, d.ends, d.n_blocks, d.controls))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        text[p] += text[i]
        tags[p] += tags[i]
        link[p] += link[i]
        ends[p] += ends[i]
        blocks[p] += blocks[i]
        controls[p] += controls[i]
    depth, in_bad, in_good, in_form = [0] * n, [0] * n, [0] * n, [0] * n
    children, same = [0] * n, {}
    place = [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        in_bad[i] = in_bad[p] or int(d.tag[i] in BAD_TAGS or d.bad[i] > 0)
        in_good[i] = in_good[p] or int(d.tag[i] in GOOD_TAGS or d.good[i] > 0)
        in_form[i] = in_form[p] or int(d.tag[i] == "form")
        place[i] = children[p]
        children[p] += 1
        key = (p, d.tag[i])
        same[key] = same.get(key, 0) + 1
    total = max(1, text[0])
    x = np.zeros((n, len(FEATURES)))
    up = np.array(parent)
    up[0] = 0
    t, g, kids = np.array(text, float), np.array(tags, float), np.array(children, float)
    x[:, 0], x[:, 1], x[:, 2] = np.log1p(t), np.log1p(d.own), np.log1p(g)
    x[:, 3] = np.log1p(t / np.maximum(g, 1))
    x[:, 4] = np.array(link) / np.maximum(t, 1)
    x[:, 5] = depth
    x[:, 6] = np.array(d.first) / total
    x[:, 7] = t / np.maximum(t[up], 1)
    x[:, 8] = np.log1p(kids[up])
    x[:, 9] = np.array(place) / np.maximum(kids[up] - 1, 1)
    x[:, 10] = np.array([1, *(same[(parent[i], d.tag[i])] for i in range(1, n))]) / np.maximum(kids[up], 1)
    x[:, 11] = np.log1p((t[up] - t) / np.maximum(kids[up] - 1, 1))
    x[:, 12] = np.array(ends) / np.maximum(t, 1) * 100
    x[:, 13] = np.log1p(blocks)
    x[:, 14] = [v in BAD_TAGS for v in d.tag]
    x[:, 15] = [v in GOOD_TAGS for v in d.tag]
    x[:, 16], x[:, 17], x[:, 18], x[:, 19] = d.bad, d.good, in_bad, in_good
    x[:, 20] = [v in ("p", "blockquote", "pre") for v in d.tag]
    x[:, 21] = [len(v) == 2 and v[0] == "h" and v[1].isdigit() for v in d.tag]
    x[:, 22] = [v in ("li", "dd", "dt", "td", "th", "option") for v in d.tag]
    x[:, 23], x[:, 24] = [v == "form" for v in d.tag], in_form
    x[:, 25] = np.array(controls) / np.maximum(g, 1)
    return x


class Trees:
    """Boosted regression trees as arrays; leaves point to themselves."""

    def __init__(self, trees: list[tuple[float, list[tuple[int, float, int, int, float]]]]) -> None:
        self.trees = [(w, *(np.array(c) for c in zip(*nodes, strict=True))) for w, nodes in trees]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                new = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
                if (new == at).all():
                    break
                at = new
            out += weight * value[at]
        return 2 * out  # the boosted score is half the log odds


def read_trees(described: str) -> list[tuple[float, list[tuple[int, float, int, int, float]]]]:
    """Trees of a fitted model from its printed form: (weight, nodes of (feature, cut, left, right, value))."""
    trees: list[tuple[float, list]] = []
    path: list[int] = []
    for line in described.splitlines():
        line = line.strip()
        if m := re.match(r"Tree \d+ \(weight ([-\d.E]+)\)", line):
            trees.append((float(m[1]), []))
            path = []
            continue
        if not trees:
            continue
        nodes = trees[-1][1]
        if m := re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line):
            nodes.append([int(m[1]), float(m[2]), len(nodes) + 1, -1, 0.0])
            path.append(len(nodes) - 1)
        elif line.startswith("Else"):
            nodes[path.pop()][3] = len(nodes)
        elif m := re.match(r"Predict: ([-\d.E]+)", line):
            nodes.append([0, 0.0, len(nodes), len(nodes), float(m[1])])
    return [(w, [tuple(n) for n in nodes]) for w, nodes in trees]


def decode(d: Dom, odds: np.ndarray) -> np.ndarray:
    """Kept nodes: the choice of the highest weighted sum in which every kept node's parent is kept."""
    own = ((odds + MARGIN) * (1 + np.log1p(d.own))).tolist()
    best = own[:]
    for i in range(len(own) - 1, 0, -1):
        if best[i] > 0:
            best[d.parent[i]] += best[i]
    keep = np.zeros(len(own), bool)
    keep[0] = True
    for i in range(1, len(own)):
        keep[i] = keep[d.parent[i]] and best[i] > 0
    return keep


def weak_labels(d: Dom) -> np.ndarray:
    """1 main, 0 other, by what the markup says: other inside a telling element, main inside article or main.

    A form is as its surroundings if it is laid around an article or main or
    holds half of the text of the article or main (or page) around it; otherwise
    it is other.
    """
    out = np.zeros(len(d.tag))
    text, holds = d.own[:], [t in GOOD_TAGS for t in d.tag]
    for i in range(len(d.tag) - 1, 0, -1):
        text[d.parent[i]] += text[i]
        holds[d.parent[i]] |= holds[i]
    named = any(t in GOOD_TAGS for t in d.tag)
    inside = [not named] * len(d.tag)
    around = [0] * len(d.tag)  # the article, main or page that a node is in
    for i in range(1, len(d.tag)):
        p = d.parent[i]
        around[i] = p if d.tag[p] in GOOD_TAGS else around[p]
        inside[i] = inside[p] or d.tag[i] in GOOD_TAGS
        out[i] = -1 if out[p] == -1 or d.tag[i] in BAD_TAGS or d.bad[i] or d.tag[i] == "form" and not holds[i] and 2 * text[i] < text[around[i]] else float(inside[i])
    # an element on the way to main text is main as well, so that decoding can reach it
    for i in range(len(d.tag) - 1, 0, -1):
        if out[i] == 1 and out[d.parent[i]] == 0:
            out[d.parent[i]] = 1
    return np.maximum(out, 0)


def variants(page: str) -> list[str]:
    """The page, the page with further parts made of its own text put in, and with its text laid out anew."""
    texts = re.findall(r"<p[^>]*>([^<]{20,})", page) or ["text"]
    pick = lambda k: texts[k % len(texts)][:300]
    k = len(page)
    put = [f'<div class="comments"><h3>Comments</h3><div class="comment"><p>{pick(k)}</p></div><div class="comment"><p>{pick(k + 1)}</p></div></div>',
           f'<aside class="sidebar"><ul><li><a href="#">{pick(k)[:40]}</a></li></ul><p>{pick(k + 2)[:80]}</p></aside>',
           f'<div id="cookie-notice"><p>{pick(k + 3)[:90]}</p></div>', f'<div class="related"><ul><li><a href="#">{pick(k + 1)[:50]}</a></li></ul></div>',
           f'<section id="newsletter-signup"><p>{pick(k + 2)[:70]}</p></section>']
    inner = re.sub(r"(?i)</article>", lambda m: put[k % 5] + m[0], page)
    outer = re.sub(r"(?i)<footer", lambda m: put[(k + 1) % 5] + put[(k + 2) % 5] + m[0], page)
    kinds = ["<p>{}</p>", "<ul><li>{}</li></ul>", "<p>{}</p>", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<h2>{}</h2>"]
    count = iter(range(k, k + page.count("<p") + 1))
    laid = re.sub(r"<p[^>]*>([^<]*)</p>", lambda m: kinds[next(count) % 6].format(m[1]), page)
    laid = re.sub(r"(?i)<article[^>]*>", lambda m: m[0] + "<div><section>", laid)
    laid = re.sub(r"(?i)</article>", "</section>" + put[(k + 4) % 5] + "</div></article>", laid)
    asked = f'<form action="#"><label>{pick(k + 4)[:30]}</label><input name="q"><p>{pick(k + 2)[:60]}</p><button>{pick(k)[:10]}</button></form>'
    inner = re.sub(r"(?i)</article>", lambda m: asked + m[0], inner)
    outer = re.sub(r"(?i)<body[^>]*>", lambda m: m[0] + '<form action="#"><input type="hidden">', outer) if k % 2 else asked.join(re.split(r"(?i)(?=<article)", outer, maxsplit=1))
    laid = re.sub(r"(?i)<article[^>]*>", lambda m: m[0] + '<form action="#">', laid) if k % 3 == 0 else laid
    return [page, inner, outer, laid]


def hidden_names(x: np.ndarray) -> np.ndarray:
    """The features with the names of elements and attributes taken out."""
    x = x.copy()
    for f in ("bad_tag", "good_tag", "bad_words", "good_words", "in_bad", "in_good"):
        x[:, FEATURES.index(f)] = 0
    return x


def train(pages: DataFrame, id_col: str, html_col: str, sample: int, trees: int, depth: int) -> Trees:
    """Fit on the ``sample`` distinct pages of the smallest hashes (all, if there are fewer)."""
    every = pages.select(F.col(html_col).cast("string").alias("h")).where("h is not null").select(F.xxhash64("h").alias("k"), "h")
    chosen = [r.k for r in every.select("k").distinct().orderBy("k").limit(sample).collect()]
    some = every.where(F.col("k").isin(chosen)).groupBy("k").agg(F.min("h").alias("h")).select("h")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [], []
            for page in b.column(0).to_pylist():
                for v in variants(page):
                    d = parse(v)
                    x, y = features(d), weak_labels(d)
                    renamed = features(replace(d, tag=["div" if t in GOOD_TAGS else t for t in d.tag]))
                    xs += [x[1:], renamed[1:], hidden_names(x)[1:]]
                    ys += [y[1:]] * 3
            x = np.concatenate(xs) if xs else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([lists(x.ravel(), np.full(len(x), x.shape[1])), pa.array(np.concatenate(ys) if ys else np.zeros(0))], ["x", "label"])

    nodes = saved(some.mapInArrow(rows, "x array<double>, label double"))
    if nodes.agg(F.countDistinct("label")).first()[0] < 2:  # nothing to learn: trust the names alone
        if chosen:
            warnings.warn(f"no model can be fitted on {len(chosen)} distinct pages (one label only); nodes are judged by names alone", stacklevel=3)
        name = FEATURES.index("in_bad")
        return Trees([(1.0, [(name, 0.5, 1, 2, 0.0), (0, 0.0, 1, 1, 1.0), (0, 0.0, 2, 2, -1.0)])])
    data = nodes.select(array_to_vector("x").alias("features"), "label").coalesce(4).cache()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32).fit(data)
    data.unpersist()
    return Trees(read_trees(model.toDebugString))


def main_text(page: str | None, model: Trees) -> str:
    if not page:
        return ""
    d = parse(page)
    keep = decode(d, model.log_odds(features(d)))
    return " ".join(t for node, t in d.blocks if keep[node])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            sample: int = 250, trees: int = 20, depth: int = 5) -> DataFrame:
    """Per row: (id, url, text, n_chars).

    Null and empty pages give the empty text; broken markup is read as far as
    it goes; repeated rows give repeated results; extra columns are ignored;
    an empty table gives an empty result.  At most ``sample`` distinct pages train
    the model, every page is extracted whole; a warning says if no model can be
    fitted, and names alone decide then.
    """
    spark = pages.sparkSession
    prepare(spark)
    kind = column_type(pages, id_col)
    model = train(pages, id_col, html_col, sample, trees, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                part = b.slice(i, 100)
                doms = [parse(p or "") for p in part.column(2).to_pylist()]
                xs = [features(d) for d in doms]
                odds = np.split(model.log_odds(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1])
                texts = []
                for d, o in zip(doms, odds, strict=True):
                    keep = decode(d, o)
                    texts.append(" ".join(t for node, t in d.blocks if keep[node]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("h"))
    out = src.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
