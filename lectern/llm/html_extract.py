"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the tree.

A small tolerant parser makes each page's elements. Every element gets features: its tag, words of its class, id and
role and of its ancestors', depth, place among its siblings, and how dense text, links and marks are in its subtree.
Spark ML's gradient-boosted trees learn which elements are main text; a page's elements are then judged together: each
is kept whole, dropped whole, or mixed, and what is kept or dropped whole decides for all below it, so that no
descendant contradicts its ancestor. Mixed costs something, so a page is cut in few places.

Learned on a bounded sample: up to `max_pages` pages of up to `max_chars` characters with an `article` or `main`
element, by hash of the page. That
element is main, the rest of the page is not. Each page is learned as it is and in re-dressed copies, in which the main
element has another tag and class, and headers, sidebars, notices, adverts, forms and comments, with the page's own
sentences, stand around and within it; so structure and names have to decide, not words.

Blocks are what block-level elements separate; white space in a block is one space, line breaks included; blocks are
joined by a newline in page order. Scripts, styles, titles, comments of the markup and form controls (textarea, select,
option, button) are never text; what math, object, canvas and noscript hold is. A kept column named as a result gives way.
Nulls: a null page is empty (text empty, 0 characters). Rows are kept one to one. Without pages to learn from, an
element counts as main if it or an ancestor is `article` or `main`. Empty table: empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PAGES = 150
#: Characters of a page that is learned from, at most; longer ones are judged like all others.
MAX_CHARS = 200_000
TREES, DEPTH = 20, 4
MIXED_COST = 0.7

_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"""(?:[^"'>]++|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Never text: scripts, styles, what is not shown, and form controls.
RAW = {"script", "style", "title", "template", "iframe", "svg", "head", "textarea", "select", "option", "button"}
_SKIP_TO_END = {"script", "style", "title", "textarea", "iframe", "template", "svg"}
VOID = {"br", "img", "input", "hr", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "address",
}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "body", "html", "div", "article", "section", "main", "aside", "nav", "footer", "header", "blockquote", "td", "th", "form"}
#: Words of class, id and role that speak for and against main text.
FOR = {"article", "content", "main", "post", "entry", "story", "body", "text", "blog", "prose", "hentry", "paragraph"}
AGAINST = {
    "nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "foot", "sidebar", "aside", "widget",
    "related", "recommended", "recommend", "promo", "promoted", "sponsor", "sponsored", "ad", "ads", "adv", "advert", "adverts", "advertisement",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search",
    "share", "sharing", "social", "comment", "comments", "reply", "replies", "respond", "discussion", "form", "copyright", "legal", "toolbar",
    "pagination", "pager", "tags", "contentinfo", "complementary", "links", "more",
}
_TAGS = ["p", "div", "li", "ul", "a", "article", "main", "section", "nav", "footer", "header", "aside", "form", "h", "table", "inline"]
_FRAME = {"nav", "footer", "header", "aside", "form"}
_COLUMN = {t: i for i, t in enumerate(_TAGS)} | {f"h{i}": _TAGS.index("h") for i in range(1, 7)} | {t: 1 for t in BLOCK - set(_TAGS) - {f"h{i}" for i in range(1, 7)}}
_SIGNS = re.compile(r"[.,;:!?]")
N_FEATURES = len(_TAGS) + 17


class Node:
    __slots__ = ("tag", "names", "parent", "children", "parts", "mark", "at", "place")

    def __init__(self, tag: str, names: list[str], parent: Node | None, mark: str | None = None):
        self.tag, self.names, self.parent, self.mark = tag, names, parent, mark
        self.at, self.place = -1, len(parent.children) if parent is not None else 0
        self.children: list[Node] = []
        self.parts: list[str | Node] = []


def _markup(page: str, pos: int = 0) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closes, tag, attributes) of each tag, and of comments and declarations with an empty tag.

    One pass: a `>` within quotes does not end a tag. From the first tag on that the page's quotes leave open, quotes
    are plain characters, so that no part of a page is read again and again. A caller may send a place to go on from.
    """
    quoted = True
    while (m := _OPENS.search(page, pos)) is not None:
        start, at = m.span()
        if m[2] is None:
            end = page.find("-->", at) if m[0] == "<!--" else page.find(">", at)
            if end < 0 and m[0] != "<!--":
                return  # no tag ends behind this place
            end = len(page) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            pos = (yield start, end, False, "", "") or end
            continue
        if quoted:
            stop = _REST.match(page, at)
            quoted = stop is not None
        end = stop.end() - 1 if quoted else page.find(">", at)
        if end < 0:
            return
        pos = (yield start, end + 1, bool(m[1]), m[2].lower(), page[at:end]) or end + 1


class _Ends:
    """Where elements end whose content is no markup; a tag without a further end is looked for once."""

    def __init__(self, page: str):
        self.page, self.none = page, set()

    def after(self, tag: str, at: int) -> int | None:
        if tag in self.none:
            return None
        m = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(self.page, at)
        if m is None:
            self.none.add(tag)
        return m.end() if m else None


def _svg_ends(page: str, pos: int, ends: _Ends) -> dict[int, int]:
    """Start of each svg from `pos` on that has an end tag, and the place behind that; nested ones are counted."""
    out, opened = {}, []
    tags = _markup(page, pos)
    tag = next(tags, None)
    while tag is not None:
        start, end, closes, name, rest = tag
        go = None
        if name == "svg" and closes:
            if opened:
                out[opened.pop()] = end
        elif name == "svg" and not rest.endswith("/"):
            opened.append(start)
        elif name in _SKIP_TO_END and not closes and not rest.endswith("/"):
            go = ends.after(name, end)
        try:
            tag = tags.send(go)
        except StopIteration:
            break
    return out


def parse(page: str) -> Node:
    """The elements of a page; text that is never shown is left out."""
    root = Node("html", [], None)
    open_nodes, at = [root], 0
    places: dict[str, list[int]] = {"html": [0]}  # of each open tag among the open nodes

    def text(piece: str) -> None:
        if piece and not any(n.tag in RAW for n in open_nodes[-3:]):
            open_nodes[-1].parts.append(html.unescape(piece))

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def shut(i: int) -> None:
        while len(open_nodes) > i:
            places[open_nodes.pop().tag].pop()

    def close(tags: set[str], scope: set[str]) -> None:
        if (i := last(tags)) and i >= last(scope):
            shut(i)

    ends, svg = _Ends(page), None
    tags = _markup(page)
    found = next(tags, None)
    while found is not None:
        start, end, closes, tag, rest = found
        text(page[at:start])
        at, go = end, None
        if tag and closes:
            if i := last((tag,)):
                shut(i)
        elif tag and not (tag in ("html", "body") and places.get(tag)):
            if tag in BLOCK:
                close({"p"}, _SCOPE)
                if tag in _ENDS:
                    close(_ENDS[tag], _SCOPE - {"td", "th"})
            if tag in VOID:
                open_nodes[-1].parts.append("\n" if tag == "br" else Node(tag, [], None) if tag == "hr" else "")
            else:
                attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(rest)} if rest.strip() else {}
                names = [w.lower() for k in ("class", "id", "role") for w in _NAME.findall(attrs.get(k, ""))]
                node = Node(tag, names, open_nodes[-1], attrs.get("data-y"))
                open_nodes[-1].children.append(node)
                open_nodes[-1].parts.append(node)
                if tag == "svg":
                    # Behind its own end tag; a self-closed one, and one that is never closed, hides nothing.
                    svg = _svg_ends(page, start, ends) if svg is None else svg
                    at = go = svg.get(start, at)
                elif tag in _SKIP_TO_END:
                    skip = ends.after(tag, at)
                    at = go = len(page) if skip is None else skip
                elif not rest.endswith("/"):
                    places.setdefault(tag, []).append(len(open_nodes))
                    open_nodes.append(node)
        try:
            found = tags.send(go)
        except StopIteration:
            break
    text(page[at:])
    return root


def order(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.children))
    return out


def parents(nodes: list[Node]) -> list[int]:
    """Number of each element's parent; 0 for the root."""
    for i, n in enumerate(nodes):
        n.at = i
    return [n.parent.at if n.parent is not None else 0 for n in nodes]


def features(nodes: list[Node]) -> np.ndarray:
    """One row per element of a page."""
    size = len(nodes)
    above = parents(nodes)
    own = np.zeros((size, 6))
    for i, n in enumerate(nodes):
        text = " ".join("".join([p for p in n.parts if p.__class__ is str]).split())
        if text:
            own[i, :3] = len(text), text.count(" ") + 1, len(_SIGNS.findall(text))
        own[i, 3], own[i, 4] = 1, n.tag == "p"
    rows = own.tolist()
    for i in range(size - 1, -1, -1):
        r = rows[i]
        if nodes[i].tag == "a":
            r[5] = r[0]
        if i:
            up = rows[above[i]]
            for c in range(6):
                up[c] += r[c]
    state: list[tuple] = []
    flags = []
    column = np.empty(size, np.int64)
    for i, n in enumerate(nodes):
        column[i] = _COLUMN.get(n.tag, 15)
        good = n.tag in ("article", "main") or not FOR.isdisjoint(n.names)
        bad = n.tag in _FRAME or not AGAINST.isdisjoint(n.names)
        u = state[above[i]] if i else (False, False, 0, False, False)
        k = len(n.parent.children) if i else 1
        flags.append((good, bad, *u, k, n.place / k))
        state.append((u[0] or good, u[1] or bad, u[2] + 1, u[3] or n.tag in ("article", "main"), u[4] or n.tag in _FRAME))
    chars, words, marks, elements, paragraphs, links = np.array(rows).T
    x = np.zeros((size, N_FEATURES))
    x[np.arange(size), column] = 1
    k = len(_TAGS)
    x[:, k : k + 9] = flags
    x[:, k + 9 :] = np.column_stack([
        np.log1p(chars), chars / elements, links / np.maximum(chars, 1), marks / np.maximum(words, 1), chars / max(chars[0], 1.0), paragraphs,
        np.log1p(elements), chars / np.maximum(words, 1),
    ])
    return x


def _labels(nodes: list[Node]) -> list[float | None]:
    """1 within the marked main element, 0 elsewhere or below a mark of 0; none for what holds the main element."""
    out: list[float | None] = []
    state: dict[int, float | None] = {}
    above: set[int] = set()
    for n in nodes:
        if n.mark == "1":
            p = n.parent
            while p is not None:
                above.add(id(p))
                p = p.parent
    for n in nodes:
        here = state.get(id(n.parent), 0.0) if n.parent is not None else 0.0
        here = float(n.mark) if n.mark in ("0", "1") else here
        state[id(n)] = here
        out.append(None if id(n) in above else here)
    # An element that holds both kinds has no label.
    mixed = {id(n.parent) for n in nodes if n.parent is not None and state[id(n)] != state[id(n.parent)]}
    grown = set()
    for n in nodes:
        if id(n) in mixed:
            p = n
            while p is not None and id(p) not in grown:
                grown.add(id(p))
                p = p.parent
    return [None if id(n) in grown else y for n, y in zip(nodes, out, strict=True)]


def _main(page: str) -> tuple[str, int, int, int, int] | None:
    """(tag, start, and where its content begins, where that ends, end) of the first article or main element that ends
    somewhere; it reaches to the last end tag of its kind. Linear in the page."""
    first = [m for tag in ("article", "main") if (m := re.search(rf"<{tag}\b", page, re.I))]
    for m in sorted(first, key=re.Match.start):
        begin = page.find(">", m.end()) + 1
        last = None
        for last in re.finditer(rf"</{m[0][1:]}\s*+>", page[begin:], re.I) if begin else ():
            pass
        if last is not None:
            return m[0][1:], m.start(), begin, begin + last.start(), begin + last.end()
    return None


def dressed(page: str, rng: random.Random, copies: int = 3) -> list[str]:
    """The page with its main element marked, and re-dressed copies of it."""
    found = _main(page)
    if found is None:
        return []
    name, start, begin, stop, end = found
    before, inner, after = page[:start], page[begin:stop], page[end:]
    body = re.split(r"</p>", inner)
    said = [s for s in (re.sub(r"<[^<>]*+>", " ", b).strip() for b in body) if s] or ["text"]

    def some() -> str:
        return rng.choice(said)[: rng.choice([40, 120, 400])]

    def around() -> str:
        links = "".join(f"<li><a href='/x'>{some()[:30]}</a></li>" for _ in range(rng.randint(3, 8)))
        return rng.choice([
            f"<header data-y='0' class='{rng.choice(['site-header', 'masthead', 'top'])}'><a href='/'>{some()[:20]}</a><p>{some()}</p></header>",
            f"<aside data-y='0'><h3>{some()[:20]}</h3><p>{some()}</p></aside>",
            f"<div data-y='0' class='{rng.choice(['sidebar', 'widget', 'related-posts', 'recommended'])}'><h3>{some()[:20]}</h3><ul>{links}</ul><p>{some()}</p></div>",
            f"<div data-y='0' class='{rng.choice(['cookie-notice', 'notice', 'consent-banner', 'alert'])}'><p>{some()}</p></div>",
            f"<div data-y='0' id='{rng.choice(['ad', 'ads', 'advert-1', 'sponsored'])}'><p>{some()}</p></div>",
            f"<form data-y='0' action='/s'><p>{some()}</p><label>{some()[:20]}</label><input name='q'></form>",
            f"<nav data-y='0'><ul>{links}</ul></nav>",
            f"<div data-y='0' class='menu'><ul>{links}</ul></div>",
            f"<footer data-y='0'>{rng.choice(['<p>', ''])}{some()}</footer>",
        ])

    def comments() -> str:
        each = "".join(f"<div class='comment'><p>{some()}</p><p>{some()}</p></div>" for _ in range(rng.randint(1, 4)))
        return f"<{(t := rng.choice(['section', 'div']))} data-y='0' {rng.choice(['class', 'id'])}='{rng.choice(['comments', 'comment-list', 'discussion'])}'><h3>{some()[:20]}</h3>{each}</{t}>"

    out = [f"{before}{page[start : begin - 1]} data-y='1'>{inner}</{name}>{after}"]
    for _ in range(copies):
        tag, attrs = rng.choice([("article", ""), ("main", ""), ("div", "class='post-content'"), ("div", "id='content'"), ("section", "class='entry'"), ("div", "class='article-body'"), ("main", "id='main'"), ("div", "class='story'")])
        parts = list(body)
        if rng.random() < 0.5 and len(parts) > 2:
            at = rng.randrange(1, len(parts))
            parts[at] = around() + parts[at]
        main = "</p>".join(parts)
        tail = comments() if rng.random() < 0.6 else ""
        inside = rng.random() < 0.5
        wrapped = f"<{tag} {attrs} data-y='1'>{main}{tail if inside else ''}</{tag}>{'' if inside else tail}"
        if rng.random() < 0.5:
            wrapped = f"<div class='{rng.choice(['wrapper', 'container', 'page', 'row'])}'>{wrapped}{around()}</div>"
        out.append(before + "".join(around() for _ in range(rng.randint(0, 2))) + wrapped + "".join(around() for _ in range(rng.randint(0, 2))) + after)
    return out


def _tree(node) -> tuple:
    """A tree of Spark's nodes: (feature, limit, left, right), or its value."""
    if node.getClass().getSimpleName() == "LeafNode":
        return (node.prediction(),)
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _value(tree[2], x[left]), _value(tree[3], x[~left])
    return out


def probability(model: list[tuple[float, tuple]] | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        k = len(_TAGS)
        return np.where((x[:, k + 5] > 0) | (x[:, _TAGS.index("article")] > 0) | (x[:, _TAGS.index("main")] > 0), 0.9, 0.1)
    score = sum(w * _value(t, x) for w, t in model)
    return 1 / (1 + np.exp(-2 * score))  # the loss of Spark's trees is log(1 + exp(-2 y F))


def train(pages: DataFrame, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS) -> list[tuple[float, tuple]] | None:
    """pages: html. The sample is bounded, so its features are made here; Spark ML fits the trees."""
    spark = pages.sparkSession
    rows = pages.filter(F.lower("html").rlike("<(article|main)[ >]") & (F.length("html") <= max_chars)).select(F.xxhash64("html").alias("h"), "html")
    n = rows.count()
    if not n:
        return None
    some = rows.filter(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * min(1.0, 2 * max_pages / n))).orderBy("h").limit(max_pages).collect()
    rng, xs, ys = random.Random(7), [], []
    for r in some:
        for page in dressed(r["html"], rng):
            nodes = order(parse(page))
            x = features(nodes)
            for row, y, node in zip(x, _labels(nodes), nodes, strict=True):
                if y is not None and row[len(_TAGS) + 9] > 0 and node.tag not in RAW:
                    xs.append(row.tolist())
                    ys.append(y)
    if len(set(ys)) < 2:
        return None
    frame = spark.createDataFrame(pa.table({"x": pa.array(xs, pa.list_(pa.float64())), "label": pa.array(ys, pa.float64())})).coalesce(4)
    frame = frame.select(array_to_vector("x").alias("features"), "label")
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7, cacheNodeIds=False).fit(frame)
    return [(w, _tree(t._java_obj.rootNode())) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)]


def decode(nodes: list[Node], p: np.ndarray) -> list[int]:
    """Per element: 1 kept whole, 0 dropped whole, -1 mixed (its own text goes by its own probability)."""
    above = parents(nodes)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weight = np.array([1.0 if any(s.__class__ is str and not s.isspace() and s for s in n.parts) else 0.3 for n in nodes])
    yes, no = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
    weight = weight.tolist()
    keep, drop, below = yes[:], no[:], [0.0] * len(nodes)
    choice = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.tag in RAW:
            keep[i], drop[i], best, choice[i] = 0.0, 0.0, 0.0, 0
        else:
            mixed = below[i] + (max(yes[i], no[i]) if weight[i] == 1.0 else 0.0) - MIXED_COST
            best = max(keep[i], drop[i], mixed)
            choice[i] = -1 if mixed >= best and n.children else 1 if keep[i] > drop[i] else 0
            if choice[i] != -1:
                best = max(keep[i], drop[i])
        if n.parent is not None:
            j = above[i]
            keep[j] += keep[i]
            drop[j] += drop[i]
            below[j] += best
    for i, n in enumerate(nodes):
        if n.parent is not None and choice[above[i]] != -1:
            choice[i] = choice[above[i]]
    return choice


def main_text(root: Node, nodes: list[Node], choice: list[int], p: np.ndarray) -> str:
    blocks, now = [], []

    def end() -> None:
        line = " ".join("".join(now).split())
        now.clear()
        if line:
            blocks.append(line)

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            end()
            continue
        if isinstance(item, tuple):
            now.append(item[0])
            continue
        if item.tag in RAW:
            continue
        i = item.at
        if item.tag in BLOCK:
            end()
        if i < 0:
            continue
        own = choice[i] == 1 or (choice[i] == -1 and p[i] >= 0.5)
        if item.tag in BLOCK:
            stack.append(None)
        for part in reversed(item.parts):
            if isinstance(part, Node):
                stack.append(part)
            elif own:
                stack.append((part,))
            else:
                stack.append((" ",))
    end()
    return "\n".join(blocks)


def extract(
    df: DataFrame, markup: str = "html", keep: tuple[str, ...] = ("page_id", "url"), max_pages: int = MAX_PAGES, learn_from: DataFrame | None = None, max_chars: int = MAX_CHARS,
) -> DataFrame:
    """`keep`, text and n_chars (code points) of every page. `learn_from`: pages to learn from (default: `df` itself)."""
    keep = tuple(k for k in keep if k not in ("text", "n_chars"))
    model = train((df if learn_from is None else learn_from).select(F.col(markup).alias("html")), max_pages, max_chars)
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts = batch.column(len(keep)), []
            for at in range(0, len(column), 64):
                trees = [order(parse(page or "")) for page in column.slice(at, 64).to_pylist()]
                p = probability(model, np.concatenate([features(t) for t in trees]))
                for nodes in trees:
                    own, p = p[: len(nodes)], p[len(nodes) :]
                    texts.append(main_text(nodes[0], nodes, decode(nodes, own), own))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return df.select(*keep, F.col(markup).alias("__html")).mapInArrow(run, schema)


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    return extract(table(spark, sf_dir, "pages"))
