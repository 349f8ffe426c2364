"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements with runs of inline text as leaves. Every node is described by
its tag, attribute tokens, depth, subtree density and siblings; gradient-boosted trees give the
chance that it leads to main text. Decoding picks the likeliest labelling in which a rejected node
has no accepted descendant. The trees learn from a bounded sample of pages: as they are, where
an article element marks the main text, and set again into generated layouts.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import chunks, map_arrow, rename_free, session_of

# Bounds of the training sample: pages, layouts each is set into, and blocks of a page used there.
SAMPLE_PAGES, LAYOUTS, LAYOUT_BLOCKS = 320, 3, 12
TREES, DEPTH, RATE, BINS = 50, 4, 0.25, 32

# Element names by role, and words in class, id, role and label attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object video audio canvas".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TAGS = (
    ("article", "main"), ("section",), ("div",), ("nav", "menu"), ("header",), ("footer",), ("aside",),
    ("form", "fieldset", "button", "select", "option", "label", "legend", "dialog"), ("p",), ("h1",),
    ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "tr"), ("td", "th"),
    ("blockquote", "pre", "figure", "figcaption"), ("#text",),
)
WORDS = (
    ("article", "content", "post", "entry", "story", "main", "body", "text", "prose"),
    ("nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "masthead", "header", "skip"),
    ("footer", "copyright", "legal", "colophon", "bottom"),
    ("sidebar", "aside", "related", "recommended", "widget", "rail", "tags", "trending", "popular", "more"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "promoted"),
    ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "warning", "dialog"),
    ("comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "reader"),
    ("form", "search", "login", "signup", "subscribe", "newsletter", "contact", "register"),
    ("share", "social", "follow", "author", "byline", "meta", "hidden", "print"),
)
WORD_GROUP = {w: n for n, words in enumerate(WORDS) for w in words}
TAG_GROUP = {t: n for n, tags in enumerate(TAGS) for t in tags}

START = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/><]*)")
QUOTE_OR_END = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(
    r"""(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))|(?<![\w-])(hidden)(?![\w=-])"""
)
SPLIT = re.compile(r"[^a-z]+")
# Share of generated layouts that are learnt a second time without classes and ids.
NAMELESS = 0.1
MARK = "\x01"  # in front of main text while layouts are learned from; never seen by features


class Node:
    __slots__ = ("tag", "parent", "depth", "groups", "hidden", "text", "linked", "children", "number")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.groups, self.hidden = [0] * len(WORDS), 0
        self.text, self.linked, self.children = "", 0, []
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, *values, bare in ATTRIBUTE.findall(attributes):
                value, name = "".join(values).lower(), name.lower()
                if name in ("class", "id", "role", "aria-label"):
                    for word in SPLIT.split(value):
                        if (group := WORD_GROUP.get(word)) is not None:
                            self.groups[group] += 1
                gone = bare or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
                self.hidden |= bool(gone)
        if parent:
            parent.children.append(self)


class Tags:
    """A page's tags, comments and declarations. Text of any kind takes time in proportion to its length:
    where a tag ends, quoted parts left out, is worked out once, from the page's last quote to its first."""

    def __init__(self, page: str):
        self.page = page
        self.marks = [m.start() for m in QUOTE_OR_END.finditer(page)]
        # The end of a tag that reaches this mark outside of quotes, or -1.
        self.ends = [-1] * (len(self.marks) + 1)
        later: dict[str, int] = {}
        for n in range(len(self.marks) - 1, -1, -1):
            mark = page[self.marks[n]]
            if mark == ">":
                self.ends[n] = self.marks[n]
            else:
                if mark in later:
                    self.ends[n] = self.ends[later[mark] + 1]
                later[mark] = n
        self.last = page.rfind(">")

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The first one from ``at`` on: start, end, ``/`` of a closing tag, name, attributes; the name is empty for
        comments and declarations. What is never closed is text, but for a comment, which runs to the page's end."""
        while found := START.search(self.page, at):
            start, at = found.span()
            if found.group(2):
                end = self.ends[bisect_left(self.marks, at)]
                if end >= 0:
                    return start, end + 1, found.group(1), found.group(2).lower(), self.page[at:end]
            elif at - start == 4:
                end = self.page.find("-->", at)
                return start, end + 3 if end >= 0 else len(self.page), "", "", ""
            elif at <= self.last:
                return start, self.page.find(">", at) + 1, "", "", ""
        return None


def parse(page: str) -> list[Node]:
    """Nodes of a page in page order, the root first. Scripts, styles and the like leave nothing."""
    root = Node("#root", None)
    nodes, stack, inline = [root], [("#root", root)], []
    opened: Counter = Counter()
    tags = Tags(page)
    run: list[str] = []
    linked = at = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            leaf = Node("#text", stack[-1][1])
            leaf.text, leaf.linked = text, min(linked, len(text))
            nodes.append(leaf)
        run.clear()
        linked = 0

    def close_to(index: int) -> None:
        nonlocal in_link
        flush()
        in_link = 0
        opened.subtract(name for name, _ in stack[index:])
        del stack[index:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            run.append(text)
            if in_link:
                linked += len(text.strip())

    while True:
        found = tags.next(at)
        add(page[at : found[0] if found else len(page)])
        if not found:
            break
        _, at, end, tag, attributes = found
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if end else 1
            elif tag in ("br", "img", "wbr"):
                run.append(" " if tag == "br" else "")
            continue
        if end:
            for index in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[index][0] == tag:
                    close_to(index)
                    break
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = closing.end() if closing else len(page)
            if tag in ("textarea", "iframe", "video", "object"):
                flush()
            continue
        if tag in CLOSES_P and opened["p"]:
            for index in range(len(stack) - 1, 0, -1):
                if stack[index][0] == "p":
                    close_to(index)
                    break
                if stack[index][0] in ("td", "th", "li", "article", "div", "section"):
                    break
        siblings = SIBLINGS.get(tag, ())
        for index in range(len(stack) - 1, 0, -1) if any(opened[name] for name in siblings) else ():
            if stack[index][0] in siblings:
                close_to(index)
                if tag != "tr" or not any(s[0] in ("td", "th", "tr") for s in stack[index - 1 :]):
                    break
            if index < len(stack) and stack[index][0] in ("ul", "ol", "dl", "table", "select", "article", "div"):
                break
        flush()
        if tag in VOID:
            continue
        node = Node(tag, stack[-1][1], attributes)
        nodes.append(node)
        stack.append((tag, node))
        opened[tag] += 1
    flush()
    for number, node in enumerate(nodes):
        node.number = number
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node; sums over subtrees are taken from the last node to the first."""
    n = len(nodes)
    parent = np.array([node.parent.number if node.parent else 0 for node in nodes])
    own = np.array([[len(x.text), x.linked, x.text.count(",") + x.text.count("."), x.text.count(" ") + bool(x.text)] for x in nodes], float)
    total = np.c_[own, np.ones(n), [x.tag == "p" for x in nodes], [x.tag == "#text" for x in nodes]]
    for number in range(n - 1, 0, -1):
        total[parent[number]] += total[number]
    above = np.zeros((n, len(WORDS) + 5))
    self_groups = np.array([x.groups for x in nodes], float)
    roles = np.array([TAG_GROUP.get(x.tag, -1) for x in nodes])
    marks = np.stack([roles == 0, np.isin(roles, (3, 4, 5)), roles == 6, roles == 7, [x.hidden > 0 for x in nodes]], 1)
    for number in range(1, n):
        above[number] = above[parent[number]] + np.r_[self_groups[parent[number]], marks[parent[number]]]
    kids = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    tag = np.zeros((n, len(TAGS)))
    tag[np.flatnonzero(roles >= 0), roles[roles >= 0]] = 1
    lead = np.cumsum(own[:, 0]) - own[:, 0]
    page = max(1.0, total[0, 0])
    up = total[parent]
    # How a node's subtree compares with its siblings', and what a leaf's parent element is.
    return np.c_[
        tag, tag[parent], self_groups, self_groups[parent], above, marks[:, 4],
        [x.depth for x in nodes], np.log1p(total[:, 0]), total[:, 1] / np.maximum(total[:, 0], 1), total[:, 2] / np.maximum(total[:, 3], 1),
        total[:, 0] / np.maximum(total[:, 4], 1), total[:, 0] / page, total[:, 5], kids, lead / page, (lead + total[:, 0]) / page,
        kids[parent], total[:, 0] / np.maximum(up[:, 0], 1), up[:, 5], up[:, 1] / np.maximum(up[:, 0], 1), np.log1p(up[:, 0]),
    ]


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, over binned features."""

    def __init__(self, edges: list[list[float]], trees: list[list[tuple]], start: float):
        self.edges, self.trees, self.start = edges, trees, start

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])).tolist() for c in x.T]
        # Columns of few values are split between them all.
        for n, column in enumerate(x.T):
            if len(values := np.unique(column)) <= BINS:
                edges[n] = ((values[1:] + values[:-1]) / 2).tolist()
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1).astype(np.int16)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = float(np.log(share / (1 - share)))
        score, trees = np.full(len(y), start), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: list[tuple] = []
            level = [(np.arange(len(y)), 0)]
            tree.append(())
            while level:
                rows, at = level.pop()
                depth = at.bit_length() if at else 0
                g, h = gradient[rows], weight[rows]
                best = (1e-3, -1, 0)
                if len(rows) > 20 and (at + 1).bit_length() <= DEPTH:
                    whole = g.sum() ** 2 / (h.sum() + 1)
                    for column in range(x.shape[1]):
                        size = len(edges[column]) + 1
                        if size > 1:
                            gs = np.cumsum(np.bincount(binned[rows, column], g, size))[:-1]
                            hs = np.cumsum(np.bincount(binned[rows, column], h, size))[:-1]
                            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                            gain[(hs < 1) | (h.sum() - hs < 1)] = 0
                            if gain.max() > best[0]:
                                best = (float(gain.max()), column, int(gain.argmax()))
                while len(tree) <= 2 * at + 2:
                    tree.append(())
                if best[1] < 0:
                    value = float(RATE * g.sum() / (h.sum() + 1))
                    tree[at] = (-1, 0.0, value)
                    score[rows] += value
                else:
                    left = binned[rows, best[1]] <= best[2]
                    tree[at] = (best[1], float(edges[best[1]][best[2]]), 0.0)
                    level += [(rows[left], 2 * at + 1), (rows[~left], 2 * at + 2)]
            trees.append(tree)
        return cls(edges, trees, start)

    def chance(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            todo = [(np.arange(len(x)), 0)]
            while todo:
                rows, at = todo.pop()
                column, edge, value = tree[at]
                if column < 0:
                    score[rows] += value
                elif len(rows):
                    left = x[rows, column] <= edge
                    todo += [(rows[left], 2 * at + 1), (rows[~left], 2 * at + 2)]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def decode(nodes: list[Node], chance: np.ndarray) -> list[str]:
    """Blocks of the likeliest labelling in which every accepted node has an accepted parent."""
    chance = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = np.log(chance).tolist(), np.log(1 - chance).tolist()
    best = yes[:]
    for node in reversed(nodes):
        own = node.number
        if node.parent:
            up = node.parent.number
            no[up] += no[own]
            best[up] += max(best[own], no[own])
    taken = [False] * len(nodes)
    for node in nodes:
        own = node.number
        taken[own] = (node.parent is None or taken[node.parent.number]) and (node.parent is None or best[own] > no[own])
    return [node.text for node in nodes if taken[node.number] and node.tag == "#text"]


def _blocks_of(nodes: list[Node]) -> tuple[list[tuple[str, str]], list[str]] | None:
    """Main blocks with their tags, and the other texts, of a page that marks its article."""
    article = next((x for x in nodes if x.tag == "article"), None)
    if article is None:
        return None
    main, rest = [], []
    for node in nodes:
        if node.tag == "#text":
            up = node.parent
            while up is not None and up is not article:
                up = up.parent
            if up is article:
                main.append((node.parent.tag if node.parent.tag in ("h1", "h2", "li", "blockquote") else "p", node.text))
            else:
                rest.append(node.text)
    return main, rest


def layout(main: list[tuple[str, str]], rest: list[str], others: list[str], rng: random.Random) -> str:
    """The blocks in a generated page, its main text marked. ``others``: texts of other pages."""
    pick, chance = rng.choice, rng.random
    say = lambda n=1: " ".join(pick(rest or ["x"]) for _ in range(n))
    quote = lambda t: html.escape(t, quote=False)

    def box(tag: str, name: str, body: str) -> str:
        attribute = pick(("class", "id", "class"))
        return f'<{tag} {attribute}="{name}">{body}</{tag}>' if name else f"<{tag}>{body}</{tag}>"

    def links(k: int) -> str:
        words = say(3).split() or ["x"]
        return "".join(f'<li><a href="/{n}">{quote(pick(words))}</a></li>' for n in range(k))

    nav = box(pick(("nav", "div", "ul")), pick(("", "menu", "navbar", "main-nav", "breadcrumbs")), f"<ul>{links(rng.randint(2, 9))}</ul>")
    header = box(pick(("header", "div")), pick(("site-header", "masthead", "header", "topbar")), f"<div>{quote(say())}</div>{nav}")
    footer = box(pick(("footer", "div")), pick(("footer", "site-footer", "legal")), f"&copy; {quote(say(2))}<p>{quote(say())}</p>")
    side = pick((f"<h3>{quote(say())}</h3><ul>{links(4)}</ul><p>{quote(say(2))}</p>", quote(say(2)), f"<p>{quote(say())}</p>"))
    side = box("aside", "", side) if chance() < 0.3 else box(pick(("aside", "div", "section")), pick(("sidebar", "widget related", "right-rail", "popular")), side)
    advert = box(pick(("div", "aside", "section")), pick(("ad", "ads", "advert", "sponsored", "promo-banner")), f"<p>{quote(pick(others))}</p>")
    notice = box(pick(("div", "section", "p")), pick(("cookie-notice", "notice", "consent", "alert gdpr")), quote(say(pick((1, 3)))) + pick(("", "<button>OK</button>")))
    form = f'<form class="{pick(("search", "newsletter", "login", "contact"))}"><label>{quote(say())}</label><input name="q"><p>{quote(say())}</p><button>{quote(say())}</button></form>'
    reader = "".join(
        box(pick(("div", "li", "article")), pick(("comment", "comment-body", "reply")), f"<b>{quote(say()[:12])}</b><p>{quote(pick(others))}</p>")
        for _ in range(rng.randint(1, 5))
    )
    comments = box(pick(("section", "div", "ol")), pick(("comments", "comment-list", "discussion", "reader-comments")), f"<h2>{quote(say())}</h2>{reader}")
    body = ""
    items = ""
    for n, (tag, text) in enumerate(main):
        open_b = "<b>" if chance() < 0.05 else ""
        tag = pick(("p", "p", "blockquote", "h2", "div")) if tag == "p" and chance() < 0.2 else tag
        tag = "li" if tag == "p" and chance() < (0.6 if items else 0.08) else tag
        own = f"<{tag}>{open_b}{MARK}{quote(text)}" + ("" if chance() < 0.1 and tag == "p" else f"</{tag}>")
        if tag == "li":
            items += own
            continue
        body += (f"<ul>{items}</ul>" if items else "") + own
        items = ""
        if n and chance() < 0.15:
            body += pick((advert, form, side, notice))
    body += f"<ul>{items}</ul>" if items else ""
    wrap = pick(("article", "main", "div", "div", "section", "td", ""))
    name = pick(("", "content", "post-content", "entry", "article-body", "story", "page", "container"))
    if chance() < 0.4:
        body += comments
    body = {"td": f"<table><tr><td>{nav}</td><td>{body}</td></tr></table>", "": body}.get(wrap) or box(wrap, name if wrap == "div" or chance() < 0.5 else "", body)
    if chance() < 0.3:
        body = box("div", pick(("wrapper", "page", "container", "main")), body + (side if chance() < 0.5 else ""))
    parts = [p for p in (notice, header if chance() < 0.6 else nav, advert) if chance() < 0.6]
    after = [p for p in (form, side, comments, advert, footer) if chance() < 0.5]
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(parts)}{body}{''.join(after)}</body></html>"


def _labels(nodes: list[Node], is_main) -> np.ndarray:
    """A node leads to main text if a leaf below it is main."""
    out = np.zeros(len(nodes))
    for node in reversed(nodes):
        if node.tag == "#text" and is_main(node):
            out[node.number] = 1
        if node.parent and out[node.number]:
            out[node.parent.number] = 1
    return out


def train(pages: list[str]) -> Boosted:
    """Trees from the pages that mark their article, as they are and with the mark and all names taken
    away, and in generated layouts, some of them also without names.

    Without such pages the layouts are filled with plain words.
    """
    rng = random.Random(5)
    parsed = [parse(p) for p in pages]
    known = [(nodes, got) for nodes in parsed if (got := _blocks_of(nodes)) and got[0]]
    if not known:
        words = [(("p", f"Plain sentence number {n}, with some words in it."), f"item {n}") for n in range(40)]
        known = [([], ([w for w, _ in words], [r for _, r in words]))]
    others = [t for _, (main, _) in known for _, t in main] or ["x"]
    x, y = [], []
    for nodes, (main, rest) in known:
        if nodes:
            article = next(n for n in nodes if n.tag == "article")
            inside = {id(article)}
            for node in nodes:
                if node.parent and id(node.parent) in inside:
                    inside.add(id(node))
            label = _labels(nodes, lambda n, inside=inside: id(n) in inside)
            # The page, and again without what names its text or any other part.
            for neutral in ([], nodes):
                for node in neutral:
                    node.tag, node.groups = "div" if node is article else node.tag, [0] * len(WORDS)
                x.append(features(nodes))
                y.append(label)
        for _ in range(LAYOUTS if nodes else 200):
            start = rng.choice((0, rng.randrange(len(main))))
            some = main[start : start + rng.randint(1, LAYOUT_BLOCKS)]
            if rng.random() < 0.3:
                # Short blocks, as headings, list items and captions have them.
                some = [(tag, " ".join(text.split()[: rng.randint(1, 8)])) for tag, text in some]
            made = parse(layout(some, rest, others, rng))
            label = _labels(made, lambda n: MARK in n.text)
            for node in made:
                node.text = node.text.replace(MARK, "").strip()
            x.append(features(made))
            y.append(label)
            if rng.random() < NAMELESS:
                for node in made:
                    node.groups = [0] * len(WORDS)
                x.append(features(made))
                y.append(label)
    return Boosted.fit(np.concatenate(x), np.concatenate(y))


def fit(pages: DataFrame, page_id: str = "page_id", page: str = "html") -> Boosted:
    """Train in one task on ``SAMPLE_PAGES`` pages, the same ones on every run."""
    session_of(pages)
    rows = rename_free(pages, {"page_id": page_id, "html": page}).where("html is not null")
    sample = rows.select("page_id", "html", F.xxhash64("page_id", F.substring("html", 1, 200)).alias("o")).orderBy("o", "page_id").limit(SAMPLE_PAGES)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        import pickle

        return pd.DataFrame([{"model": pickle.dumps(train(part.sort_values(["o", "page_id"])["html"].tolist()))}])

    found = sample.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(one, "model binary").first()
    import pickle

    return pickle.loads(bytes(found["model"])) if found else train([])


def extract(pages: DataFrame, model: Boosted, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row and whole page: main blocks joined by line feeds.

    Null and empty pages, and pages without main text, give the empty text. Repeated rows and null
    ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            parsed = [parse(p or "") for p in part["html"].to_pylist()]
            chance = model.chance(np.concatenate([features(nodes) for nodes in parsed]))
            ends = np.cumsum([len(nodes) for nodes in parsed])
            text = ["\n".join(decode(nodes, chance[e - len(nodes) : e])) for nodes, e in zip(parsed, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["page_id"].combine_chunks(), part["url"].combine_chunks(), pa.array(text, pa.string())], ["page_id", "url", "text"]
            )

    rows = rename_free(pages, {"page_id": page_id, "url": url, "html": page})
    return map_arrow(rows, run, "page_id long, url string, text string")
