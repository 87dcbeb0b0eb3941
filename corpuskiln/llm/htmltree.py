"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block-level elements and text blocks. Each node is content or not; node potentials come
from tags, class and id words and the text's shape, pair potentials join parent and child. Messages passed up the
tree and down again (sum-product) give each node's exact marginal; blocks whose marginal of being content reaches
one half are the main text. The potentials are fitted to labelled pages by maximum likelihood, with the same
messages.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Collection
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches

#: Elements that flow inside a block of text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is never text of the page.
SILENT = frozenset("script style template noscript title textarea select iframe object svg canvas audio video".split())
#: Of these, the ones that last to the end of the page if no end tag follows; others are then no more than a tag.
RAW = frozenset("script style title textarea".split())
#: Start tags that end an open element of these names (in the same container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav header footer body html form blockquote td th fieldset".split())
_OPEN = re.compile(r"<(?:(?P<c>!--)|(?P<d>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/><]*))")
#: What ends a tag or begins a quoted value in it.
_STOP = re.compile(r""">|=\s*+(["'])""")
_MARK = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Hashed node features.
WIDTH = 1 << 12


@dataclass
class Tree:
    """Nodes in page order; node 0 is the root. A block has text, an element none."""

    parent: list[int] = field(default_factory=lambda: [-1])
    level: list[int] = field(default_factory=lambda: [0])
    features: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    text: list[str | None] = field(default_factory=lambda: [None])

    def add(self, parent: int, features: tuple[int, ...], text: str | None) -> int:
        self.parent.append(parent)
        self.level.append(self.level[parent] + 1)
        self.features.append(features)
        self.text.append(text)
        return len(self.parent) - 1


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % WIDTH


@lru_cache(50_000)
def element_features(tag: str, marks: str) -> tuple[int, ...]:
    """Features of an element: its tag and the words of its class, id and role."""
    words = {w.lower() for w in re.findall(r"[A-Za-z]{2,}", re.sub(r"([a-z])([A-Z])", r"\1 \2", marks))}
    return tuple(sorted({_hash(f"tag {tag}"), *(_hash(f"mark {w}") for w in words)}))


def block_features(text: str, link_chars: int, tag: str) -> tuple[int, ...]:
    """Features of a block: the element around it, its length, how much of it is links, its punctuation."""
    n = len(text)
    share = min(3, 4 * link_chars // (n + 1))
    stops = min(3, sum(text.count(c) for c in ".!?;,"))
    found = [f"in {tag}", f"length {min(n, 1000).bit_length()}", f"links {share}", f"stops {stops}", f"links {share} length {min(n, 1000).bit_length() // 2}"]
    if "©" in text:
        found.append("copyright")
    return tuple(sorted({_hash(x) for x in found}))


class Scanner:
    """Finds the ends of a page's tags in linear time, however long values are."""

    def __init__(self, page: str):
        self.page, self.none = page, set()  # characters that don't follow any more
        self.ends: dict[str, dict[int, int]] = {}

    def find(self, c: str, position: int) -> int:
        at = -1 if c in self.none else self.page.find(c, position)
        if at < 0:
            self.none.add(c)
        return at

    def tag_end(self, position: int) -> int:
        """Behind the > of the tag whose name ends at position; a quote that is never closed counts as no quote. -1 if
        there is no >."""
        at = position
        while ">" not in self.none and (m := _STOP.search(self.page, at)) is not None:
            if m[1] is None:
                return m.end()
            if (at := self.find(m[1], m.end()) + 1) == 0:
                break
        return self.find(">", position) + 1 or -1

    def inside_end(self, name: str, position: int) -> int:
        """Behind the end tag that belongs to the start tag whose name ends at position; -1 if it has none."""
        if name not in self.ends:
            found, opened, at = {}, [], 0
            tag = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.I)
            while (m := tag.search(self.page, at)) is not None:
                at = self.tag_end(m.end())
                if at < 0:
                    break
                if not m[1]:
                    if not (name == "svg" and self.page[at - 2] == "/"):
                        opened.append(m.end())
                elif opened:
                    found[opened.pop()] = at
            self.ends[name] = found
        return self.ends[name].get(position, -1)


def parse(page: str) -> Tree:
    """The tree of a page, however malformed: unknown end tags are ignored, lost ones implied."""
    tree, stack, names = Tree(), [0], ["#root"]
    open_at: dict[str, list[int]] = {}  # where elements of a name stand on the stack, so that none is searched for
    buffer: list[str] = []
    links = at = anchor = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                tree.add(stack[-1], block_features(text, links, names[-1]), text)
            buffer.clear()
        links = 0

    def put(piece: str) -> None:
        nonlocal links
        if piece:
            buffer.append(piece)
            if anchor:
                links += len(piece)

    def close(count: int) -> None:
        flush()
        for x in names[-count:]:
            open_at[x].pop()
        del stack[-count:], names[-count:]

    def last_open(some: Collection[str]) -> int:
        return max((open_at[x][-1] for x in some if open_at.get(x)), default=0)

    position = 0
    scanner = Scanner(page)
    while (m := _OPEN.search(page, position)) is not None:
        if m["c"]:
            end = page.find("-->", m.end()) + 3
            end = end if end > 2 else len(page)
        elif m["d"]:
            end = scanner.find(">", m.end()) + 1
        else:
            end = scanner.tag_end(m.end())
        if end <= 0:  # not a tag
            position = m.end()
            continue
        put(page[at : m.start()])
        at = position = end
        name = (m["name"] or "").lower()
        if not name:
            continue
        ending = bool(m["end"])
        if name == "br":
            buffer.append(" ")
        elif name in INLINE:
            if name == "a":
                anchor = 0 if ending else 1
        elif not ending and name in SILENT:
            flush()
            if name in RAW:
                done = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, position)
                at = position = done.end() if done else len(page)
            elif not (name == "svg" and page[end - 2] == "/"):
                at = position = max(position, scanner.inside_end(name, m.end()))
        elif ending:
            if open_at.get(name):
                close(len(names) - open_at[name][-1])
            else:
                flush()
            anchor = 0
        else:
            flush()
            anchor = 0
            ends = CLOSES.get(name, {"p"} if name in SCOPES or re.fullmatch("h[1-6]|pre|hr|dl", name) else ())
            while (i := last_open(ends)) and i > last_open([x for x in SCOPES if x not in ends]):
                close(len(names) - i)
                if name not in ("tr", "td", "th"):
                    break
            if name not in VOID:
                marks = " ".join(x for t in _MARK.findall(page, m.end(), end - 1) for x in t)
                stack.append(tree.add(stack[-1], element_features(name, marks), None))
                open_at.setdefault(name, []).append(len(names))
                names.append(name)
    put(page[at:])
    flush()
    return tree


@dataclass
class Potentials:
    """Log potentials: of state 1 for each node feature; of (kind, parent's state, child's state) for each pair, where
    kind is 0 for an element and 1 for a block."""

    node: np.ndarray
    pair: np.ndarray


class Forest:
    """Several trees, laid out for passing messages level by level."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees])
        first = np.cumsum(sizes) - sizes
        self.first, self.n = first, int(sizes.sum())
        self.parent = np.concatenate([np.array(t.parent) + f for t, f in zip(trees, first, strict=True)])
        level = np.concatenate([t.level for t in trees])
        order = np.argsort(level, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(level[order])) + 1)
        self.block = np.array([x is not None for t in trees for x in t.text], np.int64)
        self.at = np.array([f for t in trees for x in t.features for f in x], np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(x) for t in trees for x in t.features])

    def pass_messages(self, p: Potentials) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each node (n, 2) and of each node with its parent (n, parent's state, own state)."""
        unary = np.zeros((self.n, 2))
        unary[:, 1] = np.bincount(self.owner, weights=p.node[self.at], minlength=self.n)
        pair = p.pair[self.block]
        up = np.zeros((self.n, 2))  # to the parent
        inside = unary  # own potential and the messages from below
        for some in self.levels[:0:-1]:
            up[some] = _logsum(pair[some] + inside[some][:, None, :], 2)
            np.add.at(inside, self.parent[some], up[some])
        total = inside.copy()
        for some in self.levels[1:]:
            above = total[self.parent[some]] - up[some]
            total[some] = inside[some] + _logsum(pair[some] + above[:, :, None], 1)
        both = np.zeros((self.n, 2, 2))
        rest = np.concatenate(self.levels[1:]) if len(self.levels) > 1 else np.zeros(0, np.int64)
        joint = pair[rest] + (total[self.parent[rest]] - up[rest])[:, :, None] + inside[rest][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True, initial=-np.inf))
        both[rest] = joint / joint.sum(axis=(1, 2), keepdims=True)
        own = np.exp(total - total.max(axis=1, keepdims=True))
        return own / own.sum(axis=1, keepdims=True), both


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(pages: list[tuple[str, list[str]]], *, steps: int = 150, l2: float = 2e-3) -> Potentials:
    """Potentials of highest likelihood for labelled pages: (html, texts of its content blocks).

    An element's state is whether content is inside it. The gradient is what is seen less what the messages expect.
    """
    trees = [parse(page) for page, _ in pages]
    forest = Forest(trees)
    state = np.array([x is not None and x in set(good) for t, (_, good) in zip(trees, pages, strict=True) for x in t.text], np.int64)
    for some in forest.levels[:0:-1]:
        np.maximum.at(state, forest.parent[some], state[some])
    n = len(pages)
    seen = np.bincount(forest.at, weights=state[forest.owner], minlength=WIDTH)
    has = np.bincount(forest.at, minlength=WIDTH) > 0
    below = np.concatenate(forest.levels[1:])
    seen_pair = np.zeros((2, 2, 2))
    np.add.at(seen_pair, (forest.block[below], state[forest.parent[below]], state[below]), 1)
    p = Potentials(np.zeros(WIDTH), np.zeros((2, 2, 2)))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (p.node, p.pair)]
    for t in range(1, steps + 1):
        own, both = forest.pass_messages(p)
        g_node = (seen - np.bincount(forest.at, weights=own[forest.owner, 1], minlength=WIDTH)) / n - l2 * p.node
        g_pair = seen_pair.copy()
        for kind in (0, 1):
            g_pair[kind] -= both[below][forest.block[below] == kind].sum(axis=0)
        for x, g, (m, v) in zip((p.node, p.pair), (g_node * has, g_pair / n - l2 * p.pair), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p


def extract_pages(pages: list[str | None], p: Potentials) -> list[str]:
    """The main text of each page: its content blocks, joined by empty lines."""
    trees = [parse(x or "") for x in pages]
    if not trees:
        return []
    forest = Forest(trees)
    content = forest.pass_messages(p)[0][:, 1] >= 0.5
    return ["\n\n".join(x for x, good in zip(t.text, content[f : f + len(t.text)].tolist(), strict=True) if good and x) for t, f in zip(trees, forest.first.tolist(), strict=True)]


def labelled_pages(n: int = 240, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Generated pages of many layouts, with the texts of their content blocks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou" if i % 2 else "bcdfghlmnprstv") for i in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + r.choice([".", ".", ".", "?", "!"])
    para = lambda: " ".join(sentence(1, 25) for _ in range(r.choice([1, 1, 2, 4, 7])))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def menu() -> str:
        items = [link() for _ in range(r.randint(3, 9))]
        tag = r.choice(['nav', 'nav class="main-nav"', 'div class="menu"', 'div id="navigation"', 'ul class="breadcrumb"', 'div class="navbar topnav"', 'div role="navigation"', 'div class="links tags"'])
        inner = r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<li>{x}" for x in items)])
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def boxed(tags: list[str], inner: str) -> str:
        tag = r.choice(tags)
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def prose(k: int) -> str:
        return "".join(r.choice([f"<p>{para()}</p>", f"<p>{para()}", f"<div>{para()}</div>", f"<h3>{words(1, 4)}</h3>", para() + "<br>"]) for _ in range(k))

    def advert() -> str:
        return boxed(['div class="ad"', 'div class="advert"', 'div id="ads-top"', 'div class="sponsored promo"', 'aside class="banner advertisement"', 'section class="sponsor"', 'div class="adbox"'], r.choice([para(), sentence(3, 12), f"<p>{para()}</p>", link()]))

    def notice() -> str:
        return boxed(['div class="cookie-notice"', 'div id="cookies"', 'div class="notice"', 'div class="alert banner"', 'div class="consent popup"', 'div class="newsletter subscribe"', 'div class="disclaimer notice"', 'div class="message notification"'], r.choice([f"<p>{para()}</p>", para(), para() + "<button>ok</button>"]))

    def form() -> str:
        return boxed(['form', 'form class="search"', 'form action="/s" id="login"'], f"<label>{words(1, 3)}</label><input name=q><p>{sentence(2, 14)}</p><button>{words(1, 2)}</button>")

    def side() -> str:
        return boxed(["aside", 'aside class="sidebar"', 'div class="sidebar"', 'div id="right-col" class="widget"', 'section class="related"', 'div class="related-posts"', 'div class="share social"'], f"<h3>{words(1, 3)}</h3>" + r.choice([prose(2), "<ul>" + "".join(f"<li>{link()}" for _ in range(4)) + "</ul>"]))

    def head() -> str:
        return boxed(["header", 'header class="site-header"', 'div class="header"', 'div id="masthead"', 'div class="topbar"', 'div class="site-title logo"'], r.choice([f"<h1>{words(1, 3)}</h1>", f"<h2>{link()}</h2><p>{sentence(2, 12)}</p>", para()]) + (menu() if r.random() < 0.5 else ""))

    def foot() -> str:
        return boxed(["footer", 'footer class="site-footer"', 'div class="footer"', 'div id="footer"', 'div class="copyright bottom"'], r.choice([f"&copy; {words(1, 3)} &middot; {sentence(2, 12)}", f"<p>{para()}</p>", link() + " " + link()]))

    def comments() -> str:
        one = lambda: boxed(['div class="comment"', 'li class="comment"', "p", 'article class="comment-body"', 'div class="reply"'], r.choice([para(), f"<b>{word()}</b> {para()}", f"<p>{para()}</p>"]))
        return boxed(['div class="comments"', 'section id="comments"', 'section class="comment-list"', 'div id="disqus" class="discussion replies"', 'ol class="commentlist"', 'div class="user-comments responses"'], f"<h3>{words(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))

    out = []
    for _ in range(n):
        good: list[str] = []

        def block(tag: str, text: str, good: list[str] = good) -> str:
            good.append(text)
            close = "" if tag in ("p", "li") and r.random() < 0.2 else f"</{tag}>"
            return f"<{tag}>{text}{close}"

        body = [block("h1", words(1, 10))] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                body.append(block("p", para()))
            elif kind < 0.78:
                body.append(block(r.choice(["h2", "h3"]), words(1, 6)))
            elif kind < 0.86:
                body.append("<ul>" + "".join(block("li", sentence(2, 15)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.90:
                body.append("<blockquote>" + block("p", para()) + "</blockquote>")
            elif kind < 0.93:
                body.append("<table><tr>" + "".join(block("td", words(1, 5)) for _ in range(3)) + "</tr></table>")
            elif kind < 0.95:
                body.append(block("pre", words(3, 20)))
            else:
                body.append(r.choice([advert, side, notice, form])())
        shell = r.choice([["article"], ["main"], ["article"], ['div class="content"'], ['div id="main"', 'div class="post entry"'], ['div class="article-body"'], ["main", 'section class="story text"'], ['div class="wrapper"', "article"], ['div id="page"', 'div class="page-content"']])
        main = "".join(f"<{t}>" for t in shell) + "".join(body) + "".join(f"</{t.split()[0]}>" for t in reversed(shell))
        before = [f() for f in (head, menu, menu, advert, notice, form) if r.random() < 0.5]
        after = [f() for f in (side, side, comments, comments, advert, form, notice, foot, foot) if r.random() < 0.5]
        r.shuffle(before)
        whole = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(before) + main + "".join(after) + ("</body></html>" if r.random() < 0.9 else "")
        # equal texts outside the content would be labelled by mistake: keep pages without them
        texts = [x for x in parse(whole).text if x]
        good = [" ".join(html.unescape(x).split()) for x in good]
        if len(set(texts)) == len(texts):
            out.append((whole, good))
    return out


_fitted: dict[int, Potentials] = {}


def fitted(n: int = 240) -> Potentials:
    """Potentials fitted to labelled_pages(n), once a process."""
    if n not in _fitted:
        _fitted[n] = fit(labelled_pages(n))
    return _fitted[n]


def extract(pages: DataFrame, *, potentials: Potentials | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """page id, the columns in keep, text (empty if there is none), n_chars (code points) of each row.

    Null and empty pages give an empty text. Rows stand for themselves: null and repeated ids and equal pages are fine,
    an empty table gives no rows. Columns that aren't asked for are ignored, whatever their names; a column in keep that
    is called like a result, or twice, is refused. The potentials (of fixed size) are broadcast; pages stay where they
    are.
    """
    if len({*keep, id_col, "text", "n_chars"}) < len(keep) + 3:
        raise ValueError(f"columns to keep must differ from one another and from {id_col}, text and n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(potentials or fitted())
    rows = pages.select(*[F.col(f"`{c}`") for c in (id_col, *keep)], F.col(f"`{html_col}`").alias("_html"))

    def make():
        p = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sources, texts = batch.column(batch.num_columns - 1).to_pylist(), []
            for i in range(0, len(sources), 200):
                texts += extract_pages(sources[i : i + 200], p)
            others = [batch.column(i) for i in range(batch.num_columns - 1)]
            return pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

        return one

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, *keep)]
    return map_batches(rows, make, ", ".join([*kinds, "text string", "n_chars bigint"]))
