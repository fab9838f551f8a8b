"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded over the tree.

A page's tags are read into a tree of blocks (tag soup allowed).  Every node gets features: its tag, depth
and place among its siblings, text, tags and links of its subtree, punctuation, its share of the page,
tokens of its attributes and those of its ancestors.  Boosted trees give each node the probabilities of
three states: ``main`` (its text is article text), ``path`` (it holds article text below, but its own is
not), ``drop``.  Decoding picks the states of the highest joint probability under the rules that
below ``drop`` there is only ``drop`` and below ``main`` no ``path``, so no ancestor contradicts a descendant.

Training data are a bounded sample of the pages themselves (``max_pages``): pages whose own markup names the
article (``article``, ``main``, ``role=main`` and the like), and variants of them in which the article and the
boilerplate go by other names, or by none, and comments, side bars, notices, forms and headers are put in.

Reading takes time linear in the page: each character is passed by a bounded number of scans, and open elements are
found by name.  A tag that the page's end cuts off is dropped; an unclosed head ends at the first block, and
any other silent element (button, svg, ...) with the element that holds it.

Defined results: null, empty and tagless pages without article text give an empty text; very long pages
are read whole; repeated rows get equal results; of equally probable labellings one with more article text
wins; where no page of the sample names its article all texts are empty; other columns play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, in_slices

# HTML's block elements, elements without content, and elements that never hold prose.
BLOCKS = frozenset("html body div p article section main header footer nav aside form fieldset figure figcaption h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre address details summary dialog menu center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video select textarea button datalist".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BOUND = frozenset("ul ol dl table body html".split())
GOOD = frozenset("article articlebody body bodytext content contents entry hentry main maincontent page post postbody posts prose story text blog news read".split())
BAD = frozenset("ad ads adbox advert advertisement advertorial alert author banner bar bio breadcrumb breadcrumbs byline bottom comment comments commentlist consent contact cookie cookies copyright credits disclaimer discussion disqus feedback foot footer footnote gdpr head header hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice notices overlay pagination paging pager popup popular privacy promo promoted promotion rating reader recommended related replies reply respond search share sharing shares sidebar sidebars side signup skip social sponsor sponsored subscribe tags teaser toolbar top topbar trending widget widgets".split())
GROUPS = ("article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "table thead tbody tfoot tr td th caption", "nav", "aside", "header", "footer", "form fieldset", "blockquote pre figure figcaption", "html body", "span a b i em strong small")
GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
FENCES = frozenset("nav aside header footer form".split())
DROP, PATH, MAIN = 0, 1, 2

# Attributes up to the closing bracket: quotes count right after "=" only, and no place is tried twice.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Nodes in page order (0 is the page itself) and its text in order."""

    tag: list[str]
    parent: list[int]
    tokens: list[tuple[str, ...]]
    inline: list[bool]
    text: list[tuple[int, str, bool]]  # node, text, inside a link; node -1 ends a block


class Reader:
    """Builds a page from its tags; ``stack`` holds the open nodes, ``where`` their depths by tag name."""

    def __init__(self):
        self.page = Page(["#page"], [-1], [()], [False], [])
        self.stack, self.where, self.blocks = [0], defaultdict(list), [0]
        self.link = 0
        self.silent: list[str] = []  # open elements from a silent one on
        self.within = Counter()  # their names

    def text(self, text: str) -> None:
        if text and not self.silent:
            self.page.text.append((self.stack[-1], text, self.link > 0))

    def ends_block(self) -> None:
        self.page.text.append((-1, "", False))

    def pop(self, depth: int) -> None:
        """Closes all nodes from that depth on."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.where[self.page.tag[node]].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def unmute(self) -> None:
        self.silent.clear()
        self.within.clear()

    def close(self, name: str) -> None:
        if self.silent:
            if self.within[name]:
                while True:
                    last = self.silent.pop()
                    self.within[last] -= 1
                    if last == name:
                        return
            if not self.where[name]:
                return
            self.unmute()
        if name == "a":
            self.link = max(0, self.link - 1)
        if name in BLOCKS:
            if self.where[name]:
                self.pop(self.where[name][-1])
            self.ends_block()
            self.link = 0
        elif self.where[name] and self.where[name][-1] > self.blocks[-1]:
            self.pop(self.where[name][-1])

    def open(self, name: str, attributes: str) -> None:
        alone = name in VOID or attributes.endswith("/")
        block = name in BLOCKS
        if self.silent == ["head"] and block:
            self.unmute()
        if self.silent or name in SILENT:
            if not alone:
                self.silent.append(name)
                self.within[name] += 1
            return
        if name in VOID:
            if name in ("br", "hr"):
                self.ends_block()
            return
        if name == "a":
            self.link += 1
        if block:
            self.ends_block()
            closes = CLOSES.get(name, ())
            bound = max((self.where[t][-1] for t in BOUND if self.where[t]), default=0)
            last = max((self.where[t][-1] for t in closes if self.where[t]), default=0)
            if last > bound:
                self.pop(last)
            elif self.page.tag[self.stack[self.blocks[-1]]] == "p":
                self.pop(self.blocks[-1])
        named = tuple(t.lower() for x in ATTRIBUTE.findall(attributes) for v in x[1:] for t in TOKEN.findall(v)) if attributes else ()
        if (block or named) and not alone:
            self.where[name].append(len(self.stack))
            if block:
                self.blocks.append(len(self.stack))
            self.page.tag.append(name)
            self.page.parent.append(self.stack[-1])
            self.page.tokens.append(named)
            self.page.inline.append(not block)
            self.stack.append(len(self.page.tag) - 1)


def parse(page: str | None) -> Page:
    """Reads tags into blocks; inline elements are nodes only if their attributes name them."""
    source, read, at, endless = page or "", Reader(), 0, set()
    while True:
        start = source.find("<", at)
        if start < 0:
            read.text(source[at:])
            break
        following = source[start + 1 : start + 2]
        if not (following.isascii() and following.isalpha()) and following not in ("/", "!", "?"):
            read.text(source[at : start + 1])
            at = start + 1
            continue
        read.text(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            if end < 0:
                break
            at = end + 3
            continue
        m = TAG.match(source, start)
        if m is None:
            # Not a name behind the bracket: up to the next closing one, as comments are; without one the page is cut off.
            end = source.find(">", start)
            if end < 0 or (following not in ("!", "?") and re.match("</?[a-zA-Z]", source[start : start + 3])):
                break
            at = end + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            read.close(name)
        elif name in RAW and not m[3].endswith("/") and name not in endless:
            close = re.compile(f"</{re.escape(name)}\\b[^>]*+>", re.I).search(source, at)
            if close:
                at = close.end()
            elif name in ("script", "style", "textarea"):
                break
            else:
                endless.add(name)
                read.open(name, m[3])
        else:
            read.open(name, m[3])
    return read.page


N_FEATURES = len(GROUPS) + 27


def features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.tag)
    parent = page.parent
    chars, linked, marks = [0] * n, [0] * n, [0] * n
    own = [0] * n
    for node, text, in_link in page.text:
        if node >= 0:
            size = 0 if text.isspace() else len(text)
            chars[node] += size
            own[node] += size
            if in_link:
                linked[node] += size
            marks[node] += len(PUNCTUATION.findall(text))
    tags, paragraphs, items = [1] * n, [t == "p" for t in page.tag], [t == "li" for t in page.tag]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        tags[p] += tags[i]
        paragraphs[p] += paragraphs[i]
        items[p] += items[i]
    depth, good_up, bad_up, fence, inside = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    good, bad, child, place, of_tag = [0] * n, [0] * n, [0] * n, [0] * n, [None] * n
    for i in range(n):
        good[i] = sum(t in GOOD for t in page.tokens[i])
        bad[i] = sum(t in BAD for t in page.tokens[i])
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            good_up[i] = good_up[p] + good[p]
            bad_up[i] = bad_up[p] + bad[p]
            fence[i] = fence[p] + (page.tag[p] in FENCES)
            inside[i] = inside[p] + (page.tag[p] in ("article", "main"))
            place[i] = child[p]
            child[p] += 1
            of_tag[p] = of_tag[p] or {}
            of_tag[p][page.tag[i]] = of_tag[p].get(page.tag[i], 0) + 1
    x = np.zeros((n, N_FEATURES))
    groups = [GROUP_OF.get(t, -1) for t in page.tag]
    has = np.array(groups)
    x[np.flatnonzero(has >= 0), has[has >= 0]] = 1
    up = np.array(parent)
    up[0] = 0
    c, li, mk, tg = (np.array(v, float) for v in (chars, linked, marks, tags))
    kids = np.array(child, float)
    same = np.array([1] + [of_tag[parent[i]][page.tag[i]] for i in range(1, n)], float)
    density = np.divide(li, c, out=np.zeros(n), where=c > 0)
    columns = (
        depth, place, kids, kids[up], np.array(place) / np.maximum(kids[up], 1), same, np.log1p(c), np.log1p(own), density, tg, c / tg,
        mk / np.maximum(c, 1) * 100, paragraphs, items, c / max(c[0], 1), c / np.maximum(c[up], 1), c * np.maximum(kids[up], 1) / np.maximum(c[up], 1),
        good, bad, good_up, bad_up, fence, inside, density[up], has[up], np.array(paragraphs)[up], np.log1p(c[up]),
    )
    for k, v in enumerate(columns):
        x[:, len(GROUPS) + k] = v
    return x


def teacher(page: Page) -> np.ndarray | None:
    """States of a page whose markup names its article; None for others.  An article's own header counts as
    article text if it holds the title."""
    n = len(page.tag)
    titled = [False] * n
    for i in range(n):
        if page.tag[i] in ("h1", "h2") and page.tag[page.parent[i]] == "header":
            titled[page.parent[i]] = True
    roots = [i for i in range(n) if page.tag[i] == "article"] or [i for i in range(n) if page.tag[i] == "main" or "articlebody" in page.tokens[i] or page.tokens[i] == ("main",)]
    roots = roots or [i for i in range(n) if page.tag[i] in ("div", "section") and any(t in ("content", "entry", "post", "story") for t in page.tokens[i]) and not any(t in BAD for t in page.tokens[i])]
    if not roots:
        return None
    state = np.zeros(n, np.int64)
    for i in range(1, n):
        up = state[page.parent[i]]
        fenced = (page.tag[i] in FENCES and not titled[i]) or any(t in BAD for t in page.tokens[i])
        if (i in roots or up == MAIN) and not fenced:
            state[i] = MAIN
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        if state[i] and not state[p]:
            state[p] = PATH
    return state


def variant(page: str, donor: str, rng: np.random.Generator, headed: bool = True) -> str:
    """The page with its article and boilerplate under other names, and with more boilerplate; if ``headed``, also a site header."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    prose = re.findall(r"<p>([^<]{20,400})", donor) or ["Thanks."]
    some = [pick(*prose) for _ in range(3)]
    box = lambda tag, attr, inner: f"<{tag} {attr}>{inner}</{tag}>"
    comments = box("section" if rng.random() < 0.5 else "div", pick('class="comments"', 'id="comments"', 'class="comment-list"', 'id="respond"'), "".join(f'<div class="comment"><p>{t}</p></div>' for t in some))
    side = pick(box("aside", "", f"<h3>{some[0][:30]}</h3><p>{some[1][:80]}</p>"), box("div", pick('class="sidebar"', 'id="sidebar"', 'class="related"'), f"<h3>{some[0][:30]}</h3><ul><li><a href='/'>{some[1][:40]}</a></li></ul><p>{some[2][:90]}</p>"))
    notice = box("div", pick('class="cookie-notice"', 'id="notice"', 'class="alert"', 'class="newsletter"'), f"<p>{some[0]}</p><button>OK</button>")
    form = box("form", 'action="/s"', f"<label>{some[1][:20]}</label><input name=q><p>{some[2][:60]}</p>")
    column = box("div", "", f"<h3>{some[0][:20]}</h3><p>{some[1][:60]}</p><form><input name=q><button>OK</button></form>")
    top = pick(box("header", "", f"<h1>{some[0][:20]}</h1><p>{some[1][:50]}</p>"), box("div", 'id="header"', f"<p>{some[1][:50]}</p>"))
    name = pick("article", "article", "main", 'div class="content"', 'div class="post"', 'div id="main"', 'div class="entry-content"', "div class='story'")
    end = name.split()[0]
    listed = lambda m: pick(m[0], m[0], m[0], f"<ul><li>{m[1]}</li><li>{some[2][:60]}</li></ul>", f"<blockquote><p>{m[1]}</p></blockquote>", f"<h2>{m[1][:40]}</h2><p>{m[1]}</p>", f"<div class='text'><p>{m[1]}</p></div>", f"<table><tr><td>{m[1][:50]}</td></tr></table>")
    page = re.sub(r"<p>([^<]+)</p>", listed if rng.random() < 0.85 else r"<span class='lead'>\1</span><br><br>" if rng.random() < 0.3 else r"\1<br><br>", page)
    if rng.random() < 0.4:  # a short title
        page = re.sub(r"(<h1[^>]*>)([^<]+)", lambda m: m[1] + " ".join(m[2].split()[: pick(1, 2, 4)]), page)
    if rng.random() < 0.15:  # a short article
        page = re.sub(r"(<article[^>]*>.*?<p>.*?</p>).*?</article>", r"\1</article>", page, count=1, flags=re.S)
    if rng.random() < 0.35:  # one of a few words
        few = pick(15, 40, 80)
        page = re.sub(rf"(<article[^>]*>.*?<p>)([^<]{{0,{few}}})[^<]*(</p>)?.*?</article>", r"\1\2\3</article>", page, count=1, flags=re.S)
    if rng.random() < 0.3:
        page = re.sub(r"(<article[^>]*>)\s*(<h1.*?</h1>)", r"\1<header>\2</header>", page, count=1, flags=re.S)
    inner = pick("", comments, notice, form, side)
    page = re.sub(r"<article[^>]*>", f"<{name}>", page).replace("</article>", f"{inner}</{end}>")
    if rng.random() < 0.5:
        page = page.replace("<nav>", f'<div class="{pick("menu", "navbar", "top-nav")}">').replace("</nav>", "</div>")
    if rng.random() < 0.5:
        page = page.replace("<footer>", f'<div {pick("class=footer", "id=footer", "class=copyright")}>').replace("</footer>", "</div>")
    if rng.random() < 0.4:
        page = page.replace(f"<{name}>", f"<div class='{pick('page', 'wrap', 'row', 'container')}'><{name}>")
    return page.replace(f"<{name}>", pick("", top if headed else "") + pick("", side, notice) + f"<{name}>").replace(f"</{end}>", f"</{end}>" + pick("", comments, side, form, column), 1)


def unnamed(page: Page) -> Page:
    """The page with plain boxes for its telling elements, and without attributes."""
    plain = {"article", "main", "section", *FENCES} - {"form"}
    return Page(["div" if t in plain else t for t in page.tag], page.parent, [()] * len(page.tag), page.inline, page.text)


@dataclass(frozen=True)
class Boosted:
    """Per tree, a full binary tree of fixed depth: feature, threshold of inner nodes; leaf values."""

    feature: np.ndarray  # int64[trees, inner]
    limit: np.ndarray  # float64[trees, inner]
    leaf: np.ndarray  # float64[trees, leaves]
    prior: np.ndarray  # float64[3]


def boost(x: np.ndarray, state: np.ndarray, rounds: int = 16, depth: int = 3, rate: float = 0.4, bins: int = 32) -> Boosted:
    """Softmax boosting on histograms: one tree per state and round, Newton leaf values."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    cuts = [np.unique(x[:, f]) if len(np.unique(x[:, f])) <= bins else c for f, c in enumerate(cuts)]
    code = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    prior = np.log((np.bincount(state, minlength=3) + 1) / (n + 3))
    margin = np.tile(prior, (n, 1))
    inner = (1 << depth) - 1
    size = bins + 2
    flat = code + np.arange(width) * size
    feature, limit, leaf = [], [], []
    for _ in range(rounds):
        p = np.exp(margin - margin.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for c in range(3):
            g, h = p[:, c] - (state == c), np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
            at = np.zeros(n, np.int64)
            fs, ls = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for d in range(depth):
                first = (1 << d) - 1
                for node in range(first, first + (1 << d)):
                    mine = np.flatnonzero(at == node)
                    if len(mine) < 20:
                        continue
                    where = flat[mine].ravel()
                    gs = np.bincount(where, np.repeat(g[mine], width), width * size).reshape(width, size).cumsum(1)
                    hs = np.bincount(where, np.repeat(h[mine], width), width * size).reshape(width, size).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    f, b = divmod(int(gain.argmax()), size)
                    if gain[f, b] > 1e-3 and b < len(cuts[f]):
                        fs[node], ls[node] = f, cuts[f][b]
                at = 2 * at + 1 + (x[np.arange(n), fs[at]] > ls[at])
            at -= inner
            value = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + 1)
            margin[:, c] += value[at]
            feature.append(fs)
            limit.append(ls)
            leaf.append(value)
    return Boosted(np.array(feature), np.array(limit), np.array(leaf), prior)


def log_probabilities(model: tuple, x: np.ndarray) -> np.ndarray:
    """log of the states' probabilities, one row per node."""
    feature, limit, leaf, prior = model
    margin, rows = np.tile(prior, (len(x), 1)), np.arange(len(x))
    inner = feature.shape[1]
    for t in range(len(feature)):
        at = np.zeros(len(x), np.int64)
        while at[0] < inner:
            at = 2 * at + 1 + (x[rows, feature[t][at]] > limit[t][at])
        margin[:, t % 3] += leaf[t][at - inner]
    margin -= margin.max(1, keepdims=True)
    return margin - np.log(np.exp(margin).sum(1, keepdims=True))


def decode(parent: list[int], logs: list[list[float]]) -> list[int]:
    """The most probable states in which drop has only drop below and main has no path below."""
    n = len(parent)
    drop, path, main = ([v[s] for v in logs] for s in (DROP, PATH, MAIN))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        drop[p] += drop[i]
        path[p] += max(drop[i], path[i], main[i])
        main[p] += max(drop[i], main[i])
    out = [DROP] * n
    for i in range(n):
        up = out[parent[i]] if i else PATH
        if up == PATH:
            best = max(drop[i], path[i], main[i])
            out[i] = MAIN if main[i] == best else PATH if path[i] == best else DROP
        elif up == MAIN:
            out[i] = MAIN if main[i] >= drop[i] else DROP
    return out


def main_text(page: Page, state: list[int]) -> str:
    """Text of the main nodes: blocks in order, each with single spaces, joined by one."""
    blocks, block = [], []
    for node, text, _ in page.text:
        if node < 0:
            if block:
                blocks.append("".join(block))
                block = []
        elif state[node] == MAIN:
            block.append(entities.unescape(text) if "&" in text else text)
    if block:
        blocks.append("".join(block))
    return " ".join(" ".join(blocks).split())


def fit(pages: list[str], variants: int = 4, seed: int = 7) -> Boosted | None:
    """Trains on pages whose markup names the article, and on ``variants`` of each, some of them without names."""
    rng = np.random.default_rng(seed)
    rows, states = [], []
    for i, source in enumerate(pages):
        for k in range(variants + 1):
            hidden = k > 0 and rng.random() < 0.2
            page = parse(source if k == 0 else variant(source, pages[int(rng.integers(len(pages)))], rng, not hidden))
            state = teacher(page)
            if state is not None:
                rows.append(features(unnamed(page) if hidden else page))
                states.append(state)
    return boost(np.concatenate(rows), np.concatenate(states)) if rows else None


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html", max_pages: int = 200) -> Boosted | None:
    """Fits the trees on at most about ``max_pages`` pages, drawn by a hash of their id."""
    usable = pages.filter(F.col(page_id).isNotNull() & F.col(html).isNotNull())
    got = bounded_sample(usable.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")), "page_id", max_pages).collect()
    return fit([r[1] for r in sorted(got)])


def extracted(html: Column, model: Boosted | None, spark) -> Column:
    """The main text of each page."""
    shared = spark.sparkContext.broadcast((model.feature, model.limit, model.leaf, model.prior) if model else None)  # some kB

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = shared.value
        for sources in in_slices(batches, 64):
            if trees is None:
                yield pa.array([""] * len(sources), pa.string())
                continue
            pages = [parse(s) for s in sources]
            logs = log_probabilities(trees, np.concatenate([features(p) for p in pages])).tolist()
            out, start = [], 0
            for p in pages:
                mine = logs[start : start + len(p.tag)]
                start += len(p.tag)
                out.append(main_text(p, decode(p.parent, mine)))
            yield pa.array(out, pa.string())

    return extract(html)
