"""Main-text extraction by gradient-boosted trees over DOM nodes.

A page is parsed into elements. Every element that may stand for a region gets features: its kind of tag,
groups of tokens in its class, id and role, those of its ancestors, depth, place among its siblings and
in the page, length and link density of its subtree, its paragraphs, list items and sentences. Boosted
trees give the chance that it is part of the article. Decoding is hierarchical: an element that is left
out takes its whole subtree with it, and of all such choices the likeliest over the page is taken, so no
descendant contradicts an ancestor.

There are no labelled pages, so the trees are fitted to pages written by a seeded generator (pages()):
articles among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, in many
mark-up styles, with the truth known for every element.

Text: character references are decoded run by run, so none comes to be across a tag; inline elements don't
break words, blocks and <br> do, white space becomes one space, blocks are joined by one space in page
order. Scripts, styles, comments and other raw-text elements hold no text. The head, svg, math, object,
video, audio, canvas and template are left out with all they hold: a head ends at the first tag or text that
cannot be in it, a self-closed element at once, an open svg or math at a tag that is HTML, the others where
their parent ends. Elements with the attribute hidden, or with display:none in their style, are left out.

Defined cases: null or empty html gives an empty text; a page without tags is one block, all of it kept;
unclosed and misnested tags are closed where their parent ends, end tags without a start are ignored, a
tag that the page breaks off in is dropped; every tag takes the same time however deep it is, so pages may be
of any length; repeated rows give repeated rows; null ids and addresses stay null; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import batches

TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 32
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "thead", "tr", "td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "option": ("select",)}
#: Elements that open or close the scope of items.
TURNS = frozenset(t for k in SAME for t in (*SAME[k], *STOPS[k]))
BROKEN = re.compile(r"<[a-z/!?]", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
#: Elements whose content is no mark-up: it runs to their end tag or else to the end of the page.
RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in "script style title textarea noscript iframe xmp noembed noframes".split()}
#: Ordinary elements that are left out with all they hold.
LEFT_OUT = frozenset("head svg math object video audio canvas template".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template head html".split())
#: Start tags that end an open svg or math, but not in their elements that may hold HTML.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article aside footer header main nav section".split())
HOLDS_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMING = frozenset("class id role aria-label itemprop".split())
TAGS = [("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "select", "label", "input", "option"), ("article",), ("main",), ("section",), ("div", "center"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dd", "dt"), ("table", "tbody", "tr", "td", "th"), ("figure", "figcaption", "details"), ("dialog",)]
KIND = {t: i for i, ts in enumerate(TAGS) for t in ts}
#: Tokens of class, id and role by what they are used for on the web.
GROUPS = [
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header masthead banner top topbar logo branding hero",
    "footer foot bottom copyright legal colophon contentinfo credits",
    "sidebar side aside rail widget widgets complementary related recommended recommendations more trending popular tags archive archives links blogroll",
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted dfp banner",
    "cookie cookies consent gdpr notice notification alert warning popup modal overlay dialog paywall announcement disclaimer toast",
    "comment comments commentlist reply replies respond disqus discussion responses feedback reviews",
    "form search searchbox login signin signup subscribe subscription newsletter contact register input",
    "share sharing social follow toolbar buttons tools print email",
    "article content contents post entry story main body text bodytext maincontent prose hentry articlebody page",
]
HIDDEN = 1 << len(GROUPS)
GROUP_OF = {w: i for i, g in reversed(list(enumerate(GROUPS))) for w in g.split()}
N_FEATURES = len(TAGS) + 3 * len(GROUPS) + len(TAGS) + 15


@functools.lru_cache(100_000)
def flag_row(kind: int, own: int, up: int, parent: int, tags: int) -> np.ndarray:
    row = [float(kind == k) for k in range(len(TAGS))]
    for g in range(len(GROUPS)):
        row += [own >> g & 1, up >> g & 1, parent >> g & 1]
    return np.array(row + [tags >> k & 1 for k in range(len(TAGS))], np.float32)


class Stack:
    """Open elements, and for each what an end tag or an implied end would find: all in constant time a tag.

    Of every open element: the depth of the p that a block would close, of the elements that another item would close
    (SAME, up to STOPS), and of the inline elements that an inline end tag may close.
    """

    def __init__(self):
        self.ids, self.tags = [0], ["#"]
        self.p, self.items, self.inline = [-1], [{}], [{}]
        self.where: dict[str, list[int]] = {}

    def push(self, i: int, tag: str) -> None:
        depth, inline = len(self.ids), tag in INLINE
        self.ids.append(i)
        self.tags.append(tag)
        self.p.append(depth if tag == "p" else self.p[-1] if inline else -1)
        items = self.items[-1]
        if tag in TURNS:
            items = {k: d for k, d in items.items() if tag not in STOPS[k]} | {k: depth for k in SAME if tag in SAME[k]}
        self.items.append(items)
        self.inline.append(self.inline[-1] | {tag: depth} if inline else {})
        self.where.setdefault(tag, []).append(depth)

    def cut(self, depth: int) -> None:
        for tag in self.tags[depth:]:
            self.where[tag].pop()
        for x in (self.ids, self.tags, self.p, self.items, self.inline):
            del x[depth:]

    def found(self, tag: str) -> int:
        """Depth of the element that an end tag closes, 0 if none."""
        if tag in INLINE:
            return self.inline[-1].get(tag, 0)  # an inline end tag closes no block
        depths = self.where.get(tag)
        return depths[-1] if depths else 0


class Out:
    """The open element that is left out, and those in it."""

    def __init__(self):
        self.tags: list[str] = []
        self.count: dict[str, int] = {}

    def __bool__(self):
        return bool(self.tags)

    def push(self, tag: str) -> None:
        self.tags.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1

    def close(self, tag: str) -> bool:
        if not self.count.get(tag):
            return False
        while self.tags:
            last = self.tags.pop()
            self.count[last] -= 1
            if last == tag:
                break
        return True

    def clear(self) -> None:
        self.tags.clear()
        self.count.clear()

    def head(self) -> bool:
        return len(self.tags) == 1 and self.tags[0] == "head"

    def foreign(self) -> bool:
        return bool(self.tags) and self.tags[0] in ("svg", "math") and not any(self.count.get(t) for t in HOLDS_HTML)


class Page:
    """Elements in page order: parent, tag, groups; and runs of text with the element they are in."""

    def __init__(self, html: str):
        self.tag, self.parent, self.groups = ["#"], [-1], [0]
        self.items: list[tuple[int, str | None]] = []  # element, text (None: a break)
        stack, at, headed, out = Stack(), 0, False, Out()
        end = html.rfind(">") + 1  # no tag is complete after it
        while m := TOKEN.search(html, at, end):
            if m.start() > at:
                self.text_run(stack, out, html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(html)
                continue
            name = name.lower()
            if m[1]:
                if not out.close(name) and (not out or stack.found(name)):
                    out.clear()
                    self.close(stack, name)
                continue
            closed = m[3].endswith("/")
            foreign = out.foreign()
            if name in RAW:
                if not (foreign and closed):
                    ends = RAW[name].search(html, at)
                    at = ends.end() if ends else len(html)
                    if out.head() and name not in IN_HEAD:
                        out.clear()
                continue
            if foreign and name in ENDS_FOREIGN or out.head() and name not in IN_HEAD:
                out.clear()
            if name == "head" and (headed or out or stack.tags[-1] not in ("#", "html")):
                continue  # a page has one head, before all else
            headed = headed or name in ("head", "body")
            if out or name in LEFT_OUT:
                if not closed and name not in VOID and not (out.head() and name in ("head", "html")):
                    out.push(name)
                continue
            if name in VOID:
                if name not in ("wbr", "img", "input"):
                    self.items.append((stack.ids[-1], None))
                continue
            self.open(stack, name, m[3])
            if closed and name not in INLINE:  # self-closed
                self.close(stack, name)
        if at < len(html):
            rest = html[at:]
            broken = BROKEN.search(rest)
            if text := rest[: broken.start()] if broken else rest:
                self.text_run(stack, out, text)

    def text_run(self, stack: Stack, out: Out, text: str) -> None:
        if out.head() and not text.isspace():
            out.clear()  # text ends an open head
        if not out:
            self.items.append((stack.ids[-1], unescape(text)))

    def open(self, stack: Stack, name: str, attributes: str) -> None:
        if name in CLOSES_P and stack.p[-1] > 0:
            stack.cut(stack.p[-1])
        elif name in SAME and stack.items[-1].get(name):
            stack.cut(stack.items[-1][name])
        groups = 0
        if attributes and not attributes.isspace():
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
                    groups |= HIDDEN
                elif key in NAMING:
                    for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                        if word in GROUP_OF:
                            groups |= 1 << GROUP_OF[word]
        self.tag.append(name)
        self.parent.append(stack.ids[-1])
        self.groups.append(groups)
        stack.push(len(self.tag) - 1, name)
        if name not in INLINE:
            self.items.append((stack.ids[-2], None))

    def close(self, stack: Stack, name: str) -> None:
        if depth := stack.found(name):
            stack.cut(depth)
        if name not in INLINE:
            self.items.append((stack.ids[-1], None))

    @functools.cached_property
    def _nodes(self) -> list[int]:
        return [i for i in range(1, len(self.tag)) if self.tag[i] not in ("html", "body") and (self.tag[i] not in INLINE or self.groups[i])]

    def nodes(self) -> list[int]:
        """Elements that are decided on: blocks, and inline ones that name what they are."""
        return self._nodes

    def features(self) -> np.ndarray:
        """A row for each of nodes()."""
        n = len(self.tag)
        chars, linked, marks, blocks = [0] * n, [0] * n, [0] * n, [0] * n
        paragraphs, listed, before, depth = [0] * n, [0] * n, [None] * n, [0] * n
        in_link = [False] * n
        above = [0] * n
        above_tags = [0] * n
        children, place = [0] * n, [0] * n
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + (self.tag[i] not in INLINE)
            in_link[i] = in_link[p] or self.tag[i] == "a"
            above[i] = above[p] | self.groups[p]
            above_tags[i] = above_tags[p] | (1 << KIND[self.tag[p]] if self.tag[p] in KIND else 0)
            if self.tag[i] not in INLINE:
                place[i] = children[p]
                children[p] += 1
        total = 0
        for i, text in self.items:
            if text is None:
                continue
            size = len(text)
            if before[i] is None:
                before[i] = total
            if not text.isspace():
                chars[i] += size
                linked[i] += size * in_link[i]
                marks[i] += text.count(".") + text.count(",")
                blocks[i] += 1
                total += size
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            blocks[p] += blocks[i]
            paragraphs[p] += paragraphs[i] + (self.tag[i] == "p")
            listed[p] += listed[i] + (self.tag[i] == "li")
            if before[i] is not None and (before[p] is None or before[i] < before[p]):
                before[p] = before[i]
        flags, numbers = [], []
        for i in self.nodes():
            own, p, size = self.groups[i], self.parent[i], chars[i]
            flags.append(flag_row(KIND.get(self.tag[i], -1), own, above[i], self.groups[p], above_tags[i]))
            numbers.append((
                math.log1p(size), linked[i] / (size + 1), marks[i] / (size + 1) * 20, size / (blocks[i] + 1), math.log1p(paragraphs[i]), math.log1p(listed[i]),
                depth[i], place[i], children[p], (before[i] or 0) / (total + 1), size / (total + 1), chars[p] / (total + 1), size / (chars[p] + 1), linked[p] / (chars[p] + 1), own >> len(GROUPS) & 1,
            ))
        if not flags:
            return np.zeros((0, N_FEATURES), np.float32)
        return np.concatenate([np.stack(flags), np.array(numbers, np.float32)], axis=1)

    def text(self, keep: np.ndarray) -> str:
        parts = [" " if text is None else text for i, text in self.items if keep[i]]
        return " ".join("".join(parts).split())


def decode(page: Page, chance: np.ndarray) -> np.ndarray:
    """Elements to keep: the likeliest choice in which what is below a left-out element is left out."""
    n = len(page.tag)
    p = np.clip(chance, 0.02, 0.98)
    yes, no, node = [0.0] * n, [0.0] * n, [False] * n
    for i, a, b in zip(page.nodes(), np.log(p).tolist(), np.log1p(-p).tolist(), strict=True):
        yes[i], no[i], node[i] = (-math.inf, 0.0, True) if page.groups[i] & HIDDEN else (a, b, True)
    best_below, none_below = [0.0] * n, [0.0] * n
    keeps = [True] * n
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        left_out = none_below[i] + no[i]
        kept = best_below[i] + yes[i]
        keeps[i] = not node[i] or kept >= left_out
        best_below[up] += max(kept, left_out) if node[i] else kept
        none_below[up] += left_out
    for i in range(1, n):
        keeps[i] = keeps[i] and keeps[page.parent[i]]
    return np.array(keeps)


class Trees:
    """Boosted trees of fixed depth on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self.binned(x)
        self.bias = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        z = np.full(len(y), self.bias)
        size = 2**DEPTH - 1
        self.feature, self.cut, self.value = np.zeros((TREES, size), np.int64), np.full((TREES, size), BINS, np.int64), np.zeros((TREES, 2**DEPTH))
        for t in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * (p - y), weight * p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                width = 2**level
                best = np.full(width, 1e-6)
                for f in range(x.shape[1]):
                    if not len(self.edges[f]):
                        continue
                    key = at * BINS + binned[:, f]
                    gs, hs = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    top = gain.argmax(1)
                    for node in np.flatnonzero(gain.max(1) > best).tolist():
                        best[node] = gain[node, top[node]]
                        self.feature[t, width - 1 + node], self.cut[t, width - 1 + node] = f, top[node]
                here = width - 1 + at
                at = 2 * at + (binned[np.arange(len(y)), self.feature[t, here]] > self.cut[t, here])
            gs, hs = np.bincount(at, g, 2**DEPTH), np.bincount(at, h, 2**DEPTH)
            self.value[t] = -RATE * gs / (hs + 1)
            z += self.value[t, at]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int64)

    def chance(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.binned(x), np.arange(len(x))
        z = np.full(len(x), self.bias)
        for t in range(TREES):
            at = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                here = 2**level - 1 + at
                at = 2 * at + (binned[rows, self.feature[t, here]] > self.cut[t, here])
            z += self.value[t, at]
        return 1 / (1 + np.exp(-z))


def pages(count: int, seed: int = 11):
    """Written pages: (html, marker of article text). Words of the article begin with 'q', all others don't."""
    rnd = random.Random(seed)

    def words(n, article=False):
        out = [("q" if article else "") + "".join(rnd.choice("aeioulnrstdmbk") for _ in range(rnd.randrange(2, 9))) for _ in range(n)]
        text = ""
        for i, w in enumerate(out):
            text += w + (rnd.choice([".", ",", ". "]) if rnd.random() < 0.12 else "") + (" " if i < n - 1 else "")
        return text + ("." if n > 4 and rnd.random() < 0.7 else "")

    def link(n=None):
        return f'<a href="/{rnd.randrange(999)}">{words(n or rnd.randrange(1, 4))}</a>'

    def attributes(group, plain=0.25):
        """class or id with a token of the group, or nothing that tells."""
        if rnd.random() < plain:
            return rnd.choice(["", "", f' class="{rnd.choice(["c1", "box", "row", "col-8", "x9z", "inner", "wrap"])}"'])
        token = rnd.choice(GROUPS[group].split())
        extra = rnd.choice(["", "-box", "-wrapper", "_inner", " row", "-1"])
        return f' {rnd.choice(["class", "class", "id", "role"])}="{token}{extra}"'

    def tag(names, group, inner, plain=0.25):
        name = rnd.choice(names)
        return f"<{name}{attributes(group, plain if name in ('div', 'section', 'p', 'ul', 'table') else 0.7)}>{inner}</{name}>"

    def links(n):
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>" if rnd.random() < 0.7 else rnd.choice([" | ", " ", "\n"]).join(link() for _ in range(n))

    def menu():
        return tag(["nav", "nav", "div", "ul"], 0, links(rnd.randrange(2, 12)), 0.1)

    def head():
        return tag(["header", "header", "div"], 1, rnd.choice([f"<h1>{words(3)}</h1>", f"<p>{words(rnd.randrange(2, 9))}</p>", words(4), ""]) + (menu() if rnd.random() < 0.5 else ""), 0.05)

    def foot():
        return tag(["footer", "footer", "footer", "div"], 2, rnd.choice(["&copy; ", "", "2024 "]) + rnd.choice([words(rnd.randrange(2, 25)), f"<p>{words(rnd.randrange(3, 30))}</p>", words(3) + " &middot; " + words(6)]) + (links(rnd.randrange(2, 7)) if rnd.random() < 0.4 else ""), 0.05)

    def side():
        inner = "".join(rnd.choice([f"<h3>{words(2)}</h3>{links(rnd.randrange(2, 7))}", f"<p>{words(rnd.randrange(5, 40))}</p>", f"<div>{words(rnd.randrange(3, 15))}</div>"]) for _ in range(rnd.randrange(1, 4)))
        return tag(["aside", "aside", "div", "section"], 3, inner, 0.05)

    def advert():
        return tag(["div", "div", "aside", "section", "ins", "p"], 4, rnd.choice([words(rnd.randrange(2, 30)), link(4), f"<p>{words(rnd.randrange(4, 20))}</p>"]), 0.0)

    def notice():
        return tag(["div", "div", "section", "p", "dialog", "aside"], 5, rnd.choice([words(rnd.randrange(4, 40)), f"<p>{words(rnd.randrange(4, 30))}</p><button>{words(1)}</button>", words(9) + link()]), 0.0)

    def comment(depth=0):
        body = rnd.choice([f"<p>{words(rnd.randrange(3, 60))}</p>", words(rnd.randrange(3, 60)), f"<b>{words(1)}</b> <time>{words(1)}</time><p>{words(rnd.randrange(4, 40))}</p>"])
        return tag(["div", "li", "article"], 6, body + (comment(depth + 1) if depth < 2 and rnd.random() < 0.2 else ""), 0.4)

    def comments():
        return tag(["div", "section", "section", "ol", "ul", "aside"], 6, (f"<h2>{words(2)}</h2>" if rnd.random() < 0.5 else "") + "".join(comment() for _ in range(rnd.randrange(1, 7))), 0.0)

    def form():
        inner = "".join(rnd.choice([f"<label>{words(2)}</label><input name=x>", f"<button>{words(1)}</button>", f"<p>{words(rnd.randrange(2, 12))}</p>", f"<select><option>{words(1)}<option>{words(1)}</select>"]) for _ in range(rnd.randrange(1, 5)))
        return tag(["form", "form", "form", "div"], 7, inner, 0.0)

    def share():
        return tag(["div", "ul", "p"], 8, links(rnd.randrange(2, 6)), 0.0)

    extras = [menu, head, foot, side, advert, notice, comments, form, share]

    def article():
        short = rnd.random() < 0.15

        def text(n):
            out = words(min(n, 3) if short else n, True)
            if rnd.random() < 0.25:
                out = out.replace(" q", " <a href='#'>q", 1) + "</a>" if " q" in out else out
            return f"<b>{out}</b>" if rnd.random() < 0.1 else out

        parts = [f"<h1>{text(rnd.randrange(2, 12))}</h1>"] if rnd.random() < 0.8 else []
        if parts and rnd.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        sizes = lambda: rnd.choice([rnd.randrange(1, 6), rnd.randrange(5, 40), rnd.randrange(20, 160)])
        if parts and rnd.random() < 0.3:  # the title once more, in a paragraph left open
            parts.append(f"<p><b>{text(rnd.randrange(1, 12))}<br>")
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 8, 14][: 3 if short else 8]) if parts else rnd.randrange(1, 9)):
            kind = rnd.random()
            if kind < 0.72:
                parts.append(f"<p>{text(sizes())}" + ("</p>" if rnd.random() < 0.8 else ""))
            elif kind < 0.78:
                parts.append(f"<h2>{text(rnd.randrange(1, 8))}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{text(rnd.randrange(2, 14))}</li>" for _ in range(rnd.randrange(2, 6))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote>{text(sizes())}</blockquote>")
            elif kind < 0.92:
                parts.append(f"<div>{text(sizes())}</div>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{text(2)}<td>{text(2)}" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<p><b>{text(rnd.randrange(1, 10))}.<br><p>")
        for _ in range(rnd.choice([0, 0, 0, 1, 2])):
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice([advert, share, notice, form, side, advert])())
        if rnd.random() < 0.1:
            parts.append(rnd.choice([comments, foot])())
        inner = "".join(parts)
        name = rnd.choice(["article", "article", "article", "main", "div", "div", "section"])
        out = f"<{name}{attributes(9, 0.7 if name in ('article', 'main') else 0.15)}>{inner}</{name}>"
        for _ in range(rnd.choice([0, 0, 1, 2])):
            wrapper = rnd.choice(["div", "main", "section", "div"])
            near = (rnd.choice(extras)() if rnd.random() < 0.4 else "", rnd.choice([comments, side, advert, share, form])() if rnd.random() < 0.5 else "")
            out = f"<{wrapper}{attributes(9, 0.7)}>{near[0]}{out}{near[1]}</{wrapper}>"
        return out

    for _ in range(count):
        above = [rnd.choice([menu, head, advert, notice, form, menu, side])() for _ in range(rnd.randrange(0, 4))]
        below = [rnd.choice([foot, comments, side, advert, notice, form, foot, menu, share])() for _ in range(rnd.randrange(0, 4))]
        yield f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body>{''.join(above)}{article()}{''.join(below)}" + rnd.choice(["</body></html>", ""])


@functools.cache
def model() -> Trees:
    """Trees fitted to written pages; the same in every session."""
    xs, ys, ws = [], [], []
    for html in pages(900):
        page = Page(html)
        x = page.features()
        own, all_ = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        for i, text in page.items:
            if text and text.strip():
                found = text.split()
                own[i] += sum(w.startswith("q") for w in found)
                all_[i] += len(found)
        for i in range(len(page.tag) - 1, 0, -1):
            own[page.parent[i]] += own[i]
            all_[page.parent[i]] += all_[i]
        nodes = np.array(page.nodes(), np.int64)
        x, nodes = x[all_[nodes] > 0], nodes[all_[nodes] > 0]
        xs.append(x)
        ys.append(own[nodes] > 0)
        ws.append(1 + np.log1p(all_[nodes]) / 4)
    return Trees(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def extract(pages_: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    trees = pages_.sparkSession.sparkContext.broadcast(model())

    def run(rows):
        for batch in batches(rows):
            parsed = [Page(h or "") for h in batch.column("html").to_pylist()]
            if not parsed:
                continue
            x = [p.features() for p in parsed]
            chance = trees.value.chance(np.concatenate(x))
            ends = np.cumsum([len(f) for f in x])[:-1]
            texts = [p.text(decode(p, c)) for p, c in zip(parsed, np.split(chance, ends), strict=True)]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages_.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
