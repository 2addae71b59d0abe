"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Each element gets features of its own (kind of tag, words in class, id and role), of its subtree (text, links,
tags per character), of its place (depth, place among siblings) and of its siblings' text. Boosted trees
give the probability that an element belongs to the article. Decoding picks the best labelling of the whole
tree in which nothing inside a dropped element is kept, and inside the article parts can only be dropped.

The trees are trained here: text blocks of a bounded sample of the pages are laid out in many ways, with
menus, notices, adverts, forms and comments around them, so that the right label of every element is known.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import column
from ._trees import Trees, boosted_trees

#: Pages sampled for training at most, and pages laid out from their blocks.
SAMPLE, LAYOUTS = 100, 360
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KINDS = {
    "root": "html body", "head": "head title meta link base", "article": "article", "main": "main", "section": "section div span td center figure blockquote details", "para": "p pre dd dt figcaption address",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li", "link": "a", "inline": "b i em strong u code sup sub small mark abbr cite q time font s label math svg object var kbd samp ins del", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside dialog",
    "form": "form input button textarea select fieldset", "code": "script style noscript template iframe", "table": "table tbody thead tfoot tr th",
}
_KIND = {t: k for k, (_, tags) in enumerate(KINDS.items()) for t in tags.split()}
BAD_WORDS = [
    ("ad", "ad ads advert advertisement advertising adbox banner sponsor sponsored promo promotion"), ("menu", "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs"), ("side", "sidebar side aside related recommended widget rail teaser"),
    ("foot", "footer foot copyright legal colophon"), ("head", "header masthead topbar branding logo"), ("comment", "comment comments reply replies discussion disqus respond"), ("notice", "notice cookie cookies consent popup modal alert gdpr newsletter subscribe signup overlay paywall"),
    ("share", "share social sharing follow tags meta byline"), ("form", "form search login contact"),
]
GOOD_WORDS = "article content main post entry story text body articlebody maincontent prose page".split()
_BAD = {w: k for k, (_, ws) in enumerate(BAD_WORDS) for w in ws.split()}
_OPEN = re.compile(r"<(?:(!--|[!?])|(/?)([a-zA-Z][^\s/>]*+))")
#: Up to the end of a tag or the value of an attribute; a value without quotes.
_NAMES, _VALUE = re.compile(r"[^>=]*+"), re.compile(r"[^\s>]*+")
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LABEL = re.compile(r"data-label=\"(\d)\"")
_WORD = re.compile(r"[a-z]+")


def tag_end(page: str, pos: int) -> int:
    """Where the tag ends whose name ends at ``pos``, -1 if it doesn't. A quote opens a value only behind an
    equals sign, and only if it is closed; anywhere else it is a character like others."""
    unclosed = set()
    while True:
        pos = _NAMES.match(page, pos).end()
        if pos == len(page):
            return -1
        if page[pos] == ">":
            return pos + 1
        pos += 1
        while pos < len(page) and page[pos] in " \t\r\n\f":
            pos += 1
        mark = page[pos : pos + 1]
        if mark in ("'", '"') and mark not in unclosed:
            end = page.find(mark, pos + 1)
            if end >= 0:
                pos = end + 1
                continue
            unclosed.add(mark)
        pos = _VALUE.match(page, pos).end()


class Tree:
    """Elements of a page in document order, and its text: pieces of (element, block number, text)."""

    def __init__(self, page: str):
        self.tag, self.parent, self.flags, self.label = ["#"], [-1], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []
        known: dict[tuple[str, str], tuple[int, int]] = {}
        stack, block, at = [0], 0, 0
        tags, parents, flags, labels = self.tag, self.parent, self.flags, self.label
        # Where in the stack the open elements of each kind stand, so that none is looked for one by one.
        spots: dict[str, list[int]] = defaultdict(list)

        def close(k: int) -> None:
            for x in stack[k:]:
                spots[tags[x]].pop()
            del stack[k:]

        def last(kinds: tuple[str, ...]) -> int:
            return max((spots[k][-1] for k in kinds if spots[k]), default=0)

        pos = 0
        while True:
            m = _OPEN.search(page, pos)
            text = page[at : m.start() if m else len(page)]
            if text:
                self.pieces.append((stack[-1], block, text))
            if m is None:
                return
            if m[1]:
                # A comment or declaration; without its end it takes the rest.
                end = page.find("-->", m.end()) if m[1] == "!--" else page.find(">", m.end())
                if end < 0:
                    return
                at = pos = end + (3 if m[1] == "!--" else 1)
                continue
            end = tag_end(page, m.end())
            if end < 0:
                return
            at = pos = end
            name, rest = m[3].lower(), page[m.end() : end - 1]
            if m[2]:
                if name in BLOCK:
                    block += 1
                if spots[name]:
                    close(spots[name][-1])
                continue
            if name in BLOCK:
                block += 1
                # An open paragraph ends unless it lies further out than a few inline elements or beyond a cell.
                if (at_p := last(("p",))) >= max(1, len(stack) - 4) and at_p > last(("button", "td", "th", "table")):
                    close(at_p)
                if name in ENDS and (at_end := last(ENDS[name])) > last(("ul", "ol", "dl", "table")):
                    close(at_end)
            if name == "br":
                self.pieces.append((stack[-1], block, " "))
                continue
            key = (name, rest) if len(rest) < 60 else None
            mark = known.get(key) if key else None
            if mark is None:
                mark = _flags(rest)
                if key:
                    known[key] = mark
            tags.append(name)
            parents.append(stack[-1])
            flags.append(mark[0])
            labels.append(mark[1] if mark[1] >= 0 else labels[stack[-1]])
            if name in VOID or rest.endswith("/") and name not in BLOCK:
                continue
            if name in RAW:
                closing = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, pos)
                end = tag_end(page, closing.end()) if closing else -1
                if end < 0:
                    return
                at = pos = end
                continue
            spots[name].append(len(stack))
            stack.append(len(tags) - 1)


def _flags(rest: str) -> tuple[int, int]:
    """Bits for groups of words in class, id, role and itemprop: bit k for BAD_WORDS[k], the next for
    GOOD_WORDS; and a training label, -1 if there is none."""
    if not rest or "=" not in rest:
        return 0, -1
    found = 0
    for m in _ATTR.finditer(rest):
        for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower()):
            if w in _BAD:
                found |= 1 << _BAD[w]
            elif w in GOOD_WORDS:
                found |= 1 << len(BAD_WORDS)
    label = _LABEL.search(rest)
    return found, int(label[1]) if label else -1


def features(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of features of all elements of all pages, and their parents, depths and pages."""
    sizes = np.array([len(t.tag) for t in trees])
    base = np.concatenate([[0], np.cumsum(sizes)])
    page = np.repeat(np.arange(len(trees)), sizes)
    parent = np.concatenate([np.array(t.parent) + np.where(np.array(t.parent) >= 0, b, 0) for t, b in zip(trees, base, strict=False)])
    # Unknown elements are taken for inline ones.
    kind = np.array([len(KINDS) if x == "#" else _KIND.get(x, _KIND["b"]) for t in trees for x in t.tag])
    flags = np.array([x for t in trees for x in t.flags])
    n = len(kind)
    own = np.zeros(n)
    for t, b in zip(trees, base, strict=False):
        for node, _, text in t.pieces:
            own[b + node] += len(text) if len(text) > 40 else len(text.strip())
    depth = np.zeros(n, np.int64)
    link = np.zeros(n, bool)
    kid = np.flatnonzero(parent >= 0)
    # Parents come before children; levels are settled from the top.
    front = np.flatnonzero(parent < 0)
    levels = [front]
    children = np.argsort(parent[kid], kind="stable")
    by_parent, starts = kid[children], np.searchsorted(parent[kid][children], np.arange(n + 1))
    while len(front):
        front = np.concatenate([by_parent[starts[x] : starts[x + 1]] for x in front]) if len(front) < 64 else by_parent[np.repeat(starts[front] - np.r_[0, np.cumsum(starts[front + 1] - starts[front])[:-1]], starts[front + 1] - starts[front]) + np.arange((starts[front + 1] - starts[front]).sum())]
        if len(front):
            depth[front] = depth[parent[front]] + 1
            link[front] = link[parent[front]] | (kind[front] == _KIND["a"])
            levels.append(front)
    text, links, tags = own.copy(), np.where(link, own, 0), np.ones(n)
    paras, kept_bad, good = (kind == _KIND["p"]).astype(float), ((flags & (1 << len(BAD_WORDS)) - 1) > 0).astype(float), (flags >> len(BAD_WORDS)).astype(float)
    up_bad, up_good, up_kind = kept_bad.copy(), good.copy(), np.zeros((n, 6))
    special = [_KIND[x] for x in ("article", "main", "nav", "footer", "aside", "form")]
    for k, s in enumerate(special):
        up_kind[:, k] = kind == s
    for front in reversed(levels[1:]):
        for x in (text, links, tags, paras):
            np.add.at(x, parent[front], x[front])
    for front in levels[1:]:
        up_bad[front] = np.maximum(up_bad[front], up_bad[parent[front]])
        up_good[front] = np.maximum(up_good[front], up_good[parent[front]])
        up_kind[front] = np.maximum(up_kind[front], up_kind[parent[front]])
    above = np.where(parent >= 0, parent, np.arange(n))
    whole = np.maximum(text[base[:-1]][page], 1)
    place, count = np.zeros(n), np.ones(n)
    number = starts[1:] - starts[:-1]
    place[by_parent] = np.arange(len(by_parent)) - starts[parent[by_parent]]
    count[kid] = number[parent[kid]]
    mean = np.where(number > 0, text / np.maximum(number, 1), text)
    bits = (flags[:, None] >> np.arange(len(BAD_WORDS) + 1)) & 1
    x = np.column_stack([
        kind, kind[above], depth, np.log1p(text), np.log1p(own), text / whole, links / np.maximum(text, 1), tags / np.maximum(text, 1), np.log1p(tags), np.log1p(paras), place, place / count, count,
        np.log1p(mean[above]), text / np.maximum(text[above], 1), links[above] / np.maximum(text[above], 1), up_bad, up_good, up_bad[above], up_good[above], up_kind, *(kind == k for k in range(len(KINDS))), *(kind[above] == k for k in range(len(KINDS))), bits, bits[above],
    ]).astype(float)
    return x, parent, depth, page


def decode(p: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Which elements are kept, by the best labelling of each tree.

    An element is dropped with all that is in it, or of the article (its elements may be dropped but are
    never outside it again), or a mere container of either; containers count as not belonging to the article.
    """
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log1p(-p)
    drop, keep, hold = no.copy(), yes.copy(), no.copy()
    order = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    for d in range(len(cut) - 2, 0, -1):
        own = order[cut[d] : cut[d + 1]]
        np.add.at(drop, parent[own], drop[own])
        np.add.at(keep, parent[own], np.maximum(keep[own], drop[own]))
        np.add.at(hold, parent[own], np.maximum(np.maximum(keep[own], drop[own]), hold[own]))
    state = np.zeros(len(p), np.int64)  # 0 dropped, 1 kept, 2 container
    for d in range(len(cut) - 1):
        own = order[cut[d] : cut[d + 1]]
        above = np.where(parent[own] >= 0, state[parent[own]], 2)
        free = np.where((keep[own] > drop[own]) & (keep[own] >= hold[own]), 1, np.where(hold[own] > drop[own], 2, 0))
        inside = np.where(keep[own] > drop[own], 1, 0)
        state[own] = np.where(above == 2, free, np.where(above == 1, inside, 0))
    return state == 1


def _joined(tree: Tree, kept: np.ndarray) -> str:
    blocks: list[list[str]] = []
    last = -1
    for node, block, text in tree.pieces:
        if kept[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    out = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return " ".join(x for x in out if x)


def extract(pages: list[str], model: Trees) -> list[str]:
    """Main text of each page: blocks in page order, joined by a space; "" if there is none."""
    trees = [Tree(p) for p in pages]
    if not trees:
        return []
    x, parent, depth, page = features(trees)
    kept = decode(model.probability(x), parent, depth)
    cut = np.searchsorted(page, np.arange(len(trees) + 1))
    return [_joined(t, kept[a:b]) for t, a, b in zip(trees, cut[:-1], cut[1:], strict=True)]


def laid_out(blocks: list[str], n: int = LAYOUTS, seed: int = 3) -> list[str]:
    """Pages with data-label="1" on the article's element and "0" on what is not part of it. Some have no landmark: the
    article lies in a plain element among others, or its blocks stand in the body one by one."""
    r = random.Random(seed)
    blocks = blocks or ["Some words that stand in for a text."]
    block = lambda: r.choice(blocks)
    short = lambda: " ".join(block().split()[: r.randint(1, 6)])
    links = lambda k: "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(k))
    wrap = lambda tags, words, inner: (lambda t: f'<{t}{r.choice([f" class={chr(34)}{r.choice(words)}{chr(34)}", f" id={chr(34)}{r.choice(words)}{chr(34)}"])} data-label="0">{inner}</{t}>')(r.choice(tags))
    by = dict(BAD_WORDS)
    word = lambda k: by[k].split()
    sentence = lambda: " ".join(block().split()[: r.randint(4, 30)])
    noise = [
        lambda: f'<nav data-label="0"><ul>{links(r.randint(3, 12))}</ul></nav>', lambda: wrap(["div", "ul"], word("menu"), links(r.randint(3, 12))), lambda: f'<header data-label="0"><h1>{short()}</h1><p>{short()}</p></header>', lambda: wrap(["div"], word("head"), f"<p>{short()}</p>"),
        lambda: f'<footer data-label="0">&copy; {short()} &middot; {sentence()}</footer>', lambda: wrap(["div"], word("foot"), f"<p>{sentence()}</p>"), lambda: f'<aside data-label="0"><h3>{short()}</h3><p>{block()}</p></aside>', lambda: wrap(["div", "section"], word("side"), f"<h3>{short()}</h3><p>{block()}</p>"),
        lambda: wrap(["div"], word("ad"), sentence()), lambda: wrap(["div"], word("ad"), f"<p>{sentence()}</p><a href=x>{short()}</a>"), lambda: wrap(["div", "section", "ol"], word("comment"), "".join(f"<div><b>{short()}</b><p>{sentence()}</p></div>" for _ in range(r.randint(1, 6)))),
        lambda: wrap(["div"], word("notice"), f"<p>{sentence()}</p><button>{short()}</button>"), lambda: f'<form data-label="0"><label>{short()}</label><input><p>{short()}</p><button>{short()}</button></form>', lambda: wrap(["div", "ul"], word("share"), links(r.randint(2, 5))), lambda: wrap(["div"], word("form"), f"<form><input><button>{short()}</button></form>"),
    ]
    # Without words in class or id: lists of links, a line of small print, a name.
    plain = [
        lambda: f'<div data-label="0"><ul>{links(r.randint(2, 8))}</ul></div>', lambda: f'<ul data-label="0">{links(r.randint(2, 8))}</ul>', lambda: f'<div data-label="0">{" | ".join(f"<a href=x>{short()}</a>" for _ in range(r.randint(1, 6)))}</div>',
        lambda: f'<div data-label="0">&copy; {short()}</div>', lambda: f'<div data-label="0">{short()}</div>', lambda: f'<div data-label="0"><a href="/">{short()}</a></div>',
    ]

    def table() -> str:
        wide, begin = r.randint(1, 4), r.choice(["<tr>", "<tr>", ""])
        row = lambda tag: begin + "".join(f"<{tag}>{r.choice([short, short, sentence])()}</{tag}>" for _ in range(wide)) + begin.replace("<", "</")
        return "<table>" + (row("th") if r.random() < 0.5 else "") + "".join(row("td") for _ in range(r.randint(1, 6))) + "</table>"

    out = []
    for _ in range(n):
        parts = [f"<{h}>{short()}</{h}>"] if (h := r.choice(["h1", "h1", "h2", "p"])) else []
        for _ in range(r.choice([1, 2, 4, 8, 16])):
            p = block()
            kind = r.random()
            if kind < 0.1:
                parts.append(f"<p><b>{p}<br>")
            elif kind < 0.16:
                parts.append(f"<ul><li>{short()}</li><li>{sentence()}</li></ul>")
            elif kind < 0.22:
                parts.append(f"<h2>{short()}</h2>")
            elif kind < 0.27:
                parts.append(f"<blockquote><p>{sentence()}</p></blockquote>")
            elif kind < 0.37:
                cut = len(p) // 2
                parts.append(f'<p>{p[:cut]}<a href="x">{short()}</a>{p[cut:]}</p>')
            elif kind < 0.41:
                parts.append(f"<pre>{sentence()}</pre>")
            elif kind < 0.47:
                cut = len(p) // 2
                parts.append(f"<p>{p[:cut]}<em><i>{short()}</i> {r.choice('+-=')} <i>{short()}</i></em>{p[cut:]}</p>")
            elif kind < 0.53:
                parts.append(table())
            elif kind < 0.57:
                parts.append("<dl>" + "".join(f"<dt>{short()}</dt><dd>{r.choice([short, sentence])()}</dd>" for _ in range(r.randint(1, 5))) + "</dl>")
            elif kind < 0.60:
                parts.append(f'<figure><img src="x"><figcaption>{sentence()}</figcaption></figure>')
            elif kind < 0.65:
                parts.append(r.choice(["<div><p>{}</p></div>", "<section><p>{}</p></section>", "<div>{}</div>"]).format(p))
            else:
                parts.append(f"<p>{p}</p>")
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            parts.insert(r.randint(1, len(parts)), r.choice(noise)())
        tag, words = r.choice([("article", None), ("article", None), ("article", "post"), ("main", None), ("div", "content"), ("div", "article"), ("section", "story"), ("div", "entry"), ("div", "post-body")])
        name = f' class="{words}"' if words else ""
        body = f'<{tag}{name} data-label="1">{"".join(parts)}</{tag}>'
        if r.random() < 0.3:
            outer = r.choice(["main", "div"])
            body = f"<{outer}>{body}</{outer}>"
        around, shell = noise, r.random()
        if shell < 0.3:
            around = r.choice([noise, plain, plain])
            if shell < 0.15:
                # A line of text in an element of no kind, straight in the body, may be a notice as well: not drawn.
                parts = [re.sub(r"^<div>([^<]*)</div>$", r"<p>\1</p>", x) for x in parts]
                body = "".join(x if 'data-label="0"' in x.split(">", 1)[0] else re.sub(r"^<(\w+)", r'<\1 data-label="1"', x) for x in parts)
            else:
                body = f'<div data-label="1">{"".join(parts)}</div>'
        before = "".join(r.choice(around)() for _ in range(r.randint(0, 4)))
        after = "".join(r.choice(around)() for _ in range(r.randint(0, 4)))
        out.append(f"<!DOCTYPE html><html><head><title>{short()}</title></head><body>{before}{body}{after}" + r.choice(["</body></html>", ""]))
    return out


def train_on(pages: list[str], layouts: int = LAYOUTS) -> Trees:
    """Trees from pages laid out anew with the paragraphs of the given ones."""
    blocks = []
    for page in pages:
        for node, _, text in (t := Tree(page)).pieces:
            if t.tag[node] == "p" and len(text.strip()) > 1:
                blocks.append(text.strip())
    trees = [Tree(p) for p in laid_out(blocks[:2000], layouts)]
    x, *_ = features(trees)
    return boosted_trees(x, np.array([v for t in trees for v in t.label]), rounds=30, depth=5)


def train(pages: DataFrame, sample: int = SAMPLE, longest: int = 50_000) -> Trees:
    """Trees from about ``sample`` pages, drawn by a hash of the html, of at most ``longest`` characters each."""
    fit = pages.where(F.length("html").between(1, longest)).select("html", F.xxhash64("html").alias("draw"))
    total = fit.count()
    if total > 2 * sample:
        # About twice as many as needed are put in order, however many there are.
        fit = fit.where(F.pmod("draw", F.lit(1 << 40)) < int(2 * sample / total * (1 << 40)))
    fit = fit.orderBy("draw").limit(sample)
    return train_on([r["html"] for r in fit.collect()])


SCHEMA = "page_id long, url string, text string"


def extract_pages(pages: DataFrame, model: Trees) -> DataFrame:
    """(page_id, url, text): the main text of every whole page. Null or empty html gives an empty text; rows
    are kept as they are, with null and repeated ids; other columns are ignored, whatever their names."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                texts = extract([h or "" for h in column(part, "html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
