"""Op 2: main text by a linear-chain conditional random field over DOM leaf blocks.

A tolerant scanner turns a page into its leaf blocks in page order, each with the chain of its ancestors. Features are
ancestor tags, words of their class, id and role attributes, and shape of the text. The field has two labels (rest,
article); it is trained by maximum likelihood (forward-backward, Adam) on labelled pages, and Viterbi decodes.
Training pages are rows (html, texts of the article's blocks); without any, `labelled_pages` writes TRAINING_PAGES
pages of many layouts from a seed, so the training set is bounded and the model the same everywhere.

Edge cases: null, empty or text-free html gives an empty text; tags, quotes and comments left open, stray end tags and
unknown references are taken as browsers do or left as text; an element left open hides nothing after its own tag, save
script and style; the text of math and noscript is text; pages are never cut; rows that repeat are extracted one by one;
an empty table gives no rows. The other columns stay beside text and n_chars, which replace columns of those names.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

TRAINING_PAGES = 800

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>|[^<]++|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Za-z]+")

# Fixed values of HTML: elements whose content is no markup, elements that hide their content, elements that begin a block,
# those without an end tag, and those besides blocks that end an svg left open.
RAW = {t: re.compile(rf"</{t}(?:[\s/][^>]*+)?>", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
HIDING = frozenset(("svg", "object", "select", "template"))
_HIDING = re.compile(r"<(?:svg|object|select|template)[\s/>]", re.I)
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul ins".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKOUT = BLOCK | frozenset("b big br code em embed head i img meta nobr ruby s small span strong strike sub sup tt u var".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "html", "div", "section", "article"))


def tokens_of(page: str):
    """The page's tokens without what lies in elements of RAW. One that is left open ends at its own tag, script and style at the page's end."""
    at, open_ = 0, set()
    while at < len(page):
        for m in _TOKEN.finditer(page, at):
            yield m
            tag = m[2] and not m[1] and m[2].lower()
            if tag in RAW and tag not in open_:
                end = RAW[tag].search(page, m.end())
                if not end and tag in ("script", "style"):
                    return
                if end:
                    at = end.end()
                    break
                open_.add(tag)
        else:
            return


def shown(tokens: list) -> list:
    """Tokens without the content of elements of HIDING that have an end tag; their own start tag stays."""
    opened: dict[str, list[int]] = {t: [] for t in HIDING}
    until: dict[int, int] = {}
    for i, m in enumerate(tokens):
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in HIDING:
            if not m[1]:
                if tag != "svg" or not m[0].endswith("/>"):
                    opened[tag].append(i)
            elif opened[tag]:
                until[opened[tag].pop()] = i
        elif tag in BREAKOUT:
            opened["svg"].clear()
    out, i = [], 0
    while i < len(tokens):
        out.append(tokens[i])
        i = until.get(i, i) + 1
    return out


def leaf_blocks(page: str) -> list[tuple[str, int, list]]:
    """(text, characters inside links, ancestors as (tag, names)) of each block with text."""
    out: list[tuple[str, int, list]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    link = links = 0

    def close():
        nonlocal links
        t = " ".join(entities.unescape("".join(text)).split())
        if t:
            out.append((t, links, list(stack)))
        text.clear()
        links = 0

    found = tokens_of(page)
    for m in shown(list(found)) if _HIDING.search(page) else found:
        raw, tag = m[0], m[2]
        if not tag:
            if raw[0] != "<" or raw == "<":
                text.append(raw)
                links += len(raw) if link else 0
            continue
        tag, end = tag.lower(), bool(m[1])
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            link = 0 if end else 1
        elif tag == "head" and not end:
            stack.append(("head", ()))
        elif tag in BLOCK or tag == "head":
            close()
            link = 0
            if end:
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                continue
            if tag == "body":
                stack = [x for x in stack if x[0] != "head"]
            if stack and stack[-1][0] == "p":
                stack.pop()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
            if tag not in VOID:
                found = [x.lower() for a in _ATTRIBUTE.finditer(m[3]) for x in _NAME.findall(a[2] or a[3] or a[4] or "")] if m[3] else ()
                stack.append((tag, tuple(found)))
        elif tag in ("img", "input", "svg", "iframe", "object", "select", "textarea"):
            text.append(" ")
    close()
    return out


def features(blocks: list[tuple[str, int, list]]) -> list[list[str]]:
    out = []
    for i, (text, links, chain) in enumerate(blocks):
        tags = [t for t, _ in chain if t not in ("html", "body")]
        names = {n for _, some in chain for n in some}
        words = text.count(" ") + 1
        f = [f"a:{t}" for t in set(tags)] + [f"n:{n}" for n in names] + [f"stem:{n}" for n in {n[:4] for n in names}]
        f.append(f"own:{tags[-1] if tags else ''}")
        f.append(f"words:{min(6, words.bit_length())}")
        f.append(f"links:{4 * min(links, len(text)) // max(1, len(text))}")
        f.append("ends" if text[-1] in ".!?:;\"'”»…" else "open")
        if "©" in text or "copyright" in text.lower():
            f.append("copyright")
        if not tags:
            f.append("bare")
        f.append("first" if not i else "last" if i == len(blocks) - 1 else "middle")
        out.append(f)
    return out


class Field:
    """Scores of label 1 by feature, of label pairs, and of the first label."""

    def __init__(self, weights: dict[str, float], pairs, first):
        self.weights, self.pairs, self.first = weights, pairs, first

    def decode(self, found: list[list[str]]) -> list[int]:
        """Viterbi; label 0 wins ties."""
        if not found:
            return []
        get, (p, s) = self.weights.get, (self.pairs, self.first)
        back = []
        a, b = s[0], s[1] + sum(get(x, 0.0) for x in found[0])
        for f in found[1:]:
            e = sum(get(x, 0.0) for x in f)
            from0, from1 = int(b + p[1][0] > a + p[0][0]), int(b + p[1][1] > a + p[0][1])
            back.append((from0, from1))
            a, b = (b + p[1][0] if from0 else a + p[0][0]), (b + p[1][1] if from1 else a + p[0][1]) + e
        path = [int(b > a)]
        for f in reversed(back):
            path.append(f[path[-1]])
        return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 120, decay: float = 1e-4) -> Field:
    """Maximum likelihood over sequences of (features, labels), by Adam on the exact gradient."""
    pages = [p for p in pages if p[0]]
    vocab = {f: i for i, f in enumerate(sorted({f for x, _ in pages for some in x for f in some}))}
    length = np.array([len(x) for x, _ in pages])
    n, longest = len(pages), int(length.max())
    at = np.array([(i, t) for i, (x, _) in enumerate(pages) for t in range(len(x))])
    row = np.repeat(np.arange(len(at)), [len(some) for x, _ in pages for some in x])
    col = np.array([vocab[f] for x, _ in pages for some in x for f in some])
    y = np.zeros((n, longest), dtype=int)
    y[at[:, 0], at[:, 1]] = [v for _, labels in pages for v in labels]
    mask = np.arange(longest)[None, :] < length[:, None]
    size = len(vocab)
    theta, m1, m2 = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & mask[:, 1:]).sum()
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for step in range(1, steps + 1):
        w, pair, first = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        e = np.zeros((n, longest, 2))
        e[at[:, 0], at[:, 1], 1] = np.bincount(row, weights=w[col], minlength=len(at))
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = first + e[:, 0]
        for t in range(1, longest):
            f = lse(forward[:, t - 1, :, None] + pair[None], 1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], f, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b = lse(pair[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], b, 0.0)
        z = lse(forward[:, -1], 1)
        node = np.exp(forward + backward - z[:, None, None])
        both = forward[:, :-1, :, None] + pair[None, None] + (e + backward)[:, 1:, None, :] - z[:, None, None, None]
        expected = (np.exp(both) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        error = (y - node[..., 1])[at[:, 0], at[:, 1]]
        start = np.array([(y[:, 0] == v).sum() - node[:, 0, v].sum() for v in (0, 1)])
        grad = np.concatenate([np.bincount(col, weights=error[row], minlength=size), (seen - expected).ravel(), start]) / n - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in vocab.items()}
    return Field(weights, theta[size : size + 4].reshape(2, 2).tolist(), theta[size + 4 :].tolist())


# Layouts of the training pages: ways to open a part of a page. Names are in use on the web at large.
ARTICLE = [["<article>"], ["<main>"], ["<main>", "<article>"], ['<div class="content">'], ['<div id="content">'], ['<div class="post">'], ['<div class="entry-content">'], ['<div class="article-body">'], ['<section class="story">'], ['<div id="main">', "<article>"], ['<div role="main">'], ['<article class="post">', '<div class="entry">'], ['<div class="main-content">'], ['<div class="text">'], ["<section>"], ['<div class="wrapper">', "<article>"], ['<div class="container">', "<main>"], ['<div class="page">', '<div class="body">']]
WRAPPERS = ["<div>", '<div id="page">', '<div class="site">', '<div class="wrapper">', '<div class="container">', '<div id="app">', '<div class="layout">', '<div id="root">']
MENU = ["<nav>", '<div class="menu">', '<ul class="navbar">', '<div id="navigation">', '<div class="breadcrumbs">', '<nav class="top-nav">', '<div class="nav">', '<ul id="menu">', '<div role="navigation">', '<menu>']
HEADER = ["<header>", '<div class="header">', '<div id="masthead">', '<header class="site-header">', '<div class="banner">', '<div class="topbar">', '<div role="banner">']
SIDE = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="related">', '<section class="widget">', '<div class="related-posts">', '<div class="recommended">', '<div role="complementary">', '<div class="teaser">', '<div class="popular">', '<div id="right-column">']
ADS = ['<div class="ad">', '<div class="advert">', '<div class="ads">', '<div class="sponsored">', '<div class="promo">', '<aside class="advertisement">', '<div id="ad-top">', '<ins class="adsbygoogle">', '<div class="ad-slot">', '<div class="banner-ad">', '<p class="ad">']
NOTICE = ['<div class="cookie-notice">', '<div class="cookie-banner">', '<div id="gdpr">', '<div class="alert">', '<div class="notice">', '<p class="notice">', '<div class="newsletter">', '<div role="alert">', '<div class="popup">', '<div class="subscribe">', '<div class="consent">', '<dialog>', '<div class="modal">', '<div class="paywall">', '<div class="disclaimer">']
FORMS = ["<form>", '<form class="search">', '<form id="login">', '<div class="signup">', '<fieldset>', '<form action="/subscribe">', '<form class="contact">']
COMMENTS = ['<div class="comments">', '<section id="comments">', '<div id="comments">', '<section class="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<div id="disqus_thread">', '<div class="reader-comments">', '<div class="discussion">', '<div class="responses">', '<ul class="replies">', '<div class="comment">', '<article class="comment">']
FOOTER = ["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div role="contentinfo">', '<p class="copyright">', '<div class="bottom">', '<div class="legal">']
SHARE = ['<div class="share">', '<ul class="social">', '<div class="tags">', '<div class="share-buttons">', '<div class="pagination">']


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages of random layout with the texts of their article's blocks."""
    rng = random.Random(seed)
    syllables = "la re mi to an er is on te ra vo ke du si no pa el ur che gri ".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def phrase(lo, hi):
        return " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize()

    def prose(most=4):
        return " ".join(phrase(1, 18) + rng.choice(["."] * 6 + ["?", "!", ""]) for _ in range(rng.randint(1, most)))

    def ended(opening):
        return f"</{re.match(r'<(\w+)', opening)[1]}>"

    def links():
        items = [f'<a href="/{word()}">{phrase(1, 3)}</a>' for _ in range(rng.randint(2, 8))]
        return rng.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " ".join(items), lambda: "".join(f"<p>{x}</p>" for x in items)])()

    def part(openings, body):
        o = rng.choice(openings)
        if o.startswith("<p"):  # a paragraph holds no blocks
            body = prose(2)
        elif openings is not COMMENTS and rng.random() < 0.05:  # a name that says nothing
            o = rng.choice(["<div>", f'<div class="{word()}">', f'<div id="{word()}">'])
        return o + body + ended(o)

    def prose_or_bare():
        return rng.choice([prose(2), f"<p>{prose(2)}</p>", f"<h3>{phrase(1, 4)}</h3><p>{prose(2)}</p>", f"<span>{prose(2)}</span>"])

    def form():
        return f"<label>{phrase(1, 3)}</label><input name=q><button>{phrase(1, 2)}</button>" + rng.choice(["", f"<p>{prose(1)}</p>", f"<select><option>{word()}</option></select>"])

    def comments():
        one = lambda: rng.choice([f'<div class="comment"><b>{phrase(1, 2)}</b><p>{prose(3)}</p></div>', f"<p>{prose(3)}</p>", f"<li><p>{prose(3)}</p></li>", f"<article><p>{prose(2)}</p></article>"])
        return rng.choice(["", f"<h2>{phrase(1, 3)}</h2>", f"<h3>{phrase(1, 2)}</h3>"]) + "".join(one() for _ in range(rng.randint(1, 5)))

    noise = {
        "menu": lambda: part(MENU, links()),
        "header": lambda: part(HEADER, rng.choice([phrase(1, 4), f"<h1>{phrase(1, 4)}</h1>", f"<p>{prose(1)}</p>", links(), f'<div class="logo">{phrase(1, 2)}</div>' + links()])),
        "side": lambda: part(SIDE, rng.choice([links(), prose_or_bare(), f"<h3>{phrase(1, 3)}</h3>" + links()])),
        "ad": lambda: part(ADS, prose_or_bare()),
        "notice": lambda: part(NOTICE, prose_or_bare() + rng.choice(["", f"<button>{phrase(1, 2)}</button>", f'<a href="/x">{phrase(1, 2)}</a>'])),
        "form": lambda: part(FORMS, form()),
        "comments": lambda: part(COMMENTS, comments()),
        "footer": lambda: part(FOOTER, rng.choice(["&copy; " + phrase(1, 3) + " &middot; " + prose(1), links(), f"<p>{prose(2)}</p>", f"<p>Copyright {phrase(1, 3)}</p>" + links()])),
        "share": lambda: part(SHARE, links()),
    }

    def article():
        out, texts = [], []

        def block(tag, t, shown=None):
            out.append(f"<{tag}>{shown or t}" + ("" if tag == "p" and rng.random() < 0.15 else f"</{tag}>"))
            texts.append(t)

        if rng.random() < 0.85:
            block("h1", phrase(2, 9) + rng.choice(["", "."]))
        for _ in range(rng.choice([0, 1, 2, 4, 8, 14, 25])):
            kind = rng.random()
            if kind < 0.08:
                block("p", phrase(1, 7))
            elif kind < 0.66:
                block("p", prose())
            elif kind < 0.74:
                t = prose(1)
                block("p", t, f"<b>{t}<br>")
            elif kind < 0.82:
                block("h2", phrase(1, 6))
            elif kind < 0.87:
                items = [phrase(2, 12) for _ in range(rng.randint(2, 5))]
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                texts.extend(items)
            elif kind < 0.91:
                block("blockquote", prose(2))
            elif kind < 0.94:
                t, u, v = prose(1), phrase(1, 3), prose(1)
                block("p", f"{t} {u} {v}", f'{t} <a href="/y">{u}</a> {v}')
            elif kind < 0.96:
                block("pre", phrase(2, 20))
            else:
                out.append(noise[rng.choice(["ad", "ad", "share", "side", "notice", "form"])]())
        return "".join(out), texts

    pages = []
    for _ in range(n):
        before = [k for k in ("notice", "header", "menu", "ad", "form", "side") if rng.random() < 0.4]
        after = [k for k in ("share", "ad", "comments", "side", "form", "notice", "menu") if rng.random() < 0.35] + ["footer"] * (rng.random() < 0.8)
        rng.shuffle(before)
        if rng.random() < 0.15:  # little else on the page
            before, after = [], after[: rng.randint(0, 1)]
        opening = rng.choice(ARTICLE) if rng.random() < 0.88 else [rng.choice(["<div>", f'<div class="{word()}">', f'<div id="{word()}">'])]
        body, texts = article()
        inner = "".join(noise[k]() for k in ("share", "comments", "form", "ad") if rng.random() < 0.12)
        middle = "".join(opening) + body + inner + "".join(ended(o) for o in reversed(opening))
        if rng.random() < 0.04:
            middle, texts = "", []
        whole = "".join(noise[k]() for k in before) + middle + "".join(noise[k]() for k in after)
        if rng.random() < 0.4:
            whole = rng.choice(WRAPPERS) + whole + "</div>"
        pages.append((f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title></head><body>{whole}</body></html>", texts))
    return pages


def labelled(page: str, texts: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page's blocks: those whose text is the next one of the article."""
    blocks, labels, want = leaf_blocks(page), [], list(texts)
    for text, _, _ in blocks:
        hit = bool(want) and text == " ".join(want[0].split())
        labels.append(int(hit))
        if hit:
            want.pop(0)
    return features(blocks), labels


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train([labelled(*p) for p in labelled_pages(TRAINING_PAGES)])


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    labels = field.decode(features(blocks))
    return "\n\n".join(b[0] for b, keep in zip(blocks, labels, strict=True) if keep)


def extract(pages: DataFrame, field: Field | None = None, html_col: str = "html") -> DataFrame:
    """Adds text and n_chars to the other columns of every page; the html column goes. No shuffle."""
    model = field or default_field()
    kept = pages.select(*[c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")], F.col(html_col).alias(html_col))

    def run(batches):
        for b in batches:
            texts = [main_text(h, model) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(released(run), f"{kinds}, text string, n_chars long")
