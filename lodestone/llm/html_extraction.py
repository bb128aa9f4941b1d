"""Operator 7, main text of web pages by a linear-chain conditional random field.

A page becomes its leaf blocks in order: the text between two tags that break lines, with the elements around it. A block's features are the tags, class, id
and role words of its ancestors and simple facts of its text; neighbouring labels have weights of their own. The field is trained, by stochastic gradient
on the exact likelihood (forward-backward), on labelled pages that `labelled_page` draws from many layouts, and decoded by Viterbi.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Elements that do not break a line of text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that show their content in the line, if not always and everywhere: what they hold is text like other text.
INLINE |= set("noscript object audio video canvas math mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mtable mtr mtd semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown, or only in a control.
HIDDEN = ("script", "style", "template", "iframe", "svg", "textarea", "select", "button", "head", "annotation", "annotation-xml")
_RAW = "script|style|template|iframe|svg|textarea|select|title"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + _RAW + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)|<(?P<open>[a-zA-Z][^\s>/]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z!?][^>]*(?:>|\Z)|</?\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements that end an open paragraph when they begin, and elements that end an open one of their own kind.
_ENDS_P = set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS_OWN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


#: Elements that may stand in a head; what else begins ends an open one, as shown text does.
_IN_HEAD = set("base basefont bgsound head html link meta noscript script style template title".split())


class Block:
    __slots__ = ("linked", "path", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, path: tuple[str, ...]):
        self.text, self.linked, self.tag, self.path = text, linked, tag, path


def _names(rest: str) -> list[str]:
    out = []
    for m in _ATTR.finditer(rest):
        out += ["c:" + w.lower() for w in _WORD.findall(m[2] or m[3] or m[4] or "")]
    return out


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of shown text; character references are decoded, white space is one blank."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]  # names around in order, so that sums over them do not depend on the hash seed
    parts: list[str] = []
    linked, links, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, path = next(((t, p) for t, p in reversed(stack) if t not in INLINE), stack[0])
                blocks.append(Block(text, linked, tag, path))
            parts.clear()
        linked = 0

    def pop(n: int) -> None:
        nonlocal links, hidden
        while len(stack) > n:
            tag, _ = stack.pop()
            links -= tag == "a"
            hidden -= tag in HIDDEN

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and hidden and stack[-1][0] == "head" and not page[at : m.start()].isspace():
            pop(len(stack) - 1)
        if m.start() > at and not hidden:
            text = page[at : m.start()]
            parts.append(text)
            linked += len(text) if links else 0
        at = m.end()
        if m["close"]:
            tag = m["close"].lower()
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
        elif m["open"]:
            tag = m["open"].lower()
            if hidden and stack[-1][0] == "head":
                if tag == "head":
                    continue
                if tag not in _IN_HEAD:
                    pop(len(stack) - 1)
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in INLINE:
                flush()
                if tag in _ENDS_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            pop(k)
                            break
                        if stack[k][0] not in INLINE:
                            break
                for k in range(len(stack) - 1, 0, -1) if tag in _ENDS_OWN else ():
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if stack[k][0] in _ENDS_OWN[tag]:
                        break
            if tag not in VOID and not m["rest"].endswith("/"):
                path = stack[-1][1]
                if tag not in INLINE:
                    path = tuple(sorted({*path, "t:" + tag, *_names(m["rest"])}))
                stack.append((tag, path))
                links += tag == "a"
                hidden += tag in HIDDEN
    if at < len(page) and hidden and stack[-1][0] == "head" and not page[at:].isspace():
        pop(len(stack) - 1)
    if at < len(page) and not hidden:
        parts.append(page[at:])
        linked += len(page) - at if links else 0
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block."""
    has = any("t:article" in b.path or "t:main" in b.path for b in blocks)
    out = []
    for k, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        f = ["bias", "leaf:" + b.tag, *b.path]
        where = "content" if "t:article" in b.path or "t:main" in b.path else "outside" if has else "unknown"
        f += ["in:" + where, f"in:{where}:{b.tag}"]
        if not any(x[0] == "c" for x in b.path):
            f.append(f"unnamed:{where}:{b.tag}")
        f.append("words:" + ("1" if n < 3 else "3" if n < 8 else "8" if n < 20 else "20" if n < 60 else "60"))
        share = b.linked / max(1, len(b.text))
        f.append("links:" + ("all" if share > 0.8 else "many" if share > 0.3 else "few" if share > 0 else "none"))
        f.append("end:" + ("stop" if b.text[-1] in ".!?…:;\"”»)" else "open"))
        if "©" in b.text:
            f.append("sign")
        if k == 0:
            f.append("first")
        if k == len(blocks) - 1:
            f.append("last")
        out.append(f)
    return out


class Field:
    """Linear-chain conditional random field with the labels 0 (other) and 1 (main text)."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, 2))
        self.step = np.zeros((2, 2))

    def _rows(self, blocks: list[Block]) -> list[np.ndarray]:
        return [np.array([self.index[x] for x in f if x in self.index], np.int64) for f in features(blocks)]

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.3, ridge: float = 1e-4, seed: int = 11) -> Field:
        for blocks, _ in pages:
            for f in features(blocks):
                for x in f:
                    self.index.setdefault(x, len(self.index))
        self.weight = np.zeros((len(self.index), 2))
        squares, step_squares = np.full(self.weight.shape, 1e-2), np.full((2, 2), 1e-2)
        rng = np.random.default_rng(seed)
        data = []
        for b, y in pages:
            if b:
                rows = self._rows(b)
                at, size = np.concatenate(rows), np.array([len(r) for r in rows])
                uniq, inv = np.unique(at, return_inverse=True)
                data.append((at, np.cumsum(size) - size, size, uniq, inv, np.array(y)))
        for _ in range(epochs):
            for k in rng.permutation(len(data)).tolist():
                at, first, size, uniq, inv, y = data[k]
                single, pair = self._marginals(np.add.reduceat(self.weight[at], first, axis=0))
                single[np.arange(len(y)), y] -= 1
                grad_step = pair.sum(0)
                np.add.at(grad_step, (y[:-1], y[1:]), -1)
                each = np.repeat(single, size, axis=0)
                grad = np.stack([np.bincount(inv, each[:, j], len(uniq)) for j in (0, 1)], 1) + ridge * self.weight[uniq]
                squares[uniq] += grad**2
                self.weight[uniq] -= rate * grad / np.sqrt(squares[uniq])
                step_squares += grad_step**2
                self.step -= rate * grad_step / np.sqrt(step_squares)
        return self

    def _marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: P(label of each block), P(labels of each two neighbours)."""
        (s00, s01), (s10, s11) = self.step.tolist()
        rows = score.tolist()

        def added(x: float, y: float) -> float:
            return max(x, y) + math.log1p(math.exp(-abs(x - y)))

        a, b = rows[0]
        fore = [(a, b)]
        for p, q in rows[1:]:
            a, b = p + added(a + s00, b + s10), q + added(a + s01, b + s11)
            fore.append((a, b))
        total = added(a, b)
        a = b = 0.0
        back = [(a, b)]
        for p, q in rows[:0:-1]:
            a, b = added(s00 + p + a, s01 + q + b), added(s10 + p + a, s11 + q + b)
            back.append((a, b))
        f, g = np.array(fore), np.array(back[::-1])
        pair = np.exp(f[:-1, :, None] + self.step + (score[1:] + g[1:])[:, None, :] - total)
        return np.exp(f + g - total), pair

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi: the likeliest labels of a page together."""
        if not blocks:
            return []
        weight, index = self.weight, self.index
        (s00, s01), (s10, s11) = self.step.tolist()
        known: dict[tuple, tuple[float, float]] = {}
        choices = []
        a = b = 0.0
        for k, f in enumerate(features(blocks)):
            key = tuple(f)
            if (w := known.get(key)) is None:
                w = known[key] = tuple(weight[[index[x] for x in f if x in index]].sum(0).tolist())
            if k == 0:
                a, b = w
                continue
            from0, from1 = a + s00 < b + s10, a + s01 < b + s11
            choices.append((int(from0), int(from1)))
            a, b = max(a + s00, b + s10) + w[0], max(a + s01, b + s11) + w[1]
        path = [int(b > a)]
        for c in reversed(choices):
            path.append(c[path[-1]])
        return path[::-1]


# ---------------------------------------------------------------- labelled pages


def labelled_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page of a random layout and the blocks of its main text."""
    main: list[str] = []
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: bool(rng.random() < p)
    word = lambda: "".join(pick("ba", "lo", "ter", "in", "es", "ü", "con", "di", "a", "ron", "ци", "el") for _ in range(int(rng.integers(1, 4))))

    def say(a: int, b: int, stop: bool = True) -> str:
        words = [word() + (pick("!!", "%%%", "***", ",", "|") if odd else "") for odd in (rng.random(int(rng.integers(a, b))) < pick(0, 0, 0, 0.05, 0.7))]
        return pick(" ", " ", " ", " | ").join(words).capitalize() + (pick(".", ".", ".", "!", "?", "", "") if stop else "")

    def put(text: str) -> str:
        main.append(text)
        return html.escape(text)

    def name(*kinds: str) -> str:
        how = pick("class", "class", "id", "none", "role")
        kind = pick(*kinds)
        return "" if how == "none" else f' {how}="{kind}"' if chance(0.6) else f' {how}="{pick("site", "page", "main", "box", "x1")}{pick("-", "_", " ")}{kind}"'

    def links(n: int) -> str:
        return "".join(f'<a href="/{k}">{say(1, 3, False)}</a> ' if chance(0.5) else f'<li><a href="/{k}">{say(1, 4, False)}</a></li>' for k in range(n))

    def menu() -> str:
        tag = pick("nav", "nav", "div", "ul", "header")
        return f"<{tag}{name('nav', 'menu', 'navbar', 'breadcrumb', 'topbar', 'navigation', 'header')}><ul>{links(int(rng.integers(2, 8)))}</ul></{tag}>"

    def masthead() -> str:
        return f"<header{name('header', 'masthead', 'banner', 'logo')}><div>{say(1, 5, False)}</div><p>{say(2, 8)}</p></header>"

    def advert() -> str:
        return f'<{(t := pick("div", "div", "aside", "p", "section"))} class="{pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad", "ad-slot", "adsbox")}">{say(2, 25)}</{t}>'

    def notice() -> str:
        if chance(0.08):
            return f"<noscript>{say(3, 12)}</noscript>"
        return f'<{(t := pick("div", "div", "section", "p"))} {pick("class", "id", "role")}="{pick("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "banner", "popup", "modal", "notification", "cookies", "disclaimer", "paywall", "subscribe")}"><p>{say(4, 25)}</p></{t}>'

    def sidebar() -> str:
        tag = pick("aside", "aside", "div")
        mark = "" if tag == "aside" and chance(0.5) else f' class="{pick("sidebar", "side", "widget", "related", "rail", "recommended", "popular", "trending", "secondary")}"'
        return f"<{tag}{mark}><h3>{say(1, 4, False)}</h3><ul>{links(int(rng.integers(2, 6)))}</ul><p>{say(3, 25)}</p></{tag}>"

    def form() -> str:
        return f'<form{name("search", "newsletter", "login", "signup", "contact", "form")}><label>{say(1, 4, False)}</label><input type="text"><p>{say(2, 12)}</p><select><option>{word()}</option></select><button>{word()}</button></form>'

    def share() -> str:
        return f'<div class="{pick("share", "social", "tags", "meta", "byline", "toolbar", "author", "pagination", "pager")}">{links(3)}</div>'

    def comments() -> str:
        inner = "".join(f'<{(t := pick("div", "li", "article", "p"))} class="{pick("comment", "reply", "comment-body", "user-comment", "response")}"><b>{word()}</b><p>{say(3, 40)}</p></{t}>' for _ in range(int(rng.integers(1, 5))))
        tag = pick("section", "div", "ol")
        mark = pick("comments", "comment-list", "commentlist", "disqus_thread", "discussion", "responses", "replies", "comments-area", "reader-comments")
        return f'<{tag} {pick("class", "id")}="{mark}"><h2>{say(1, 3, False)}</h2>{inner}</{tag}>'

    def footer() -> str:
        tag = pick("footer", "footer", "footer", "div")
        mark = "" if tag == "footer" and chance(0.6) else f' class="{pick("footer", "foot", "copyright", "colophon", "bottom", "legal")}"'
        return f"<{tag}{mark}>{pick('&copy; ', '© ', '')}{say(1, 4, False)} &middot; {say(3, 14)} {links(int(rng.integers(0, 4)))}</{tag}>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.62:
            return f"<p>{put(say(1, 90))}{pick('</p>', '</p>', '</p>', '')}"
        if kind < 0.7:
            return f"<p><b>{put(say(1, 50))}{pick('<br></b></p>', '<br>', '</b></p>')}"
        if kind < 0.78:
            return f"<{(t := pick('h2', 'h3'))}>{put(say(1, 7, False))}</{t}>"
        if kind < 0.86:
            return f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{put(say(1, 15))}</li>" for _ in range(int(rng.integers(1, 5)))) + f"</{t}>"
        if kind < 0.91:
            return f"<blockquote>{put(say(3, 30))}</blockquote>"
        if kind < 0.93:
            return f"<{(t := pick('div', 'figcaption', 'pre', 'dd'))}>{put(say(1, 30))}</{t}>"
        if kind < 0.96:
            return f"<table><tr><td>{put(say(1, 4, False))}</td><td>{put(say(1, 4, False))}</td></tr></table>"
        before, link = say(2, 10, False), word()
        main.append(f"{before} {link}.")
        return f"<p>{html.escape(before)} <a href='/x'>{link}</a>.</p>"

    def story() -> str:
        shape = pick("article", "article", "article", "main", "main", "class", "bare")
        body = [f"<h1>{put(say(1, 12, chance(0.3)))}</h1>"] if chance(0.85) else []
        for _ in range(int(rng.integers(1, 14))):
            part = paragraph()
            if chance(0.2):
                around = pick("section", "div", "div", "figure")
                part = f"<{around}>{part}</{around}>"
            body.append(part)
            if chance(0.1):
                body.append(pick(advert, share, form, sidebar, notice)())
        inner = "".join(body)
        if shape == "article":
            return f"<article{name('post', 'entry', 'article', 'story', 'hentry') if chance(0.3) else ''}>{inner}{comments() if chance(0.08) else ''}</article>"
        if shape == "main":
            return f"<main>{inner}{comments() if chance(0.15) else ''}</main>"
        if shape == "class":
            return f'<div {pick("class", "id")}="{pick("content", "post", "article", "entry-content", "story", "article-body", "post-content", "main-content", "body-text", "text")}">{inner}</div>'
        return inner

    before = [pick(menu, menu, advert, notice, masthead, form, sidebar)() for _ in range(int(rng.integers(0, 5)))]
    middle = story()
    after = [pick(advert, sidebar, comments, share, form, notice, menu)() for _ in range(int(rng.integers(0, 4)))]
    after += [footer()] if chance(0.85) else []
    before, after = ([] if chance(0.15) else before), ([] if chance(0.2) else after)  # bare and cut-off pages
    head = f"<head><title>{say(1, 8, False)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{middle}{''.join(after)}{pick('</body></html>', '')}", main


def labels_of(page: str, main: list[str]) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled page: those that hold a part of the main text, in order."""
    blocks = leaf_blocks(page)
    want, at, out = [" ".join(x.split()) for x in main], 0, []
    for b in blocks:
        hit = at < len(want) and b.text == want[at]
        out.append(int(hit))
        at += hit
    return blocks, out


@lru_cache(maxsize=2)
def trained(pages: int = 1500, seed: int = 3) -> Field:
    rng = np.random.default_rng(seed)
    return Field().train([labels_of(*labelled_page(rng)) for _ in range(pages)])


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: (page_id, url, text, n_chars). Null and empty html give an empty text; repeated rows give one row each; other columns
    are not looked at."""
    small_batches(pages.sparkSession)
    known = field or trained()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            texts = [main_text(h, known) for h in x.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(batches, "page_id long, url string, text string, n_chars long").withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
