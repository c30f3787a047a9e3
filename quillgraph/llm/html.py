"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A tolerant tokenizer turns a page into leaf blocks: runs of text between block-level tags, with the tags, class and id words
of their ancestors. Each block has two labels, text of the article or not; features of ancestors, place and wording give the
state scores, a 2 x 2 table the transitions, and Viterbi picks the page's best sequence. The weights maximise the
likelihood of labelled pages, by forward-backward in numpy. An element keeps the score of its whole path, so a block costs no
more on a deep page than on a flat one. The driver's tables label no pages, so the labelled pages are
written by ``labelled_pages``: articles in varied wrappers among menus, headers, sidebars, notices, adverts, forms, footers
and reader comments. ``extract`` takes any other labelled pages as well.

Defined cases: a null or empty page, or one without an article, gives the empty text; unclosed or stray tags are tolerated;
script, style, template, title, select, textarea and comments never are text, and such an element without its end tag lasts
to the end of the page; repeated rows give repeated results; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Element groups of HTML.
_RAW = set("script style template select textarea title metadata desc".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "noscript iframe object canvas optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SECTIONS = set("article aside body footer form header main nav section table ul ol dl figure blockquote div".split())
_CLOSES_P = _BLOCK - {"option", "optgroup"}

#: Parts of class and id words that name a region; a word such as "commentlist" counts as "comment" too.
_STEMS = ("comment", "discuss", "respon", "repl", "nav", "menu", "foot", "head", "side", "widget", "share", "social", "cookie", "advert", "promo", "relat", "subscri", "newsletter", "breadcrumb")

Block = tuple[str, list[str]]  # text, features


@dataclass(slots=True)
class _Open:
    """An open element: its tag, the path features that it adds, the path's score, the nearest section, whether in a link."""

    tag: str
    adds: tuple[str, ...]
    score: float
    near: str
    link: bool


class _Page:
    """Reads one page into blocks: (text, features), or with ``state`` (text, sum of the features' scores)."""

    def __init__(self, page: str, state: dict[str, float] | None = None) -> None:
        self.blocks: list[tuple[str, list[str] | float]] = []
        self.state = state
        self.stack = [_Open("", (), 0.0, "", False)]
        self.path: dict[str, None] = {}  # features of all open elements
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = self.size = 0
        self.head, self.above = self.stack[0], []
        at, n = 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            if not m:
                self._text(page[at:])
                break
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing = name.lower(), bool(m[1] or m[4])
            attrs = m[3] or m[6] or ""
            if name in _RAW:
                if not closing:
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                    # an element that closes itself swallows what follows only if there is an end tag, as browsers read it
                    at = end.end() if end else at if attrs.endswith("/") else n
            elif name == "head":
                continue
            elif closing:
                self._close(name)
            else:
                self._open(name, attrs)
        self._flush()

    def _text(self, s: str) -> None:
        if not self.parts:
            self.head = self.stack[-1]
            if self.state is None:
                self.above = list(self.path)
        s = _html.unescape(s) if "&" in s else s
        self.parts.append(s)
        k = len(s.strip())
        self.size += k
        self.linked += k * self.stack[-1].link

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                own = [f"near:{self.head.near}", *wording(text, self.linked / max(self.size, 1))]
                self.blocks.append((text, [*self.above, *own] if self.state is None else self.head.score + sum(self.state.get(f, 0.0) for f in own)))
            self.parts, self.linked, self.size = [], 0, 0

    def _pop(self, name: str) -> None:
        while True:
            last = self.stack.pop()
            self.open[last.tag] -= 1
            for f in last.adds:
                del self.path[f]
            if last.tag == name:
                return

    def _close(self, name: str) -> None:
        if name in _BLOCK:
            self._flush()
        if self.open.get(name):
            self._pop(name)

    def _open(self, name: str, attrs: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name in _BLOCK:
            self._flush()
            if name in _CLOSES_P and self.open.get("p"):
                self._pop("p")
            if name in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack[-1].tag == name:
                self._pop(name)
        if name in _VOID or attrs.endswith("/") and (self.open.get("svg") or self.open.get("math")):
            return
        last = self.stack[-1]
        words = {w.lower().rstrip("s") for a in _ATTR.findall(attrs) for w in _WORD.findall(a[1] or a[2] or a[3])} if "=" in attrs else set()
        stems = {k for k in _STEMS for w in words if k in w}
        adds = tuple(f for f in [f"in:{name}", *(f"cls:{w}" for w in sorted(words)), *(f"stem:{k}" for k in sorted(stems))] if f not in self.path)
        self.path.update(dict.fromkeys(adds))
        near = last.near
        if name in _SECTIONS:
            near = " ".join([name, *sorted(words)][:3]) if words or name not in ("div", "section") else near
        score = last.score + sum(self.state.get(f, 0.0) for f in adds) if self.state else 0.0
        self.stack.append(_Open(name, adds, score, near, last.link or name == "a"))
        self.open[name] = self.open.get(name, 0) + 1


def wording(text: str, linked: float) -> list[str]:
    """Features of a block's text."""
    n = text.count(" ") + 1
    out = [f"words:{min(n.bit_length(), 7)}", f"link:{int(linked * 3.99)}"]
    out += [k for k, ok in (("stop", text[-1] in ".!?…\"”"), ("comma", "," in text), ("mark", any(c in text for c in "©|»›"))) if ok]
    low = text.lower() if n < 40 else ""
    out += [f"say:{w}" for w in ("©", "cookie", "copyright", "subscribe", "newsletter", "advert", "sponsored", "repl", "comment", "share", "log in", "sign up", "all rights", "related", "privacy") if w in low]
    return out


def blocks(page: str | None) -> list[Block]:
    return _Page(page or "").blocks


class Crf:
    """Two labels; ``state`` maps a feature to its score for label 1, ``move`` is the transition table."""

    def __init__(self, state: dict[str, float], move: list[list[float]], start: float) -> None:
        self.state, self.move, self.start = state, move, start

    def label(self, scores: list[float]) -> list[int]:
        """The best sequence for the blocks' state scores, by Viterbi."""
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.move
        back = []
        s0, s1 = 0.0, self.start
        for k, e in enumerate(scores):
            if k:
                a0, a1 = (0, s0 + m00) if s0 + m00 >= s1 + m10 else (1, s1 + m10)
                b0, b1 = (0, s0 + m01) if s0 + m01 >= s1 + m11 else (1, s1 + m11)
                back.append((a0, b0))
                s0, s1 = a1, b1
            s1 += e
        out = [int(s1 > s0)]
        for a, b in reversed(back):
            out.append(b if out[-1] else a)
        return out[::-1]


def train(pages: Iterable[tuple[list[Block], list[int]]], epochs: int = 100, rate: float = 0.15, penalty: float = 5e-5) -> Crf:
    """Weights by gradient ascent (Adam) on the likelihood; all pages step together along their blocks."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for p, _ in pages for _, fs in p for f in fs})
    index = {f: k for k, f in enumerate(names)}
    longest, b, nf = max(len(p) for p, _ in pages), len(pages), len(names)
    x, y, on = np.zeros((longest, b, nf), np.float32), np.zeros((longest, b), int), np.zeros((longest, b))
    for j, (p, labels) in enumerate(pages):
        for t, (_, fs) in enumerate(p):
            x[t, j, [index[f] for f in fs]] = 1
            y[t, j], on[t, j] = labels[t], 1
    w = np.zeros(nf + 5)  # features, four moves, start
    mean, square = np.zeros_like(w), np.zeros_like(w)
    flat = x.reshape(-1, nf)
    for step in range(1, epochs + 1):
        move = w[nf : nf + 4].reshape(2, 2)
        e = np.zeros((longest, b, 2))
        e[..., 1] = (flat @ w[:nf].astype(np.float32)).reshape(longest, b)
        e[0, :, 1] += w[-1]
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[0] = e[0]
        for t in range(1, longest):
            nxt = np.logaddexp(fwd[t - 1][:, :1] + move[0], fwd[t - 1][:, 1:] + move[1]) + e[t]
            fwd[t] = np.where(on[t][:, None] > 0, nxt, fwd[t - 1])
        for t in range(longest - 2, -1, -1):
            s = bwd[t + 1] + e[t + 1]
            prv = np.logaddexp(move[:, 0] + s[:, :1], move[:, 1] + s[:, 1:])
            bwd[t] = np.where(on[t + 1][:, None] > 0, prv, 0.0)
        z = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
        p1 = np.exp(fwd[..., 1] + bwd[..., 1] - z) * on
        grad = np.zeros_like(w)
        grad[:nf] = ((y * on - p1).reshape(-1) @ flat)
        for i in (0, 1):
            for j in (0, 1):
                both = np.exp(fwd[:-1, :, i] + move[i, j] + e[1:, :, j] + bwd[1:, :, j] - z) * on[1:]
                grad[nf + 2 * i + j] = ((y[:-1] == i) & (y[1:] == j) & (on[1:] > 0)).sum() - both.sum()
        grad[-1] = (y[0] - p1[0]).sum()
        grad = grad / b - penalty * w * 10
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Crf({f: float(w[k]) for f, k in index.items()}, w[nf : nf + 4].reshape(2, 2).tolist(), float(w[-1]))


def labelled_pages(n: int = 450, seed: int = 3) -> list[tuple[str, list[str]]]:
    """(html, blocks of its article) of ``n`` written pages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ka lo mi ren tu sal ve dor in the an es eau chi öß ça ñe ba".split()) for _ in range(r.randint(1, 4)))

    def sentence(a: int = 3, b: int = 18) -> str:
        ws = [word() + ("," if r.random() < 0.1 else "") for _ in range(r.randint(a, b))]
        return (" ".join(ws).rstrip(",") + r.choice("....!?")).capitalize()

    para = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 1, 2, 3, 5, 9])))
    label = lambda: " ".join(word() for _ in range(r.randint(1, 4)))
    links = lambda k: "".join(f'<li><a href="/{word()}">{label()}</a></li>' for _ in range(k))
    say = lambda *a: r.choice(a)

    def junk(kind: str) -> str:
        k = r.randint(2, 8)
        if kind == "nav":
            return say(f"<nav><ul>{links(k)}</ul></nav>", f'<div class="{say("menu", "navbar", "nav", "breadcrumbs", "main-menu")}"><ul>{links(k)}</ul></div>', f'<ul id="menu">{links(k)}</ul>', f'<nav>{"".join(f"<a href=/>{label()}</a> " for _ in range(k))}</nav>')
        if kind == "header":
            return say(f"<header><h1>{label()}</h1><p>{sentence()}</p></header>", f'<header><a href="/">{label()}</a><div class="tagline">{sentence()}</div></header>', f'<div id="header" class="{say("site-header", "masthead", "topbar")}"><a href="/">{label()}</a> {label()}</div>')
        if kind == "ad":
            c = say("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "ad-slot", "sponsor")
            return say(f'<div class="{c}">{para()}</div>', f'<aside class="{c}"><p>{para()}</p></aside>', f'<div id="{c}"><a href="/x">{sentence()}</a></div>')
        if kind == "side":
            return say(f"<aside><h3>{label()}</h3><ul>{links(k)}</ul></aside>", f'<div class="{say("sidebar", "widget", "related", "trending", "recommended")}"><h3>{label()}</h3><p>{para()}</p><ul>{links(k)}</ul></div>', f"<aside><p>{para()}</p></aside>")
        if kind == "notice":
            if r.random() < 0.1:
                return f"<noscript><p>{para()}</p></noscript>"
            return f'<div class="{say("cookie", "cookie-notice", "consent", "notice", "gdpr-banner", "alert", "popup", "modal", "newsletter", "subscribe")}"><p>{say("We use cookies. ", "", "Subscribe to our newsletter. ")}{para()}</p><button>{label()}</button></div>'
        if kind == "form":
            return say(f'<form action="/s"><label>{label()}</label><input name="q"><button>{label()}</button></form>', f"<form><p>{para()}</p><select><option>{label()}</option></select><button>{label()}</button></form>")
        if kind == "share":
            return f'<div class="{say("share", "social", "tags", "meta", "byline", "pagination", "author-bio", "author-box", "post-author")}">{"".join(f"<a href=/>{label()}</a> " for _ in range(k))}{say("", label(), para())}</div>'
        if kind == "comments":
            one = lambda: say(f'<div class="comment"><b>{label()}</b><p>{para()}</p></div>', f'<article class="comment"><header>{label()}</header><p>{para()}</p></article>', f"<li><p>{para()}</p></li>")
            name = say("comments", "comment-list", "responses", "disqus", "replies", "commentlist", "comments-area", "discussion", "user-comments", "respond", "thread")
            if r.random() < 0.3:
                item = lambda: say(f"<li><p>{para()}</p></li>", f"<li><b>{label()}</b> {para()}</li>", f'<li class="{say("comment", "depth-1", "even")}"><div class="comment-body"><p>{para()}</p></div></li>')
                return f'{say("", f"<h3>{k} comments</h3>", f"<h3>{label()}</h3>")}<{(t := say("ol", "ul"))} {say("id", "class")}="{name}">{"".join(item() for _ in range(k))}</{t}>'
            return f'<{(t := say("section", "div"))} {say("id", "class")}="{name}"><h3>{say("Comments", label(), "Discussion", f"{k} comments")}</h3>{"".join(one() for _ in range(k))}</{t}>'
        return say(f"<footer>&copy; {label()} &middot; {sentence()}</footer>", f'<div class="{say("footer", "site-footer", "copyright", "bottom")}">&copy; {label()}<p>{para()}</p></div>', f"<footer><p>{para()}</p><ul>{links(k)}</ul></footer>")

    out = []
    for _ in range(n):
        body, text = [], []

        def put(tag: str, s: str) -> None:
            text.append(s)  # noqa: B023
            body.append(say(f"<{tag}>{s}</{tag}>", f"<{tag}>{s}</{tag}>\n", f"<{tag}>{s}" if tag == "p" else f"<{tag}>{s}</{tag}>", f"<p><b>{s}<br>" if tag == "p" else f"<{tag}>{s}</{tag}>"))  # noqa: B023

        if r.random() < 0.85:
            put(say("h1", "h1", "h2"), say(label(), sentence()))
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            u = r.random()
            if u < 0.76:
                put("p", say(para(), para(), word().capitalize() + "."))
            elif u < 0.83:
                put("h2", label())
            elif u < 0.87:
                items = [sentence() for _ in range(r.randint(2, 5))]
                body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                text += items
            elif u < 0.9:
                put("blockquote", para())
            elif u < 0.92:
                put("td", label())
            else:
                body.append(junk(say("ad", "side", "share", "notice")))
        inside = r.random() < 0.15
        if inside:
            body.append(junk("comments"))
        core = "".join(body)
        wrap = say(*["<article>{}</article>"] * 4, "<main>{}</main>", "<main><article>{}</article></main>", '<div class="{c}">{}</div>', '<div id="{c}">{}</div>', '<section class="{c}">{}</section>', '<div role="main">{}</div>', '<main class="{c}"><div>{}</div></main>', '<article class="{c}"><section>{}</section></article>')
        if r.random() < 0.4:  # nothing says that it is the article: no wrapper, or one that says nothing
            wrap = say("{}", "{}", "<div>{}</div>", '<div class="row"><div class="col">{}</div></div>', '<div class="{n}">{}</div>', '<div id="{n}"><div class="{n}">{}</div></div>', "<section>{}</section>", "<center>{}</center>").replace("{n}", word())
        core = wrap.replace("{c}", say("content", "post", "entry-content", "article-body", "story", "post-body", "main-content", "article", "text")).replace("{}", core)
        before = [junk(k) for k in ("notice", "header", "nav", "form", "ad", "side") if r.random() < 0.45]
        after = [junk(k) for k in ("share", "ad", "side", "comments", "form", "nav", "footer", "notice") if r.random() < 0.45]
        if r.random() < 0.03:
            core, text = "", []
        if r.random() < 0.1:  # laid out by a table
            after = [x if r.random() < 0.5 else say("&copy; ", "Copyright ", "") + label() for x in after] + ([f"&copy; {label()}"] if r.random() < 0.5 else [])
            before = [x if r.random() < 0.5 else say(" | ", " ").join(f"<a href=/>{label()}</a>" for _ in range(r.randint(2, 5))) for x in before]
            cell = lambda x: f"<tr><td>{x}</td></tr>"
            bare = "".join(body) if r.random() < 0.5 and text else core
            before, core, after = ["<table>", *map(cell, before)], cell(bare), [*map(cell, after), "</table>"]
        if r.random() < 0.35:  # all of it in elements that only lay the page out
            around = say('<div id="wrapper">', '<div class="container">', '<div id="page" class="site">', '<div class="wrap"><div class="row"><div class="col">', "<div>", f'<div class="{word()}">')
            before, after = [around, *before], [*after, "</div>" * around.count("<div")]
        page = "".join(["<html><head><title>", label(), "</title></head><body>", *before, core, *after, say("</body></html>", "")])
        out.append((page, text))
    return out


def fit(pages: list[tuple[str, list[str]]]) -> Crf:
    """A model of (html, blocks of the article); blocks are matched in page order."""
    seqs = []
    for page, texts in pages:
        got, want, k = blocks(page), [" ".join(_html.unescape(t).split()) for t in texts], 0
        labels = []
        for t, _ in got:
            labels.append(int(k < len(want) and t == want[k]))
            k += labels[-1]
        seqs.append((got, labels))
    return train(seqs)


@lru_cache(1)
def default_model() -> Crf:
    return fit(labelled_pages())


def main_text(page: str | None, model: Crf) -> str:
    found = _Page(page or "", model.state).blocks
    return "\n\n".join(t for (t, _), y in zip(found, model.label([e for _, e in found]), strict=True) if y)


def _extractor(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py(), model) for p in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Crf | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2]]
    return rows.mapInArrow(_extractor(model or default_model()), ", ".join([*kinds, "text string", "n_chars long"]))
