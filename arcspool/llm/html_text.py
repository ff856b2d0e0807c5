"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with
scripts, styles, comments and other raw elements left out and unclosed tags
closed as browsers do. Each block has a vector of its tag path (hashed tag names
and words of class, id and role attributes), its hashed words, and a few ratios.
A bidirectional LSTM in numpy reads the vectors of a page in order and labels
every block as main text or not, so a block's label depends on the whole page.

The model is trained by ``train`` on pages that ``training_pages`` lays out at
random with known labels (menus, headers, footers, sidebars, notices, adverts,
forms and comments around and inside articles; table layouts; pages of bare text);
it never sees the pages it extracts from, so it doesn't depend on the input.
``python -m arcspool.llm.html_text`` trains it anew (some minutes) and writes the
weights to ``html_weights.npz`` beside this file, from where ``trained`` takes
them; some 200 KB are broadcast.

Plan: a map over the scan. A worker labels pages in groups of bounded padded size.
Time and memory grow in proportion to a page: blocks keep the counts of their tag
path (256 bytes, shared by blocks of one path) whatever its depth, and a page of
more than ``WINDOW`` blocks is labelled window by window, each direction carrying
its state over, which gives the same labels as all at once.

Defined results: null or empty html and pages without main blocks give empty
text with n_chars 0; an element that is never closed ends with its parent, a
script, style, textarea or comment with the page; rows may repeat; null ids and
urls pass through; columns beyond those kept are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.llm.suffix_dedup import prefix_hashes, substring_hashes
from arcspool.plans.stash import small_batches

PATH_BINS, WORD_BINS, RATIOS, HIDDEN = 256, 64, 6, 16
WIDTH = PATH_BINS + WORD_BINS + RATIOS
TRAIN_PAGES, EPOCHS, SEED = 4000, 12, 3
WEIGHTS = Path(__file__).with_name("html_weights.npz")
#: Blocks and bytes of text that are looked at together.
WINDOW = 2048
_TEXT_BYTES = 1 << 20
_PADDED = 1 << 13

#: Elements that run inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is the nearest open block element.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

#: Elements whose content isn't shown as text of the page.
HIDDEN_CONTENT = frozenset("noscript template svg iframe object select".split())

#: Groups: raw element; then end mark, name and attributes of any other tag. A quote counts only behind an equals sign.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|textarea)(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _bin(word: str, bins: int) -> int:
    return zlib.crc32(word.encode()) % bins


@lru_cache(maxsize=20_000)
def _element_bins(tag: str, attrs: str) -> tuple[int, ...]:
    names = [tag]
    for m in _ATTR.finditer(attrs):
        names += ["." + w for w in re.findall(r"[a-z]+", (m[1] or m[2] or m[3] or "").lower())]
    return tuple(_bin(n, PATH_BINS) for n in names)


class _Path:
    """The open block elements, with clipped counts of their bins that cost the same at any depth."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.open, self.counts, self.clipped = Counter(), [0] * PATH_BINS, bytearray(PATH_BINS)
        self.shared: dict[bytes, bytes] = {}

    def push(self, tag: str, bins: tuple[int, ...]) -> None:
        self.stack.append((tag, bins))
        self.open[tag] += 1
        for b in bins:
            self.counts[b] += 1
            if self.counts[b] < 3:
                self.clipped[b] += 1

    def pop(self) -> str:
        tag, bins = self.stack.pop()
        self.open[tag] -= 1
        for b in bins:
            self.counts[b] -= 1
            if self.counts[b] < 2:
                self.clipped[b] -= 1
        return tag

    def close(self, tag: str) -> None:
        """Close the nearest open ``tag`` and all inside it; nothing if there is none."""
        if self.open[tag]:
            while self.pop() != tag:
                pass

    def bins(self) -> bytes:
        now = bytes(self.clipped)
        return self.shared.setdefault(now, now)


def blocks(page: str) -> list[tuple[str, bytes, float]]:
    """(text, counts of path bins up to two, share of characters in links) of each leaf block in page order."""
    path = _Path()
    out, parts, links, at = [], [], 0, 0
    in_link = False
    hidden, inside = 0, Counter()  # open elements of hidden content: their number, and of the elements in them by tag

    def flush():
        nonlocal parts, links
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((text, path.bins(), min(1.0, links / max(1, len(raw)))))
            parts, links = [], 0

    def take(text: str):
        nonlocal links
        if text and not hidden:
            parts.append(text)
            if in_link:
                links += len(text)

    last = page.rfind(">") + 1  # no tag ends behind it
    for m in _TOKEN.finditer(page, 0, last):
        take(page[at : m.start()])
        at = m.end()
        end, tag, attrs = m[2], m[3], m[4]
        if tag is None:
            if m[1]:
                take(" ")
            if at == last and m[0].startswith("<!--") and not m[0].endswith(("->", "-!>", "<!-->")):
                at = len(page)  # a comment that never ends
            elif at == last and m[1] and not re.search(rf"</{m[1]}[^>]*>\Z", m[0][-80 - len(m[1]) :], re.I):
                at = len(page)
            continue
        tag = tag.lower()
        if hidden:
            if not end:
                if tag not in VOID and not attrs.rstrip().endswith("/"):
                    inside[tag] += 1
                    hidden += tag in HIDDEN_CONTENT
                continue
            if inside[tag]:
                inside[tag] -= 1
                hidden -= tag in HIDDEN_CONTENT
                continue
            if tag in INLINE or not path.open[tag]:
                continue
            hidden, inside = 0, Counter()  # never closed: it ends with its parent
        elif tag in HIDDEN_CONTENT:
            take(" ")
            if not end and not (tag == "svg" and attrs.rstrip().endswith("/")):
                hidden = inside[tag] = 1
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not end
            elif tag in ("br", "img", "wbr"):
                take(" ")
            continue
        flush()
        in_link = False
        if end:
            path.close(tag)
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            shut = CLOSES.get(tag, {"p"})
            while path.stack and path.stack[-1][0] in shut:
                path.pop()
            path.push(tag, _element_bins(tag, attrs))
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z!?/]", rest)  # a tag that never ends
    take(rest[: cut.start()] if cut else rest)
    flush()
    return out


def _word_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of words and how many fall into each bin, gathered over slices of bounded size."""
    n = len(texts)
    count, spread = np.zeros(n, np.int64), np.zeros(n * WORD_BINS, np.int64)
    raw = [t.encode() for t in texts]
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def gather():
        data = np.frombuffer(b" ".join(held), np.uint8)
        space = np.flatnonzero(data == 32)
        start, end = np.r_[0, space + 1], np.r_[space, len(data)]
        block = np.array(owner)[np.searchsorted(np.cumsum([len(x) + 1 for x in held]), start, "right")]
        bins = (substring_hashes(prefix_hashes(data), start, end) >> np.uint64(58)).astype(np.int64)
        np.add(count, np.bincount(block, minlength=n), out=count)
        np.add(spread, np.bincount(block * WORD_BINS + bins, minlength=n * WORD_BINS), out=spread)

    for k, t in enumerate(raw):
        at = 0
        while at < len(t):
            stop = len(t)
            if stop - at > _TEXT_BYTES:  # cut at a space, or in a word that has no end in sight
                stop = t.rfind(b" ", at + 1, at + _TEXT_BYTES)
                stop = stop if stop > 0 else at + _TEXT_BYTES
            held.append(t[at:stop])
            owner.append(k)
            size += stop - at
            at = stop + (t[stop : stop + 1] == b" ")
            if size >= _TEXT_BYTES:
                gather()
                held, owner, size = [], [], 0
    if held:
        gather()
    return count, spread.reshape(n, WORD_BINS)


def vectors(found: list[tuple[str, bytes, float]]) -> np.ndarray:
    """The network's input for the blocks of one or more pages."""
    n = len(found)
    x = np.zeros((n, WIDTH), np.float32)
    if not n:
        return x
    count, spread = _word_bins([t for t, _, _ in found])
    x[:, PATH_BINS : PATH_BINS + WORD_BINS] = np.sqrt(spread / np.maximum(1, count)[:, None])
    x[:, :PATH_BINS] = np.frombuffer(b"".join(p for _, p, _ in found), np.uint8).reshape(n, PATH_BINS)
    for k, (t, _, link) in enumerate(found):
        x[k, -RATIOS:] = (np.log1p(len(t)) / 6, np.log1p(count[k]) / 4, link, t[-1] in ".!?", t[0].isupper(), min(1.0, 10 * t.count("|") / len(t)))
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(x: np.ndarray, wx, wh, b):
    """States (T, B, H) of a pass over x (T, B, D) and what the backward pass needs."""
    pre = x @ wx + b
    t_n, b_n, h_n = x.shape[0], x.shape[1], wh.shape[0]
    h = c = np.zeros((b_n, h_n), np.float32)
    hs, cache = np.zeros((t_n, b_n, h_n), np.float32), []
    for t in range(t_n):
        z = pre[t] + h @ wh
        s = _sigmoid(z[:, : 3 * h_n])
        i, f, o, g = s[:, :h_n], s[:, h_n : 2 * h_n], s[:, 2 * h_n :], np.tanh(z[:, 3 * h_n :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        cache.append((h, before, i, f, o, g, tc))
        h = o * tc
        hs[t] = h
    return hs, cache


def _scan(x: np.ndarray, wx, wh, b, state=None):
    """States (T, B, H) of a pass over x (T, B, D) from ``state``, and the last state; sigmoids by way of tanh, in place."""
    t_n, b_n, h_n = x.shape[0], x.shape[1], wh.shape[0]
    half = np.r_[np.full(3 * h_n, 0.5), np.ones(h_n)].astype(wx.dtype)
    pre, wh = (x @ wx + b) * half, wh * half
    h, c = state or (np.zeros((b_n, h_n), np.float32),) * 2
    hs = np.zeros((t_n, b_n, h_n), np.float32)
    for t in range(t_n):
        z = h @ wh
        z += pre[t]
        np.tanh(z, z)
        s = z[:, : 3 * h_n]
        s *= 0.5
        s += 0.5
        c = s[:, h_n : 2 * h_n] * c
        c += s[:, :h_n] * z[:, 3 * h_n :]
        h = np.tanh(c)
        h *= s[:, 2 * h_n :]
        hs[t] = h
    return hs, (h, c)


def _lstm_back(x, wx, wh, cache, dhs):
    """Gradients of wx, wh, b from those of the states."""
    dwh, dz_all = np.zeros_like(wh), np.zeros((*x.shape[:2], wx.shape[1]), np.float32)
    dh = dc = 0
    for t in range(x.shape[0] - 1, -1, -1):
        h, before, i, f, o, g, tc = cache[t]
        d = dhs[t] + dh
        dc = dc + d * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
        dz_all[t] = dz
    flat = dz_all.reshape(-1, dz_all.shape[2])
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


class BiLSTM:
    """Weights of both directions and the output layer."""

    def __init__(self, weights: list[np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = SEED) -> BiLSTM:
        rnd, h = np.random.default_rng(seed), HIDDEN
        one = lambda: [rnd.normal(0, 0.08, (WIDTH, 4 * h)), rnd.normal(0, 0.2, (h, 4 * h)), np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]]
        return cls([np.asarray(w, np.float32) for w in [*one(), *one(), rnd.normal(0, 0.2, 2 * h), np.zeros(1)]])

    @staticmethod
    def _padded(pages: list[np.ndarray]):
        n = np.array([len(p) for p in pages])
        x = np.zeros((n.max(), len(pages), WIDTH), np.float32)
        for k, p in enumerate(pages):
            x[: n[k], k] = p
        back = np.where(np.arange(n.max())[:, None] < n, n - 1 - np.arange(n.max())[:, None], np.arange(n.max())[:, None])
        return n, x, back, np.take_along_axis(x, back[:, :, None], 0)

    def log_odds(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page (blocks, WIDTH) the log odds of its blocks being main text."""
        n, x, back, r = self._padded(pages)
        fore, _ = _scan(x, *self.w[:3])
        rear, _ = _scan(r, *self.w[3:6])
        rear = np.take_along_axis(rear, back[:, :, None], 0)
        g = np.concatenate([fore, rear], 2) @ self.w[6] + self.w[7]
        return [g[: n[k], k] for k in range(len(pages))]

    def log_odds_of(self, found: list[tuple[str, bytes, float]], window: int = WINDOW) -> np.ndarray:
        """As ``log_odds`` of one page, a window of blocks at a time; each direction carries its state over."""
        cuts, size = [0], 0
        for k, (t, _, _) in enumerate(found):
            if k - cuts[-1] == window or (size > _TEXT_BYTES and k > cuts[-1]):
                cuts.append(k)
                size = 0
            size += len(t)
        spans = list(zip(cuts, [*cuts[1:], len(found)], strict=True))
        g, half = np.full(len(found), self.w[7][0]), len(self.w[6]) // 2
        state, kept = None, {}
        for k, (a, b) in enumerate(spans):
            x = vectors(found[a:b])
            if k > len(spans) - 5:  # the last few are read again at once
                kept[a] = x
            hs, state = _scan(x[:, None], *self.w[:3], state=state)
            g[a:b] += hs[:, 0] @ self.w[6][:half]
        state = None
        for a, b in reversed(spans):
            x = kept.pop(a) if a in kept else vectors(found[a:b])
            hs, state = _scan(x[::-1, None], *self.w[3:6], state=state)
            g[a:b] += (hs[:, 0] @ self.w[6][half:])[::-1]
        return g

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        """Mean log loss over the blocks and its gradients."""
        n, x, back, r = self._padded(pages)
        fore, cf = _lstm(x, *self.w[:3])
        rear, cr = _lstm(r, *self.w[3:6])
        both = np.concatenate([fore, np.take_along_axis(rear, back[:, :, None], 0)], 2)
        g, y, mask = both @ self.w[6] + self.w[7], np.zeros(both.shape[:2], np.float32), np.arange(n.max())[:, None] < n
        for k, v in enumerate(labels):
            y[: n[k], k] = v
        p = _sigmoid(g)
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / n.sum()
        dg = ((p - y) * mask / n.sum()).astype(np.float32)
        dboth = dg[:, :, None] * self.w[6]
        df = _lstm_back(x, self.w[0], self.w[1], cf, dboth[:, :, :HIDDEN])
        db = _lstm_back(r, self.w[3], self.w[4], cr, np.take_along_axis(dboth[:, :, HIDDEN:], back[:, :, None], 0))
        return float(loss), [*df, *db, np.tensordot(dg, both, ((0, 1), (0, 1))), dg.sum(keepdims=True).reshape(1)]


# Layouts of training pages. Cue words stand for what such blocks tend to say.
_MENU = "home about contact news login shop archive search next previous menu index topics help".split()
_CUES = {
    "notice": "we use cookies accept privacy consent notice agree this site browser please enable update settings".split(),
    "ad": "sponsored advertisement buy now offer sale discount free deal promo shop today".split(),
    "form": "name email password subscribe search send sign up submit your message required newsletter".split(),
    "comments": "reply says comment posted by user ago thanks great report likes anonymous".split(),
    "footer": "copyright © rights reserved terms privacy imprint contact sitemap powered by".split(),
    "side": "related trending popular most read more also tags recent posts follow".split(),
    "header": "welcome site daily official portal online the home of since".split(),
}
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve eur que ment cion der sch ung keit los ado eau tre é ü ñ".split()


class _Layout:
    """One random page and the labels of its blocks."""

    def __init__(self, rnd):
        self.rnd, self.out, self.truth = rnd, [], []

    def pick(self, *options):
        return options[self.rnd.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.rnd.random() < p

    def text(self, low: int, high: int, cues: str = "", share: float = 0.0) -> str:
        words = []
        for _ in range(self.rnd.integers(low, high + 1)):
            if cues and self.chance(share):
                words.append(self.pick(*_CUES[cues]))
            else:
                words.append("".join(self.pick(*_SYLLABLES) for _ in range(self.rnd.integers(1, 5))))
            if self.chance(0.12):
                words[-1] += self.pick(".", ",", ".")
        s = " ".join(words)
        return s[:1].upper() + s[1:] + ("." if self.chance(0.6) else "") + (" &amp; " + self.pick(*_MENU) if self.chance(0.03) else "")

    def leaf(self, tag: str, text: str, main: bool, attrs: str = ""):
        style = self.rnd.integers(8)
        if style == 0 and tag == "p":
            self.out.append(f"<p{attrs}><b>{text}<br>")
        elif style == 1:
            self.out.append(f"<{tag}{attrs}><span>{text}</span> <a href='/x'>{self.pick(*_MENU)}</a></{tag}>")
        elif style == 2 and tag in ("p", "li"):
            self.out.append(f"<{tag}{attrs}>{text}")
        else:
            self.out.append(f"<{tag}{attrs}>{text}</{tag}>")
        self.truth.append(main)

    def box(self, tags: tuple, names: tuple, fill, named: float = 0.8):
        """An element of one of ``tags``; a div or section always says what it is in class or id."""
        tag = self.pick(*tags)
        attrs = ""
        if tag in ("div", "section", "ul", "ins") or self.chance(named * 0.4):
            attrs = f' {self.pick("class", "class", "id")}="{self.pick("", "", "box ", "site-", "main-" if tag != "div" else "")}{self.pick(*names)}{self.pick("", "", " clearfix", "-1", "_wrap")}"'
        self.out.append(f"<{tag}{attrs}>")
        fill()
        self.out.append(f"</{tag}>")

    def links(self, low=3, high=8):
        self.out.append("<ul>")
        for _ in range(self.rnd.integers(low, high)):
            self.out.append(f'<li><a href="/{self.rnd.integers(99)}">{self.pick(self.pick(*_MENU), self.text(1, 3))}</a></li>')
            self.truth.append(False)
        self.out.append("</ul>")

    def nav(self):
        self.box(("nav", "nav", "div", "ul"), ("menu", "nav", "navbar", "navigation", "breadcrumb", "topnav"), self.links)

    def some(self, cues: str, low: int, high: int, long: int, tags=("p", "div", "span", "h3", "li")):
        for _ in range(self.rnd.integers(low, high + 1)):
            self.leaf(self.pick(*[t for t in tags if t != "span"]), self.text(1, long, cues, 0.3 if self.chance(0.6) else 0.0), False)

    def ad(self):
        self.box(("div", "div", "aside", "ins"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), lambda: self.bare("ad", 30))

    def bare(self, cues: str, long: int):
        """Text of the box itself, or a few leaves."""
        if self.chance(0.6):
            self.out.append(self.text(2, long, cues, 0.3 if self.chance(0.5) else 0.0))
            self.truth.append(False)
        else:
            self.some(cues, 1, 3, long)

    def notice(self):
        self.box(("div", "section", "aside"), ("cookie", "notice", "consent", "alert", "popup", "modal", "gdpr", "message", "warning"), lambda: self.bare("notice", 40))

    def form(self):
        def fill():
            for _ in range(self.rnd.integers(1, 4)):
                self.leaf(self.pick("p", "div", "button", "h3", "legend"), self.text(1, 8, "form", 0.5), False)
        self.box(("form", "form", "form", "div"), ("search", "login", "subscribe", "newsletter", "signup", "form"), fill)

    def comments(self):
        def fill():
            self.leaf(self.pick("h2", "h3"), self.text(1, 3, "comments", 0.7), False)
            for _ in range(self.rnd.integers(1, 6)):
                self.out.append(self.pick('<div class="comment">', "<li>", '<div class="reply">', "<div>", "<article class='comment'>"))
                tag = re.match(r"<(\w+)", self.out[-1])[1]
                for _ in range(self.rnd.integers(1, 3)):
                    self.leaf("p", self.text(3, 50, "comments", 0.05), False)
                self.out.append(f"</{tag}>")
            if self.chance(0.4):
                self.form()
        self.box(("section", "div", "div", "ul"), ("comments", "comment-list", "replies", "discussion", "responses", "disqus"), fill)

    def side(self):
        def fill():
            self.leaf(self.pick("h2", "h3", "h4"), self.text(1, 3, "side", 0.6), False)
            self.links(1, 6) if self.chance(0.6) else self.some("side", 1, 4, 30)
        self.box(("aside", "aside", "div", "section"), ("sidebar", "related", "widget", "trending", "popular", "recommended", "share", "social"), fill)

    def header(self):
        def fill():
            self.leaf(self.pick("h1", "p", "div", "h2"), self.text(1, 5, "header", 0.4), False)
            if self.chance(0.5):
                self.leaf("p", self.text(2, 10, "header", 0.3), False)
            if self.chance(0.5):
                self.nav()
        self.box(("header", "header", "div"), ("header", "masthead", "top", "banner", "branding"), fill)

    def footer(self):
        def fill():
            if self.chance(0.5):
                self.out.append(self.pick("&copy; ", "© ", "") + self.text(2, 20, "footer", 0.3))
                self.truth.append(False)
            else:
                self.some("footer", 1, 3, 25)
            if self.chance(0.3):
                self.links(2, 5)
        self.box(("footer", "footer", "div"), ("footer", "bottom", "copyright", "legal", "colophon"), fill)

    def paragraph(self):
        if self.chance(0.04):  # cells of a table that was written as text, some lines of it alike
            for _ in range(1 if self.chance(0.6) else self.rnd.integers(2, 5)):
                self.leaf("p", " | ".join(self.text(1, 2) if self.chance(0.1) else self.text(1, 1) for _ in range(self.rnd.integers(2, 40))), True)
            return
        self.leaf("p", self.text(1, 4) if self.chance(0.25) else self.text(5, 30 if self.chance(0.4) else 90), True)

    def definitions(self):
        self.out.append("<dl>")
        for _ in range(self.rnd.integers(1, 6)):
            self.leaf("dt", self.text(1, 5), True)
            for _ in range(self.rnd.integers(1, 3)):
                self.leaf("dd", self.text(1, 40), True)
        self.out.append("</dl>")

    def story(self):
        """Main text without an element of its own around it."""
        if self.chance(0.6):
            self.leaf(self.pick("h1", "h2"), self.text(2, 12), True)
        for _ in range(self.rnd.integers(1, 60 if self.chance(0.1) else 10)):
            if self.chance(0.06):
                self.definitions()
            else:
                self.paragraph()

    def bare_page(self):
        """Text in no element at all, or right in the body."""
        bare = self.chance(0.5)
        wrap = self.chance(0.6)
        self.out.append(self.pick("<html><body>", "<body>") if wrap else "")
        if self.chance(0.3):
            self.out.insert(0, f"<title>{self.text(1, 6)}</title>")
            self.truth.append(False)
        if self.chance(0.25):
            self.nav()
        if bare:
            for _ in range(1 if self.chance(0.6) else self.rnd.integers(1, 5)):
                if self.chance(0.3):
                    self.leaf(self.pick("h1", "h2"), self.text(1, 8), True)
                self.out.append(self.text(3, 120) + self.pick("<hr>", "<p></p>", "<hr/>"))
                self.truth.append(True)
        else:
            self.story()
        if self.chance(0.25):
            self.footer()
        self.out.append(self.pick("</body></html>", "") if wrap else "")

    def table_page(self):
        """A page laid out as a table: rows of menu and footer, cells of text beside them."""
        cell = lambda: f"<td{self.pick('', '', ' colspan=2', ' valign=top', ' width=150')}>"

        def menu():
            self.out.append(cell())
            if self.chance(0.6):  # one block of links
                self.out.append(self.pick(" | ", " ", " - ").join(f'<a href="/{i}">{self.pick(self.pick(*_MENU), self.text(1, 2))}</a>' for i in range(self.rnd.integers(2, 7))))
                self.truth.append(False)
            else:
                self.links()
            self.out.append("</td>")

        self.out.append("<html><body>" + self.pick("", f"<table{self.pick('', ' border=0', ' width=100%')}>"))
        self.out.append("" if "<table" in self.out[-1] else "<table>")
        if self.chance(0.4):
            self.out.append("<tr>" + cell() + self.text(1, 5, "header", 0.4) + "</td></tr>")
            self.truth.append(False)
        if self.chance(0.8):
            self.out.append("<tr>")
            menu()
            self.out.append("</tr>")
        self.out.append("<tr>")
        if self.chance(0.4):
            menu()
        self.out.append(cell())
        if self.chance(0.3):
            self.out.append(self.text(15, 120) + "</td></tr>")
            self.truth.append(True)
        else:
            self.story()
            self.out.append("</td></tr>")
        if self.chance(0.85):
            self.out.append("<tr>" + cell() + self.pick("&copy; ", "© ", "Copyright ", "Copyright &copy; ", "") + self.pick("2019", "2020", "2021 ", "") + self.text(1, 14, "footer", 0.4) + "</td></tr>")
            self.truth.append(False)
        self.out.append("</table></body></html>")

    def article(self):
        def fill():
            if self.chance(0.85):
                self.leaf("h1", self.text(2, 12), True)
            plain = self.chance(0.3)  # nothing but paragraphs
            for _ in range(self.rnd.integers(0 if self.chance(0.1) else 1, 200 if self.chance(0.04) else 40 if self.chance(0.15) else 14)):
                what = self.rnd.random() * (0.68 if plain else 1)
                if what < 0.68:
                    self.paragraph()
                elif what < 0.76:
                    self.leaf(self.pick("h2", "h3", "h4"), self.text(1, 8), True)
                elif what < 0.81:
                    self.leaf(self.pick("blockquote", "pre", "figcaption"), self.text(2, 40), True)
                elif what < 0.87:
                    tag = self.pick("ul", "ol")
                    self.out.append(f"<{tag}>")
                    for _ in range(self.rnd.integers(1, 5)):
                        self.leaf("li", self.text(2, 20), True)
                    self.out.append(f"</{tag}>")
                elif what < 0.895:
                    self.out.append("<table><tr>")
                    for _ in range(self.rnd.integers(1, 5)):
                        self.leaf(self.pick("td", "th"), self.text(1, 5), True)
                    self.out.append("</tr></table>")
                elif what < 0.92:
                    self.definitions()
                elif what < 0.935:
                    self.out.append("<div>" + self.text(5, 60) + "</div>")
                    self.truth.append(True)
                else:
                    self.pick(self.ad, self.side, self.form, self.notice)()
            if self.chance(0.15):
                self.comments()
        self.box(("article", "article", "article", "main", "div", "section"), ("content", "post", "entry", "article", "story", "body", "text", "main"), fill)

    def page(self):
        kind = self.rnd.random()
        if kind < 0.16:
            (self.bare_page if kind < 0.08 else self.table_page)()
            return "".join(self.out), np.array(self.truth, np.float32)
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.text(1, 9)}</title><style>p{{}}</style></head><body>")
        self.truth.append(False)
        around = [self.header] * self.chance(0.4) + [self.nav] * self.chance(0.8) + [self.notice] * self.chance(0.25) + [self.ad] * self.chance(0.5) + [self.side] * self.chance(0.2)
        self.rnd.shuffle(around)
        for f in around:
            f()
        wrap = self.chance(0.3)
        if wrap:
            self.out.append(self.pick("<main>", '<div id="page">', '<div class="container">', '<div class="wrapper main">'))
        if not wrap and self.chance(0.1):
            self.story()
        else:
            self.article()
            if self.chance(0.1):
                self.article()
        after = [self.comments] * self.chance(0.35) + [self.side] * self.chance(0.35) + [self.form] * self.chance(0.25) + [self.ad] * self.chance(0.25) + [self.notice] * self.chance(0.15)
        self.rnd.shuffle(after)
        for f in after:
            f()
        if wrap:
            self.out.append("</div>")
        if self.chance(0.85):
            self.footer()
        if self.chance(0.2):
            self.notice()
        return "".join(self.out) + self.pick("</body></html>", ""), np.array(self.truth, np.float32)


def training_pages(n: int, seed: int) -> list[tuple[str, np.ndarray]]:
    """``n`` random pages with the label of each of their blocks."""
    rnd = np.random.default_rng(seed)
    return [_Layout(rnd).page() for _ in range(n)]


@lru_cache(maxsize=1)
def trained() -> BiLSTM:
    """The labeller whose weights ``train`` has written beside this file."""
    with np.load(WEIGHTS) as held:
        return BiLSTM([held[f"w{i}"].astype(np.float32) for i in range(8)])


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BiLSTM:
    """A labeller fitted by Adam on random layouts; the same every time on one machine."""
    data = []
    for page, truth in training_pages(pages, seed):
        x = vectors(blocks(page))
        if len(x) == len(truth) and len(x):
            data.append((x, truth))
    if len(data) < 0.95 * pages:
        raise ValueError("training pages and their labels don't line up")
    data.sort(key=lambda d: len(d[0]))
    groups = [data[k : k + 32] for k in range(0, len(data), 32)]
    model, rnd = BiLSTM.fresh(seed), np.random.default_rng(seed)
    m, v, t = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w], 0
    for e in range(epochs):
        for k in rnd.permutation(len(groups)):
            _, grads = model.gradients(*zip(*groups[k], strict=True))
            t += 1
            rate = 0.01 * (1 - 0.8 * e / epochs)
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                model.w[i] = (model.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def main_text(model: BiLSTM, pages: list[str]) -> list[str]:
    """The main text of each page."""
    out = [""] * len(pages)
    group: list[tuple[int, list]] = []
    most = size = 0

    def put(k: int, found, g: np.ndarray):
        out[k] = "\n\n".join(b[0] for b, keep in zip(found, g > 0, strict=True) if keep)

    def label():
        nonlocal group, most, size
        if group:
            x = vectors([b for _, found in group for b in found])
            cut = np.cumsum([len(found) for _, found in group])[:-1]
            for (k, found), g in zip(group, model.log_odds(np.split(x, cut)), strict=True):
                put(k, found, g)
            group, most, size = [], 0, 0

    for k in sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k])):
        found = blocks(pages[k])
        if not found:
            continue
        if len(found) > WINDOW or len(pages[k]) > _TEXT_BYTES:
            put(k, found, model.log_odds_of(found))
            continue
        if max(most, len(found)) * (len(group) + 1) > _PADDED or size > _TEXT_BYTES:
            label()
        group.append((k, found))
        most, size = max(most, len(found)), size + len(pages[k])
    label()
    return out


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: BiLSTM | None = None) -> DataFrame:
    """The columns ``keep`` with text and n_chars, for every row."""
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((model or trained()).w)
    src = df.select(*keep, F.col(html_col).cast("string").alias("_html"))

    def run(batches):
        net = BiLSTM(held.value)
        for batch in batches:
            texts = main_text(net, batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"]))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{f"w{i}": w.astype(np.float16) for i, w in enumerate(train().w)})
