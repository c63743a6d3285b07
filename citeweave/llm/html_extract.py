"""HTML extraction: a recurrent labeller, a numpy bidirectional LSTM, reads a page's blocks and keeps the article's."""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import table, word_hashes

#: Fixed: elements of HTML that begin a block, that have no end tag, whose content is no text of the page, and whose content is not markup.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button label select option textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("template svg math object head canvas select datalist".split())
RAW = frozenset("script style noscript iframe title textarea noembed noframes xmp".split())
#: Fixed: what may stand in a head and in a select; another element ends them.
HEAD, SELECT = RAW | frozenset("base link meta template".split()), frozenset("option optgroup hr template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed: for an opening tag, which open elements it ends, and the elements beyond which it ends none.
_SCOPE = frozenset("html table td th caption object template".split())
ENDS = {
    "li": (frozenset({"li"}), BLOCK - {"li", "p", "div", "address"}),
    **{t: (frozenset({"dd", "dt"}), BLOCK - {"dd", "dt", "p", "div", "address"}) for t in ("dd", "dt")},
    **{t: (frozenset({"td", "th"}), frozenset({"tr", "table"})) for t in ("td", "th")},
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    **{t: (frozenset({"thead", "tbody", "tfoot", "tr"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
}
_P = (frozenset({"p"}), _SCOPE | {"button"})
#: Fixed: block elements inside which a paragraph can't stay open.
ENDS_P = BLOCK - {"button", "label", "option", "body", "html"}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+)?+""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_SHORT_COMMENT = re.compile(r"<!--(?:>|->)")
_NAMES = frozenset("class id role itemprop aria-label".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    """An open element, and what stands above it: the hashed names on the path to it, how many, and the last one."""

    tag: str
    mask: int
    depth: int
    last: str
    silent: bool


@dataclass
class Block:
    path: Element
    text: str
    linked: int  # characters inside links


class Open:
    """The open elements. Where an element of a kind last stands is looked up, never searched for, so that deep pages take linear time."""

    def __init__(self) -> None:
        self.stack = [Element("", 0, 0, "", False)]
        self.at: dict[str, list[int]] = {}

    def last(self, tags: frozenset) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, tag: str, names: list[str]) -> None:
        top = self.stack[-1]
        mask = top.mask
        for x in names:
            mask |= 1 << _bucket(x, PATH)
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, mask, top.depth + len(names), names[-1] if names else top.last, top.silent or tag in SILENT))

    def cut(self, place: int) -> None:
        """Ends the element at a place and all inside it."""
        while len(self.stack) > place:
            self.at[self.stack.pop().tag].pop()

    def end(self, tags: frozenset, barrier: frozenset) -> None:
        """Ends the innermost elements of these tags that no barrier stands above."""
        beyond = self.last(barrier)
        place = min((self.at[t][-1] for t in tags if self.at.get(t) and self.at[t][-1] > beyond), default=0)
        if place:
            self.cut(place)


def tag_end(page: str, at: int, names: list[str] | None = None) -> int:
    """Where a tag ends whose attributes begin at a place, -1 if nowhere; names gets the words of its class, id and the like."""
    while True:
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if names is not None and m[1] and m[1].lower() in _NAMES:
            names.extend(f".{w.lower()}" for w in _PARTS.findall(m[2] or m[3] or m[4] or ""))
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at + 1
        if not m[0]:
            at += 1


def blocks(page: str | None) -> list[Block]:
    """The page's leaves in order: text between block borders, with the path of tags and names above it.

    Character references are decoded and white space is one space; a line break is white space, an image is nothing. Comments, the
    head and elements such as script, style or svg have no leaves, and what scripts and the like hold is not markup. Unclosed, stray
    and odd tags are borne, optional end tags are supplied; a script or style without an end takes the rest of the page, a tag without an
    end is text. The time is linear in the page, however deep it is.
    """
    page = page or ""
    out: list[Block] = []
    parts: list[str] = []
    opened = Open()
    stack = opened.stack
    linked, link = 0, False
    n = len(page)
    last_tag_end, endless = page.rfind(">"), set()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack[-1], text, linked))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if not raw:
            return
        if stack[-1].tag == "head" and raw.strip():  # only a body has text
            opened.cut(opened.at["head"][-1])
        if not stack[-1].silent:
            text = html.unescape(raw)
            parts.append(text)
            if link:
                linked += len(text)

    at = 0
    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last_tag_end and not page.startswith("<!--", start):
            add(page[at:])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            short = _SHORT_COMMENT.match(page, start)
            end = start + 1 if short else page.find("-->", start + 4)
            at = short.end() if short else end + 3 if end >= 0 else n
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            end = n if end < 0 else end
            add(page[start + 9 : end].replace("&", "&amp;"))
            at = end + 3
            continue
        m = _TAG.match(page, start)
        if not m:
            if page[start + 1 : start + 2] in ("!", "?", "/"):  # a declaration, or an end tag without a name
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = start + 1
            continue
        tag, closing, names = m[1].lower(), page[start + 1] == "/", []
        end = tag_end(page, m.end(), None if closing else names)
        if end < 0:
            add(page[start : start + 1])
            at = start + 1
            continue
        at = end
        if closing:
            if tag == "a":
                link = False
            if tag == "br":
                parts.append(" ")
            heading = tag in HEADINGS
            place = opened.last(HEADINGS) if heading else opened.last(frozenset({tag}))
            if tag in BLOCK or tag in SILENT:
                flush()
                barrier = frozenset({"table"}) if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else _SCOPE - {tag}
                if place and tag not in ("body", "html") and (place > opened.last(barrier) or tag in ("table", "head", "template", "object")):
                    opened.cut(place)
            elif place and place > opened.last(BLOCK):
                opened.cut(place)
            continue
        top = stack[-1]
        if top.tag == "head" and tag not in HEAD or tag == "body":
            opened.cut(opened.at["head"][-1] if opened.at.get("head") else len(stack))
        elif opened.at.get("select") and tag not in SELECT and tag not in RAW:
            opened.cut(opened.at["select"][-1])
        elif top.silent and tag in BLOCK:  # a drawing has no blocks
            for drawing in ("svg", "math"):
                if opened.at.get(drawing):
                    opened.cut(opened.at[drawing][-1])
        if tag in RAW:
            found = None if tag in endless else _RAW_END[tag].search(page, at)
            if tag == "textarea":
                flush()
            if found:
                end = tag_end(page, found.end())
                at = n if end < 0 else end
            elif tag in ("script", "style"):
                at = n
            else:
                endless.add(tag)
            continue
        if tag == "a":
            link = True
        if tag == "br":
            parts.append(" ")
        empty = page[end - 2] == "/" and tag not in BLOCK  # as drawings have them
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                opened.end(*_P)
            if tag in ENDS:
                opened.end(*ENDS[tag])
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                opened.cut(len(stack) - 1)
        if tag in VOID or empty:
            continue
        if tag in BLOCK or tag in SILENT:
            opened.push(tag, [tag, *names])
        elif names:
            opened.push(tag, ["inline", *names])
    flush()
    return out


# -- vectors ------------------------------------------------------------------------------------
PATH, WORDS, REST = 384, 48, 10
N = PATH + WORDS + REST


@functools.lru_cache(1 << 16)
def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def vectors(found: list[Block], low: int = 0, high: int | None = None) -> np.ndarray:
    """Tag-path and hashed-word vectors, and lengths, links, punctuation and place, of the blocks low to high of a page."""
    part, total = found[low:high], len(found)
    x = np.zeros((len(part), N), np.float32)
    if not part:
        return x
    path = np.frombuffer(b"".join(b.path.mask.to_bytes(PATH // 8, "little") for b in part), np.uint8)
    x[:, :PATH] = np.unpackbits(path.reshape(len(part), PATH // 8), axis=1, bitorder="little")
    for i, b in enumerate(part):
        if b.path.last:
            x[i, _bucket("leaf:" + b.path.last, PATH)] = 1
    texts = [b.text.lower().encode("utf-8", "surrogatepass") for b in part]
    hashes, starts, _ = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    code = (hashes >> np.uint64(20)).astype(np.int64) % WORDS
    words = np.bincount(owner, minlength=len(part))
    counts = np.bincount(owner * WORDS + code, minlength=len(part) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = counts / np.maximum(np.linalg.norm(counts, axis=1), 1)[:, None]
    size, place = np.array([len(b.text) for b in part]), np.arange(low, low + len(part))
    x[:, PATH + WORDS :] = np.stack([
        np.log1p(words) / 5, np.log1p(size) / 7, np.array([b.linked for b in part]) / np.maximum(size, 1), np.array([b.text[-1:] in ".!?…" for b in part]), words < 4,
        place / max(total - 1, 1), 1 / (1 + place), 1 / (total - place), np.array(["©" in b.text for b in part]), np.minimum(np.array([b.path.depth for b in part]) / 10, 3),
    ], axis=1)
    return x


# -- network ------------------------------------------------------------------------------------
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, p: dict, side: str) -> tuple[np.ndarray, list]:
    """One direction over (time, batch, features); steps outside the mask leave the state as it was."""
    t, b, _ = x.shape
    h_size = p["u" + side].shape[0]
    h, c = np.zeros((b, h_size), np.float32), np.zeros((b, h_size), np.float32)
    z_all = x @ p["w" + side] + p["b" + side]
    out, kept = np.zeros((t, b, h_size), np.float32), []
    for k in range(t):
        z = z_all[k] + h @ p["u" + side]
        i, f, o = (_sigmoid(z[:, j * h_size : (j + 1) * h_size]) for j in range(3))
        g = np.tanh(z[:, 3 * h_size :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        m = mask[k][:, None]
        kept.append((h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
        out[k] = h
    return out, kept


def _back(x: np.ndarray, p: dict, side: str, kept: list, d_out: np.ndarray, grads: dict) -> None:
    dh = np.zeros_like(d_out[0])
    dc = np.zeros_like(dh)
    dz_all = np.zeros((len(kept), dh.shape[0], 4 * dh.shape[1]), np.float32)
    for k in range(len(kept) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = kept[k]
        dh = dh + d_out[k]
        dh_in, dc_in = dh * m, dc * m
        do = dh_in * tc
        dc2 = dc_in + dh_in * o * (1 - tc * tc)
        dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
        dz_all[k] = dz
        grads["u" + side] += h.T @ dz
        dh = dz @ p["u" + side].T + dh * (1 - m)
        dc = dc2 * f + dc * (1 - m)
    grads["w" + side] += np.tensordot(x, dz_all, ([0, 1], [0, 1]))
    grads["b" + side] += dz_all.sum((0, 1))


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, pages))
    x, mask = np.zeros((most, len(pages), N), np.float32), np.zeros((most, len(pages)), np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, 1
    return x, mask


def _logits(x: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, tuple]:
    fwd, k1 = _run(x, mask, p, "f")
    bwd, k2 = _run(x[::-1], mask[::-1], p, "r")
    both = np.concatenate([fwd, bwd[::-1]], axis=2)
    return both @ p["v"] + p["a"], (both, k1, k2)


#: Blocks whose vectors are held at once; a longer page is read in stretches, in both directions, with the state carried on.
_HELD = 4096


def _states(pages: list[list[Block]], p: dict, side: str, held: list) -> np.ndarray:
    """The outputs of one direction over pages side by side, (time, page, hidden); held keeps the vectors of a batch that fits for the other one."""
    most, h_size = max(map(len, pages)), p["u" + side].shape[0]
    step = max(1, _HELD // len(pages))
    out = np.zeros((most, len(pages), h_size), np.float32)
    h, c = np.zeros((2, len(pages), h_size), np.float32)
    u, length = p["u" + side], np.array([len(x) for x in pages])
    starts = range(0, most, step)
    for low in starts if side == "f" else reversed(starts):
        if held:
            x = held[0]
        else:
            x = _batch([vectors(page, low, low + step) for page in pages])[0]
            if most <= step:
                held.append(x)
        z_all = x @ p["w" + side] + p["b" + side]
        for k in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            live = np.flatnonzero(length > low + k)
            z = z_all[k, live] + h[live] @ u
            gates = _sigmoid(z[:, : 3 * h_size])
            c[live] = gates[:, h_size : 2 * h_size] * c[live] + gates[:, :h_size] * np.tanh(z[:, 3 * h_size :])
            h[live] = gates[:, 2 * h_size :] * np.tanh(c[live])
            out[low + k] = h
    return out


def probabilities(pages: list[list[Block]], p: dict) -> list[np.ndarray]:
    """That each block is the article's; pages of alike lengths run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        n = max(1, min(64, _HELD // len(pages[order[min(at + 63, len(order) - 1)]])))
        group, held = order[at : at + n], []
        at += n
        some = [pages[k] for k in group]
        z = np.concatenate([_states(some, p, "f", held), _states(some, p, "r", held)], axis=2) @ p["v"] + p["a"]
        for j, k in enumerate(group):
            out[k] = _sigmoid(z[: len(pages[k]), j, 0])
    return out


# -- training pages -----------------------------------------------------------------------------
#: Fixed: names under which pages put the article and what surrounds it.
GOOD = "article main content post entry story body text page-content post-content entry-content article-body main-content post-body story-body prose markdown".split()
JUNK = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav pagination pager toc links skip".split(),
    "header": "header masthead site-header top banner logo branding page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon credits page-footer".split(),
    "aside": "sidebar aside widget related recommended popular rail trending more-stories tags share social author-bio".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad promoted sponsor adslot teaser".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal newsletter subscribe privacy announcement overlay paywall cookie-banner cookie-notice".split(),
    "form": "form search login signup subscribe-form contact search-form comment-form respond".split(),
    "comments": "comments comment comment-list commentlist discussion replies responses reader-comments disqus comment-body feedback".split(),
}


def training_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """Seeded invented pages, each with the labels of its blocks in order."""
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in ("th", "an", "er", "qu", "ent", "sch", "ci", "lo", "mi", "ra", "sp", "tr", "é", "ñ", "ü", "") for b in ("e", "on", "ing", "a", "eau", "lich", "os", "is", "u")]

    vocabulary = ["".join(rng.choice(syllables, k)) for k in rng.integers(1, 5, 3000)]

    def word() -> str:
        return vocabulary[rng.integers(0, len(vocabulary))]

    def words(low: int, high: int) -> str:
        return " ".join(vocabulary[k] for k in rng.integers(0, len(vocabulary), rng.integers(low, high)))

    def sentence() -> str:
        text = words(1, 28)
        return text[:1].upper() + text[1:] + "....?! "[rng.integers(0, 7)].strip()

    def paragraph() -> str:
        style = rng.random()
        if style < 0.15:
            return sentence()
        if style < 0.21:  # lists in a line, shouting, symbols: text all the same
            return {0: str.upper, 1: lambda x: x.replace(" ", " | "), 2: lambda x: x.replace(" ", "*** ")}[int(rng.integers(0, 3))](words(2, 60))
        return " ".join(sentence() for _ in range(max(1, int(rng.exponential(3)))))

    def mark(kind: str, names: list[str], tag: str, inner: str) -> str:
        name = str(rng.choice(names))
        how = rng.integers(0, 4)
        native = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "good": str(rng.choice(["article", "main"]))}.get(kind)
        if native and how < 2:
            extra = f' class="{name}"' if how else ""
            return f"<{native}{extra}>{inner}</{native}>"
        where = str(rng.choice(["class", "id", "class"]))
        return f'<{tag} {where}="{name}{"" if rng.random() < 0.6 else " " + word()}">{inner}</{tag}>'

    def junk(kind: str) -> tuple[str, int]:
        style, k = rng.integers(0, 3), int(rng.integers(1, 7))
        if kind in ("nav", "aside") and style < 2 or kind == "footer" and style == 0:
            return mark(kind, JUNK[kind], "div", (f"<h3>{words(1, 4)}</h3>" if (t := rng.random() < 0.3) else "") + "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 5)}</a></li>' for _ in range(k)) + "</ul>"), k + t
        if kind == "comments":
            k = int(rng.integers(1, 5))
            one = lambda: f'<div class="comment"><span class="who">{word()}</span><p>{paragraph()}</p></div>' if style else f"<li><p>{paragraph()}</p></li>"
            made = "".join(one() for _ in range(k))
            return mark(kind, JUNK[kind], str(rng.choice(["section", "div"])), f"<h3>{words(1, 3)}</h3>" + made), 1 + k * (2 if style else 1)
        if kind == "form":
            return mark(kind, JUNK[kind], "div", f"<label>{words(1, 4)}</label><input name=q><button>{words(1, 3)}</button>"), 2
        k = int(rng.integers(1, 3))
        lead = "&copy; " if kind == "footer" and rng.random() < 0.6 else ""
        body = "".join(f"<p>{lead}{paragraph()}</p>" for _ in range(k)) if style == 0 else lead + (f'<a href="#">{words(1, 5)}</a> ' if style == 1 else "") + paragraph()
        return mark(kind, JUNK[kind], str(rng.choice(["div", "section", "div"])), body), k if style == 0 else 1

    out = []
    for _ in range(n):
        body, labels = [], []

        def put(kind: str, chance: float) -> None:
            if rng.random() < chance:
                text, k = junk(kind)
                body.append(text)
                labels.extend([0] * k)

        for kind, chance in (("notice", 0.3), ("header", 0.5), ("nav", 0.8), ("form", 0.15), ("ad", 0.5), ("aside", 0.25)):
            put(kind, chance)
        inner, own = [], []
        if rng.random() < 0.85:
            inner.append(f"<h1>{words(2, 14)}</h1>")
            own.append(1)
        for _ in range(1 + int(rng.exponential(5))):
            kind = rng.random()
            if kind < 0.08:
                inner.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.12:
                k = int(rng.integers(2, 5))
                inner.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(k)) + "</ul>")
                own.extend([1] * (k - 1))
            elif kind < 0.16:
                inner.append(f"<blockquote>{paragraph()}</blockquote>")
            elif kind < 0.30:
                inner.append(f"<p><b>{paragraph()}<br>")
            elif kind < 0.36:
                inner.append(f'<p>{paragraph()} <a href="/{word()}">{words(1, 4)}</a> {paragraph()}</p>')
            else:
                inner.append(f"<p>{paragraph()}</p>")
            own.append(1)
            if rng.random() < 0.05:
                text, k = junk(str(rng.choice(["ad", "aside", "notice", "form"])))
                inner.append(text)
                own.extend([0] * k)
        body.append(mark("good", GOOD, "div", "".join(inner)))
        labels.extend(own)
        for kind, chance in (("ad", 0.2), ("aside", 0.3), ("comments", 0.35), ("form", 0.2), ("nav", 0.1), ("notice", 0.15), ("footer", 0.85)):
            put(kind, chance)
        text = "".join(body)
        if rng.random() < 0.3:
            text = f'<div id="{rng.choice(["wrapper", "page", "container", "app", "root", "site"])}">{text}</div>'
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{text}" + ("</body></html>" if rng.random() < 0.9 else ""), labels))
    return out


@dataclass(frozen=True)
class Settings:
    pages: int = 900
    hidden: int = 24
    epochs: int = 6
    batch: int = 16
    rate: float = 0.01
    seed: int = 29


@functools.lru_cache(4)
def train(s: Settings = Settings()) -> dict:
    """The network's weights from seeded invented pages: Adam on the log loss of every block."""
    data = []
    for page, labels in training_pages(s.pages, s.seed):
        found = blocks(page)
        if len(found) == len(labels):
            data.append((vectors(found), np.array(labels, np.float32)))
    rng = np.random.default_rng(s.seed)
    shapes = {f"{k}{d}": v for d in "fr" for k, v in (("w", (N, 4 * s.hidden)), ("u", (s.hidden, 4 * s.hidden)), ("b", (4 * s.hidden,)))} | {"v": (2 * s.hidden, 1), "a": (1,)}
    p = {k: (rng.normal(0, 0.08, v) if len(v) > 1 else np.zeros(v)).astype(np.float32) for k, v in shapes.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), s.batch):
            part = [data[k] for k in order[at : at + s.batch]]
            x, mask = _batch([v for v, _ in part])
            x = x * (rng.random((*x.shape[:2], N)) > 0.1)  # names that a page leaves out
            y = np.zeros(mask.shape, np.float32)
            for j, (_, labels) in enumerate(part):
                y[: len(labels), j] = labels
            z, (both, k1, k2) = _logits(x, mask, p)
            dz = ((_sigmoid(z[:, :, 0]) - y) * mask / mask.sum())[:, :, None]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            grads["v"], grads["a"] = np.tensordot(both, dz, ([0, 1], [0, 1])), dz.sum((0, 1))
            d = dz @ p["v"].T
            _back(x, p, "f", k1, d[:, :, : s.hidden], grads)
            _back(x[::-1], p, "r", k2, d[::-1, :, s.hidden :], grads)
            step += 1
            rate = s.rate * (1 - epoch / s.epochs)
            for k in p:
                m1[k] += 0.1 * (grads[k] - m1[k])
                m2[k] += 0.01 * (grads[k] ** 2 - m2[k])
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return p


def extract(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """Adds text and n_chars to every row: the article's blocks in page order, joined by a blank line.

    A null or empty page, or one whose blocks are all rejected, has an empty text. A page without markup is one block.
    Whole pages are read, whatever their length and depth. Repeated rows stay; other columns may be null; columns named
    text and n_chars are replaced; an empty table stays empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train() if weights is None else weights)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out, found = [], []
            for k, page in enumerate(batch):
                found.append(blocks(page))
                if sum(map(len, found)) >= 4 * _HELD or k == len(batch) - 1:
                    scores = probabilities(found, shared.value)
                    out += ["\n\n".join(b.text for b, p in zip(x, s) if p >= 0.5) for x, s in zip(found, scores)]
                    found = []
            yield pd.Series(out, dtype=object)

    udf = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.select(*kept, udf("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
