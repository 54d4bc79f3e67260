"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, with the
zones of their ancestors (tags and the words of class and id). Each block gets
binary ancestor and text features; the field scores them and the change from one
block to the next, and Viterbi decoding marks the blocks of the article.

The field is trained here, by gradient ascent on the exact likelihood, on
labelled pages that :mod:`fieldglass.llm.trainingpages` lays out in many ways.
Extraction is row-wise, in time that grows with the page. It reads whole pages;
scripts, styles and comments in the markup never become blocks, nor do they cut one,
nor does what a browser shows only without scripts. Choices of forms are blocks of a form; drawings,
formulas and embedded objects are read as the text within them.

Cases: null or empty html, and pages without text, give an empty text and 0
characters; broken markup is read as a browser does (end tags of nothing open are
skipped, only elements without content end themselves, open elements end with the
page); repeated rows repeat; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import record_batch, sliced, text_or_empty

EXTRACTED = "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_kept int"
JOIN = "\n\n"

#: Quotes count after an equals sign only; a comment may end at once, or with an exclamation mark.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements whose content isn't markup; the last two cut a text.
RAW = frozenset("script style textarea iframe".split())
CUTS = frozenset(("textarea", "iframe"))
#: Elements whose content is markup that isn't shown; they end with their parent at the latest.
HIDDEN = frozenset(("noscript", "template"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input canvas".split())
#: Drawings and formulas stand within a text; their parts don't cut it.
INLINE |= frozenset("svg g path circle ellipse line polyline polygon rect text tspan textpath defs use symbol marker mask pattern image clippath lineargradient radialgradient stop filter".split())
INLINE |= frozenset("math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose merror semantics annotation".split())
#: Open lists of choices, which any block ends.
CHOICES = frozenset(("option", "optgroup", "select", "datalist"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same row ends.
CLOSES = {"p": {"p", *CHOICES}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "select": CHOICES, "datalist": CHOICES}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Zones by tag, and by the words of class, id and role.
ZONE_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "main", "section": "section", "head": "head", "title": "head", "menu": "nav", "figure": "figure", "blockquote": "quote", "table": "table", "ul": "list", "ol": "list", "dl": "list", "pre": "pre", "address": "footer", "select": "form", "datalist": "form", "optgroup": "form", "option": "form"}
ZONE_WORDS = {
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner outbrain taboola",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip topbar navlinks links",
    "header": "header masthead logo brand sitename tagline",
    "footer": "footer copyright legal colophon imprint bottom",
    "aside": "sidebar side aside related recommended widget trending popular more rail teaser",
    "form": "form newsletter subscribe signup login search newsletters",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay warning paywall message",
    "comment": "comment comments commentlist reply replies disqus respond discussion feedback reader",
    "social": "share sharing social follow twitter facebook tags",
    "content": "content article post entry story body text main maincontent articlebody prose",
}
_ZONE_OF = {word: zone for zone, words in ZONE_WORDS.items() for word in words.split()}
ZONES = tuple(dict.fromkeys([*ZONE_TAGS.values(), *ZONE_WORDS]))
_BIT = {zone: 1 << i for i, zone in enumerate(ZONES)}
_NEGATIVE = sum(_BIT[z] for z in ("ad", "nav", "header", "footer", "aside", "form", "notice", "comment", "social", "head"))
_POSITIVE = sum(_BIT[z] for z in ("article", "main", "content"))


@dataclass
class Block:
    text: str
    tag: str
    zones: int
    inner: int
    linked: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; text has single spaces and is trimmed.

    ``zones`` are those of all ancestors, ``inner`` those at or below the
    innermost article, ``linked`` the characters inside links.
    """
    found: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, link = 0, False
    hidden = 0  # where in the stack the outermost hidden element is

    def close() -> None:
        nonlocal linked, link
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                tag, zones, inner = stack[hidden - 1]
                found.append(Block(text, tag, zones, inner, linked))
            parts.clear()
        linked, link = 0, False

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and not hidden:
            parts.append(page[at:end])
            if link:
                linked += end - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing, attributes = m[2].lower(), m[1] == "/", m[3]
        if name in RAW:
            if not closing:
                over = _raw_end(name).search(page, at)
                at = over.end() if over else size
            if name in CUTS and not hidden:
                close()
            continue
        if name in INLINE:
            if hidden:
                continue
            if name == "br":
                parts.append(" ")
            elif name == "a":
                link = not closing
            continue
        if closing:
            # what isn't open ends nothing, and what is takes all above it along: each element is passed once
            k = len(stack) - 1
            while opened[name] and stack[k][0] != name:
                k -= 1
            if not (opened[name] or name == "p" and not hidden):
                continue
            if not hidden or k < hidden:
                close()
            if opened[name]:
                opened.subtract(tag for tag, _, _ in stack[k:])
                del stack[k:]
                hidden = hidden if hidden < len(stack) else 0
            continue
        if name in HIDDEN:
            hidden = hidden or len(stack)
        elif not hidden:
            close()
        if name in VOID:
            continue
        ends = CLOSES.get(name) or ({"p", *CHOICES} if name in ZONE_TAGS or name in HEADINGS or name == "div" else ())
        while stack[-1][0] in ends:
            opened[stack.pop()[0]] -= 1
        own = _BIT.get(ZONE_TAGS.get(name, ""), 0)
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                for word in _WORD.findall((a[2] or a[3] or a[4] or "").lower()):
                    own |= _BIT.get(_ZONE_OF.get(word, ""), 0)
        _, zones, inner = stack[-1]
        stack.append((name, zones | own, own if name in ("article", "main") else inner | own))
        opened[name] += 1
    close()
    return found


@functools.lru_cache(64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I)


_TEXT_FEATURES = ("words_1", "words_2_4", "words_5_9", "words_10_24", "words_25_79", "words_80", "links_none", "links_some", "links_most", "ends_sentence", "has_comma", "has_copyright", "has_bar", "starts_upper", "all_upper", "digits")
_TAGS = ("p", "li", "td", "div", "a", "body", "section", "h1", "h2", "h3", "blockquote", "pre", "span", "footer", "header", "nav", "article", "main", "figcaption", "dd", "dt")
FEATURES = ("bias", *(f"in_{z}" for z in ZONES), *(f"inner_{z}" for z in ZONES), *(f"tag_{t}" for t in _TAGS), "tag_heading", "tag_other", *_TEXT_FEATURES, "clean", "rejected", "inner_rejected", "first", "last", "after_heading", "page_has_article", "article_elsewhere")
_AT = {name: i for i, name in enumerate(FEATURES)}
_IN, _INNER, _TEXT = _AT[f"in_{ZONES[0]}"], _AT[f"inner_{ZONES[0]}"], _AT["words_1"]
_ENDS = tuple(".!?:;\"'”»)…")


def features(page: list[Block]) -> list[list[int]]:
    """Numbers of the features that hold for each block."""
    article = any(b.zones & _BIT["article"] for b in page)
    out, heading = [], False
    for i, b in enumerate(page):
        words, chars = b.text.count(" ") + 1, len(b.text)
        f = [0, _TEXT + (0 if words == 1 else 1 if words < 5 else 2 if words < 10 else 3 if words < 25 else 4 if words < 80 else 5)]
        for k, bit in enumerate(_BIT.values()):
            if b.zones & bit:
                f.append(_IN + k)
                if b.inner & bit:
                    f.append(_INNER + k)
        is_heading = b.tag in HEADINGS
        f.append(_AT.get(f"tag_{b.tag}", _AT["tag_other"]))
        f.append(_TEXT + (6 if not b.linked else 8 if b.linked * 2 > chars else 7))
        for holds, name in (
            (is_heading, "tag_heading"),
            (b.text.endswith(_ENDS), "ends_sentence"),
            ("," in b.text, "has_comma"),
            ("©" in b.text, "has_copyright"),
            ("|" in b.text or "·" in b.text, "has_bar"),
            (b.text[0].isupper(), "starts_upper"),
            (b.text.isupper(), "all_upper"),
            (not b.zones & _NEGATIVE, "clean"),
            (b.zones & _NEGATIVE, "rejected"),
            (b.inner & _NEGATIVE and b.zones & _POSITIVE, "inner_rejected"),
            (i == 0, "first"),
            (i == len(page) - 1, "last"),
            (heading, "after_heading"),
            (article, "page_has_article"),
            (article and not b.zones & _BIT["article"], "article_elsewhere"),
        ):
            if holds:
                f.append(_AT[name])
        heading = is_heading
        out.append(f)
    return out


@dataclass
class Field:
    """Emission weights of label 1 against 0, transitions [from, to] and the start's."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks."""
        weights, (t00, t01), (t10, t11), start = self.emission.tolist(), *self.transition.tolist(), self.start.tolist()
        zero, one, back = 0.0, 0.0, []
        for i, f in enumerate(features(page)):
            e = sum([weights[k] for k in f])
            if i == 0:
                zero, one = start[0], start[1] + e
                continue
            a, b, c, d = zero + t00, one + t10, zero + t01, one + t11
            back.append((b > a, d > c))
            zero, one = (b if b > a else a), (d if d > c else c) + e
        labels = [one > zero] if page else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 100, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """The field that makes the labels of ``pages`` (features, labels) likeliest, by Adam."""
    pages = [p for p in pages if p[1]]
    longest = max(len(y) for _, y in pages)
    x = np.zeros((len(pages), longest, len(FEATURES)), np.float32)
    y, live = np.zeros((len(pages), longest), np.int64), np.zeros((len(pages), longest), bool)
    for i, (rows, labels) in enumerate(pages):
        y[i, : len(labels)], live[i, : len(labels)] = labels, True
        for j, f in enumerate(rows):
            x[i, j, f] = 1
    both = live[:, 1:] & live[:, :-1]
    size, params = live.sum(), np.zeros(len(FEATURES) + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    flat = x.reshape(-1, x.shape[2])
    for step in range(1, rounds + 1):
        w, t, s = params[: len(FEATURES)], params[len(FEATURES) : -2].reshape(2, 2), params[-2:]
        e = np.zeros((*y.shape, 2))
        e[..., 1] = (flat @ w.astype(np.float32)).reshape(y.shape)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = s + e[:, 0]
        for j in range(1, longest):
            forward[:, j] = np.where(live[:, j, None], np.logaddexp(forward[:, j - 1, :1] + t[0], forward[:, j - 1, 1:] + t[1]) + e[:, j], forward[:, j - 1])
        for j in range(longest - 2, -1, -1):
            after = backward[:, j + 1] + e[:, j + 1]
            backward[:, j] = np.where(live[:, j + 1, None], np.logaddexp(t[:, 0] + after[:, :1], t[:, 1] + after[:, 1:]), 0)
        z = np.logaddexp(forward[:, 0, 0] + backward[:, 0, 0], forward[:, 0, 1] + backward[:, 0, 1])
        one = np.exp(np.minimum(forward[..., 1] + backward[..., 1] - z[:, None], 0)) * live
        pair = np.exp(np.minimum(forward[:, :-1, :, None] + t + (e + backward)[:, 1:, None, :] - z[:, None, None, None], 0)) * both[..., None, None]
        gold = np.zeros_like(t)
        np.add.at(gold, (y[:, :-1][both], y[:, 1:][both]), 1)
        first = np.array([1 - one[:, 0].mean(), one[:, 0].mean()]) * len(pages)
        gold_first = np.bincount(y[:, 0], minlength=2)
        g = np.concatenate([flat.T @ ((y - one) * live).reshape(-1).astype(np.float32), (gold - pair.sum(axis=(0, 1))).ravel(), gold_first - first]) / size - ridge * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(params[: len(FEATURES)], params[len(FEATURES) : -2].reshape(2, 2), params[-2:])


@functools.lru_cache(1)
def trained() -> Field:
    """The field of the labelled training pages, fitted once in a process."""
    from fieldglass.llm.trainingpages import labelled_pages

    return fit([(features(found), labels) for found, labels in labelled_pages()])


def main_text(page: str, field: Field) -> tuple[str, int, int]:
    """The article's text, and the numbers of blocks and of blocks kept."""
    found = blocks(page)
    kept = [b.text for b, keep in zip(found, field.decode(found), strict=True) if keep]
    return JOIN.join(kept), len(found), len(kept)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and its length for each row of ``pages`` (page_id, url, html)."""
    shipped = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            texts, n, kept = zip(*(main_text(h, shipped.value) for h in part.column(2).to_pylist()), strict=True)
            yield record_batch({"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": n, "n_kept": kept}, EXTRACTED)

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInArrow(run, EXTRACTED)
