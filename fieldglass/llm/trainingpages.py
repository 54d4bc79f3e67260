"""Labelled pages for the extraction field: invented articles in varied layouts.

Every leaf of a page is written with a mark in front of its text that says
whether it belongs to the article. The pages are read into blocks like any other,
and the marks become labels and are taken off again.
"""

from __future__ import annotations

import random

from fieldglass.llm.htmltext import Block, blocks

KEEP, DROP = "\ue000", "\ue001"
PAGES, SEED = 350, 7
_SYLLABLES = "ka ro mi te lu sa no vi der en ung que ción ou re th an or ble ä é ß ñ".split()


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.noise = rng.choice(["", "", "", "%%%", "!!", " |"])
        self.upper = rng.random() < 0.05

    def words(self, least: int, most: int) -> str:
        rng = self.rng
        out = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 5))) + (self.noise if rng.random() < 0.7 else "") for _ in range(rng.randint(least, most))]
        text = " ".join(w + ("," if rng.random() < 0.07 else "") for w in out)
        return text.upper() if self.upper else text

    def sentence(self, least: int, most: int) -> str:
        text = self.words(least, most)
        return text[:1].upper() + text[1:] + self.rng.choice(("...", ".", ".", ".", "!", "?"))[-1]

    def prose(self) -> str:
        lengths = self.rng.choice(((1, 4), (4, 12), (8, 25), (8, 25)))
        return " ".join(self.sentence(*lengths) for _ in range(self.rng.choice((1, 1, 2, 3, 5, 8))))

    def leaf(self, mark: str, tag: str, text: str, attributes: str = "") -> str:
        return f"<{tag}{attributes}>{mark}{text}</{tag}>"

    def named(self, tag: str, *names: str) -> str:
        return f'<{tag} {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(names)}">'

    def menu(self, opening: str, closing: str) -> str:
        rng = self.rng
        tag = rng.choice(("li", "li", "span", "div", "td"))
        items = "".join(f'<{tag}><a href="/{i}">{DROP if tag != "span" or not i else ""}{self.words(1, 3)}</a></{tag}> ' for i in range(rng.randint(2, 9)))
        inside = {"li": f"<ul>{items}</ul>", "td": f"<table><tr>{items}</tr></table>"}.get(tag, items)
        return f"{opening}{inside}{closing}"

    def boilerplate(self, kind: str) -> str:
        rng, d = self.rng, "</div>"
        texts = lambda tag="p": "".join(self.leaf(DROP, tag, self.prose()) for _ in range(rng.randint(1, 3)))
        bare = lambda: DROP + self.prose()
        inside = rng.choice((texts, bare, lambda: self.leaf(DROP, "div", self.prose())))()
        if kind == "nav":
            return self.menu(*rng.choice((("<nav>", "</nav>"), (self.named("div", "menu", "nav main-nav", "navbar", "breadcrumbs"), d), (self.named("ul", "menu", "nav"), "</ul>"), ("<nav>", "</nav>"))))
        if kind == "header":
            return f"<header>{self.leaf(DROP, rng.choice(('div', 'h1', 'p', 'span')), self.words(1, 6))}</header>" if rng.random() < 0.6 else self.named("div", "header", "masthead", "site-header") + inside + d
        if kind == "ad":
            return self.named("div", "ad", "ads", "advert", "ad-slot", "sponsored", "promo banner", "advertisement") + inside + d
        if kind == "notice":
            return self.named("div", "cookie-banner", "notice", "consent", "alert", "gdpr-notice", "popup") + inside + rng.choice(("", self.leaf(DROP, "button", self.words(1, 2)))) + d
        if kind == "aside":
            return f"<aside>{self.leaf(DROP, 'h3', self.words(1, 4))}{inside}</aside>" if rng.random() < 0.6 else self.named("div", "sidebar", "related", "widget", "side") + self.menu("", "") + inside + d
        if kind == "form":
            return f"<form>{DROP}{self.words(1, 5)}<input name=q><button>{DROP}{self.words(1, 2)}</button>{self.leaf(DROP, 'p', self.prose())}</form>"
        if kind == "comments":
            rows = "".join(f'{self.named("div", "comment", "comment-body", "reply")}{self.leaf(DROP, "p", self.prose())}</div>' for _ in range(rng.randint(1, 5)))
            rows = rng.choice((rows, texts(), f"<ul>{texts('li')}</ul>"))
            return self.named("div", "comments", "comment-list", "reader-comments", "disqus", "replies") + rng.choice(("", self.leaf(DROP, "h3", self.words(1, 2)))) + rows + d
        if kind == "social":
            return self.named("div", "share", "social", "sharing tags") + DROP + self.words(1, 4) + d
        text = rng.choice((f"&copy; {self.words(1, 4)} &middot; {self.prose()}", self.words(2, 8), self.prose()))
        return f"<footer>{self.leaf(DROP, 'p', text) if rng.random() < 0.4 else DROP + text}</footer>" if rng.random() < 0.7 else self.named("div", "footer", "copyright", "legal") + DROP + text + d

    def article(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            title = self.leaf(KEEP, rng.choice(("h1", "h1", "h1", "h2")), rng.choice((self.sentence(2, 12), self.words(1, 12))))
            out.append(f"<header>{title}</header>" if rng.random() < 0.12 else title)
        for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
            r = rng.random()
            if r < 0.62:
                out.append(self.leaf(KEEP, "p", self.prose()))
            elif r < 0.72:
                out.append(f"<p><b>{KEEP}{self.prose()}<br>")
            elif r < 0.77:
                out.append(self.leaf(KEEP, rng.choice(("h2", "h3")), self.words(1, 8)))
            elif r < 0.81:
                out.append("<ul>" + "".join(self.leaf(KEEP, "li", rng.choice((self.words(1, 6), self.prose()))) for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.84:
                out.append(f"<blockquote>{self.leaf(KEEP, 'p', self.prose()) if rng.random() < 0.5 else KEEP + self.prose()}</blockquote>")
            elif r < 0.87:
                out.append(self.leaf(KEEP, rng.choice(("div", "pre", "section")), self.prose()))
            elif r < 0.89:
                out.append("<table>" + "".join(f"<tr>{self.leaf(KEEP, 'td', self.words(1, 4))}{self.leaf(KEEP, 'td', self.words(1, 4))}</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.91:
                out.append(f"<figure><img src=x>{self.leaf(KEEP, 'figcaption', self.prose())}</figure>")
            else:
                out.append(f'<p>{KEEP}{self.words(1, 20)} <a href="/x">{self.words(1, 4)}</a> {self.prose()}</p>')
            if rng.random() < 0.06:
                out.append(self.boilerplate(rng.choice(("ad", "ad", "social", "aside", "notice", "form", "nav"))))
        if rng.random() < 0.08:
            out.append(self.boilerplate(rng.choice(("comments", "footer", "social"))))
        inside = "".join(out)
        r = rng.random()
        if r < 0.5:
            inside = f"<article>{inside}</article>"
        elif r < 0.6:
            inside = f"<main>{inside}</main>"
        elif r < 0.66:
            inside = f"<main><article>{inside}</article></main>"
        elif r < 0.86:
            inside = self.named("div", "content", "post", "entry-content", "article-body", "story", "main", "post-content") + inside + "</div>"
        elif r < 0.93:
            inside = f"<div>{inside}</div>"
        return inside

    def page(self) -> str:
        rng = self.rng
        before = [k for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.45]
        after = [k for k in ("social", "ad", "comments", "aside", "form", "nav", "notice", "footer") if rng.random() < 0.4]
        rng.shuffle(before)
        head = f"<head><title>{DROP}{self.words(2, 9)}</title><style>p{{}}</style></head>" if rng.random() < 0.9 else ""
        body = "".join(map(self.boilerplate, before)) + self.article() + "".join(map(self.boilerplate, after))
        if rng.random() < 0.3:
            body = self.named("div", "page", "wrapper", "container", "site") + body + "</div>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + rng.choice(("</body></html>", ""))


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels (1: of the article) of ``n`` pages."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        found, labels = [], []
        for b in blocks(_Page(rng).page()):
            keep = KEEP in b.text
            text = b.text.replace(KEEP, "").replace(DROP, "").strip()
            if text:
                found.append(Block(text, b.tag, b.zones, b.inner, b.linked))
                labels.append(int(keep))
        out.append((found, labels))
    return out
