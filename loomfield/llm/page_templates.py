"""Labelled pages that the block classifier of ``html_extract`` is fitted on, made from a seed.

A page is an article in one of several layouts among menus, headers, footers, sidebars, notices, adverts, forms
and reader comments.  Layouts mark their parts by element names, by class words, by both or by neither, and some
articles bear class words that elsewhere stand for boilerplate, so that no single mark settles a block.
"""

from __future__ import annotations

import random
from html import escape

_SYLLABLES = "ba ce di fo gu ha in ka le mo nu or pe ra si tu va we xi yo an er th st on".split()
#: Class words of parts, as sites write them.
_WORDS = {
    "nav": ("nav", "navbar", "main-menu", "menu", "breadcrumbs", "pagination", "site-navigation"),
    "head": ("header", "masthead", "site-header", "page-header"),
    "foot": ("footer", "site-footer", "copyright", "legal", "bottom-footer"),
    "side": ("sidebar", "side-bar", "widget", "related", "related-posts", "recommended", "share", "social-share"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "top-banner"),
    "notice": ("cookie-notice", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal"),
    "comments": ("comments", "comment-list", "commentlist", "replies", "discussion", "respond"),
    "form": ("search", "search-box", "login", "newsletter", "subscribe", "signup"),
    "here": ("article", "content", "main-content", "post", "entry-content", "story", "post-body"),
}
_ODD = ("legal", "share", "search-engines", "banner-free", "sidebar-layout", "menu-open", "social", "cookie-recipes", "advert-history", "no-sidebar")


class Page:
    """One page under way: its markup, and its labelled blocks in order."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        self.style = rng.choice(("tags", "classes", "both", "both", "neither"))
        self.noisy, self.bare = rng.random() < 0.2, rng.random() < 0.15
        self.loose = rng.random() < 0.5

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, n: int) -> str:
        found = [self.word() for _ in range(n)]
        return " ".join(w + self.rng.choice(("###", "%%%", "&", "!!")) if self.noisy and self.rng.random() < 0.7 else w for w in found)

    def prose(self, n: int) -> str:
        left, found = n, []
        while left > 0:
            k = min(left, self.rng.randint(1, 16))
            s = self.words(k).capitalize()
            if k > 6 and self.rng.random() < 0.5:
                at = s.index(" ", len(s) // 2) if " " in s[len(s) // 2 :] else len(s)
                s = f"{s[:at]},{s[at:]}"
            found.append(s if self.bare else s + self.rng.choice("....?!"))
            left -= k
        return " ".join(found)

    def block(self, tag: str, text: str, content: bool, linked: float = 0.0, attributes: str = "") -> None:
        """A block; a share of its words is linked."""
        words = text.split()
        cut = round(linked * len(words))
        shown = " ".join(map(escape, words))
        if cut:
            shown = f'<a href="/{self.word()}">{" ".join(map(escape, words[:cut]))}</a> {" ".join(map(escape, words[cut:]))}'
        elif self.rng.random() < 0.2 and len(words) > 6:
            shown = f"<b>{escape(words[0])}</b> {' '.join(map(escape, words[1:]))}"
        self.out.append(f"<{tag}{attributes}>{shown}</{tag}>" if tag else shown)
        self.labels.append((" ".join(words), content))

    def marked(self, part: str, tag: str, plain: str = "div") -> tuple[str, str]:
        """Start and end of an element for a part, as the page's style marks it."""
        name = tag if tag and self.style in ("tags", "both") else plain
        said = ""
        if self.style in ("classes", "both") or not tag and self.style == "tags":
            said = f' {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(_WORDS[part])}"'
        elif self.rng.random() < 0.3:
            said = f' class="{self.word()}"'
        if part != "here" and self.rng.random() < 0.05:
            said += self.rng.choice((" hidden", ' style="display: none"', ' aria-hidden="true"'))
        return f"<{name}{said}>", f"</{name}>"

    def wrap(self, part: str, tag: str, body, plain: str = "div") -> None:
        start, end = self.marked(part, tag, plain)
        self.out.append(start)
        body()
        self.out.append(end)

    def link_list(self, most: int = 8) -> None:
        self.out.append("<ul>")
        for _ in range(self.rng.randint(2, most)):
            self.block("li", self.words(self.rng.randint(1, 3)), False, 1.0)
        self.out.append("</ul>")

    def menu(self) -> None:
        if self.rng.random() < 0.1:
            self.out.append("<table><tr>")
            for _ in range(self.rng.randint(2, 6)):
                self.block("td", self.words(self.rng.randint(1, 2)), False, 1.0)
            self.out.append("</tr></table>")
            return
        self.wrap("nav", "nav", self.link_list, self.rng.choice(("div", "td")) if self.style == "neither" else "div")

    def header(self) -> None:
        def body() -> None:
            self.block(self.rng.choice(("h1", "div", "p")), self.words(self.rng.randint(1, 3)), False, self.rng.choice((0.0, 1.0)))
            if self.rng.random() < 0.5:
                self.menu()

        self.wrap("head", "header", body)

    def footer(self) -> None:
        def body() -> None:
            self.block(self.rng.choice(("", "p", "div")), "© " + self.prose(self.rng.randint(3, 20)), False)
            if self.rng.random() < 0.4:
                self.link_list(5)

        self.wrap("foot", "footer", body)

    def advert(self) -> None:
        self.wrap("ad", "aside" if self.rng.random() < 0.2 else "", lambda: self.block(self.rng.choice(("", "p")), self.prose(self.rng.randint(2, 20)), False, self.rng.choice((0.0, 0.0, 0.3, 1.0))))

    def notice(self) -> None:
        self.wrap("notice", "dialog" if self.rng.random() < 0.3 else "", lambda: self.block(self.rng.choice(("", "p")), self.prose(self.rng.randint(5, 30)), False, self.rng.choice((0.0, 0.2))))

    def sidebar(self) -> None:
        def body() -> None:
            self.block(self.rng.choice(("h3", "p", "h2")), self.words(self.rng.randint(1, 3)), False)
            if self.rng.random() < 0.6:
                self.link_list(6)
            else:
                self.block("p", self.prose(self.rng.randint(4, 30)), False, self.rng.choice((0.0, 0.5)))

        self.wrap("side", "aside", body)

    def form(self) -> None:
        def body() -> None:
            self.block(self.rng.choice(("p", "label", "div", "legend")), self.words(self.rng.randint(1, 6)), False)

        self.wrap("form", "form", body, "form" if self.rng.random() < 0.8 else "div")

    def comments(self) -> None:
        def body() -> None:
            self.block("h3", self.words(2), False)
            for _ in range(self.rng.randint(1, 8)):
                start = self.rng.choice(('<div class="comment">', "<div>", '<article class="comment">', "<li>"))
                self.out.append(start)
                self.block(self.rng.choice(("p", "p", "")), self.prose(self.rng.randint(3, 40)), False, 0.05)
                self.out.append(f"</{start[1:-1].split(' ')[0]}>")

        # without a mark nothing tells comments from the text
        style, self.style = self.style, "both" if self.style == "neither" else self.style
        self.wrap("comments", "", body, self.rng.choice(("div", "section")))
        self.style = style

    def text(self) -> None:
        if self.rng.random() < 0.8:
            self.block("h1", self.prose(self.rng.randint(2, 14)).rstrip(".?!") if self.rng.random() < 0.7 else self.words(3), True)
        inside = [self.advert, self.form, self.sidebar]
        for _ in range(self.rng.randint(1, 12)):
            kind = self.rng.random()
            if kind < 0.7:
                self.block("p", self.prose(self.rng.choice((1, 2, 4, 8, 15, 30, 60, 120))), True, self.rng.choice((0.0, 0.0, 0.1, 0.3)))
            elif kind < 0.76:
                self.block(self.rng.choice(("h2", "h3")), self.words(self.rng.randint(1, 6)), True)
            elif kind < 0.84:
                self.out.append("<ul>")
                for _ in range(self.rng.randint(1, 5)):
                    self.block("li", self.prose(self.rng.randint(1, 14)), True, self.rng.choice((0.0, 0.0, 0.3, 1.0)))
                self.out.append("</ul>")
            elif kind < 0.88:
                self.out.append("<table>")
                for _ in range(self.rng.randint(1, 4)):
                    self.out.append("<tr>")
                    for _ in range(3):
                        self.block("td", self.words(self.rng.randint(1, 3)), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif kind < 0.94:
                self.block(self.rng.choice(("blockquote", "pre", "figcaption")), self.prose(self.rng.randint(2, 40)), True)
            elif self.style != "neither":
                self.rng.choice(inside)()

    def article(self) -> None:
        if self.rng.random() < 0.15:
            odd = self.rng.choice(_ODD)
            tag = self.rng.choice(("article", "main", "div", "section"))
            said = odd if tag in ("article", "main") else f"{self.rng.choice(_WORDS['here'])} {odd}" if self.rng.random() < 0.85 else odd
            self.out.append(f'<{tag} {self.rng.choice(("class", "id"))}="{said}">')
            self.text()
            self.out.append(f"</{tag}>")
        else:
            self.wrap("here", self.rng.choice(("article", "article", "main")), self.text, self.rng.choice(("div", "section", "td")))

    def build(self) -> tuple[str, list[tuple[str, bool]]]:
        some = lambda p: self.rng.random() < p
        around = self.rng.choice(("", "", "", "<div>", '<div class="wrapper">', "<main>", '<div id="page">', "<div>", self.rng.choice(("<form>", "")), f'<div class="{self.rng.choice(_ODD)}">'))
        self.out.append(f"<html><head><title>{self.words(3)}</title></head><body>{around}")
        for part, p in ((self.notice, 0.3), (self.header, 0.6), (self.menu, 0.6), (self.advert, 0.4)):
            if some(p):
                part()
        if some(0.2):
            self.sidebar()
        if some(0.96):
            self.article()
        for part, p in ((self.sidebar, 0.4), (self.comments, 0.3), (self.form, 0.2), (self.advert, 0.2), (self.footer, 0.7), (self.notice, 0.1)):
            if some(p):
                part()
        self.out.append(("</" + around[1:].split(" ")[0].rstrip(">") + ">" if around else "") + "</body></html>")
        return "".join(self.out), self.labels


def pages(n: int, seed: int) -> list[tuple[str, list[tuple[str, bool]]]]:
    """(markup, [(text, is content)] in page order) of ``n`` pages."""
    rng = random.Random(seed)
    return [Page(rng).build() for _ in range(n)]
