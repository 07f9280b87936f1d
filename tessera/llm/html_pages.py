"""Labelled pages to train the extraction model on, made up by rule: a layout is drawn, and each block in it is labelled
by the part of the page that it belongs to. Layouts differ in how much they tell: by elements, by names, or by neither."""

from __future__ import annotations

import random

_SYLLABLES = ("ka", "lo", "mi", "ter", "an", "so", "ve", "ru", "din", "pe", "ost", "al")
#: Names that page authors give to parts of a page: those of the main text, and those of all else, by part.
CONTENT_NAMES = ("content", "main", "post", "entry", "story", "article-body", "article", "text", "body", "entry-content", "post-content", "page-content", "main-content", "prose")
OTHER_NAMES = {
    "menu": ("nav", "menu", "navbar", "breadcrumb", "toc", "pagination", "site-navigation", "main-menu", "nav-links"),
    "header": ("header", "masthead", "top-bar", "branding", "site-header", "banner-top"),
    "footer": ("footer", "bottom", "copyright", "legal", "site-footer", "page-footer"),
    "sidebar": ("sidebar", "aside", "related", "widget", "recommended", "side-content", "related-posts", "widget-area"),
    "notice": ("notice", "cookie-banner", "alert", "newsletter", "popup", "consent", "cookie-notice", "subscribe"),
    "advert": ("ad", "ads", "advert", "sponsored", "promo", "banner", "ad-content", "advertisement", "post-ad"),
    "comments": ("comments", "comment", "replies", "respond", "discussion", "comment-body", "comment-content", "comment-text", "post-comments", "comment-list", "reply"),
    "share": ("share", "social", "tags", "meta", "share-buttons", "post-meta", "byline"),
}


class Maker:
    def __init__(self, seed: int, content_names: tuple[str, ...] = CONTENT_NAMES, other_names: dict[str, tuple[str, ...]] = OTHER_NAMES):
        self.r = random.Random(seed)
        self.content_names, self.other_names = content_names, other_names

    def words(self, low: int, high: int) -> str:
        out = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        out = [w + self.r.choice(["", "", "", "", "", "", ","]) for w in out]
        return " ".join(out).capitalize() + self.r.choice([".", ".", ".", "", "!"])

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18) for _ in range(self.r.randint(low, high)))

    def block(self, tag: str, text: str, label: int, attrs: str = "") -> str:
        """data-y is the label; it is read by the trainer and no feature."""
        return f'<{tag}{attrs} data-y="{label}">{text}</{tag}>'

    def links(self, n: int) -> str:
        if self.r.random() < 0.2:
            return self.block("div", " ".join(f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n)), 0)
        return "<ul>" + "".join(self.block("li", f'<a href="/{k}">{self.words(1, 3)}</a>', 0) for k in range(n)) + "</ul>"

    def opaque(self) -> str:
        """A name that says nothing."""
        return self.r.choice(["css-", "x", "sc-", "m_", "jss"]) + "".join(self.r.choices("bcdfghjk0123456789", k=5))

    def named(self, names: tuple[str, ...], plain: float = 0.3) -> str:
        """Attributes with one of the names, or with one that says nothing."""
        said = self.opaque() if self.r.random() < plain else self.r.choice(names)
        if self.r.random() < 0.2:
            said = f"{self.opaque()} {said}" if self.r.random() < 0.5 else f"{said} {self.opaque()}"
        return f' {self.r.choice(["class", "class", "id"])}="{said}"'

    def article(self, para: str = "p") -> str:
        r, out = self.r, []
        if r.random() < 0.7:
            out.append(self.block("h1", self.words(3, 12), 1))
        if r.random() < 0.15:
            out.append(self.other("share"))
        for _ in range(r.choice([1, 1, 2, 2, 3, 4, 6, 8, 12])):
            kind = r.random()
            if kind < 0.72:
                text = self.sentences(1, 6) if r.random() < 0.8 else self.words(1, 12)
                if r.random() < 0.2:
                    text += f' <a href="/x">{self.words(1, 4)}</a>'
                if r.random() < 0.2:
                    text = f"<b>{text}"
                out.append(self.block(para, text, 1, self.named(self.content_names, 0.8) if r.random() < 0.1 else ""))
            elif kind < 0.8:
                out.append(self.block(r.choice(["h2", "h3"]), self.words(1, 7), 1))
            elif kind < 0.86:
                out.append("<ul>" + "".join(self.block("li", self.words(2, 15), 1) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append("<blockquote>" + self.block("p", self.words(5, 40), 1) + "</blockquote>")
            elif kind < 0.93:
                out.append("<table><tr>" + "".join(self.block("td", self.words(1, 4), 1) for _ in range(4)) + "</tr></table>")
            elif kind < 0.95:
                out.append("<dl>" + self.block("dt", self.words(1, 3), 1) + self.block("dd", self.words(4, 20), 1) + "</dl>")
            elif kind < 0.97:
                out.append(self.block("pre", self.words(3, 20), 1))
            else:
                out.append(self.other(r.choice(["advert", "share", "notice"])))
        if r.random() < 0.2:
            out.append(self.other("comments"))
        return "".join(out)

    def other(self, part: str) -> str:
        r = self.r
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside"}.get(part, "section") if r.random() < 0.6 else "div"
        attrs = self.named(self.other_names[part], 0.1) if tag in ("div", "section") or r.random() < 0.5 else ""
        if part == "menu" or part == "share" or (part in ("footer", "sidebar") and r.random() < 0.4):
            inside = self.links(r.randint(2, 9))
        elif part == "comments":
            inside = "".join(self.block("p", self.sentences(1, 4), 0) for _ in range(r.randint(1, 5)))
            if r.random() < 0.4:
                inside = f"<div{self.named(self.other_names['comments'], 0)}>{inside}</div>"
            if r.random() < 0.4:
                inside += "<form>" + self.block("label", self.words(1, 4), 0) + "</form>"
        else:
            inside = "".join(self.block(r.choice(["p", "p", "h3", "div"]), self.words(1, 25), 0) for _ in range(r.randint(1, 3)))
            if tag == "div" and r.random() < 0.5:
                return self.block(tag, self.words(2, 20), 0, attrs)
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def page(self) -> str:
        r = self.r
        bare = r.random() < 0.25  # nothing but the text
        before = [] if bare else [self.other(p) for p in r.sample(["menu", "header", "notice", "advert"], r.randint(0, 4))]
        after = [] if bare else [self.other(p) for p in r.sample(["comments", "sidebar", "footer", "advert", "notice", "share"], r.randint(0, 5))]
        shell = "" if bare or r.random() < 0.08 else r.choice(["article", "article", "main", "div", "div", "section"])
        text = self.article(r.choice(["p", "p", "p", "p", "p", "p", "p", "div", "my-para", "x-text"]))
        if shell:
            attrs = self.named(self.content_names) if shell in ("div", "section") or r.random() < 0.3 else ""
            text = f"<{shell}{attrs}>{text}</{shell}>"
            if r.random() < 0.3:
                text = f'<main><div class="{r.choice(("wrapper", "container", "page"))}">{text}</div>{self.other("sidebar") if r.random() < 0.5 else ""}</main>'
        title = self.block("title", self.words(2, 10), 0)
        form = "<form>" + self.block("p", self.words(1, 6), 0) + self.block("button", self.words(1, 2), 0) + "</form>" if not bare and r.random() < 0.3 else ""
        inside = "".join([*before, form, text, *after])
        frame = r.random()  # a whole page, a body alone, or a fragment
        return f"<!DOCTYPE html><html><head>{title}</head><body>{inside}</body></html>" if frame < 0.7 else f"<body>{inside}</body>" if frame < 0.85 else inside


def labelled_pages(n: int, seed: int, **names) -> list[str]:
    return [Maker(seed * 100_003 + k, **names).page() for k in range(n)]
