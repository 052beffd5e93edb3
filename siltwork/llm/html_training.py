"""Labelled pages for training the extractor: made by rule, with the main text marked.

An element with ``data-state="1"`` begins the main text, one with ``data-state="0"`` begins
something else, and an unmarked element above a main text is a wrapper.
"""

from __future__ import annotations

import random

MENU = ("menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "topnav")
HEADER = ("header", "masthead", "site-header", "topbar", "branding")
FOOTER = ("footer", "copyright", "site-footer", "colophon", "legal")
SIDE = ("sidebar", "widget", "related", "recommended", "trending", "tags", "aside")
NOTICE = ("cookie", "consent", "notice", "banner", "alert", "popup", "modal", "paywall", "gdpr")
ADVERT = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion")
FORM = ("newsletter", "subscribe", "signup", "search", "login", "share", "social")
COMMENT = ("comments", "comment", "replies", "reply", "discussion", "disqus", "respond")
MAIN = ("article", "content", "post", "entry", "story", "main", "article-body", "post-content", "body", "text")
WRAP = ("wrapper", "container", "page", "layout", "row", "site", "inner")
SYLLABLES = ("an", "ber", "ca", "de", "el", "fo", "ga", "hin", "is", "jo", "ka", "lo", "mer", "no", "or", "pe", "qui", "ra", "st", "ti", "un", "ve", "wi", "za", "é", "ñ", "ü")


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.r
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
        return " ".join(w + ("." if r.random() < 0.1 else "," if r.random() < 0.05 else "") for w in out).capitalize() + r.choice((".", ".", "", " &amp;"))

    def link(self) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 3)}</a>'

    def links(self) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 8))) + "</ul>"

    def box(self, tags: tuple[str, ...], names: tuple[str, ...], inside: str, state: str = "0") -> str:
        """An element known by its tag, its class, its id, or tag and class together."""
        tag = self.r.choice((*tags, "div", "section")) if tags else self.r.choice(("div", "div", "section"))
        attribute = "" if tag in tags and self.r.random() < 0.6 else f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}"'
        return f'<{tag}{attribute} data-state="{state}">{inside}</{tag}>'

    def junk(self) -> str:
        r = self.r
        kind = r.randrange(9)
        if kind == 0:
            return self.box(("nav",), MENU, self.links())
        if kind == 1:
            return self.box(("header",), HEADER, r.choice((f"<h1>{self.words(2, 6)}</h1>", f"<p>{self.words(2, 8)}</p>", "")) + self.links())
        if kind == 2:
            return self.box(("footer",), FOOTER, r.choice(("&copy; ", f"<p>&copy; {self.words(2, 6)}</p>")) + self.words(3, 20) + r.choice(("", self.links())))
        if kind == 3:
            return self.box(("aside",), SIDE, f"<h3>{self.words(1, 3)}</h3>" + r.choice((self.links(), f"<p>{self.words(5, 40)}</p>")))
        if kind == 4:
            return self.box((), NOTICE, r.choice((f"<p>{self.words(5, 40)}</p>", self.words(5, 40))) + r.choice(("", "<button>Ok</button>")))
        if kind == 5:
            return self.box((), ADVERT, r.choice((f"<p>{self.words(3, 40)}</p>", self.words(3, 40), self.link(), f"<span>{self.words(3, 9)}</span>")))
        if kind == 6:
            return self.box(("form",), FORM, f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + r.choice(("", f"<p>{self.words(3, 15)}</p>", "<select><option>A</option></select>")))
        inner = "".join(f'<div class="{r.choice(("comment", "reply"))}">' + r.choice((f"<b>{self.words(1, 2)}</b>", "")) + f"<p>{self.words(5, 60)}</p></div>" for _ in range(r.randint(1, 4)))
        return self.box((), COMMENT, f"<h2>{self.words(1, 3)}</h2>{inner}" if r.random() < 0.5 else inner)

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{self.words(3, 12)}</h1>")
        for _ in range(r.randint(1, 12)):
            roll = r.random()
            if roll < 0.68:
                text = self.words(6, 120)
                if r.random() < 0.3:
                    text += r.choice((f" <b>{self.words(1, 5)}</b> ", f" <em>{self.words(1, 3)}</em> ", f" {self.link()} ", f"<span> {self.words(1, 4)}</span>", f"<code>{self.words(1, 2)}</code>")) + self.words(2, 20)
                out.append(r.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div><p>{text}</p></div>")))
            elif roll < 0.76:
                out.append(f"<h{(k := r.randint(2, 4))}>{self.words(1, 7)}</h{k}>")
            elif roll < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif roll < 0.86:
                out.append(f"<blockquote><p>{self.words(5, 40)}</p></blockquote>")
            elif roll < 0.9:
                out.append(r.choice((f"<pre>{self.words(3, 20)}</pre>", f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>", f"<figure><img src=x><figcaption>{self.words(2, 9)}</figcaption></figure>")))
            else:
                out.append(self.junk())
        return self.box(("article", "main", "article"), MAIN, "".join(out), "1")

    def page(self) -> str:
        r = self.r
        parts = [self.junk() for _ in range(r.randint(0, 3))] + [self.main()] + [self.junk() for _ in range(r.randint(0, 4))]
        body = "<!-- x -->".join(parts)
        if r.random() < 0.5:
            body = f'<div class="{r.choice(WRAP)}">{body}</div>'
        if r.random() < 0.2:
            body = f"<div>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(3, 8)}</title><style>p{{}}</style></head><body>{body}<script>x()</script></body></html>"


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    return [Writer(seed * 100_003 + i).page() for i in range(n)]
