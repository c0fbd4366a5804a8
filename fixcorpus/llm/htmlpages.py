"""Labelled pages for training the block labeller: made-up layouts with known main blocks, from a fixed seed."""

from __future__ import annotations

import random

from .htmltext import Block, blocks

_SYLLABLES = "ka lo mi ter vus en ro pal shi do fa ne gri tol bu wex ja que ".split()
_LINKS = "home news sport about contact login shop help archive next previous search".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: set[str] = set()
        self.count = 0

    def words(self, least: int, most: int, stop: bool = True) -> str:
        r = self.r
        self.count += 1
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(least, most))]
        out.insert(r.randrange(len(out) + 1), f"x{self.count}")
        text = " ".join(w + ("," if r.random() < 0.08 else ". " + r.choice(out).capitalize() if r.random() < 0.08 else "") for w in out)
        return text.capitalize() + (r.choice(".....!?") if stop else "")

    def kept(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return text

    def paragraph(self) -> str:
        r = self.r
        text = self.kept(self.words(*r.choice([(1, 4), (4, 12), (15, 60), (40, 120)])))
        if r.random() < 0.2:
            a, _, b = text.partition(" ")
            return f'<p>{a} <a href="/{r.randrange(99)}">{b}</a></p>' if r.random() < 0.3 and len(text) < 60 else f"<p><b>{a}</b> {b}</p>"
        return f"<p>{text}" + r.choice(["</p>", "</p>", "</p>", "<br>"])

    def content(self) -> str:
        r = self.r
        title = f"<h1>{self.kept(self.words(3, 10, r.random() < 0.4))}</h1>" if r.random() < 0.9 else ""
        out = [f"<header>{title}</header>" if title and r.random() < 0.2 else title]
        if r.random() < 0.2:
            out.append(f"<header><p class='byline'>{self.words(2, 5, False)}</p></header>")
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.70:
                out.append(self.paragraph())
            elif kind < 0.74:
                out.append(f"<div>{self.kept(self.words(8, 60))}</div>")
            elif kind < 0.80:
                out.append(f"<h2>{self.kept(self.words(2, 7, False))}</h2>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.kept(self.words(3, 14))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote>{self.kept(self.words(8, 30))}</blockquote>")
            elif kind < 0.90:
                out.append(f"<pre>{self.kept(self.words(4, 12, False))}</pre>")
            elif kind < 0.96:
                out.append(self.advert())
            else:
                out.append(self.junk())
        return "".join(out)

    def links(self) -> str:
        r = self.r
        return "<ul>" + "".join(f'<li><a href="/{w}">{w if r.random() < 0.5 else self.words(1, 2, False)}</a></li>' for w in r.sample(_LINKS, r.randint(2, 7))) + "</ul>"

    def advert(self) -> str:
        name = self.r.choice(["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "ad banner"])
        return f'<div class="{name}">{self.words(3, 25)}</div>'

    def junk(self) -> str:
        r = self.r
        kind = r.randrange(7)
        text = self.words(3, 30)
        if kind == 0:
            return f'<div class="{r.choice(["cookie notice", "cookie-banner", "notice", "consent", "newsletter", "popup", "alert"])}"><p>{text}</p></div>'
        if kind == 1:
            return f'<form action="/s"><label>{self.words(1, 3, False)}</label><input name="q"><p>{text}</p></form>'
        if kind == 2:
            name = r.choice(["", ' class="sidebar"', ' class="related"', ' class="box"'])
            head = f"<h3>{self.words(1, 4, False)}</h3>" if r.random() < 0.6 else ""
            return f"<aside{name}>{head}<p>{text}</p>{self.links() if r.random() < 0.6 else ''}</aside>"
        if kind == 3:
            name = r.choice(['class="sidebar"', 'id="sidebar"', 'class="widget"', 'class="related"'])
            return f"<div {name}><h3>{self.words(1, 4, False)}</h3><p>{text}</p></div>"
        if kind == 4:
            return f'<div class="{r.choice(["share", "social", "tags", "meta", "breadcrumb", "pagination"])}"><a href="/s">{self.words(1, 3, False)}</a> {self.words(1, 4, False)}</div>'
        if kind == 5:
            return f'<div class="{r.choice(["menu", "nav", "navbar", "toolbar"])}">{self.links()}</div>'
        return self.comments()

    def comments(self) -> str:
        r = self.r
        name, tag = r.choice(["comments", "comment-list", "responses", "replies", "discussion"]), r.choice(["div", "section"])
        each = "".join(f'<div class="comment"><b>{self.words(1, 2, False)}</b><p>{self.words(3, 40)}</p></div>' for _ in range(r.randint(1, 4)))
        return f'<{tag} {r.choice(["class", "id"])}="{name}"><h3>{self.words(1, 3, False)}</h3>{each}</{tag}>'

    def page(self) -> str:
        r = self.r
        body = []
        if r.random() < 0.3:
            rank = r.choice(["h1", "h2", "div"])
            body.append(f"<header><{rank}>{self.words(1, 4, False)}</{rank}>" + (f"<p>{self.words(2, 9, False)}</p>" if r.random() < 0.7 else "") + "</header>")
        if r.random() < 0.8:
            body.append(f"<nav>{self.links()}</nav>" if r.random() < 0.8 else f'<div class="menu">{self.links()}</div>')
        if r.random() < 0.6:
            body.append(self.advert())
        if r.random() < 0.3:
            body.append(self.junk())
        inner = self.content()
        shape = r.random()
        comments = self.comments() if r.random() < 0.3 else ""
        if shape < 0.45:
            inside = r.random() < 0.4
            body.append(f"<article>{inner}{comments if inside else ''}</article>{'' if inside else comments}")
        elif shape < 0.57:
            body.append(f"<main>{inner}</main>{comments}")
        elif shape < 0.75:
            name = r.choice(["content", "post", "entry", "article", "story", "post-content", "main"])
            body.append(f'<div {r.choice(["class", "id"])}="{name}">{inner}</div>{comments}')
        else:
            # nothing names the text's place; it begins with its title or a paragraph, right below the body or in plain containers
            begin, end = r.choice([("", ""), ("<section>", "</section>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), (f'<div class="x{r.randrange(999)}">', "</div>")])
            body.append(f"{begin}{inner}{end}{comments}")
        if r.random() < 0.3:
            body.append(self.junk())
        if r.random() < 0.8:
            body.append(f"<footer>{r.choice(['&copy; ', '&copy; 2020 ', ''])}{self.words(1, 14)}</footer>" if r.random() < 0.8 else f'<div class="footer"><p>&copy; {self.words(1, 9)}</p></div>')
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6, False)}</title><style>p{{}}</style></head><body>{''.join(body)}" + r.choice(["</body></html>", "</body></html>", ""])


def labelled(n: int, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """``n`` pages as blocks with labels, 1 for main text."""
    out = []
    for i in range(n):
        made = _Page(seed * 100_003 + i)
        found = blocks(made.page())
        out.append((found, [int(b.text in made.main) for b in found]))
    return out
