"""Labelled pages to learn content extraction from: invented layouts with a label on their elements.

``data-y="1"`` marks main content and ``data-y="0"`` anything else; elements without
it inherit.  Tags, names, nesting, order, lengths and faults (unclosed paragraphs and
inline elements, missing ends) vary by a seeded generator, so every run trains the
same model.
"""

from __future__ import annotations

import random

_PIECES = "ba co de fi gu la me no pi ra so tu ver lon mar sten que rie ou ent ich ung ción é ü ñ".split()
# Names that pages give their parts (fixed values).
CONTENT = "article content post entry story body main text page news blog document read prose".split()
MENU = "nav menu navbar navigation breadcrumb breadcrumbs links tabs toolbar topbar toc pager pagination".split()
HEADER = "header masthead top brand logo banner title site hero".split()
FOOTER = "footer bottom copyright legal credits imprint foot colophon".split()
SIDE = "sidebar side aside widget rail secondary column related recommended popular trending teaser more promo".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo banner promotion adsense commercial".split()
NOTICE = "cookie notice consent gdpr alert popup modal overlay warning message toast disclaimer subscribe newsletter paywall signup".split()
FORM = "form search login signup contact subscribe newsletter field".split()
COMMENTS = "comment comments reply replies discussion disqus thread respond reviews feedback responses".split()
SHARE = "share social follow sharing tags meta byline".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.r = rng

    def word(self) -> str:
        w = "".join(self.r.choice(_PIECES) for _ in range(self.r.randint(1, 4)))
        return w + self.r.choice(["", "", "", "", "", "", "***", ",", "!!"]) if self.r.random() < 0.2 else w

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice(". . . ? !".split()) for _ in range(self.r.randint(low, high)))

    def inline(self, text: str) -> str:
        parts = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            k = self.r.randrange(len(parts))
            tag = self.r.choice(["b", "i", "em", "strong", "a href='/x'", "span", "code"])
            parts[k] = f"<{tag}>{parts[k]}</{tag.split()[0]}>"
        return " ".join(parts)

    def named(self, names: list[str]) -> str:
        if self.r.random() < 0.1:
            return ""
        name = self.r.choice(names)
        style = self.r.random()
        if style < 0.3:
            name = f"{name}-{self.r.choice('box wrap inner area block list item section container'.split())}"
        elif style < 0.4:
            name = f"{self.r.choice('site page main js c l'.split())}-{name}"
        return f' {self.r.choice(["class", "class", "class", "id"])}="{name}"'

    def element(self, tag: str, names: list[str] | None, inner: str, y: int | None = None) -> str:
        label = "" if y is None else f' data-y="{y}"'
        return f"<{tag}{self.named(names) if names else ''}{label}>{inner}</{tag}>"

    def link_list(self) -> str:
        n = self.r.randint(1, 9)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{k}">{self.words(1, 4)}</a></li>' for k in range(n)) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n))

    def menu(self) -> str:
        return self.r.choice([
            lambda: f'<nav data-y="0">{self.link_list()}</nav>',
            lambda: self.element("nav", MENU, self.link_list(), 0),
            lambda: self.element("div", MENU, self.link_list(), 0),
            lambda: f'<div role="navigation" data-y="0">{self.link_list()}</div>',
            lambda: self.element("ul", MENU, "".join(f"<li>{self.words(1, 2)}</li>" for _ in range(4)), 0),
        ])()

    def header(self) -> str:
        inner = self.r.choice([self.words(1, 5), f"<a href='/'>{self.words(1, 3)}</a><p>{self.words(2, 8)}</p>", f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 6)}</div>{self.menu()}"])
        return self.element("header", HEADER if self.r.random() < 0.5 else None, inner, 0) if self.r.random() < 0.7 else self.element("div", HEADER, inner, 0)

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>{self.sentences(1, 2)}</p>{self.link_list()}", self.link_list(), f"Copyright 2024 {self.words(2, 6)}"])
        return self.element("footer", FOOTER if self.r.random() < 0.4 else None, inner, 0) if self.r.random() < 0.7 else self.element("div", FOOTER, inner, 0)

    def side(self) -> str:
        inner = self.r.choice([self.link_list(), f"<h3>{self.words(1, 3)}</h3>{self.link_list()}", f"<p>{self.sentences(1, 4)}</p>", self.words(3, 30), f"<div><h4>{self.words(1, 4)}</h4><p>{self.sentences(1, 2)}</p></div>" * self.r.randint(1, 3)])
        return self.element("aside", SIDE if self.r.random() < 0.5 else None, inner, 0) if self.r.random() < 0.6 else self.element("div", SIDE, inner, 0)

    def advert(self) -> str:
        inner = self.r.choice([self.sentences(1, 3), f"<a href='/ad'>{self.words(2, 9)}</a>", f"<p>{self.sentences(1, 2)}</p>", f"<span>{self.words(1, 2)}</span> {self.sentences(1, 2)}"])
        return self.element(self.r.choice(["div", "div", "aside", "section", "p"]), ADVERT, inner, 0).replace("<div data-y", '<div class="ad" data-y').replace("<section data-y", '<section class="ads" data-y').replace("<p data-y", '<p class="ad" data-y')

    def notice(self) -> str:
        inner = self.r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button>", f"{self.words(3, 15)} <a href='/c'>{self.words(1, 2)}</a>"])
        extra = self.r.choice(["", "", ' role="alert"', ' role="dialog"'])
        return f'<{(t := self.r.choice(["div", "div", "section", "p", "aside"]))} class="{self.r.choice(NOTICE)}{self.r.choice(["", "-bar", "-banner", "-box"])}"{extra} data-y="0">{inner}</{t}>'

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 2)}</label><input name='q'>" for _ in range(self.r.randint(1, 3)))
        body = f"<p>{self.words(2, 9)}</p>{fields}<select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>"
        return f'<form{self.named(FORM) if self.r.random() < 0.5 else ""} data-y="0">{self.r.choice([fields, body, fields + "<textarea>x</textarea>"])}</form>'

    def comments(self) -> str:
        def one() -> str:
            text = self.sentences(1, self.r.choice([1, 3, 8]))
            return self.r.choice([f"<p>{text}</p>", f"<div class='comment'><b>{self.word()}</b><p>{text}</p></div>", f"<li>{text}</li>", f"<article class='comment'><p>{text}</p></article>", f"<article><p>{text}</p></article>", f"<article><h4>{self.word()}</h4><p>{text}</p></article>", f"<div>{text}</div>"])

        inner = self.r.choice(["", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(one() for _ in range(self.r.randint(1, 6)))
        tag = self.r.choice(["div", "section", "section", "ol", "aside"])
        return f'<{tag} {self.r.choice(["class", "id"])}="{self.r.choice(COMMENTS)}{self.r.choice(["", "", "-list", "-section", "-area"])}" data-y="0">{inner}</{tag}>'

    def share(self) -> str:
        return self.element(self.r.choice(["div", "ul", "p"]), SHARE, self.r.choice([self.link_list(), self.words(1, 5)]), 0).replace("<div data-y", '<div class="share" data-y').replace("<p data-y", '<p class="share" data-y')

    def block(self) -> str:
        size = self.r.choice([(1, 1), (1, 3), (2, 6), (4, 10)])
        return self.r.choice([
            lambda: f"<p>{self.inline(self.sentences(*size))}</p>",
            lambda: f"<p>{self.inline(self.sentences(*size))}</p>",
            lambda: f"<p>{self.sentences(*size)}",
            lambda: f"<p><b>{self.sentences(*size)}<br>",
            lambda: f"<p>{self.words(1, 8)}</p>",
            lambda: f"<h{self.r.randint(2, 4)}>{self.words(1, 8)}</h2>",
            lambda: "<ul>" + "".join(f"<li>{self.words(1, 20)}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>",
            lambda: f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>",
            lambda: f"<div>{self.sentences(*size)}</div>",
            lambda: f"<div><p>{self.sentences(*size)}</p><p>{self.sentences(1, 2)}</p></div>",
            lambda: f"<section><h2>{self.words(1, 5)}</h2><p>{self.sentences(*size)}</p></section>",
            lambda: "<table>" + f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" * self.r.randint(1, 3) + "</table>",
            lambda: f"<pre>{self.words(4, 20)}</pre>",
            lambda: f"<figure><img src='x.png'><figcaption>{self.words(2, 9)}</figcaption></figure>",
        ])()

    def inside(self) -> str:
        """What stands in the main content: blocks, and now and then something that is not content."""
        parts = [f"<h1>{self.words(1, 10)}</h1>"] if self.r.random() < 0.8 else []
        parts += [f"<p>{self.words(1, 3)}.</p>"] if self.r.random() < 0.1 else [self.block() for _ in range(self.r.choice([1, 2, 3, 5, 9]))]
        if self.r.random() < 0.35:
            parts.insert(self.r.randint(1, len(parts)), self.r.choice([self.advert, self.share, self.form, self.side, self.notice, self.advert])())
        if self.r.random() < 0.15:
            parts.append(self.comments())
        if self.r.random() < 0.2:  # an article may have a header and a footer of its own
            parts.insert(0, f'<header data-y="0">{self.r.choice([f"<h1>{self.words(1, 8)}</h1>", f"<p>{self.words(1, 6)}</p>", f"<h1>{self.words(1, 6)}</h1><p>{self.words(2, 8)}</p>"])}</header>')
        if self.r.random() < 0.2:
            parts.append(f'<footer data-y="0">{self.r.choice([self.words(1, 8), f"<p>{self.words(2, 9)}</p>", self.link_list()])}</footer>')
        return "".join(parts)

    def content(self) -> str:
        inner = self.inside()
        return self.r.choice([
            lambda: f'<article data-y="1">{inner}</article>',
            lambda: f'<article data-y="1">{inner}</article>',
            lambda: self.element("article", CONTENT, inner, 1),
            lambda: f'<main data-y="1">{inner}</main>',
            lambda: f'<main><article data-y="1">{inner}</article></main>',
            lambda: f'<main data-y="1"><div>{inner}</div></main>',
            lambda: f'<div class="{self.r.choice(CONTENT)}" data-y="1">{inner}</div>',
            lambda: f'<div id="{self.r.choice(CONTENT)}" data-y="1">{inner}</div>',
            lambda: f'<section class="{self.r.choice(CONTENT)}" data-y="1">{inner}</section>',
            lambda: f'<div role="main" data-y="1">{inner}</div>',
        ])()

    def page(self) -> str:
        r = self.r
        before, after = [], []
        for make, chance in ((self.header, 0.5), (self.menu, 0.8), (self.form, 0.25), (self.notice, 0.3), (self.advert, 0.5), (self.side, 0.25)):
            if r.random() < chance:
                before.append(make())
        for make, chance in ((self.comments, 0.35), (self.share, 0.2), (self.side, 0.35), (self.advert, 0.3), (self.form, 0.2), (self.menu, 0.15), (self.notice, 0.2), (self.footer, 0.85)):
            if r.random() < chance:
                after.append(make())
        if r.random() < 0.15:
            before = []
        if r.random() < 0.15:
            after = []
        if r.random() < 0.3:
            r.shuffle(before)
        main = "" if r.random() < 0.03 else self.content()
        plain = r.random()
        if plain < 0.04:  # content that stands in the body itself
            main = self.inside()
            body = f'<body data-y="1">{"".join(before)}{main}{"".join(after)}</body>'
        elif plain < 0.3:
            body = f'<body>{"".join(before[:1])}<div{self.named(["page", "wrapper", "container", "layout", "site"])}>{"".join(before[1:])}{main}{"".join(after[:-1])}</div>{"".join(after[-1:])}</body>'
        elif plain < 0.4:
            body = f'<body>{"".join(before)}<div class="row"><div class="col">{main}</div>{"".join(after[:1])}</div>{"".join(after[1:])}</body>'
        else:
            body = f'<body>{"".join(before)}{main}{"".join(after)}</body>'
        head = f"<head><title>{self.words(1, 9)}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}{body}" + r.choice(["</html>", ""])


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    writer = _Writer(random.Random(seed))
    return [writer.page() for _ in range(n)]
