"""Labelled pages to train the extractor on, made by rule.

Block elements carry the attribute MARK: 1 if their own text is article text, 0 if not; elements without it have their
parent's. Only training reads that attribute. Layouts, class names and words vary by a seeded generator; nothing is taken from any site or table.
"""

from __future__ import annotations

import random

MARK = "data-y"
#: Class or id names by what they mark. Pages draw from them, or use invented names.
NAMES = {
    "content": ["content", "post", "entry", "article-body", "story", "main", "post-content", "text", "article", "body-copy", "page-content"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "banner-ad", "promo", "promoted", "ad-slot", "adsbygoogle"],
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumbs", "breadcrumb", "topnav", "main-menu", "pagination", "pager", "tabs"],
    "side": ["sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "right-column", "tags", "read-more"],
    "head": ["header", "site-header", "masthead", "top", "topbar", "branding", "logo", "site-title"],
    "foot": ["footer", "site-footer", "copyright", "bottom", "legal", "colophon", "credits", "disclaimer"],
    "notice": ["cookie", "cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "privacy-notice", "alert", "banner", "popup", "modal", "paywall"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "contact-form", "subscription"],
    "comment": ["comments", "comment", "comment-list", "replies", "discussion", "disqus_thread", "respond", "disqus", "comment-body", "reader-comments", "responses", "user-comment"],
    "share": ["share", "social", "sharing", "share-buttons", "follow", "social-links"],
}
_SYLLABLES = "an be con da el fi go hu is ja ko le mi no ou pre qua re sta ti un ve wa xo ya zi ä é ó ñ ung tion ly er".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        n = min(int(self.r.lognormvariate(0, 0.9) * (low + high) / 2) + low, high * 3)
        out = [self.word() for _ in range(n)]
        for i in range(0, n, self.r.randint(6, 14)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += self.r.choice((".", ".", "!", "?", ","))
        return " ".join(out) + self.r.choice((".", ".", ".", "", "!"))

    def attrs(self, kind: str | None, y: int | None = None) -> str:
        out = "" if y is None else f' data-y="{y}"'
        name = self.r.choice(NAMES[kind]) if kind and self.r.random() < 0.85 else self.word() if self.r.random() < 0.5 else None
        if name:
            out += f' {self.r.choice(("class", "class", "id"))}="{name}{self.r.choice(("", "", " " + self.word()))}"'
        return out

    def links(self, n: int) -> str:
        wrap = self.r.random()
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(n)]
        if wrap < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(items) if wrap < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.choice((0, 0, 0, 1, 2))):
            i = self.r.randrange(len(words))
            tag = self.r.choice(("b", "i", "em", "strong", "a", "span", "code"))
            words[i] = f'<{tag}{" href=" + chr(34) + "/x" + chr(34) if tag == "a" else ""}>{words[i]}</{tag}>'
        return self.r.choice((" ", " ", "\n")).join(words)

    def paragraph(self) -> str:
        text = self.inline(self.words(1, 60))
        return self.r.choice((f"<p>{text}</p>",) * 9 + (f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<p>{text}<br>{self.words(3, 20)}</p>"))

    def article(self) -> str:
        out = [f"<h1>{self.words(2, 12)}</h1>"] if self.r.random() < 0.85 else []
        if out and self.r.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        if self.r.random() < 0.08:  # many short lines, some of them repeated
            line = self.words(1, 4)
            return "".join([*out, *(f"<p>{line if self.r.random() < 0.5 else self.words(1, self.r.choice((3, 12)))}</p>" for _ in range(self.r.randint(5, 80)))])
        for _ in range(max(1, int(self.r.lognormvariate(1.6, 0.8)))):
            x = self.r.random()
            if x < 0.70:
                out.append(self.paragraph())
            elif x < 0.75:
                out.append(f"<h{(k := self.r.choice((2, 3, 4)))}>{self.words(1, 8)}</h{k}>")
            elif x < 0.79:
                out.append("<ul>" + "".join(f"<li>{self.inline(self.words(2, 15))}</li>" for _ in range(self.r.randint(1, 6))) + "</ul>")
            elif x < 0.82:
                out.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif x < 0.84:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            elif x < 0.845:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
            else:
                out.append(self.r.choice((self.ad, self.share, self.related, self.notice, self.form, self.named_block, self.named_block, self.named_block))())
        return "".join(out)

    def bare(self) -> str:
        """Article text without blocks of its own: lines between breaks, and now and then a heading, a paragraph, preformatted text or something that is not article."""
        out = [f"<h1>{self.words(2, 10)}</h1>"] if self.r.random() < 0.5 else []
        for _ in range(max(1, int(self.r.lognormvariate(1.1, 0.7)))):
            x = self.r.random()
            out.append(self.inline(self.words(4, 60)) + self.r.choice(("<br>", "<br><br>", "<br/>\n<br/>", "<br>\n")) if x < 0.75 else self.paragraph() if x < 0.85 else f"<pre>{self.words(3, 40)}</pre>" if x < 0.9 else self.r.choice((self.share, self.ad, self.related))())
        return "".join(out)

    def table(self, content: str) -> str:
        """A layout table, mostly without names: cells of links beside the cell of the article."""
        plain = lambda inner: f'<td data-y="0"{self.attrs("nav") if self.r.random() < 0.3 else ""}>{inner}</td>'
        menu = lambda: plain(self.r.choice((self.links(self.r.randint(2, 9)), f"<p>{self.words(1, 3)}</p>" + self.links(self.r.randint(2, 6)), self.links(self.r.randint(2, 5)) + self.words(1, 6))))
        cells = [menu() if self.r.random() < 0.8 else "", f'<td data-y="1">{content}</td>', menu() if self.r.random() < 0.3 else ""]
        top = f"<tr>{plain(self.words(1, 6))}</tr>" if self.r.random() < 0.3 else ""
        foot = f"<tr>{plain(self.r.choice(('&copy; ', '')) + self.words(2, 8))}</tr>" if self.r.random() < 0.3 else ""
        return f'<table data-y="0"{self.r.choice(("", " width=100%", " border=0"))}>{top}<tr>{"".join(cells)}</tr>{foot}</table>'

    def ad(self) -> str:
        tag = self.r.choice(("div", "div", "aside", "section", "p", "p"))
        inner = self.inline(self.words(2, 25)) if tag == "p" or self.r.random() < 0.6 else self.paragraph()
        return f"<{tag}{' data-y=' + chr(34) + '0' + chr(34)} class=\"{self.r.choice(NAMES['ad'])}\">{inner}</{tag}>"

    def share(self) -> str:
        return f"<div{self.attrs('share', 0)}>{self.links(self.r.randint(2, 5))}</div>"

    def related(self) -> str:
        tag = self.r.choice(("aside", "div", "section"))
        return f"<{tag}{self.attrs('side', 0)}><h3>{self.words(1, 3)}</h3>{self.links(self.r.randint(2, 8))}</{tag}>"

    def sidebar(self) -> str:
        tag = self.r.choice(("aside", "aside", "div"))
        kind = "side" if tag == "aside" else None
        named = self.attrs(kind, 0) if kind else f" data-y=\"0\" class=\"{self.r.choice(NAMES['side'])}\""
        parts = [f"<h3>{self.words(1, 4)}</h3>", self.links(self.r.randint(2, 8)), f"<p>{self.inline(self.words(3, 30))}</p>", f"<div>{self.words(2, 20)}</div>"]
        return f"<{tag}{named}>{''.join(p for p in parts if self.r.random() < 0.6) or parts[2]}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(("div", "div", "section", "dialog", "p", "p"))
        body = self.words(4, 30) if tag == "p" or self.r.random() < 0.4 else f"<p>{self.words(4, 30)}</p><button>{self.word()}</button>"
        return f"<{tag} data-y=\"0\" {self.r.choice(('class', 'id'))}=\"{self.r.choice(NAMES['notice'])}\">{body}</{tag}>"

    def form(self) -> str:
        inner = f"<p>{self.words(2, 20)}</p>" * self.r.randint(0, 1) + f"<label>{self.words(1, 4)}</label><input><div>{self.words(1, 12)}</div>"
        return f"<form{self.attrs('form', 0)}>{inner}<button>{self.word()}</button></form>"

    def named_block(self) -> str:
        """Prose under a boilerplate name of any kind."""
        kind = self.r.choice([k for k in NAMES if k != "content"])
        tag = self.r.choice(("div", "div", "section", "aside", "p", "span"))
        tag = "div" if tag == "span" else tag
        body = self.inline(self.words(3, 40)) if tag == "p" or self.r.random() < 0.4 else "".join(self.paragraph() for _ in range(self.r.choice((1, 1, 2))))
        return f"<{tag} data-y=\"0\" {self.r.choice(('class', 'id'))}=\"{self.r.choice(NAMES[kind])}\">{body}</{tag}>"

    def comments(self) -> str:
        tag = self.r.choice(("section", "div", "ol", "div"))
        item = "li" if tag == "ol" else self.r.choice(("div", "article", "div"))
        one = lambda: f"<{item}{self.attrs('comment')}><div>{self.words(1, 3)}</div>{self.paragraph()}{self.paragraph() if self.r.random() < 0.3 else ''}</{item}>"
        head = f"<h{(k := self.r.choice((2, 3)))}>{self.words(1, 3)}</h{k}>" if tag != "ol" else ""
        return f"<{tag} data-y=\"0\" {self.r.choice(('class', 'id'))}=\"{self.r.choice(NAMES['comment'])}\">{head}{''.join(one() for _ in range(self.r.randint(1, 6)))}</{tag}>"

    def page(self) -> str:
        r = self.r
        maybe = lambda p, f: f() if r.random() < p else ""
        nav = lambda: (lambda t: f"<{t}{self.attrs('nav', 0) if t == 'nav' else f' data-y={chr(34)}0{chr(34)} class={chr(34)}' + r.choice(NAMES['nav']) + chr(34)}>{self.links(r.randint(2, 9))}</{t}>")(r.choice(("nav", "nav", "div", "menu")))
        header = lambda: (lambda t: f"<{t} data-y=\"0\"{'' if t == 'header' else f' class={chr(34)}' + r.choice(NAMES['head']) + chr(34)}>{maybe(0.6, lambda: f'<h1>{self.words(1, 4)}</h1>')}<p>{self.words(1, 12)}</p>{maybe(0.5, nav)}</{t}>")(r.choice(("header", "header", "div")))
        footer = lambda: (lambda t: f"<{t} data-y=\"0\"{'' if t == 'footer' else f' class={chr(34)}' + r.choice(NAMES['foot']) + chr(34)}>{r.choice(('&copy; ', '', '<p>'))}{self.words(2, 25)}{maybe(0.4, lambda: self.links(4))}")(r.choice(("footer", "footer", "footer", "div")))
        frame = r.choice(("article", "article", "article", "main", "div", "section", "main article", "div div", "", "body", "body", "table"))
        tags = frame.split()
        opened = "".join(f"<{t}{self.attrs('content', 1) if t in ('div', 'section') or r.random() < 0.2 else ' data-y=' + chr(34) + '1' + chr(34)}>" for t in tags)
        body = self.bare() if r.random() < (0.35 if frame in ("body", "div", "", "table") else 0.05) else self.article()
        if frame == "body" and r.random() < 0.35:  # the article is all there is
            return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body data-y=\"1\">{body}</body></html>"
        late = maybe(0.25, self.comments)
        if frame in ("body", "table"):
            tags, opened, body = [], "", self.table(body) if frame == "table" else body
        if not tags and not frame:
            opened, tags = "<div data-y=\"1\">", ["div"]
        inside = r.random() < 0.3
        content = opened + body + (late if inside else "") + "".join(f"</{t}>" for t in reversed(tags))
        parts = [maybe(0.5, header), maybe(0.7, nav), maybe(0.5, self.ad), maybe(0.2, self.notice), maybe(0.2, self.sidebar), content, "" if inside else late, maybe(0.3, self.related), maybe(0.3, self.sidebar), maybe(0.2, self.form), maybe(0.2, self.ad), maybe(0.15, self.notice), maybe(0.25, self.named_block)]
        if r.random() < 0.2 and frame != "body":
            parts = ["<div data-y=\"0\"" + r.choice((" id=\"wrapper\"", " class=\"container\"", "")) + ">", *parts, "</div>"]
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body data-y=\"{int(frame == 'body')}\">{''.join(parts)}{maybe(0.8, footer)}</body></html>"


def labelled_pages(n: int = 1400, seed: int = 11) -> list[str]:
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]
