"""Labelled web pages for training the extraction model: invented text in varied page layouts, main blocks marked."""

from __future__ import annotations

import random

#: The attribute that marks the blocks of the main text in a labelled page.
MARK = "data-main"
# Names that page authors commonly give to regions, by what they hold.
ASIDE = [
    ("nav", ""), ("ul", "menu"), ("div", "nav"), ("div", "menu"), ("div", "navbar"), ("div", "breadcrumb"), ("header", ""), ("div", "header"), ("div", "topbar"), ("footer", ""),
    ("div", "footer"), ("div", "copyright"), ("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "banner"),
    ("div", "sponsored"), ("div", "promo"), ("div", "cookie"), ("div", "notice"), ("div", "alert"), ("div", "popup"), ("form", ""), ("form", "search"), ("div", "newsletter"),
    ("div", "subscribe"), ("div", "share"), ("div", "social"), ("div", "pagination"), ("div", "login"), ("section", "comments"), ("div", "comments"), ("ol", "comments"), ("div", "comment"), ("div", "replies"), ("div", "tags"),
    ("aside", "notice"), ("section", "related"), ("dialog", ""),
]
MAIN = [
    ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "main"), ("div", "post"), ("div", "entry"), ("div", "article"), ("div", "story"), ("div", "text"), ("section", ""), ("section", "content"),
    ("div", ""), ("td", ""),
]
# Words that short pieces around an article are often about.
HINTS = frozenset("cookie cookies consent privacy accept subscribe newsletter login register copyright rights reserved sponsored advertisement share comments reply".split())
INSIDE = [x for x in ASIDE if x[0] not in ("nav", "header", "footer") and x[1] not in ("header", "topbar", "footer", "menu", "navbar")]


def _word(r: random.Random) -> str:
    return "".join(r.choice(["an", "er", "st", "le", "ou", "ti", "re", "on", "de", "ch", "ein", "que", "ada", "é", "ü"]) for _ in range(r.randint(1, 4)))


def _text(r: random.Random, words: int, noise: str) -> str:
    out = [_word(r) for _ in range(max(1, words))]
    if noise == "loud":
        return " ".join(w.upper() + "!!" for w in out)
    if noise == "signs":
        return " ".join(w + r.choice(["***", "&amp;&amp;", "%%%", "###"]) for w in out)
    text = " ".join(out).capitalize()
    return text + (r.choice([".", ".", "?", "!"]) if r.random() < 0.8 else "")


def _linked(r: random.Random, words: int) -> str:
    return f'<a href="/{_word(r)}">{_text(r, words, "")}</a>'


def _boilerplate(r: random.Random, tag: str, name: str) -> str:
    """A region that is not main text: links, short or long sentences, fields, remarks of readers."""
    attribute = f' {r.choice(["class", "id"])}="{r.choice(["", "site-", "page_", "top-"])}{name}{r.choice(["", "-box", "_wrap"])}"' if name else ""
    if name and r.random() < 0.15:  # a name that nothing is known by: only what the region holds tells
        tag, attribute = "div", f' class="{_word(r)}"'
    hint = f" {r.choice(sorted(HINTS))}" if r.random() < 0.3 else ""
    kind = r.random()
    words = r.choice([1, 3, 6, 12, 25, 50])
    if tag in ("nav", "ul", "ol") or kind < 0.3:
        body = "".join(f"<li>{_linked(r, r.randint(1, 3)) if r.random() < 0.8 else _text(r, r.randint(1, 20), '')}</li>" for _ in range(r.randint(2, 8)))
        body = body if tag in ("ul", "ol") else f"<ul>{body}</ul>"
    elif kind < 0.55:
        body = "&copy; " * (r.random() < 0.3) + _text(r, words, r.choice(["", "", "loud"])) + hint
    elif kind < 0.85 and name in ("comments", "comment", "replies", "related") and r.random() < 0.5:
        remark = lambda: f"<p>{_text(r, r.choice([2, 8, 25]), '')}</p>"
        body = "".join(r.choice(["<article>{}</article>", '<div class="comment-body">{}</div>', '<div class="content">{}</div>', "<li>{}</li>"]).format(remark()) for _ in range(r.randint(1, 4)))
    elif kind < 0.85 and "header" in (tag, name) or name in ("banner", "topbar"):
        body = f"<h1>{_text(r, r.randint(1, 4), '')}</h1>" + f"<p>{_text(r, words, '')}</p>" * (r.random() < 0.5)
    elif kind < 0.85:
        body = "".join(f"<{t}>{_text(r, r.choice([2, 5, 12, 30]), '')}</{t}>" for t in (r.choice(["p", "p", "div", "h3", "h2"]) for _ in range(r.randint(1, 4))))
    else:
        body = f"<label>{_text(r, 2, '')}</label><p>{_text(r, words, '')}{hint} {_linked(r, 2)}</p>"
    return f"<{tag}{attribute}>{body}</{tag}>"


def _article(r: random.Random, tag: str, name: str) -> str:
    noise = r.choice(["", "", "", "loud", "signs"])
    size = r.choice([1, 4, 15, 60])
    blocks = []
    if r.random() < 0.8:
        blocks.append(f'<{r.choice(["h1", "h1", "h2"])} {MARK}="1">{_text(r, r.randint(1, 8), noise)}</h1>'.replace("</h1>", ""))
    for _ in range(r.choice([1, 2, 4, 8])):
        t = r.choice(["p", "p", "p", "p", "p", "p", "div", "blockquote", "h2", "li", "pre", "td"])
        words = r.randint(1, 2 * size)
        text = _text(r, words, noise) + (f" {_linked(r, 2)} {_text(r, words, noise)}" if r.random() < 0.2 else "")
        text = f"<b>{text}" + ("</b>" if r.random() < 0.7 else "<br>") if r.random() < 0.2 else text
        one = f'<{t} {MARK}="1">{text}' + (f"</{t}>" if r.random() < 0.85 or t == "td" else "")
        blocks.append({"li": f"<ul>{one}</ul>", "td": f"<table><tr>{one}</tr></table>"}.get(t, one))
        if r.random() < 0.12:
            blocks.append(_boilerplate(r, *r.choice(INSIDE)))
    attribute = f' class="{r.choice(["", "page-", "single_"])}{name}{r.choice(["", "-body", "_inner"])}"' if name else ""
    opened, closed = (f"<table><tr><td{attribute}>", "</td></tr></table>") if tag == "td" else (f"<{tag}{attribute}>", f"</{tag}>")
    return opened + "".join(blocks) + closed


def labelled_pages(n: int, seed: int) -> list[str]:
    """``n`` pages whose main blocks carry the attribute ``MARK``; the same for the same seed."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        before = [_boilerplate(r, *r.choice(ASIDE)) for _ in range(r.randint(0, 4))]
        after = [_boilerplate(r, *r.choice(ASIDE)) for _ in range(r.randint(0, 4))]
        body = "".join([*before, _article(r, *r.choice(MAIN)), *after])
        body = f'<div id="{r.choice(["page", "wrapper", "root"])}">{body}</div>' if r.random() < 0.4 else body
        pages.append(f"<html><head><title>{_text(r, 5, '')}</title></head><body>{body}</body></html>")
    return pages
