"""Labelled pages to train the page model on: layouts and wordings that sites use, with their main texts.

Written by a rule from lists of usual element names; the words themselves say nothing.
"""

from __future__ import annotations

import random

import pandas as pd

SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti ul va xe zo th en st".split()
MAIN = ["<article>", "<article>", "<article>", "<article>", '<article class="post">', "<main>", '<div class="post-content">', '<div id="content">', '<div class="entry-content">',
        '<section class="story">', '<div class="article-body">', '<div itemprop="articleBody" class="text">', '<div class="main">', "<div>",
        '<div class="css-1ab">', '<div class="blog-post">', '<main id="main"><article>', '<div id="page"><div class="column">']
NAV = ["<nav>", '<nav class="menu">', '<div class="navbar">', '<ul class="menu">', '<div id="navigation">', '<div class="breadcrumbs">']
HEADER = ["<header>", '<div id="header">', '<div class="masthead">', '<header class="site-header">']
FOOTER = ["<footer>", '<div id="footer">', '<div class="footer-wrap">', '<footer class="site-footer">']
SIDE = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<aside class="related">', '<div class="related-posts">',
        '<div class="popular">', '<section class="recommended">']
ADVERT = ['<div class="ad">', '<div class="advert">', '<div class="ads-banner">', '<ins class="adsbygoogle">', '<div class="sponsored">',
          '<div class="promo">', '<div id="banner">', '<div class="advertisement">', '<aside class="ad">']
NOTICE = ['<div class="cookie-notice">', '<div id="consent">', '<div class="gdpr-banner" role="dialog">', '<div class="alert notice">',
          '<div class="popup">', '<dialog>', '<section class="cookie">', '<div class="newsletter-signup">', '<div class="notice">']
COMMENTS = ['<section id="comments">', '<div class="comments">', '<ol class="commentlist">', '<div id="disqus_thread">', '<div class="comment-list">',
            '<section class="responses">', '<div class="reader-comments">']
FORM = ["<form>", '<form class="search-form">', '<div class="login-form"><form>', '<form id="subscribe">', '<form class="contact">']
SHARE = ['<div class="share">', '<ul class="social-links">', '<div class="tools">']


def _close(opening: str) -> str:
    names = [part.split(">")[0].split()[0] for part in opening.split("<")[1:]]
    return "".join(f"</{n}>" for n in reversed(names))


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        ends = self.r.choices([". ", ", ", "! ", "? "], [6, 3, 0.5, 0.5], k=self.r.randint(low, high))
        return "".join(self.words(3, 14).capitalize() + e for e in ends).strip(" ,") + self.r.choice([".", ".", ".", ""])

    def links(self, n: int, listed: bool) -> str:
        one = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>" if listed else " ".join(one)

    def wrapped(self, kinds: list[str], inner: str) -> str:
        opening = self.r.choice(kinds)
        return opening + inner + _close(opening)

    def block(self, tag: str, text: str) -> str:
        """A content block; now and then with inline markup, or without its end tag."""
        self.main.append(text)
        words = text.split(" ")
        if len(words) > 6 and self.r.random() < 0.3:
            i = self.r.randrange(len(words) - 3)
            mark = self.r.choice(["b", "em", 'a href="/x"', "span", "strong"])
            words[i] = f"<{mark}>{words[i]}"
            words[i + 1] += f"</{mark.split()[0]}>"
        end = "" if tag == "p" and self.r.random() < 0.15 else f"</{tag}>"
        return f"<{tag}>{' '.join(words)}{end}"

    def loose(self, tag: str = "p") -> str:
        return f"<{tag}>{self.sentences(1, 3)}</{tag}>"

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.wrapped(NAV, self.links(r.randint(2, 9), r.random() < 0.7))
        if kind == "header":
            return self.wrapped(HEADER, r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 8)}</p>", self.words(1, 4)]) + self.links(r.randint(0, 5), r.random() < 0.5))
        if kind == "footer":
            return self.wrapped(FOOTER, r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", self.loose(), self.links(4, True)]))
        if kind == "side":
            return self.wrapped(SIDE, f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + r.choice([self.links(r.randint(2, 8), True), self.loose(), self.loose() + self.loose()]))
        if kind == "advert":
            return self.wrapped(ADVERT, r.choice([self.sentences(1, 3), self.loose(), f'<a href="/b">{self.words(2, 8)}</a>']))
        if kind == "notice":
            return self.wrapped(NOTICE, r.choice([self.loose(), self.sentences(1, 3), self.loose() + f"<button>{self.words(1, 2)}</button>"]))
        if kind == "comments":
            one = lambda: r.choice([f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.sentences(1, 6)}</p></div>', f"<li><p>{self.sentences(1, 6)}</p></li>", f"<p>{self.sentences(1, 8)}</p>"])
            return self.wrapped(COMMENTS, f"<h3>{self.words(1, 2)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6))))
        if kind == "form":
            return self.wrapped(FORM, f"<p>{self.words(2, 8)}</p>" * r.randint(0, 1) + f"<label>{self.words(1, 2)}</label><input><button>{self.words(1, 2)}</button>")
        return self.wrapped(SHARE, self.links(r.randint(2, 5), r.random() < 0.5))

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            head = self.block("h1" if r.random() < 0.8 else "h2", self.words(3, 10))
            out.append(f"<header>{head}</header>" if r.random() < 0.1 else head)
        poor = r.random() < 0.25
        for _ in range(r.choice([1, 1, 2, 3]) if poor else r.choice([1, 1, 2, 3, 4, 5, 6, 8, 10, 14])):
            x = r.random()
            if poor:  # hardly a sentence, or a long run of words without any
                out.append(self.block("p", r.choice([self.words(1, 3), self.words(1, 8), self.sentences(1, 1), self.words(40, 120), self.words(10, 60).replace(" ", ", ")])))
            elif x < 0.74:
                out.append(self.block("p", self.sentences(*r.choice([(1, 1), (1, 3), (2, 6), (4, 14)]))))
            elif x < 0.79:
                out.append(self.block(r.choice(["h2", "h3"]), self.words(1, 7)))
            elif x < 0.84:
                out.append("<ul>" + "".join(self.block("li", self.sentences(1, 2)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.87:
                out.append("<blockquote>" + self.block("p", self.sentences(1, 3)) + "</blockquote>")
            elif x < 0.89:
                out.append("<table>" + "".join(f"<tr>{self.block('td', self.words(1, 4))}{self.block('td', self.words(1, 4))}</tr>" for _ in range(3)) + "</table>")
            elif x < 0.91:
                out.append("<figure><img>" + self.block("figcaption", self.sentences(1, 1)) + "</figure>")
            else:
                out.append(self.boilerplate(r.choice(["advert", "advert", "share", "side", "notice", "form"])))
        if r.random() < 0.2:
            out.append(self.boilerplate(r.choice(["comments", "share"])))
        return self.wrapped(MAIN, "".join(out))

    def page(self) -> tuple[str, str]:
        r = self.r
        before = [self.boilerplate(k) for k in ("notice", "header", "nav", "advert", "form") if r.random() < 0.5]
        r.shuffle(before)
        article = self.article()
        after = [self.boilerplate(k) for k in ("comments", "side", "side", "share", "form", "advert", "notice", "footer") if r.random() < 0.45]
        if r.random() < 0.2:
            before, after = before + after[:1], after[1:]
        inner = "".join(before) + article + "".join(after)
        if r.random() < 0.3:
            inner = self.r.choice(['<div id="wrapper">', '<div class="page">', "<div>"]) + inner + "</div>"
        return f"<html><head><title>{self.words(2, 5)}</title></head><body>{inner}</body></html>", "\n".join(self.main)


def labelled_pages(n: int = 400, seed: int = 11) -> pd.DataFrame:
    """`html, main` of n pages."""
    return pd.DataFrame([_Writer(seed * 100_003 + i).page() for i in range(n)], columns=["html", "main"])
