"""Labelled pages to fit the page model on: ``data-gold`` says whether an element belongs to the main text (children inherit it)."""

from __future__ import annotations

import random

LETTERS = "aeiourstnlmdcp"
BEFORE = [
    '<nav><ul>{items}</ul></nav>', '<header><div class="logo">{w}</div><p>{s}</p></header>', '<div id="top-menu"><a href="/">{w}</a> <a href="/b">{w}</a></div>', '<div class="cookie-notice"><p>{s}</p><button>{w}</button></div>',
    '<div class="ad">{s}</div>', '<div class="breadcrumbs"><a href="/">{w}</a> / <a href="/x">{w}</a></div>', '<form class="search"><label>{w}</label><input></form>', '<div role="banner"><h2>{w}</h2></div>', '<div class="alert"><p>{s}</p></div>',
    '<ul class="navbar">{items}</ul>', '<div class="masthead"><h1>{w}</h1><p>{s}</p></div>',
]
AFTER = [
    '<footer>&copy; {w} &middot; {s}</footer>', '<aside><h3>{w}</h3><p>{s}</p><ul>{items}</ul></aside>', '<div class="sidebar"><h3>{w}</h3><p>{s} {s}</p></div>', '<section class="comments"><h3>{w}</h3><div class="comment"><p>{s}</p></div><p>{s}</p></section>',
    '<div class="related"><h4>{w}</h4><ul>{items}</ul></div>', '<div id="footer"><p>{s}</p><p>{w}</p></div>', '<form id="subscribe"><p>{s}</p><input></form>', '<div class="share"><a href="/s">{w}</a></div>', '<div class="newsletter"><p>{s}</p></div>',
    '<div id="comments"><ol><li><p>{s}</p><p>{s}</p></li><li>{s}</li></ol></div>', '<div class="widget"><p>{s}</p></div>', '<div class="sponsored"><p>{s} {s}</p></div>',
]
INSIDE = ['<p>{s}</p>'] * 8 + ['<p>{s} {s} <a href="/l">{w}</a> {s}</p>'] * 3 + ['<h2>{w} {w}</h2>', '<ul><li>{s}</li><li>{w}</li></ul>', '<blockquote><p>{s}</p></blockquote>', '<pre>{w} {w}</pre>', '<table><tr><td>{w}</td><td>{s}</td></tr></table>',
                                  '<p>{w}.</p>', '<figure><figcaption>{s}</figcaption></figure>', '<p><b>{s}<br>', '<div><p>{s}</p></div>', '<section><h3>{w}</h3><p>{s}</p></section>', '<p><a href="/r">{w} {w}</a></p>']
INTRUDERS = ['<div class="ad" data-gold="0">{s}</div>', '<div class="share-tools" data-gold="0"><a href="/f">{w}</a></div>', '<aside data-gold="0"><p>{s}</p></aside>', '<div class="promo" data-gold="0"><p>{s}</p></div>', '<nav data-gold="0"><ul>{items}</ul></nav>',
             '<form data-gold="0"><p>{s}</p></form>', '<section class="comments" data-gold="0"><h3>{w}</h3><p>{s}</p><p>{s} {s}</p></section>', '<div class="related" data-gold="0"><p><a href="/z">{w}</a></p></div>', '<footer data-gold="0"><p>{s}</p></footer>', '<div class="newsletter" data-gold="0"><p>{s}</p></div>']
MAIN = ['<article data-gold="1">', '<article class="post" data-gold="1">', '<main data-gold="1">', '<div class="content" data-gold="1">', '<div id="main-content" data-gold="1">', '<section class="entry" data-gold="1">', '<div class="article-body" data-gold="1">', '<div role="main" data-gold="1">',
        '<main data-gold="1"><article>', '<div class="story-text" data-gold="1">', '<div class="post-body" data-gold="1">']


def examples(n: int = 80, seed: int = 13) -> list[str]:
    """``n`` pages of invented words, the same for the same seed."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choices(LETTERS, k=rng.randrange(2, 9)))

    def sentence() -> str:
        return " ".join(word() for _ in range(rng.randrange(3, 25))).capitalize() + rng.choice([".", "!", "?", "."])

    def fill(template: str) -> str:
        while "{" in template:
            template = template.replace("{w}", word(), 1).replace("{s}", sentence(), 1)
            template = template.replace("{items}", "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randrange(2, 7))), 1)
        return template

    out = []
    for _ in range(n):
        main = rng.choice(MAIN)
        body = rng.choices(INSIDE, k=rng.randrange(1, 9))
        for _ in range(rng.choice([0, 0, 1, 2])):
            body.insert(rng.randrange(len(body) + 1), rng.choice(INTRUDERS))
        opened = main.count("<")
        close = "".join(f"</{tag.split()[0].strip('<>')}>" for tag in reversed(main.replace(">", "> ").split("<")[1:])) if opened else ""
        head = rng.choice(["<h1>{w} {w} {w}</h1>", "<header><h1>{w} {w}</h1></header>", "<h1>{s}</h1>", ""])
        parts = rng.sample(BEFORE, rng.randrange(0, 4)) + [main + head + "".join(body) + close] + rng.sample(AFTER, rng.randrange(0, 4))
        page = "".join(map(fill, parts))
        if rng.random() < 0.4:
            page = f'<div class="{rng.choice(["wrapper", "container", "page", "site"])}">{page}</div>'
        out.append(f"<html><head><title>{word()}</title></head><body>{page}</body></html>")
    return out
