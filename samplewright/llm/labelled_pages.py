"""Labelled pages for the extraction model, put together from labelled parts by rule.

``data-label`` marks an element and all that is inside: "content" or "other". Unmarked parts are "other".
"""

from __future__ import annotations

# A few lines of prose, and the parts of pages.
PROSE = (
    "The river rose twice that spring, and the lower fields stayed under water until the middle of May.",
    "Most visitors come for the castle, but the market behind it is older and far more lively.",
    "Nobody had opened the archive since the fire; the first box held letters, maps and a broken seal.",
    "A small pump is enough, provided that the filter is cleaned every week and the hose is kept straight.",
    "She learned the trade from her uncle. Ten years later she owned three workshops.",
    "Rain is expected in the north. Temperatures stay mild.",
    "Why did the plan fail? Because no one had asked the people who were to carry it out.",
    "It works.",
)
NAMES_OF_CONTENT = ("content", "post body", "entry content", "article body", "story", "main text", "post", "page content", "entry", "article")
OTHER = (
    '<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul></nav>',
    '<div class="nav navbar menu"><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></div>',
    '<header class="site header"><h1><a href="/">The Daily Harbour</a></h1><p>Stories from the coast since 1921.</p></header>',
    '<div id="header" class="masthead"><p>The Daily Harbour</p></div>',
    '<div class="breadcrumb breadcrumbs"><a href="/">Home</a> &gt; <a href="/x">Travel</a></div>',
    '<div class="ad">Buy two lamps and get the third one free. Offer ends on Sunday.</div>',
    '<div class="ads banner"><p>Cheap flights to the south. Book today and save a lot.</p></div>',
    '<div class="advert advertisement sponsor sponsored"><p>Advertisement. A bank you can trust with your savings.</p></div>',
    '<div class="promo teaser"><h3>Try our new paper</h3><p>The first month costs you nothing.</p></div>',
    '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten walks</a></li><li><a href="/2">The old mill</a></li></ul></aside>',
    '<div class="sidebar widget"><h3>About the author</h3><p>Writes about rivers and lives near one.</p></div>',
    '<aside class="related recommended"><h2>Read more</h2><p><a href="/3">How the bridge was built</a></p></aside>',
    '<div class="cookie notice consent"><p>We use cookies to make this site work. By going on you agree to that.</p></div>',
    '<div class="notice alert warning popup modal overlay"><p>This page is best seen with a recent browser.</p></div>',
    '<div role="alert" class="message"><p>Our offices are closed on Monday.</p></div>',
    '<form class="search" action="/q"><p>Search this site</p><input name="q"></form>',
    '<form class="newsletter signup subscribe"><label>Your address</label><p>Get the news by mail every morning.</p></form>',
    '<div class="newsletter subscribe"><p>Join forty thousand readers of our letter.</p></div>',
    '<div class="social share sharing"><a href="#">Share</a> <a href="#">Print</a></div>',
    '<section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>I was there and saw it. A fine piece!</p></div><div class="comment reply"><p>Thank you for this story, it made my day.</p></div></section>',
    '<div class="comments discussion responses"><div class="comment"><p>My father worked at that mill for years.</p></div></div>',
    '<section class="comments responses"><article class="comment"><header class="author"><b>Ann</b></header><p>A good read, thank you.</p></article><article class="comment"><p>I can only agree with that.</p></article></section>',
    '<ul class="comments commentlist"><li class="comment"><p>You forgot the second bridge, the one by the church.</p></li></ul>',
    '<footer>&copy; 2019 The Daily Harbour &middot; All about the coast and its people.</footer>',
    '<footer class="site footer"><p>Imprint and privacy. No part may be copied without leave.</p><ul><li><a href="/p">Privacy</a></li></ul></footer>',
    '<div id="footer" class="copyright legal"><p>All texts belong to their authors.</p></div>',
    '<div class="tags meta byline"><a href="/t">travel</a>, <a href="/u">rivers</a></div>',
    '<div class="pagination pager"><a href="?p=2">Next</a></div>',
)


def _prose(n: int) -> str:
    return PROSE[n % len(PROSE)]


def _body(n: int) -> str:
    """Paragraphs, with other kinds of blocks in turn."""
    first = f"<h1>{_prose(n + 5)[:40]}</h1>" if n % 3 else f"<h1>{_prose(n + 2)}</h1><h2>{_prose(n + 3)[:30]}</h2>"
    blocks = [f"<p>{_prose(n + i)} {_prose(n * 3 + i + 1)}</p>" for i in range(2 + n % 4)]
    others = (
        f"<ul><li>{_prose(n + 1)}</li><li>{_prose(n + 4)[:25]}</li></ul>",
        f"<blockquote><p>{_prose(n + 6)}</p></blockquote>",
        f"<h2>{_prose(n + 2)[:28]}</h2><p>{_prose(n + 7)}</p>",
        f"<pre>{_prose(n)}</pre><ol><li>{_prose(n)}</li><li>{_prose(n + 4)}</li><li>{_prose(n + 1)[:15]}</li></ol>",
        f"<figure><figcaption>{_prose(n + 3)}</figcaption></figure><ul><li>{_prose(n + 5)[:20]}<li>{_prose(n + 6)}</ul>",
        f"<table><tr><td>{_prose(n)[:12]}</td><td>{n}</td></tr></table>",
        f"<ol><li>{_prose(n + 2)}</li></ol><h3>{_prose(n)[:20]}</h3><p><a href='/x'>{_prose(n + 1)[:30]}</a> {_prose(n + 5)}</p>",
        f"<section><h2>{_prose(n)[:22]}</h2><p>{_prose(n + 1)}</p></section><div><p>{_prose(n + 2)}</p></div>",
    )
    return first + blocks[0] + others[n % len(others)] + "".join(blocks[1:])


def _marked(part: str) -> str:
    """The part with its outermost element marked as other."""
    end = min(part.index(" "), part.index(">"))
    return part[:end] + ' data-label="other"' + part[end:]


def labelled_pages(count: int = 160) -> list[str]:
    """Pages that go through the ways to mark an article and the parts around it and inside it."""
    pages = []
    for n in range(count):
        name = NAMES_OF_CONTENT[n % len(NAMES_OF_CONTENT)]
        part = lambda k, n=n: OTHER[(n * 5 + k * 7) % len(OTHER)]
        body = _body(n)
        if n % 9 == 4:  # very little text
            body = f"<p>{_prose(n)[:-1]}</p>"
        if n % 4 == 1:  # something else inside the article
            body += _marked(part(11)) + f"<p>{_prose(n + 3)}</p>"
        if n % 11 == 7:  # no element around the article
            around = "".join(_marked(part(k)) for k in range(3))
            pages.append(f'<html><body data-label="content">{around}{body}{_marked(part(4))}</body></html>')
            continue
        article = (
            f'<article data-label="content">{body}</article>',
            f'<article class="{name}" data-label="content">{body}</article>',
            f'<main><article data-label="content">{body}</article></main>',
            f'<div class="{name}" data-label="content">{body}</div>',
            f'<main data-label="content">{body}</main>',
            f'<div id="{name}" data-label="content"><div>{body}</div></div>',
            f'<article data-label="content">{body}</article>',
            f'<section><article data-label="content">{body}</article></section>',
        )[n % 8]
        around = [part(k) for k in range(2 + n % 4)]
        half = (n % 3) + 1
        inner = "".join(around[:half]) + article + "".join(around[half:])
        if n % 5 == 2:
            inner = f'<div class="wrapper container page">{inner}</div>'
        pages.append(f"<html><head><title>{_prose(n)}</title></head><body>{inner}</body></html>")
    return pages
