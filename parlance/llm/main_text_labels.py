"""The small labelled table: page layouts whose text blocks begin with + (main text) or - (other).

``~n`` stands for n words of filling. The layouts cover pages with and without an article element, lists of links, adverts,
notices, forms, sidebars and reader comments at several places, short and long.
"""

from __future__ import annotations

import re

LAYOUTS = [
    # article element, everything around it
    """<body><nav><ul><li><a href=a>- ~1</a></li><li><a href=b>- ~2</a></li></ul></nav><div class="ad">- ~6</div>
    <article><h1>+ ~8</h1><p>+ ~120</p><p><b>+ ~40</b><br>+ ~9<p>+ ~1</p><p>+ ~60</p></article><footer>- ~9</footer></body>""",
    # header and sidebar with long texts, article with links, lists and quotes
    """<header><a href=/>- ~2</a><p>- ~30</p></header><main><article><header><h1>+ ~6</h1><p>+ ~4</p></header>
    <p>+ ~20 <a href=x>~12</a> ~3</p><ul><li>+ ~5</li><li><a href=y>+ ~4</a></li></ul><blockquote>+ ~25</blockquote><h2>+ ~3</h2><p>+ ~70</p>
    <aside>- ~40</aside><div class="share"><a href=z>- ~1</a></div></article></main><aside><p>- ~80</p><p>- ~50</p></aside><footer><p>- ~40</p></footer>""",
    # comments below the text inside and outside of the article
    """<article><h1>+ ~5</h1><p>+ ~90</p><p>+ ~3</p><section class="comments"><h3>- ~2</h3><p>- ~60</p><p>- ~15</p></section></article>
    <div id="comments"><p>- ~90</p><p>- ~30</p></div><form><label>- ~2</label><p>- ~40</p></form>""",
    # no article element: long texts with few links are the text
    """<div class="menu"><a href=1>- ~1</a><a href=2>- ~1</a><a href=3>- ~2</a></div><div class="content"><h1>+ ~7</h1><p>+ ~80</p><p>+ ~100</p><p>+ ~30</p></div>
    <div class="sidebar"><h3>- ~2</h3><p>- ~25</p></div><div class="footer">- ~12</div>""",
    """<div><a href=1>- ~2</a> | <a href=2>~2</a></div><div><p>+ ~70</p><p>+ ~55</p><p>+ ~25</p><p>+ ~110</p></div><div><a href=3>- ~4</a></div><div>- ~3</div>""",
    """<table><tr><td><a href=1>- ~1</a></td></tr><tr><td><a href=2>- ~3</a></td></tr></table><div>+ ~150</div><div>+ ~60</div><p>- ~4</p><ul><li><a href=a>- ~6</a></li><li><a href=b>- ~7</a></li></ul>""",
    # notices and adverts of the length of a paragraph
    """<div class="cookie-notice"><p>- ~45</p><a href=c>- ~2</a></div><div role="banner">- ~20</div><main><h1>+ ~6</h1><p>+ ~65</p><div class="advert"><p>- ~50</p></div><p>+ ~75</p><p>+ ~2</p>
    <div class="newsletter"><p>- ~20</p></div><figure><figcaption>+ ~9</figcaption></figure></main><div class="related"><p>- ~35</p></div>""",
    """<div id="banner"><p>- ~60</p></div><article><p>+ ~3</p><p>+ ~2</p><p>+ ~150</p><form><p>- ~30</p></form><footer>- ~12</footer></article><div class="popup">- ~55</div><nav><p>- ~40</p></nav>""",
    """<article><h1>+ ~2</h1></article><section class="reader-comments"><article><p>- ~60</p></article><article><p>- ~2</p></article></section><footer><a href=x>- ~3</a></footer>""",
    """<div class="notice">- ~70</div><article><h1>+ ~9</h1><p>+ ~1</p><p><a href=k>+ ~30</a></p><p>+ ~14</p></article><div>- ~80</div><p>- ~120</p>""",
    """<header><nav><a href=1>- ~1</a></nav><h1>- ~4</h1></header><div><h2>+ ~6</h2><p>+ ~45</p><p>+ ~95</p></div><footer><p>- ~60</p></footer>""",
    """<main><p>+ ~40</p><p>+ ~1</p><section><h2>+ ~3</h2><p>+ ~60</p><ol><li>+ ~2</li><li>+ ~18</li></ol></section></main><section><p>- ~60</p><p>- ~75</p></section>""",
    # wrappers and articles whose class names what stands beside the text
    """<div class="has-sidebar"><article><h1>+ ~6</h1><p>+ ~80</p><div class="share"><p>- ~6</p></div></article><section class="comments"><article><p>- ~50</p></article></section><div class="sidebar"><p>- ~40</p></div></div>""",
    """<main class="content with-menu"><div class="menu"><a href=1>- ~2</a></div><h1>+ ~5</h1><p>+ ~70</p><p>+ ~9</p></main><div class="related"><p>- ~40</p></div>""",
    # nothing but text
    """<body><p>+ ~60</p></body>""",
    """<h1>+ ~4</h1><p>+ ~60</p><p>+ ~40</p>""",
    """<body>+ ~90</body>""",
    """<p>+ ~30</p><p>+ ~45</p><p>+ ~20</p>""",
]


#: Each layout is filled several times, with so many times the words.
SCALES = (0.4, 1.0, 2.5)


def labelled_pages() -> list[str]:
    def fill(layout: str, scale: float) -> str:
        return re.sub(r"~(\d+)", lambda m: " ".join(["word"] * max(1, round(int(m[1]) * scale))), layout)

    return [fill(layout, scale) for whole in LAYOUTS for layout in _cuts(whole) for scale in SCALES]


def _cuts(layout: str) -> list[str]:
    """A layout, and where it has an article also without what stands before it, after it, and both."""
    found = re.search(r"<(article|main)>.*?</\1>", layout, re.S)
    if found is None:
        return [layout]
    return [layout, layout[found.start() :], layout[: found.end()], found[0]]
