"""Main text: layouts that the tree has not seen, odd mark-up, and the planted structure of the pages table."""

import html
import re

import pytest

from parlance.llm import main_text as M

TEXT = "Ein längerer Absatz mit vielen Wörtern, der den Inhalt der Seite trägt und nicht nur ein Verweis ist. " * 3


def pages(spark, *texts):
    return spark.createDataFrame([(i, f"u{i}", t, "x") for i, t in enumerate(texts)], "page_id long, url string, html string, text string")


@pytest.fixture(scope="module")
def tree(spark):
    return M.learned_tree(M.labelled_table(spark))


def texts(spark, tree, *pages_):
    return {r.page_id: r.text for r in M.main_text(pages(spark, *pages_), tree=tree).collect()}


def test_article_without_the_rest(spark, tree):
    page = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>"<p>no</p>"</script></head><body>
    <header class=top><a href=/>no</a></header><nav><ul><li>no<li>no</ul></nav><!-- <p>no</p> --><div id='cookie-banner'><p>{'no ' * 80}</p></div>
    <article><h1>Head&amp;line</h1><p>{TEXT}<br>a&lt;b &amp;amp; c&nbsp;d</p><div class="ad">no</div><p>x<b>y</b>z</p><form><input value="a>b"><label>no</label></form>
    <section id=comments><p>{'no ' * 60}</p></section></article><aside><p>{'no ' * 70}</p></aside><div class="comments"><article><p>no</p></article></div><footer>no<p>{'no ' * 50}"""
    want = "Head&line " + " ".join(TEXT.split()) + " a<b &amp; c d xyz"
    assert texts(spark, tree, page) == {0: want}


def test_plain_pages(spark, tree):
    menu = "".join(f"<a href={i}>no</a> " for i in range(8))
    page = f"<div class=menu>{menu}</div><div><p>{TEXT}</p><p>{TEXT}</p></div><div class=footer>no no</div>"
    assert texts(spark, tree, page, f"<p>{TEXT}</p>") == {0: " ".join((TEXT * 2).split()), 1: " ".join(TEXT.split())}


def test_article_alone(spark, tree):
    parts = ["<article><p>", "<main><h1>", "<body><nav><a href=x>no</a></nav><article><p>", "<div class=ad>no</div><main><p>a</p><p>"]
    for text in ("one", "a few words here", TEXT):
        got = texts(spark, tree, *[p + text for p in parts])
        want = " ".join(text.split())
        assert got == {0: want, 1: want, 2: want, 3: "a " + want}


def test_class_words_of_wrappers(spark, tree):
    body = f"<h1>Head</h1><p>{TEXT}</p><div class=share>no</div>"
    want = "Head " + " ".join(TEXT.split())
    wraps = [
        f"<div class='has-sidebar'><article>{body}</article><div class=sidebar><p>{'no ' * 60}</p></div></div>",
        f"<main class='content with-menu'>{body}</main>",
        f"<article class='post comments-open'>{body}</article><section class=comments><article class=comment><p>{'no ' * 60}</p></article></section>",
        f"<div class='has-sidebar'><div><article>{body}</article><div class=comments><article><p>no</p></article></div></div></div>",
        f"<div class='has-sidebar'><div><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></div><div class=sidebar><p>no no</p></div></div>",
    ]
    got = texts(spark, tree, *wraps)
    assert [got[i] for i in range(4)] == [want] * 4
    assert got[4] == want + " " + " ".join(TEXT.split())


def test_embedded_elements_of_an_article(spark, tree):
    page = f"<svg><text>no</text></svg><article><p>{TEXT}</p><p>so <math><mi>x</mi></math> <object>shown</object> <noscript>plain</noscript></p></article>"
    assert texts(spark, tree, page) == {0: " ".join(TEXT.split()) + " so x shown plain"}


def test_odd_pages(spark, tree):
    odd = [None, "", "<", "<p", "<!-- open", "<script>var a", "</div></p>", "<article>" + "<p>w" * 3000, "<article><p>cut <a hre", "a < b and c > d " * 9]
    got = texts(spark, tree, *odd)
    assert [got[i] for i in range(7)] == ["", "", "<", "", "", "", ""]
    assert got[7] == " ".join(["w"] * 3000) and got[8] == "cut" and got[9] == ("a < b and c > d " * 9).strip()


def test_empty_table(spark, tree):
    assert M.main_text(pages(spark, "x").limit(0), tree=tree).count() == 0


def test_given_pages(spark, tree):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in M.main_text(rows, tree=tree).collect()}
    for page in rows.collect():
        inside = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        inside = re.sub(r"</?[a-z][^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inside))
        assert got[page.page_id].text == " ".join(html.unescape(inside).split())
        assert got[page.page_id].n_chars == len(got[page.page_id].text)


def test_suspected_wrappers(spark, tree):
    body = f"<h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p>"
    want = "Head " + " ".join((TEXT * 2).split())
    menu = "<ul>" + "".join(f"<li><a href={i}>no link</a>" for i in range(6)) + "</ul>"
    wraps = [
        f"<form id=aspnetForm><nav>{menu}</nav><div><article>{body}</article></div><div class=footer>no</div></form>",
        f"<body><form method=post><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></form></body>",
        f"<article><h1>Head</h1><p>{TEXT}</p></article><article class='post has-comments'><p>{TEXT}</p></article>",
        f"<div class=social-issues>{body}</div>",
        f"<h1>Head</h1><div class=has-sidebar><p>{TEXT}</p><p>{TEXT}</p></div><div class=sidebar>{menu}</div>",
        f"<article><form><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></form></article>",
        f"<dialog open><article>{body}</article></dialog>",
        f"<article>{body}<form class=newsletter><p>no no no no no</p></form></article><section id=comments><article><p>{'no ' * 400}</p></article></section>",
        f"<div>{body}</div><div class=comments><p>{'no ' * 400}</p></div>",
    ]
    got = texts(spark, tree, *wraps)
    assert [got[i] for i in range(len(wraps))] == [want] * len(wraps)


def unseen_pages(count):
    """Labelled pages of layouts that the labelled table does not hold: html, and the words that belong to the text."""
    import random

    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefgimnorstu") for _ in range(rng.randrange(2, 9)))
    out = []
    for _ in range(count):
        text, noise = [], []

        def said(into, low, high):
            words = [("t" if into is text else "n") + word() for _ in range(rng.randrange(low, high))]
            into.extend(words)
            return " ".join(words)

        def links(n):
            return "".join(f"<li><a href='/{i}'>{said(noise, 1, 4)}</a></li>" for i in range(n))

        paragraphs = "".join(rng.choice(["<p>{}</p>", "<p class=lead>{}</p>", "<blockquote>{}</blockquote>", "<p>{}<br></p>"]).format(said(text, 15, 70)) for _ in range(rng.randrange(2, 8)))
        body = f"<h{rng.choice('12')}>{said(text, 2, 8)}</h2>" + paragraphs
        side = rng.choice(["<aside><h3>{0}</h3><ul>{1}</ul></aside>", "<div class='sidebar right'><h3>{0}</h3><ul>{1}</ul></div>", "<div id=related-posts><ul>{1}</ul><p>{0}</p></div>"])
        side = side.format(said(noise, 1, 4), links(rng.randrange(3, 9)))
        promo = rng.choice(["<div class='ad-slot'>{}</div>", "<div class=cookie-notice><p>{}</p></div>", "<form class=search-form><label>{}</label><input></form>", "<div role=alert>{}</div>"]).format(said(noise, 2, 12))
        comments = rng.choice(["", "<section class='comments-area'><p>{}</p></section>", "<div id=disqus><article>{}</article></div>"])
        comments = comments.format(said(noise, 20, 60)) if comments else ""
        top = rng.choice(["<header><ul>{}</ul></header>", "<nav>{}</nav>", "<div class='navbar top'><ul>{}</ul></div>"]).format(links(rng.randrange(3, 8)))
        foot = rng.choice(["<footer><p>{}</p></footer>", "<div class=footer>{}</div>"]).format(said(noise, 3, 15))
        main = rng.choice(["<article>{}</article>", "<main class='col with-sidebar'>{}</main>", "<div class=content>{}</div>", "<form id=form1><article class='post comments-open'>{}</article></form>", "<div class='page has-nav'><section>{}</section></div>"])
        inner = promo if rng.random() < 0.5 else ""
        page = top + (promo if not inner else "") + main.format(body + inner) + side + comments + foot
        out.append((f"<!doctype html><html><body>{page}</body></html>", text))
    return out


def test_precision_and_recall_on_unseen_layouts(spark, tree):
    made = unseen_pages(60)
    got = texts(spark, tree, *[h for h, _ in made])
    kept = right = wanted = 0
    for i, (_, words) in enumerate(made):
        found = got[i].split()
        kept, wanted, right = kept + len(found), wanted + len(words), right + sum(w[0] == "t" for w in found)
    print("precision", right / kept, "recall", right / wanted)
    assert right / kept >= 0.95 and right / wanted >= 0.95
