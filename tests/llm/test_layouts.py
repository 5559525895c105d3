"""Pages written by hand in layouts that the training pages do not have, with the blocks of their articles."""

import time

import pytest

from labeldates.llm import extract

BLOG = ("""<!doctype html><html><head><title>My blog</title><meta name=viewport content="width=device-width"></head><body class="post-template-default single single-post has-sidebar comments-open">
<a class="skip-link" href="#content">Skip to content</a><div id="page" class="site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Notes</a></p></div>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-12" class="post-12 post type-post hentry category-cooking">
<header class="entry-header"><h1 class="entry-title">A soup for winter</h1></header><div class="entry-content"><p>Cut the leeks into thin rings and wash them well.</p><ul><li>Two leeks</li><li>One litre of stock</li></ul><p>Cook for twenty minutes.</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>I made it yesterday, it was great.</p></div></li></ol></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Bread</a></li></ul></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by hand</div></footer></div></body></html>""",
    ["A soup for winter", "Cut the leeks into thin rings and wash them well.", "Two leeks", "One litre of stock", "Cook for twenty minutes."])
WIKI = ("""<html><body class="mediawiki ltr sitedir-ltr skin-vector page-Heron"><div id="mw-page-base"></div><div id="content" role="main"><h1 id="firstHeading">Heron</h1><div id="bodyContent"><div class="mw-parser-output">
<p>The <b>heron</b> is a long-legged bird <a href="/wiki/Bird">that</a> lives near water.</p><table class="infobox"><tr><th>Family</th><td>Ardeidae</td></tr></table><h2><span>Diet</span></h2><p>It eats fish &amp; frogs.</p></div></div></div>
<div id="mw-navigation"><h2>Navigation menu</h2><div class="vector-menu"><ul><li><a href="/login">Log in</a></li></ul></div></div><footer id="footer"><ul><li>This page was last edited on 3 May.</li></ul></footer></body></html>""",
    ["Heron", "The heron is a long-legged bird that lives near water.", "Family", "Ardeidae", "Diet", "It eats fish & frogs."])
NEWS = ("""<html lang=de><body><div class="cookie-consent-banner" role="dialog"><p>Wir verwenden Cookies.</p><button>OK</button></div><header><div class="logo">Tagblatt</div><nav><a href="/politik">Politik</a><a href="/sport">Sport</a></nav></header>
<main><article class="story notice-of-strike"><h1>Züge stehen still</h1><p class="lead">Am Montag fuhren keine Züge.</p><figure><img src=a.jpg><figcaption>Ein leerer Bahnsteig</figcaption></figure><div class="ad-slot" data-ad-unit="top"><span>Anzeige</span></div><p>Die Gewerkschaft verhandelt weiter.</p>
<aside class="related-stories"><h3>Mehr dazu</h3><ul><li><a href=/2>Streik im Herbst</a></li></ul></aside><blockquote>Wir bleiben ruhig.</blockquote></article></main><section class="newsletter-signup"><h3>Newsletter</h3><form><input type=email></form></section><footer><p>&copy; 2024 Tagblatt</p></footer></body></html>""",
    ["Züge stehen still", "Am Montag fuhren keine Züge.", "Ein leerer Bahnsteig", "Die Gewerkschaft verhandelt weiter.", "Wir bleiben ruhig."])
DOCS = ("""<body id="top" class="docs dark-mode"><div class="navbar navbar-fixed"><div class="navbar-inner"><a href="/">Docs</a><form class="search-form"><input></form></div></div><div class="container"><div class="row"><div class="col-3 sidebar-menu"><ul><li><a href=a>Install</a><li><a href=b>Use</a></ul></div>
<div class="col-9 main-content"><h1>Install</h1><p>Download the file first.</p><pre>tar xf file.tar</pre><ol><li>Open it</li><li>Run it</li></ol></div></div></div><div class="page-footer"><p>Copyright the authors. All rights reserved.</p></div>""",
    ["Install", "Download the file first.", "tar xf file.tar", "Open it", "Run it"])
REVIEW = ("""<body class="no-js alert-free"><div class="wrapper"><div class="top-bar"><ul class="social-links"><li><a href=f>Follow us</a></li></ul></div><article class="ad-review"><div class="post-header"><h1>The best adverts of the year</h1></div><p>An advert for soap won this year.</p><p>It was short.</p></article>
<div class="adv-box"><p>Buy soap now.</p></div><div class="user-remarks"><h4>Remarks</h4><div class="remark"><p>I like the soap.</p></div></div></div></body>""",
    ["The best adverts of the year", "An advert for soap won this year.", "It was short."])
PLAIN = ("""<html><head><title>t<body><h1>On rivers</h1><p>Rivers run down to the sea.<p>Some of them are long.</body></html>""".replace("<title>t", "<title>t</title></head>"), ["On rivers", "Rivers run down to the sea.", "Some of them are long."])
SECTIONS = ("""<body><section class="hero-menu"><nav><a href=/>Start</a></nav></section><section itemprop="articleBody"><h2>Uno</h2><p>El río baja al mar.</p><div class="share-buttons"><a href=t>Compartir</a></div><p>Es muy largo.</p></section><section class="discussion"><p>Me gusta mucho este texto.</p></section><div role="contentinfo">Aviso legal</div></body>""",
    ["Uno", "El río baja al mar.", "Es muy largo."])
PAGES = {"blog": BLOG, "wiki": WIKI, "news": NEWS, "docs": DOCS, "review": REVIEW, "plain": PLAIN, "sections": SECTIONS}


@pytest.fixture(scope="module")
def model():
    return extract.train()


@pytest.mark.parametrize("name", PAGES)
def test_layout(model, name):
    page, want = PAGES[name]
    assert extract.main_texts(model, [page], extract.Features(), {})[0].split("\n\n") == want


BODIES = ('class="home has-sidebar"', 'class="no-comments"', 'class="alert-free"', 'class="ad menu footer sidebar"', 'id="comments"', 'class="cookie-notice popup"')


def test_classes_of_the_body_say_nothing(model):
    pages = [p for p, _ in extract.labelled(60, seed=41)]
    plain = [p.replace("<body", "<body data-x", 1) if "<body" in p else p for p in pages]
    want = extract.main_texts(model, plain, extract.Features(), {})
    for attributes in BODIES:
        changed = [p.replace("<body data-x", f"<body {attributes} data-x") for p in plain]
        assert extract.main_texts(model, changed, extract.Features(), {}) == want


def test_all_of_a_block_is_looked_at_and_all_roles_count():
    found = extract.blocks('<div class="nav menu ad comments sidebar footer share notice main article header login"><p>' + "word " * 200 + "all rights reserved.</p></div>")
    ids = extract.Features().page(found)[0]
    assert extract.Features._id("cue 0 long True place 6") in ids and all(extract.Features._id(f"at 0 {r}") in ids for r in ("nav", "ad", "comment", "aside", "footer", "share", "notice", "main", "article", "header", "form"))


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "<p>a" * 60_000, "<b>" * 60_000 + "x<hr>" * 60_000, "<ul><li>" * 30_000 + "x" + "<li>y" * 60_000, '<a "' * 60_000, "<div class=ad>x" * 60_000, "<" * 200_000, "<p>x</div>" * 60_000], ids=["paragraphs", "inline", "lists", "quotes", "roles", "signs", "stray"])
def test_scan_takes_time_in_proportion(page):
    began = time.monotonic()
    extract.blocks(page)
    assert time.monotonic() - began < 10
