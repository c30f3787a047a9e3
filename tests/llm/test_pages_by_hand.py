"""Main text of pages set by hand in the manner of common site kinds; the article's blocks stand in ⟦ ⟧."""

import re

import pytest

from quillgraph.llm import html

P = [
    "The old bridge over the river was closed on Monday after engineers found cracks in two of its piers.",
    "Residents said they had warned the council for years. “Nobody listened,” said Maria Lopez, who lives nearby.",
    "Repairs are expected to take until the autumn, and buses will be sent round by the northern road.",
    "To make the dough, mix the flour with the salt, add the water slowly, and knead it for ten minutes.",
    "Leave it under a cloth in a warm place until it has doubled. Then shape it and let it rest once more.",
    "Our team measured the speed of the current at twelve points; the results agree with the earlier survey.",
    "It was a quiet year for the club, with few new players and fewer goals, but nobody was in the mood to complain.",
    "You install the package with one command. After that, open the settings file and change the port.",
    "Der Zug kam mit einer Stunde Verspätung an, und auf dem Bahnsteig wartete niemand mehr.",
    "She wrote the first draft in a week, threw it away, and began again with a different narrator.",
    "The committee meets twice a month. Its minutes are public, and anyone may speak for three minutes.",
    "In 1887 the family moved to the coast, where the father found work as a keeper of the lighthouse.",
]
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'

PAGES = {
    "bare": f"<html><body><h1>⟦Bridge closed⟧</h1><p>⟦{P[0]}⟧</p><p>⟦{P[1]}⟧</p></body></html>",
    "bare with nav and footer": f"<body><nav>{NAV}</nav><h1>⟦Bridge closed⟧</h1><p>⟦{P[0]}⟧</p><p>⟦{P[1]}⟧</p><p>⟦{P[2]}⟧</p><footer>&copy; 2021 The Herald</footer></body>",
    "grid": f'<body><div id=wrapper><div class=row><div class=col><h1>⟦Bread⟧</h1><p>⟦{P[3]}⟧</p><p>⟦{P[4]}⟧</p></div></div></div></body>',
    "comment list": f'<body><article><h2>⟦A survey⟧</h2><p>⟦{P[5]}⟧</p><p>⟦{P[2]}⟧</p></article><ol class="commentlist"><li><p>I was there too, and it was not like that at all.</p></li><li><p>Thanks for this, very useful.</p></li></ol></body>',
    "blog": f'<body class="home blog"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><h1 class="site-title"><a href="/">My Kitchen</a></h1><p class="site-description">Food and more</p></header><div id="content"><article class="post hentry"><header class="entry-header"><h1 class="entry-title">⟦Bread for beginners⟧</h1></header><div class="entry-content"><p>⟦{P[3]}⟧</p><p>⟦{P[4]}⟧</p></div></article><div id="comments" class="comments-area"><h2>2 thoughts on this</h2><ol class="comment-list"><li class="comment even"><p>Mine did not rise, what did I do wrong?</p></li></ol><div id="respond"><form><p>Your email address will not be published.</p><textarea></textarea></form></div></div></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Soup</a></li></ul></section></aside><footer class="site-footer">Proudly made at home</footer></div></body>',
    "old table": f'<body><table width=100%><tr><td colspan=2><a href="/">Start</a> | <a href="/map">Map</a> | <a href="/mail">Mail</a></td></tr><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td><h2>⟦Our year⟧</h2><p>⟦{P[6]}⟧<p>⟦{P[10]}⟧</td></tr><tr><td colspan=2>&copy; 1999 The Club</td></tr></table></body>',
    "main": f'<body><header><a href="/">Docs</a><form role="search"><input><button>Search</button></form></header><main><h1>⟦Installing⟧</h1><p>⟦{P[7]}⟧</p><ul><li>⟦Stop the server first, then copy the files.⟧</li><li>⟦Start it again and look at the log.⟧</li></ul></main><footer><a href="/terms">Terms</a> <a href="/privacy">Privacy</a></footer></body>',
    "cookie": f'<body><div class="cookie-banner"><p>We use cookies to improve your visit. By going on you accept them.</p><button>Accept</button></div><div class="container"><h1>⟦Spät am Abend⟧</h1><p>⟦{P[8]}⟧</p></div></body>',
    "sidebar": f'<body><div class="container"><div class="sidebar"><h3>Popular</h3><ul><li><a href="a">Ten ways to cook rice</a></li><li><a href="b">Why cats sleep</a></li></ul></div><div class="content"><h1>⟦The second draft⟧</h1><p>⟦{P[9]}⟧</p><p>⟦{P[11]}⟧</p></div></div></body>',
    "nameless divs": f"<body><div><div><div><h1>⟦Minutes⟧</h1></div><div><p>⟦{P[10]}⟧</p><p>⟦{P[0]}⟧</p></div></div></div></body>",
    "hashed classes": f'<body><div class="x1a9k"><nav class="q8z">{NAV}</nav><div class="p0w3"><h1 class="kk2">⟦The keeper⟧</h1><div class="zz9"><p>⟦{P[11]}⟧</p><p>⟦{P[9]}⟧</p></div></div></div></body>',
    "paragraphs with advert": f'<body><article><p>⟦{P[0]}⟧</p><div class="advertisement"><p>Buy two pairs and get the third one free.</p></div><p>⟦{P[2]}⟧</p></article></body>',
    "related": f'<body><section class="story"><h1>⟦Bridge⟧</h1><p>⟦{P[1]}⟧</p></section><div class="related-articles"><h3>Related</h3><p><a href="/x">Tunnel opens after nine years</a></p><p><a href="/y">Ferry sold</a></p></div></body>',
    "share and tags": f'<body><article><h1>⟦Results⟧</h1><p>⟦{P[5]}⟧</p><div class="share-buttons"><a href=#>Tweet</a> <a href=#>Mail</a></div></article><div class="tags"><a href=#>river</a> <a href=#>survey</a></div></body>',
    "headings": f"<body><h1>⟦Guide⟧</h1><h2>⟦First steps⟧</h2><p>⟦{P[7]}⟧</p><h2>⟦Baking⟧</h2><p>⟦{P[3]}⟧</p></body>",
    "quote": f"<body><div class=post><p>⟦{P[9]}⟧</p><blockquote>⟦Nothing is harder than the first page, and nothing easier than the last.⟧</blockquote><p>⟦{P[11]}⟧</p></div></body>",
    "comments of an unknown kind": f'<body><div id="text"><h1>⟦The year⟧</h1><p>⟦{P[6]}⟧</p></div><div class="user-comments"><h4>3 comments</h4><div class="item"><b>Tom</b><p>We will do better next year, I am sure.</p></div><div class="item"><b>Ann</b><p>Worst season I can remember.</p></div></div></body>',
    "newsletter": f'<body><main><article><h1>⟦Draft⟧</h1><p>⟦{P[9]}⟧</p></article></main><div class="newsletter-signup"><p>Subscribe to our newsletter and never miss a story.</p><form><input type=email><button>Sign up</button></form></div></body>',
    "unclosed": f"<body><h1>⟦Coast⟧</h1><p>⟦{P[11]}⟧<p>⟦{P[10]}⟧<p>⟦{P[2]}⟧",
    "breadcrumbs": f'<body><div class="breadcrumbs"><a href=/>Home</a> » <a href=/n>News</a></div><div id="main-content"><h1>⟦Closed⟧</h1><p>⟦{P[0]}⟧</p></div></body>',
    "page layout": f'<body><div id="page"><div id="top"><ul class="menu"><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div id="middle"><h1>⟦A warm place⟧</h1><p>⟦{P[4]}⟧</p><p>⟦{P[3]}⟧</p></div><div id="footer"><p>All rights reserved.</p></div></div></body>',
    "script and style": f"<body><style>p {{ color: red }}</style><script>var a = '<p>No text</p>';</script><h1>⟦Train⟧</h1><p>⟦{P[8]}⟧</p><noscript>Turn on scripts.</noscript></body>",
    "centre": f"<body><center><h2>⟦Minutes of May⟧</h2></center><p>⟦{P[10]}⟧</p><p>⟦{P[6]}⟧</p></body>",
    "author box": f'<body><article><h1>⟦Lighthouse⟧</h1><p>⟦{P[11]}⟧</p><p>⟦{P[9]}⟧</p></article><div class="author-bio"><p>Jane writes about the sea. She lives with two dogs.</p></div></body>',
    "popup": f'<body><div class="modal popup"><p>Join our list today!</p><button>No thanks</button></div><section><h1>⟦Current⟧</h1><p>⟦{P[5]}⟧</p></section></body>',
    "list article": f"<body><article><h1>⟦Three steps⟧</h1><ol><li>⟦{P[3]}⟧</li><li>⟦{P[4]}⟧</li></ol></article></body>",
    "nested layout": f'<body><div class="wrap"><div class="container"><div class="row"><div class="col-8"><h1>⟦Road⟧</h1><p>⟦{P[2]}⟧</p><p>⟦{P[1]}⟧</p></div><div class="col-4 sidebar"><h3>Weather</h3><p>Sunny, 21 degrees, light wind.</p></div></div></div></div></body>',
    "references": f"<body><p>⟦See &amp; hear: {P[5]}⟧</p><p>⟦A &lt;b&gt; is bold.  And   this is&nbsp;one.⟧</p></body>",
    "discussion": f'<body><main><h1>⟦Port⟧</h1><p>⟦{P[7]}⟧</p></main><section id="discussion"><h2>Discussion</h2><ul><li>Works for me, thanks a lot.</li><li>Does not start here.</li></ul></section></body>',
    "login": f'<body><div id="header"><a href=/>Logo</a><form><label>User</label><input><button>Log in</button></form></div><div id="body"><h2>⟦Club news⟧</h2><p>⟦{P[6]}⟧</p></div></body>',
    "footer only": "<body><footer><p>Copyright 2020, all rights reserved.</p></footer></body>",
    "menu only": f"<body><nav>{NAV}</nav></body>",
}


@pytest.fixture(scope="module")
def results():
    model, out = html.default_model(), {}
    for name, marked in PAGES.items():
        want = [" ".join(html._html.unescape(re.sub("<[^>]*>", "", t)).split()) for t in re.findall("⟦(.*?)⟧", marked, re.S)]
        out[name] = (html.main_text(marked.replace("⟦", "").replace("⟧", ""), model).split("\n\n"), want or [""])
    return out


def test_nearly_all_blocks_are_right(results):
    got = {(n, b) for n, (g, _) in results.items() for b in g if b}
    want = {(n, b) for n, (_, w) in results.items() for b in w if b}
    assert len(PAGES) >= 30
    assert len(got & want) >= 0.97 * len(want), want - got
    assert len(got & want) >= 0.95 * len(got), got - want


def test_most_pages_are_right(results):
    wrong = [n for n, (g, w) in results.items() if g != w]
    assert len(wrong) <= 3, wrong


@pytest.mark.parametrize("name", ["bare", "bare with nav and footer", "grid", "comment list"])
def test_pages_that_were_lost_before(results, name):
    assert results[name][0] == results[name][1]
