"""HTML extraction: message passing against enumeration, layouts held out, plain and broken pages."""

import html as entities
import itertools
import math
import random
import re
import time

import numpy as np
from test_operators import SF

from stereolith.llm import html_text as H
from stereolith.llm import queries

STORY = "The quick brown fox jumps over the lazy dog again and again. " * 7
STORY = STORY.strip()


def test_marginals_equal_enumeration():
    r = random.Random(4)
    for _ in range(25):
        t = H.Tree()
        for _ in range(r.randint(1, 8)):
            inner = [i for i, x in enumerate(t.text) if x is None]
            leaf = r.random() < 0.5
            t.add(r.choice(inner), "#text" if leaf else r.choice(["div", "p", "nav"]), "p" if leaf else r.choice(["", "ad", "post"]), "word " * r.randint(1, 60) if leaf else None)
        model = H.Model([r.gauss(0, 1) for _ in H.FEATURES], [[[r.gauss(0, 1) for _ in "01"] for _ in "01"] for _ in range(len(H.KINDS) ** 2)])
        features, pair = H.active(t)
        nodes = [i for i, f in enumerate(features) if f is not None]
        got = model.marginals(t)
        if not nodes:
            assert not any(got)
            continue
        total, on = 0.0, np.zeros(len(got))
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            y = dict(zip(nodes, labels, strict=True))
            s = sum(y[i] * sum(model.weights[k] for k in features[i]) + (model.ties[pair[i]][y[t.parent[i]]][y[i]] if i else 0) for i in nodes)
            total += math.exp(s)
            for i in nodes:
                on[i] += y[i] * math.exp(s)
        assert np.allclose(got, on / total)


def test_gradient_is_that_of_the_likelihood():
    pages = list(H.labelled_pages(H.WRAPPERS[:3], 2))
    forest = H.Forest(iter(pages))
    r = np.random.default_rng(0)
    w, tie = r.normal(size=len(H.FEATURES)) / 3, r.normal(size=(len(H.KINDS) ** 2, 2, 2))

    def likelihood(w, tie):
        # log of the labelling's score, less log of the sum over all (upward pass in logs)
        s, up = 0.0, np.zeros((len(forest.y), 2))
        up[:, 1] = forest.x @ w
        for i in range(len(forest.y) - 1, -1, -1):
            y, p = int(forest.y[i]), forest.parent[i]
            s += y * (forest.x[i] @ w)
            if p < 0:
                s -= np.logaddexp(*up[i])
            else:
                own = tie[forest.pair[i]]
                s += own[int(forest.y[p]), y]
                up[p] += [np.logaddexp(*(own[k] + up[i])) for k in (0, 1)]
        return s / len(forest.y)

    gw, gt = forest.gradient(w, tie)
    e = 1e-5
    for k in r.choice(np.flatnonzero(forest.x.sum(0)), 8):
        d = np.zeros_like(w)
        d[k] = e
        assert abs((likelihood(w + d, tie) - likelihood(w - d, tie)) / (2 * e) - gw[k]) < 1e-6
    for k, a, b in itertools.product(np.unique(forest.pair[1:])[:6], (0, 1), (0, 1)):
        d = np.zeros_like(tie)
        d[k, a, b] = e
        assert abs((likelihood(w, tie + d) - likelihood(w, tie - d)) / (2 * e) - gt[k, a, b]) < 1e-6


def right(model, pages):
    pages = list(pages)
    return sum(model.text(p) == "\n\n".join(b) for p, b in pages) / len(pages)


def test_new_pages_and_layouts_held_out():
    assert right(H.train(), H.labelled_pages(each=15, seed=77)) > 0.97
    some = tuple(w for k, w in enumerate(H.WRAPPERS) if k % 3)
    assert right(H.train(some), H.labelled_pages(H.WRAPPERS[::3], 25, seed=5)) > 0.9


def test_plain_pages():
    text = H.train().text
    assert text(f"<html><body><p>{STORY}</p><p>{STORY}</p></body></html>") == f"{STORY}\n\n{STORY}"
    assert text(f"<body><h1>T</h1><p>{STORY}</p></body>") == f"T\n\n{STORY}"
    assert text(f"<body><nav>..</nav><p>{STORY}</p><footer>..</footer></body>") == STORY
    assert text(STORY) == STORY and text("a < b, 1 <2") == "a < b, 1 <2"
    assert text(f'<article><p>{STORY}</p><p class="comment">{STORY}</p></article>') == f"{STORY}\n\n{STORY}"
    assert text(f'<p>{STORY} <a href="x>here</a></p>') == f"{STORY} here"
    assert text(f'<p title="a > b">{STORY}</p><!-- <p>no</p> --><script>var a = "</p>";</script>') == STORY
    assert text(f"<table><tr><td>{STORY}<td>{STORY}</table>") == f"{STORY}\n\n{STORY}"


BESIDE = [
    f'<div class="comment">{STORY}</div>',
    f'<ol class="comment-list"><li>{STORY}</li></ol>',
    f'<div class="user-comment">{STORY}</div>',
    f'<article class="comment">{STORY}</article>',
    f"<section><h3>3 comments</h3><p>{STORY}</p></section>",
    f'<div id="comments"><p>{STORY}</p></div>',
    "<div>This site uses cookies and similar things to make your visit better.</div>",
    '<div class="top">Site name</div>',
    "<div>Site name</div>",
    '<div class="right-col"><h4>Related</h4><p>Another story here</p></div>',
    "<p>Some unclassed notice beside.</p>",
    f"<div><p>{STORY}</p></div>",
]
WITHIN = [
    (f"<p><a href=x>{STORY}</a></p>", [STORY]),
    ("<ul><li><a href=x>one link</a></li><li><a href=y>two link</a></li></ul>", ["one link", "two link"]),
    (f'<p class="notice">{STORY}</p>', [STORY]),
    ('<h2 class="alert">Alert heading</h2>', ["Alert heading"]),
    (f'<p class="comment">{STORY}</p>', [STORY]),
]


def test_what_stands_beside_a_wrapper_is_no_story():
    text, inner = H.train().text, f"<h1>T</h1><p>{STORY}</p><p>{STORY}</p>"
    for x in BESIDE:
        for page in (f"<article>{inner}</article>{x}", f"{x}<article>{inner}</article>", f"<main>{inner}</main>{x}", f"<div>{x}</div><article>{inner}</article>"):
            assert text(f"<html><body>{page}</body></html>") == f"T\n\n{STORY}\n\n{STORY}", (x, page[:40])


def test_what_stands_within_a_wrapper_is_story():
    text = H.train().text
    for x, want in WITHIN:
        for a in ("article", "main"):
            page = f"<body><nav><a href=/>Home</a></nav><{a}><h1>T</h1><p>{STORY}</p>{x}<p>{STORY}</p></{a}><footer>c</footer></body>"
            assert text(page) == "\n\n".join(["T", STORY, *want, STORY]), (x, a)


def blog(body, comments):
    """The layout of a common weblog program."""
    return f"""<html><head><title>x</title></head><body class="home blog"><div id="page" class="site"><header id="masthead" class="site-header">
<div class="site-branding"><p class="site-title"><a href="/">My blog</a></p></div><div class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></div></header>
<div id="primary"><div class="entry-content">{body}</div><ol class="comment-list">{"".join(f'<li class="comment"><p>{c}</p></li>' for c in comments)}</ol><div id="respond"><h3>Leave a reply</h3><form><textarea></textarea></form></div></div>
<div id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/a">A post</a></li></ul></section></div><div class="site-info">Proudly powered by a program</div></div></body></html>"""


def news(body, comments):
    """The layout of a newspaper."""
    return f"""<html><body><div class="cookie">We use cookies.</div><div class="header"><a href="/">The Paper</a></div><main id="main"><article><div data-component="text-block">{body}</div></article>
<section><h2>{len(comments)} comments</h2><div>{"".join(f"<p>{c}</p>" for c in comments)}</div></section></main><div><h2>More on this story</h2><ul><li><a href=x>Other thing</a></li></ul></div><footer><p>&copy; The Paper</p></footer></body></html>"""


def test_layouts_of_another_hand():
    r, text = random.Random(2), H.train().text
    words = "It was the best time of the year and the worst in which to travel by train through the hills of the north".split()
    say = lambda n: " ".join(r.choices(words, k=n))
    for layout in (blog, news):
        fine = 0
        for _ in range(200):
            blocks = [(say(r.randint(3, 9)), "h2") if r.random() < 0.15 else (say(r.randint(4, 90)), "p") for _ in range(r.randint(2, 12))]
            page = layout("".join(f"<{tag}>{x}</{tag}>" for x, tag in blocks), [say(r.randint(2, 70)) for _ in range(r.randint(1, 5))])
            fine += text(page) == "\n\n".join(x for x, _ in blocks)
        assert fine >= 190, (layout.__name__, fine)


def test_deep_and_broken_pages_take_linear_time():
    text, n = H.train().text, 200_000
    for page in ("<div>" * n, "<div>" * n + "</p>" * n, "<a<a" * n, "<option>" * n, "<ul>" + "<div>" * n + "<li></li>" * n, '<a x="' * n, "<a x='\"" * n, "<p>" * n + "x", "<" * n, "<svg>" * n, "<script>" * n, "<!--" * n):
        began = time.perf_counter()
        text(page)
        assert time.perf_counter() - began < 15


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "plain words"), (4, "<article><h1>Title</h1><p>" + "Some &eacute;  long\n sentence of the story. " * 9 + "</p><script>if (a < b) { '</p>' }</script></article><div class=ad>buy this now</div>"), (5, "<" * 2000), (5, "<p>" * 3000 + "x"), (None, "<p>null id</p>")]
    got = H.extract(spark.createDataFrame([(i, "u", h, 1) for i, h in rows], "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows)
    by = {x["page_id"]: x["text"] for x in got}
    assert by[1] == by[2] == "" and by[3] == "plain words" and by[4] == "Title\n\n" + " ".join(["Some é long sentence of the story."] * 9)
    assert sorted(x["text"] for x in got if x["page_id"] == 5) == ["<" * 2000, "x"] and by[None] == "null id"
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_articles_of_the_tables(spark):
    for x, y in zip(spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect(), queries.QUERIES["op8_html_text"](spark, SF).orderBy("page_id").collect(), strict=True):
        inside = re.search("<article>(.*?)</article>", x["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert y["text"] == "\n\n".join(b for b in blocks if b) and y["n_chars"] == len(y["text"])
