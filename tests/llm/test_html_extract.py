import re

import pytest

from spindrift.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    pages = [f"<article><p>{' '.join(f'word{i}{k}' for k in range(30))}</p></article>" for i in range(40)]
    return H.train_on(pages)


CASES = [
    ("<html><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>Title</h1><p>One &amp; two\n three.</p><p>More <b>bo</b>ld.</p></article><footer>&copy; x</footer></body></html>", "Title One & two three. More bold."),
    ('<body><div class="sidebar"><p>Side words here</p></div><main><p>Main words are these and many more of them.</p><div class="comments"><div><p>A reader says so</p></div></div></main></body>', "Main words are these and many more of them."),
    ("<body><article><p><b>Open<br><p>next one<p>last</article><script>var t='</p>';</script>", "Open next one last"),
    ("<article><p title=it's>Hello don't lose this text of the page.</p><p>x <math><mi>a</mi> = <mi>b</mi></math> y > z</p></article>", "Hello don't lose this text of the page. x a = b y > z"),
    ("<article><p data-x='a > b' title = \"it's\">Quoted values may hold a &gt; sign.</p></article>", "Quoted values may hold a > sign."),
    ("<article><p>Words before<!-- a > b --> and <!x>behind</p></article>", "Words before and behind"),
    ("<article><h1>Letters</h1><p>First some words about the letters.</p><table><td>Alpha is one</td><td>Beta is two</td></table><p>Then some more words follow.</p></article>", "Letters First some words about the letters. Alpha is one Beta is two Then some more words follow."),
    ("<article><p>First some words about the letters.</p><table><tr><th>Name</th><th>Place</th></tr><tr><td>Alpha</td><td>One</td></tr></table></article>", "First some words about the letters. Name Place Alpha One"),
    ("<article><p>First some words about the letters.</p><dl><dt>Alpha</dt><dd>The first of all</dd></dl></article>", "First some words about the letters. Alpha The first of all"),
    ('<article><p>Words before an advert stand here and there.</p><div class="ad">Buy this now</div><p>Words behind the advert stand here too.</p></article>', "Words before an advert stand here and there. Words behind the advert stand here too."),
    ('<article><p>Words before an advert stand here and there.</p><div class="ad-slot">Buy this now</div><p>Words behind the advert stand here too.</p></article>', "Words before an advert stand here and there. Words behind the advert stand here too."),
    ('<article><p>Words before a notice stand here and there.</p><div class="notice"><p>We use cookies</p><button>Fine</button></div><p>Words behind the notice stand here too.</p></article>', "Words before a notice stand here and there. Words behind the notice stand here too."),
    ("<html><body><div><a href=a>Home</a> <a href=b>News</a></div><div><h1>A title</h1><p>The first paragraph of a text that has no landmark at all.</p><p>The second one follows it and is as long as the first.</p></div><div>&copy; Someone</div></body></html>", "A title The first paragraph of a text that has no landmark at all. The second one follows it and is as long as the first."),
    ("<html><body><h1>A title</h1><p>The first paragraph of a text that stands in the body.</p><p>The second one follows it and is as long as the first.</p></body></html>", "A title The first paragraph of a text that stands in the body. The second one follows it and is as long as the first."),
    ("", ""), ("no markup < at all", ""), ("<nav><a>only</a></nav>", ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_cases(model, page, text):
    assert H.extract([page], model) == [text]


@pytest.mark.parametrize("part", ['<a "', "<a ='", "<!x", "<!-- ", "</x>", "<script>", "</script", "<div>", "<div></p>", "<a b=", "<p x='>", "<<", "<li><b>", "<p><i>"])
def test_scanning_is_linear(part):
    import time

    took = []
    for n in (2_000, 32_000):
        began = time.perf_counter()
        H.Tree("<p>a<script>" * (part == "</script") + part * n)
        took.append(time.perf_counter() - began)
    # 16 times as much; a scan that starts anew for each would take 256 times as long.
    assert took[1] < 0.5 or took[1] < 60 * took[0]


@pytest.mark.parametrize("lead, part", [("", "<li></li>"), ("<li><ul>", "<li></li>"), ("<table>", "<td></td>"), ("<p>", "<p></p>")])
def test_deep_pages_are_linear(lead, part):
    import time

    took = []
    for n in (1_000, 16_000):
        began = time.perf_counter()
        H.Tree(lead + "<div>" * n + part * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 0.5 or took[1] < 60 * took[0]


def test_decoding_is_the_best_labelling():
    """All labellings of small trees in which nothing inside a dropped element is kept, and nothing inside the article a container."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        p = rng.random(n)
        worth = lambda s: sum(np.log(p[k] if x == "k" else 1 - p[k]) for k, x in enumerate(s))  # noqa: B023, E731
        may = {"d": "d", "k": "kd", "c": "kdc"}
        good = [s for s in itertools.product("kdc", repeat=n) if all(s[k] in may[s[parent[k]]] for k in range(1, n))]
        best = max(worth(s) for s in good)
        got = H.decode(p, parent, depth)
        assert np.isclose(np.where(got, np.log(p), np.log1p(-p)).sum(), best)


def test_no_pages(spark, model):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert H.extract_pages(empty, model).collect() == [] and H.train(empty) is not None


def test_repeated_and_long(spark, model):
    long = "<article>" + "".join(f"<p>Part {k} of a very long text.</p>" for k in range(4000)) + "</article>"
    rows = [(1, "u", long, "x"), (1, "u", long, "y")]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert [r.text for r in got] == [" ".join(f"Part {k} of a very long text." for k in range(4000))] * 2


def test_unseen_layouts(model):
    pages = H.laid_out([f"Some {k} unseen words stand here for the {k}th text of all." for k in range(50)], 120, seed=77)
    trees = [H.Tree(p) for p in pages]
    right = sum(got == H._joined(t, [v == 1 for v in t.label]) for t, got in zip(trees, H.extract(pages, model), strict=True))
    assert right >= 0.97 * len(pages)


def test_nothing_kept_inside_dropped(model):
    import numpy as np

    rng = np.random.default_rng(1)
    parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, 200)])
    depth = np.zeros(200, int)
    for k in range(1, 200):
        depth[k] = depth[parent[k]] + 1
    kept = H.decode(rng.random(200), parent, depth)
    inside = {k for k in range(200) if kept[k]}
    for k in inside:
        above, seen_gap = parent[k], False
        while above >= 0:
            seen_gap |= above not in inside
            assert not (seen_gap and above in inside)
            above = parent[above]


def test_table(spark, model):
    rows = [(1, "u", "<article><p>Text of a page that is kept.</p></article>"), (2, None, None), (None, "v", "")]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in got) == [(0, "v", ""), (1, "u", "Text of a page that is kept."), (2, "", "")]


def test_article_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract_pages(pages, H.train(pages)).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.sub("<[^>]*>", "", re.sub("</?(p|h1)>", "\0", inner.replace("<br>", " "))).split("\0")
        import html

        want = " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert got[r.page_id] == want
