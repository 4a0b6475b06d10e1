import time

import pytest

from fenloom.llm import html

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return html.Model(html.labelled_pages())


def test_held_out_layouts(model):
    wrong = total = 0
    for page, labels in html.labelled_pages(150, seed=99):
        nodes = html.parse(page)
        for n, y, p in zip(nodes, labels, model.marginals(nodes)):
            if n.text is not None:
                total += 1
                wrong += (p > 0.5) != y
    assert total > 2000 and wrong < 0.01 * total


def test_marginals_against_enumeration(model):
    import itertools

    import numpy as np

    nodes = html.parse("<div class=menu><a href=x>go</a><p>one two</p></div><article><p>text</p></article>")
    own = np.zeros((len(nodes), 2))
    for i, f in enumerate(html.features(nodes)):
        own[i] = sum((model.own[name] for name in f if name in model.own), np.zeros(2))
    weight, total = np.zeros(len(nodes)), 0.0
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = model.start[y[0]] + sum(own[i, y[i]] for i in range(len(nodes)))
        s += sum(model.pair.get(model.kind(n), model.other)[y[n.parent], y[i]] for i, n in enumerate(nodes) if i)
        total += np.exp(s)
        weight += np.exp(s) * np.array(y)
    assert np.allclose(weight / total, model.marginals(nodes), atol=1e-9)


@pytest.mark.parametrize("page, want", [
    ("", ""), (None, ""), ("<!DOCTYPE html><html><head><title>t</title></head><body></body></html>", ""),
    ("<article><h1>T &amp; u</h1><p>one<br>two\n three<p><b>four</article>", "T & u\none two three\nfour"),
    ("<article><p>a<script>var x='<p>no</p>'</script>b</p><!-- c --><p>&lt;d&gt; &#233;&nbsp;e</p></article>", "a b\n<d> é e"),
    ("<body><nav><ul><li><a href=a>Home</a></li></ul></nav><article><p>cut off &am", "cut off &am"),
    ("<div id=content><p>Story text here.</p></div><div class=comments><p>I liked it a lot.</p></div><footer>&copy; x</footer>", "Story text here."),
])
def test_pages(model, page, want):
    assert model.extract(page) == want


@pytest.mark.parametrize("page, want", [
    ("<article><h3>Title</h3><p>Some text of the story.</p></article>", "Title\nSome text of the story."),
    ("<article><h1>T</h1><ol><li>one</li><li>two</li></ol><p>end of it</p></article>", "T\none\ntwo\nend of it"),
    ("<article><ol><li>one</li></ol></article>", "one"),
    ("<main><h1>A</h1><h3 class='zz'>B</h3><p>c d e</p><dl><dt>f</dt><dd>g</dd></dl><figure><img src=x><figcaption>h</figcaption></figure>"
     "<section><h5>i</h5><p>j</p></section><h6>k</h6></main><div class=comments><h3>Replies</h3><ol><li>no</li></ol></div>",
     "A\nB\nc d e\nf\ng\nh\ni\nj\nk"),
    ("<article><header><h1>Head</h1><p>deck line</p></header><p>body</p></article><footer><p>foot</p></footer>", "Head\ndeck line\nbody"),
    ("<nav><ul><li><a href=a>Home</a></li></ul></nav><article><h3>Title</h3><p>Body here.</p><h4>Sub</h4><ol><li>a</li><li>b</li></ol></article>"
     "<aside><h3>Related</h3><ul><li><a href=b>x y</a></li></ul></aside><footer>&copy; me</footer>", "Title\nBody here.\nSub\na\nb"),
])
def test_every_content_tag(model, page, want):
    assert model.extract(page) == want


@pytest.mark.parametrize("page, want", [
    ("<article><p>..</p><button>Share</button><label>Name</label></article>", ".."),
    ("<article><p>one<label>Name<p>two three</p></article>", "one\ntwo three"),
    ("<article><p>a <button><b>x</b></button> b</p><form><fieldset><legend>You</legend><input></fieldset></form></article>", "a b"),
    ("<article><p>Some text here.</p><h2>Resources</h2><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></article>",
     "Some text here.\nResources\nOne\nTwo"),
    ("<article><header><h1>The title of it</h1></header><p>Some body text that is longer.</p><p>And more.</p></article>",
     "The title of it\nSome body text that is longer.\nAnd more."),
    ("<article><p>cut in a tag <a href=\"http://x", "cut in a tag"),
    ("<article><p>text <a title=it's>of</a> a story</p></article>", "text of a story"),
])
def test_forms_and_lists(model, page, want):
    assert model.extract(page) == want


@pytest.mark.parametrize("page", [
    "<div>" * 100_000, "<div><p>x" * 30_000, "<option>x" * 200_000, "<svg>x" * 200_000, "<svg/>x" * 100_000 + "</svg>", "<body>" * 100_000,
    "<a '\"" * 300_000, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<" + "a" * 1_000_000 + '"'])
def test_linear_in_the_page(model, page):
    start = time.process_time()
    model.extract(page)
    assert time.process_time() - start < 5


def test_no_tag_decides_alone(model):
    odds = {k: v[1] - v[0] for k, v in model.own.items() if k.startswith("tag=")}
    assert all(abs(odds[f"tag={t}"]) < 5 for t in "h2 h3 h4 h5 h6 ol ul dl figure section table nav footer aside pre".split()), odds


def test_deep_and_long(model):
    assert model.extract("<article>" + "<div>" * 2000 + "deep" + "</div>" * 2000 + "</article>") == "deep"
    assert len(model.extract("<article><p>" + "word " * 200_000 + "</p></article>")) == 999_999


def test_column(spark):
    rows = spark.createDataFrame([(1, "<article><p>x</p></article>", "t"), (2, None, "t"), (2, "", None)], "page_id long, html string, text string")
    got = html.extract(rows).collect()
    assert sorted((r["row"]["page_id"], r["text"]) for r in got) == [(1, "x"), (2, ""), (2, "")]
    empty = spark.createDataFrame([], "page_id long, html string, text string")
    assert html.extract(empty).collect() == []
