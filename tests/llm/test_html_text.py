import html
import re

import numpy as np
import pytest

from arcspool.llm import html_text as H
from arcspool.llm.queries import op3_html_text


def test_whole_table(spark):
    """The pages of the table have one article each, so its blocks are the text to find."""
    d = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in op3_html_text(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(rows) == len(pages)
    right = 0
    for p in pages:
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1]
        cut = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        right += rows[p.page_id].text == "\n\n".join(x for x in cut if x)
        assert rows[p.page_id].url == p.url and rows[p.page_id].n_chars == len(rows[p.page_id].text)
    assert right == len(pages)


def test_held_out_layouts():
    model, ok, n, skipped = H.trained(), 0, 0, 0
    for page, truth in H.training_pages(150, seed=77):
        found = H.blocks(page)
        if len(found) != len(truth):  # a layout whose unclosed tags join two blocks
            skipped += 1
            continue
        ok += ((model.log_odds([H.vectors(found)])[0] > 0) == truth).sum()
        n += len(truth)
    assert ok > 0.985 * n and skipped < 5


def test_blocks():
    page = "<p>One <b>two</b><br>three&nbsp;&lt;b&gt; <script>x='</p>'</script>four<p>five<!-- no --><li>six<li>seven<td a='>'>eight</p></p><div/>nine <a href=x>ten"
    assert [t for t, _, _ in H.blocks(page)] == ["One two three <b> four", "five", "six", "seven", "eight", "nine ten"]
    assert H.blocks("") == [] and H.blocks("<script>never closed") == [] and H.blocks("a < b")[0][0] == "a < b"


def test_elements_that_hide_or_never_end():
    want = {
        "<p>a<svg width=3 />b</p>c": ["a b", "c"],
        "<div><object><p>no</div><p>yes": ["yes"],
        "<select-box>shown</select-box>": ["shown"],
        "<p title=don't>one</p><p>it's</p>": ["one", "it's"],
        "<p title='a>b'>one</p>": ["one"],
        "x<!-- c": ["x"], "x<textarea> never": ["x"], "a <b": ["a"], "<!-->t<p>u": ["t", "u"], "<script>1</script>tail": ["tail"],
        "<template><div>q<script>1</script></div></template><p>v<noscript><p>w</noscript>z": ["v z"],
        "<select><option>o<p>r</select>s": ["s"],
        "<svg><svg>x</svg>y</svg>z": ["z"],
    }
    for page, texts in want.items():
        assert [t for t, _, _ in H.blocks(page)] == texts, page


def test_layouts_without_an_article_element():
    table = "<table><tr><td><a href=/>Home</a> <a href=/a>About</a></td></tr><tr><td><h1>Title of it</h1><p>The story goes on and on for some words.</p><p>And then it ends.</p></td></tr><tr><td>Copyright 2020</td></tr></table>"
    lists = "<article><h1>T</h1><p>Some words go here and there.</p><dl><dt>term</dt><dd>What the term means in this text.</dd></dl><p>End of it.</p></article>"
    bare = "<html><body>Just some words of text. More of them follow here.</body></html>"
    got = H.main_text(H.trained(), [table, lists, bare])
    assert got == [
        "Title of it\n\nThe story goes on and on for some words.\n\nAnd then it ends.",
        "T\n\nSome words go here and there.\n\nterm\n\nWhat the term means in this text.\n\nEnd of it.",
        "Just some words of text. More of them follow here.",
    ]


def test_windows_give_the_same_labels():
    model = H.trained()
    for page, _ in H.training_pages(20, seed=5):
        found = H.blocks(page)
        np.testing.assert_allclose(model.log_odds([H.vectors(found)])[0], model.log_odds_of(found, 3), atol=1e-3)


@pytest.mark.parametrize("page", [
    "<div>x y" * 8000, "<p>" * 100_000 + "x", "<p>some words in here.</p>" * 30_000, "<article><p>" + "word " * 400_000, "</x>" * 50_000 + "<div>" * 5000 + "</y>" * 50_000,
    "<a" * 100_000, '<a ="' * 50_000 + ">", "<svg>" * 30_000 + "x", "<p>" + "x" * 3_000_000,
], ids=["nested", "empty", "many", "one", "unmatched", "unended", "quotes", "hidden", "word"])
def test_large_pages_take_bounded_memory(page):
    """Time and memory in proportion: some hundred bytes for each byte of the page at most, however it is nested."""
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.perf_counter()
    H.main_text(H.trained(), [page])
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 60 and peak < 60_000_000 + 80 * len(page)


def test_word_bins_do_not_depend_on_slices(monkeypatch):
    texts = ["one two three four " * 50 + "end", "a", "b c"]
    whole = H._word_bins(texts)
    monkeypatch.setattr(H, "_TEXT_BYTES", 64)
    for a, b in zip(whole, H._word_bins(texts), strict=True):
        np.testing.assert_array_equal(a, b)


def test_weights_are_those_of_the_generator():
    """A short training gets near the kept weights' accuracy; the file isn't of another architecture."""
    assert [w.shape for w in H.trained().w] == [w.shape for w in H.BiLSTM.fresh().w]
    model, ok, n = H.train(300, 4), 0, 0
    for page, truth in H.training_pages(60, seed=78):
        found = H.blocks(page)
        if len(found) == len(truth):
            ok += ((model.log_odds([H.vectors(found)])[0] > 0) == truth).sum()
            n += len(truth)
    assert ok > 0.93 * n


def test_gradients():
    rnd = np.random.default_rng(0)
    model = H.BiLSTM.fresh()
    model.w = [w.astype(np.float64) for w in model.w]
    pages = [rnd.normal(size=(n, H.WIDTH)).astype(np.float32) * 0.3 for n in (3, 5)]
    labels = [rnd.integers(0, 2, len(p)).astype(np.float32) for p in pages]
    _, grads = model.gradients(pages, labels)
    for i, g in enumerate(grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = model.w[i][at]
        model.w[i][at] = kept + 1e-2
        up, _ = model.gradients(pages, labels)
        model.w[i][at] = kept - 1e-2
        down, _ = model.gradients(pages, labels)
        model.w[i][at] = kept
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.02, abs=1e-5)


def test_edges(spark):
    long = "<article>" + "<p>word and more of it.</p>" * 5000 + "</article>"
    rows = [(1, None, None, "x"), (2, "u", "", "y"), (None, "u", "<nav><ul><li><a href=/>Home</a></ul></nav>", "z"), (4, "v", long, "w"), (4, "v", long, "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id in (1, 2, None)] == [""] * 3
    assert all(r.text.count("word and more of it.") == 5000 for r in got if r.page_id == 4)
    assert H.extract(df.limit(0)).count() == 0
