import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from graphmend.llm import html_blocks, quality

TREE = html_blocks.grow_tree(*html_blocks.labelled_table())
PAGES = [
    ("<html><head><title>T</title><script>var a='</p><p>no';</script><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy now</div>"
     "<article><h1>Head &amp; tail</h1><p>One <b>bo</b>ld  word\n&nbsp;here.<br>Next<p>Of.<p>Last &lt;tag&gt; &eacute;</article><footer>&copy; X</footer></body>",
     "Head & tail One bold word here. Next Of. Last <tag> é"),
    ("<div id=cookie-banner>We use cookies</div><main><p>Only this.</p><form><p>Your name</p><input></form><aside>Related things</aside><p>And that.</p></main>"
     "<section class=comments><p>I like it very much, thank you for all of this long text that goes on and on.</p></section>", "Only this. And that."),
    ("<article><p>Kept<!-- <p>gone</p> --> whole</p><noscript>no</noscript><div class='share-buttons'>Share</div></article>", "Kept whole"),
    ("", ""), (None, ""), ("<p", ""), ("<!-- open", ""), ("<script>x", ""),
    ("<article><p title=\"a > b\">Quoted</p><p>1 < 2</p></article>", "Quoted 1 < 2"),
    ("<article>" + "<p>word</p>" * 20_000 + "</article>", " ".join(["word"] * 20_000)),
]
SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def test_pages(spark):
    rows = [(i, f"u{i}", p, "clash", 3) for i, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "clash", 3), (None, "u", PAGES[1][0], "clash", 3)]
    got = html_blocks.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {i: t for i, (_, t) in enumerate(PAGES)} | {None: PAGES[1][1]}
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id]))
    assert html_blocks.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("opening", [
    '<body style="overflow:hidden"><div>', '<body><div style="overflow: hidden">', "<body><div data-state='hidden'>", '<body><div title="class=ad hidden">',
    '<body><div data-state=hidden data-class="ad" data-id="sidebar" data-role=banner>', '<body><div class="text" class="ad" aria-label="not hidden">'])
def test_attributes_are_read_by_name(opening):
    """Words in values of other attributes neither hide an element nor name its class."""
    assert html_blocks.main_text(f"{opening}<article><h1>Head</h1><p>All of the text.</p></article></div></body>", TREE) == "Head All of the text."
    long = "The committee met again on Tuesday to talk about the bridge, and after two hours of argument agreed on very little. " * 3
    found = html_blocks.blocks(f"{opening}<p>{long}</p></div></body>")
    assert [(b[0], b[1][2]) for b in found] == [(" ".join(long.split()), False)]


@pytest.mark.parametrize("attribute", ["hidden", 'HIDDEN=""', "class=x hidden", 'aria-hidden="true"', "hidden='until-found'"])
def test_hidden_elements_are_left_out(attribute):
    assert html_blocks.main_text(f"<article><p>Shown text.</p><div {attribute}><p>Not this.</p></div></article>", TREE) == "Shown text."


def test_plain_page_by_words_and_links():
    """No containers or class names: word counts and link density decide."""
    long = "The committee met again on Tuesday to talk about the bridge, and after two hours of argument agreed on very little. " * 3
    page = f"<div>Tuesday paper</div><div>Sunny</div><div>{long}</div><div>{long}</div><div><a>Next</a> <a>Back</a></div><div>Page 9</div>"
    assert html_blocks.main_text(page, TREE) == " ".join((long + long).split())


def test_link_density_of_the_block_itself():
    """A long list of links without any name is no main text, a paragraph of as many words with one link is."""
    links = " ".join(f"<a href=/{i}>Story number {i} of the day</a>" for i in range(12))
    text = "The committee met again on Tuesday to talk about the bridge, and after two hours of <a>argument</a> agreed on very little. " * 3
    plain = " ".join(text.replace("<a>", "").replace("</a>", "").split())
    assert html_blocks.main_text(f"<div>{links}</div><div>{text}</div><div>{text}</div><div>{links}</div>", TREE) == f"{plain} {plain}"


@pytest.mark.parametrize("piece", [
    '<a "', "<div>x", '<a x="<a x=', "<p title='", "</script ", "<script>a</script ", "<a x=\"b\" y='>", "<", "</", '"><a x=', "<li>x", "<!--", "&#99999999"])
def test_broken_pages_in_linear_time(piece):
    """Half a million characters of deep nesting, unclosed quotes or tags take seconds, not hours."""
    for end in ("", ">"):
        begun = time.monotonic()
        html_blocks.main_text(piece * (500_000 // len(piece)) + end, TREE)
        assert time.monotonic() - begun < 10


def test_long_numerals_and_formulas():
    page = "<article><p>a&#" + "9" * 6000 + ";b &#" + "0" * 5000 + "65; <math><mi>x</mi><mo>=</mo><mn>2</mn></math> y</p></article>"
    assert html_blocks.main_text(page, TREE) == "a\ufffdb A x=2 y"


def test_unclosed_quote_keeps_the_text():
    assert html_blocks.main_text("<article><p title='never closed>One.</p><p class=\"x\">Two.</p></article>", TREE) == "One. Two."


def test_a_plainer_reading_of_the_given_pages():
    """An independent reading by the standard library's parser: text of the article elements, blocks joined by a space."""
    import pyarrow.parquet as pq

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.skip, self.parts = 0, 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.skip += tag in ("script", "style")
            self.parts.append((self.depth, " " if tag not in html_blocks._INLINE else ""))

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.skip -= tag in ("script", "style")
            self.parts.append((self.depth, " " if tag not in html_blocks._INLINE else ""))

        def handle_data(self, data):
            if not self.skip:
                self.parts.append((self.depth, data))

    table = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column(0).to_pylist()
    plain = [p for p in table if p and "<article" in p and not re.search("<(?:aside|form|nav)|class=", p[p.index("<article"):p.rindex("</article")])]
    assert len(plain) > len(table) / 4
    for page in plain:
        reader = Article()
        reader.feed(page)
        want = " ".join("".join(t for d, t in reader.parts if d > 0).split())
        assert html_blocks.main_text(page, TREE) == want


def test_tree_learns_its_table():
    x, y = html_blocks.labelled_table()
    assert 0.3 < y.mean() < 0.7 and len(y) < 200
    assert np.mean([html_blocks.is_main(TREE, r) == bool(v) for r, v in zip(x.tolist(), y)]) > 0.95
    assert html_blocks.grow_tree(x, np.ones(len(x))) == (1.0,)


def brute_tokens(text):
    import re

    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x00-\x20\x7fA-Za-z0-9\x80-\xff]+", text)


def test_tokens_against_a_plain_scan():
    texts = [b"", b"Plain words, HERE!! twice twice 42", "Été À la ß | x".encode(), b" \n\t ", b"a"]
    part, surface, shape = quality.tokens(texts)
    assert [int((part == i).sum()) for i in range(len(texts))] == [len(brute_tokens(t)) for t in texts]
    _, low, _ = quality.tokens([b"WORD word Word"])
    assert len(set(low.tolist())) == 1
    _, _, shapes = quality.tokens([b"WORD x word y Word z word word"])
    assert len(set(shapes.tolist())) == 5  # capitals, single letter, small, first capital, repeated
    assert (surface < quality.SURFACES).all() and (shape >= quality.SURFACES).all() and (shape < quality.ROWS).all()


def test_context_table_counts_every_text(spark):
    texts = ["a b c a", None, "", "b c\nd e, f!", "a b c a", "x y z " * 2000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, sums int").repartition(3)
    want = np.zeros(quality.ROWS * quality.DIM)
    places, signs = quality._index_vectors()
    for t in texts:
        part, surface, shape = quality.tokens([(t or "").encode()])
        for i in range(len(part)):
            for j in range(len(part)):
                if i != j and abs(i - j) <= quality.WINDOW:
                    np.add.at(want, surface[i] * quality.DIM + places[surface[j]], signs[surface[j]])
                if abs(i - j) == 1:
                    np.add.at(want, shape[i] * quality.DIM + places[shape[j]], signs[shape[j]])
        if t and len(t) > 1000:
            break
    assert (quality.context_table(docs).reshape(-1) == want).all()
    assert not quality.context_table(docs.limit(0)).any()


def test_pooling_in_segments_is_pooling_whole(monkeypatch):
    words = quality.word_vectors(np.random.default_rng(0).standard_normal((quality.ROWS, quality.DIM)))
    texts = [b"some words here and there " * 50, b"", b"other, things! 12 " * 30, b"x"]
    whole = quality.pool(texts, words)
    monkeypatch.setattr(quality, "SEGMENT", 64)
    assert np.allclose(quality.pool(texts, words)[:, quality.DIM * 2], whole[:, quality.DIM * 2])
    assert np.abs(quality.pool(texts, words) - whole).max() < 0.1
    assert not whole[1].any()


def noisy(rng, good):
    words = ["".join(rng.choice(list("aeioutrsnl"), 5)) for _ in range(40)]
    return " ".join(w if good else w.upper() + "!!" for w in words)


def test_quality_end_to_end(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        rows.append((i, noisy(rng, good), "s", "l", 0.5))
        if i < 220:
            labels.append((i, int(good), 0))
    rows += [(1000, None, "s", "l", 0.5), (1001, "", "s", "l", 0.5), (None, "no id here", "s", "l", 0.5), (5, rows[5][1], "s", "l", 0.5), (1002, "word " * 100_000, "s", "l", 0.5)]
    labels += [(None, 1, 0), (3, None, 0), (7, 5, 0), (9, 1, 0), (99_999, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, label double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality.score_documents(docs, quality.fit_quality(docs, lab)).select(
        "doc_id", quality.held_out().alias("held_out"), "score", "label").collect()
    assert len(scored) == len(rows)
    right = []
    for r in scored:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 240 and r.held_out:
            right.append((r.score >= 0.5) == (r.doc_id % 4 != 0))
    assert np.mean(right) > 0.95
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and 150 < kept.count() < 200


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score_documents(docs, quality.fit_quality(docs, none)).collect()] == [0.5, 0.5]
    assert quality.score_documents(docs.limit(0), quality.fit_quality(docs.limit(0), none)).count() == 0


def test_held_out_labels_are_not_learned(spark):
    """Flipping every held-out label leaves the scores as they are."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, noisy(rng, i % 2 == 0)) for i in range(60)], "doc_id long, text string")
    label = lambda i, flip: int(i % 2 == 0) ^ int(flip and zlib.crc32(str(i).encode()) % 3 == 1)
    got = []
    for flip in (False, True):
        lab = spark.createDataFrame([(i, label(i, flip)) for i in range(60)], "doc_id long, quality int")
        got.append(sorted((r.doc_id, r.score) for r in quality.score_documents(docs, quality.fit_quality(docs, lab)).collect()))
    assert [g[0] for g in got[0]] == [g[0] for g in got[1]]
    assert np.allclose([g[1] for g in got[0]], [g[1] for g in got[1]])


@pytest.mark.parametrize("shift", [4.0])
def test_temperature_calibrates(shift):
    """Noisy labels: the mean score of the fitted network is close to the share of label 1."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 2 * quality.DIM + 1))
    p = 1 / (1 + np.exp(-x[:, 0] * shift / 4))
    y = (rng.random(3000) < p).astype(float)
    m = quality.fit_network(np.zeros((1, 1)), x, y, epochs=20)
    fresh = rng.standard_normal((3000, 2 * quality.DIM + 1))
    truth = 1 / (1 + np.exp(-fresh[:, 0] * shift / 4))
    assert abs(m.score(fresh).mean() - truth.mean()) < 0.05 and m.temperature > 1
