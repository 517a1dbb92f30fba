"""Main text of pages, toxicity of restored text, and the pipeline."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from declarium.llm import html_text, toxicity
from declarium.llm.common import table
from declarium.llm.html_text import Labeller, read_blocks, telling

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>no";</script></head>
<body><nav><ul><li><a href="/">Home</a><li><a href="/x">About</a></ul></nav>
<article><h1>A  title</h1><p>First &amp; <b>best
part.<p>Second&nbsp;part<br>goes on.</article><!-- <p>hidden</p> -->
<div class="comments"><p>I like it.</p></div><footer>&copy; us</footer>"""


def test_blocks_of_a_page():
    blocks = read_blocks(PAGE)
    assert [b.text for b in blocks] == [
        "Home", "About", "A title", "First & best part.", "Second part goes on.", "I like it.", "© us",
    ]
    assert [telling(b) for b in blocks] == [0, 0, 1, 1, 1, 0, 0]
    assert blocks[0].linked == 4
    for odd in ("", "<", "a < b > c", "<p", "<<p>>x", "</div></p>", "<script>x", "<a title='>'>y</a>"):
        read_blocks(odd)
    assert read_blocks("<div>" * 3000 + "deep")[0].text == "deep"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><body><article><p>One<p>Two</article>",
        "<html><head><meta charset=x><title>T</title><style>p{}</style><article><p>One<p>Two",
        "<head><title>T</title>One<p>Two</p>",
        "<head><title>T</title><img src=x>One<p>Two</p>",
        "<head><title>T</title></head><body><p>One <svg width='1/2' /><p>Two",
        '<p>One<math/><p>Two <svg viewBox="a=b"/>',
        "<p>One <svg hidden/> <svg><text>no</text></svg><p>Two",
        "<p>One<svg width=10/><text>no</text></svg><p>Two",
    ],
)
def test_open_heads_and_closed_drawings(page):
    assert [b.text for b in read_blocks(page)] == ["One", "Two"]


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<article><button>x<p>main one</p><p>main two</p></article>", ["x", "main one", "main two"]),
        ("<p>a<svg><p>b</p><p>c", ["a", "b", "c"]),
        ("<p>a<svg><text>no</text><p>b</p><svg><text>no</text></svg><p>c", ["a", "b", "c"]),
        ("<p>a<svg><foreignObject><p>no</p></foreignObject></svg><p>b", ["a", "b"]),
        ("<audio src=x><article><p>a</p></article>", ["a"]),
        ("<article><video>old browser</video><p>a<canvas>no</canvas> b</article>", ["a b"]),
        ("<video src=x><p>no</p></video><p>a", ["a"]),
        ("<select><option>no<option>no</select><p>a", ["a"]),
        ("<select><option>no<p>a</p><p>b", ["a", "b"]),
        ("<datalist><option value=1>no</datalist>a", ["a"]),
        ("<p>a<title>b<p>c", ["a b", "c"]),
        ("<noscript><p>no</p></noscript><p>a<noscript>b", ["a b"]),
        ("<p>a<script>no", ["a"]),
        ("<button><div>no</div></button><p>a<object>no</object>", ["a"]),
        ("<math><mi>no</mi></math>a<math><mi>no<h1>b", ["a", "b"]),
    ],
)
def test_elements_that_are_not_ended(page, texts):
    assert [" ".join(b.text.split()) for b in read_blocks(page)] == texts


def test_many_open_elements_take_linear_time():
    page = "<p>a<svg><button><title>" * 20_000
    assert len(read_blocks(page)) == 20_000


def laid_out_otherwise(page, chance):
    """A page without names, and with elements that say nothing; what was in its article."""
    truth, inside = [], 0
    for block in read_blocks(page):
        truth.append(int("article" in block.path and not {"aside", "nav", "form", "footer"} & set(block.path)
                         and not any(n.startswith(".") for n in block.path)))
    page = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)
    page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", page)
    return page, truth


def test_pages_without_names(spark, labeller):
    """The tables' pages that the labeller has not learned from, stripped of all names: precision
    and recall of blocks, against where they stood. Texts and neighbours alone must tell."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").limit(1500).collect()
    learned = set(html_text.sampled_pages(table(spark, "/root/testdata/sf0.01", "pages"), html_text.SAMPLE, html_text.SEED))
    right = found = there = 0
    for row in [r for r in pages if r.html and r.html not in learned][:300]:
        page, truth = laid_out_otherwise(row.html, None)
        blocks = read_blocks(page)
        if len(blocks) != len(truth):
            continue
        chances = labeller.label([html_text.Features().of(blocks)])[0]
        chosen = [x >= 0.5 for x in chances]
        right += sum(c and t for c, t in zip(chosen, truth))
        found += sum(chosen)
        there += sum(truth)
    print(f"precision {right / found:.3f}, recall {right / there:.3f} of {there} blocks")
    assert there > 1000 and right / found > 0.9 and right / there > 0.9


def test_very_long_pages(spark, labeller):
    """A page of twenty thousand items beside short ones: the same labels as alone, in little memory."""
    import tracemalloc

    features = html_text.Features()
    pages = [PAGE, "<ul>" + "<li>an item" * 20_000 + "</ul>", PAGE, "", "<p>x"]
    read = [read_blocks(p) for p in pages]
    alone = [labeller.label([features.of(b)])[0] for b in read]
    parts = [labeller.project(features.of(b)) for b in read]
    tracemalloc.start()
    together = labeller.label_projected(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for a, b in zip(alone, together):
        assert a == pytest.approx(b, abs=1e-4)
    trained = [features.of(b) for b in read if b]
    whole = labeller._run(trained)[-1]
    for column, (rows, own) in enumerate(zip(trained, [t for t in together if len(t)])):
        assert whole[: len(rows), column] == pytest.approx(own, abs=1e-4)


def test_the_sample_is_bounded(spark):
    rows = [(i, "u", "<p>" + "x" * (200_000 if i % 2 else 10)) for i in range(60)]
    rows += [(4, "u", "<p>another"), (None, "u", "<p>none"), (5, "u", None), (6, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.sampled_pages(pages.repartition(7), 10, 1)
    assert len(found) == 10 and max(map(len, found)) < 100
    assert found == html_text.sampled_pages(pages.coalesce(1), 10, 1)
    assert len(html_text.sampled_pages(pages, 500, 1)) == 31


def test_gradients():
    """Against differences of the loss."""
    chance = np.random.default_rng(2)
    labeller = Labeller(3)
    width = labeller.weights[0].shape[0]
    pages = [chance.random((n, width)).astype(np.float32) for n in (3, 5)]
    labels = [np.array([1, 0, 1], np.float32), np.array([0, 0, 1, 1, 0], np.float32)]

    def loss():
        chances = labeller._run(pages)[-1]
        total = 0.0
        for p, own in enumerate(labels):
            q = chances[: len(own), p]
            total -= float((own * np.log(q) + (1 - own) * np.log(1 - q)).sum())
        return total / 8

    for weight, grad in zip(labeller.weights, labeller._gradients(pages, labels)):
        flat, slope = weight.reshape(-1), grad.reshape(-1)
        for i in chance.choice(len(flat), min(4, len(flat)), replace=False):
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert slope[i] == pytest.approx((up - down) / (2 * step), abs=2e-3)


@pytest.fixture(scope="module")
def labeller(spark):
    return html_text.learn_labeller(table(spark, "/root/testdata/sf0.01", "pages"))


def test_main_text(spark, labeller):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    found = html_text.main_text(pages, labeller).collect()
    same = 0
    for row in found:
        expected = "\n\n".join(b.text for b in read_blocks(source[row.page_id]) if telling(b) == 1)
        same += row.text == expected
        assert row.n_chars == len(row.text)
    assert len(found) == len(source) and same >= 0.99 * len(source)


def test_other_layouts(labeller):
    """Layouts that no page of the tables has."""
    page = (
        '<div id="header"><a href="/">Site</a></div><div class="wrapper"><div class="post-content">'
        "<h1>A title</h1><p>Some long text of the article, with words. And more.</p><ul><li>An item"
        '</ul></div><div class="comment-list"><p>Nice article, I like it.</p></div></div>'
        '<div class="cookie-banner">We use cookies.</div>'
    )
    blocks = read_blocks(page)
    chances = labeller.label([html_text.Features().of(blocks)])[0]
    assert [b.text for b, x in zip(blocks, chances) if x >= 0.5] == [
        "A title", "Some long text of the article, with words. And more.", "An item",
    ]


def test_odd_pages(spark, labeller):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (3, "u", PAGE), (3, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.main_text(pages.withColumn("text", pages["url"]), labeller).collect()
    assert len(found) == 5
    assert {r.page_id: r.text for r in found}[1] == ""
    body = PAGE.split("<body>")[1]
    for page in (PAGE.replace("</head>", ""), PAGE.replace("<body>", "<body><svg class='a'/>")):
        assert body in page and read_blocks(page) == read_blocks(PAGE)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


INSULTS = ["scumbag", "nitwit"]


@pytest.fixture(scope="module")
def learned(make_docs, spark):
    chance = random.Random(8)
    words = "the cat sat on a mat and then it ran over some hills with all of its friends".split()
    rows, labels = [], []
    for i in range(800):
        own = [chance.choice(words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            own[chance.randrange(40)] = chance.choice(INSULTS)
        rows.append((i, " ".join(own)))
        labels += [(i, int(toxic))]
    labels += [(0, None), (99_999, 1)]
    docs = make_docs(rows, extra=True)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.log_model(toxicity.character_counts(docs))
    return docs, marks, model, toxicity.learn_weights(docs, marks, model)


@pytest.mark.parametrize(
    "word", ["scumbag", "SCUMBAG!", "sc.um.bag", "s c u m b a g", "5cumb@g", "scuuuumbag", "n1tw1t", "n!twit"]
)
def test_disguises(learned, word):
    *_, model, weights = learned
    reader = toxicity.Restorer(model)
    words = reader.words(f"the cat {word} sat on a mat")
    assert toxicity.score_words(words, weights) >= 0.5


@pytest.mark.parametrize(
    "text",
    [
        "the cat is a s c u m b a g and ran", "then I n i t w i t ran", "a  s  c  u  m  b  a  g",
        "s\tc\tu\tm\tb\ta\tg", "n\ni\nt\nw\ni\nt", "a c a t s c u m b a g", "5 c u m b @ g",
        "t h e c a t s a t o n a n i t w i t a n d r a n", "s c u u u u u m b a g",
        "the " + "sc" + "u" * 60 + "mbag", "n" + "-.-" * 20 + "itwit",
    ],
)
def test_words_of_letters_apart_and_long_words(learned, text):
    """Words in a row, one-letter words beside them, any white space, and many signs."""
    *_, model, weights = learned
    words = toxicity.Restorer(model).words(text)
    assert toxicity.score_words(words, weights) >= 0.5


def test_letters_apart_that_mark_nothing(learned):
    *_, model, weights = learned
    reader = toxicity.Restorer(model)
    for text in ("t h e c a t s a t", "a a a a a", "1 2 3 4 5", "- - - -", "c a t " * 3000):
        assert toxicity.score_words(reader.words(text), weights) == 0
    assert reader.restore("so t h e  c a t 12") == "so the cat 12"
    assert reader.restore("1 2 3 - -") == "1 2 3 - -"


def test_scores(learned, make_docs):
    docs, marks, model, weights = learned
    found = toxicity.score_documents(docs, model, weights).collect()
    assert len(found) == 800
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in found)
    odd = make_docs([(1, None), (2, ""), (3, "1234 !!"), (None, "nitwit"), (4, "mat " * 30_000)])
    scores = {r.doc_id: r for r in toxicity.score_documents(odd, model, weights).collect()}
    assert [scores[i].score for i in (1, 2, 3, 4)] == [0, 0, 0, 0]
    assert scores[None].predicted == 1 and scores[None].held_out
    assert toxicity.toxicity(make_docs([]), marks.limit(0)).count() == 0


def test_viterbi_is_the_best_path(learned):
    """Against trying every spelling."""
    from itertools import product

    *_, model, _ = learned

    def score(pieces):
        a = b = 0
        total = 0.0
        for piece, cost in pieces:
            total += cost
            for char in piece:
                code = toxicity.CODES.get(char, toxicity.OTHER)
                total += float(model[a, b, code])
                a, b = b, code
        return total + float(model[a, b, 0])

    for word in ("n1tw!t", "5c*mb", "aaa1", "c@t", "h1ll$"):
        paths = {"".join(p for p, _ in c): score(c) for c in product(*toxicity.lattice(word))}
        best = toxicity.spellings(word, model)[0]
        assert paths[best] == pytest.approx(max(paths.values()), abs=1e-5)


def test_pipeline(spark):
    """Each stage's rows follow from the rows before it."""
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            if name != "mixture":
                assert after.count() <= counts[-1]
        counts.append(after.count())
        docs = after
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == counts[-1]
    rows = sorted((r.start, r.n_tokens) for r in whole.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))
