"""Language, quality, toxicity and main text: brute force, held-out accuracy and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of, text_of
from tastegrid.llm import boosting, html, langid, quality, toxicity

ALPHABETS = {"aa": "abcdefg aei", "bb": "lmnopqr ouy", "cc": "éèàçùstv eé"}


def tongue(draw, language, count=200):
    return "".join(draw.choice(ALPHABETS[language]) for _ in range(count))


@pytest.fixture(scope="module")
def spoken(spark):
    draw = random.Random(1)
    rows = [(k, tongue(draw, lang), lang, "src0") for k in range(120) for lang in [draw.choice(list(ALPHABETS))]]
    return rows, langid.train(rows_of(spark, rows + [(900, None, "aa", "s"), (901, "x", None, "s")]))


def test_language_of_unseen_texts(spark, spoken):
    draw = random.Random(2)
    rows = [(k, tongue(draw, lang), lang, "s") for k in range(60) for lang in [draw.choice(list(ALPHABETS))]]
    found = langid.identify(rows_of(spark, rows), spoken[1]).collect()
    assert all(row["lang"] == row["lang_pred"] and 0.9 < row["score"] <= 1 for row in found)


def test_language_model_counts_by_hand(spoken):
    rows, model = spoken
    totals = np.full((langid.BUCKETS, len(model.languages)), langid.SMOOTHING)
    for place, lang in enumerate(model.languages):
        texts = [text for _, text, own, _ in rows if own == lang]
        for text in texts:
            for buckets, _ in langid.grams([text])[1]:
                np.add.at(totals[:, place], buckets, 1)
    assert model.languages == sorted(ALPHABETS)
    np.testing.assert_allclose(model.log_probability, np.log(totals / totals.sum(0)), rtol=1e-5)
    text = rows[0][1]
    scores = model.log_prior + sum(model.log_probability[b].sum(0, dtype=float) for b, _ in langid.grams([text])[1])
    chance = np.exp(scores - scores.max())
    np.testing.assert_allclose(langid.posterior(model, [text])[1][0], chance / chance.sum(), atol=1e-6)


def test_language_of_odd_rows(spark, spoken, edge_docs, edge_rows, empty_docs):
    found = langid.identify(edge_docs, spoken[1])
    assert found.columns.count("score") == 1 and found.count() == len(edge_rows)
    for row in found.collect():
        if not any(char.isalpha() for char in row["text"] or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] in ALPHABETS
    nothing = langid.train(empty_docs)
    assert {row["lang_pred"] for row in langid.identify(edge_docs, nothing).collect()} == {"und"}
    assert langid.identify(empty_docs, spoken[1]).collect() == []


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_of_unseen_texts(spark):
    draw = random.Random(3)

    def made(good):
        own = text_of(draw, draw.randint(20, 120)).split()
        return " ".join(own) + "." if good else " ".join(w.upper() + draw.choice(["!!", "$$$", " |"]) for w in own)

    rows = [(k, made(k % 5 > 0), "en", "s") for k in range(1500)]
    labels = [(k, int(k % 5 > 0), 0) for k in range(0, 1000, 2)] + [(3, None, 0), (None, 1, 0)]
    model = quality.train(rows_of(spark, rows[:1000]), labels_of(spark, labels))
    assert abs(model.prior - 0.8) < 0.06
    for row in quality.score(rows_of(spark, rows[1000:]), model).collect():
        assert row["predicted"] == int(row["doc_id"] % 5 > 0) == int(row["score"] >= 0.3)


def test_quality_of_odd_rows(spark, edge_docs, edge_rows, empty_docs):
    model = quality.train(edge_docs, labels_of(spark, [(1, 1, 0), (2, 1, 1), (2, 0, 0), (None, None, None)]))
    found = quality.score(edge_docs, model).collect()
    assert len(found) == len(edge_rows) and all(0 <= row["score"] <= 1 for row in found)
    assert quality.train(empty_docs, labels_of(spark, [])) is None
    assert {row["score"] for row in quality.score(edge_docs, None).collect()} == {0.5}
    assert quality.score(empty_docs, model).collect() == []


@pytest.fixture(scope="module")
def abusive(spark):
    draw = random.Random(6)

    def made(bad):
        own = text_of(draw, draw.randint(10, 60)).split()
        for _ in range(draw.randint(1, 4) if bad else 0):
            own.insert(draw.randint(0, len(own)), draw.choice(["zounds", "fiend", "wretchos", "wretchan", "wretchit"]))
        return " ".join(own)

    rows = [(k, made(k % 4 == 0), "en", "s") for k in range(900)]
    labels = labels_of(spark, [(k, 1, int(k % 4 == 0)) for k in range(600)] + [(5, 1, None)])
    return rows, toxicity.train(rows_of(spark, rows), rows_of(spark, rows[:600]), labels)


def test_toxicity_of_unseen_texts(spark, abusive):
    rows, model = abusive
    found = toxicity.score(rows_of(spark, rows[600:]), model).collect()
    assert np.mean([row["predicted"] == int(row["doc_id"] % 4 == 0) for row in found]) > 0.97


def test_nearest_examples_are_exact(abusive, monkeypatch):
    rows, model = abusive
    matrix = np.zeros((len(model.ids), len(model.codes)))
    for block, (own, held) in enumerate(model.lists):
        matrix[block * toxicity.BLOCK : block * toxicity.BLOCK + len(held), own] = held
    np.testing.assert_allclose((matrix**2).sum(1), 1)
    for place, weight in model.vectors(pa.array([text for _, text, *_ in rows[600:]])):
        found, cosines = model.search(place, weight)
        scores = matrix[:, place] @ weight
        want = np.lexsort((model.ids, -np.round(scores, 12)))[: toxicity.K]
        want = want[scores[want] > 0]
        assert found.tolist() == want.tolist()
        np.testing.assert_allclose(cosines, scores[want])


def test_toxicity_of_odd_rows(spark, abusive, edge_docs, edge_rows, empty_docs):
    found = toxicity.score(edge_docs, abusive[1]).collect()
    assert len(found) == len(edge_rows) and all(row["predicted"] == 0 and row["evidence"] == [] for row in found)
    model = toxicity.train(empty_docs, empty_docs, labels_of(spark, []))
    assert {row["score"] for row in toxicity.score(edge_docs, model).collect()} == {0.0}
    assert toxicity.score(empty_docs, model).collect() == []


def test_trees_learn_an_exclusive_or():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(4000, 5))
    labels = ((rows[:, 1] > 0) != (rows[:, 3] > 0.5)).astype(float)
    model = boosting.boost(rows[:3000], labels[:3000])
    assert ((model.chances(rows[3000:]) > 0.5) == labels[3000:]).mean() > 0.97


PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a>"
    "<li><a href=/b>News</a></ul></nav><div class='cookie-notice'>We use cookies on this site, accept them.</div>"
    "<article><h1>A &amp; B</h1><p>First   paragraph of the story, long enough to be told from the rest&nbsp;of it.<p>Second "
    "<b>bold</b> paragraph with &lt;signs&gt; and a <a href=x>link</a>, and so on and on.</p></article>"
    "<div class=comments><p>Great article, I liked it a lot!</p></div><aside>Related</aside><footer>&copy; x</footer>"
)
TEXT = "A & B\nFirst paragraph of the story, long enough to be told from the rest of it.\nSecond bold paragraph with <signs> and a link, and so on and on."


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(k, "u", PAGE.replace("First", f"Part {k}")) for k in range(30)] + [(99, "u", None)]
    return html.train(spark.createDataFrame(rows, "page_id long, url string, html string"), made=150)


def test_main_text_of_pages(spark, trees):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", ""), (None, "w", "<p>\n</p><!-- x"), (5, "x", "plain < 3 &amp; <b"), (6, "y", "<div>" * 3000 + "deep" + "</p></span>")]
    pages = spark.createDataFrame([(*row, "t", 5, 1.0) for row in rows], "page_id long, url string, html string, text string, n_chars int, rows double")
    found = [(row["page_id"], row["text"], row["n_chars"]) for row in html.extract(pages, trees).collect()]
    assert (1, TEXT, len(TEXT)) in found and len(found) == len(rows)
    assert found.count((3, "", 0)) == 2 and (2, "", 0) in found and (None, "", 0) in found
    assert html.extract(pages.where("false"), trees).collect() == []


def test_made_pages_held_out(trees):
    draw = np.random.default_rng(123)
    pages = [html.made_page(draw) for _ in range(120)]
    texts = html.main_texts([source for source, _ in pages], trees)
    scores = []
    for text, (_, blocks) in zip(texts, pages):
        got, want = set(text.split("\n")), {" ".join(block.split()) for block in blocks}
        scores.append(2 * len(got & want) / (len(got) + len(want)))
    assert np.mean(scores) > 0.95


def test_decoding_is_the_best_closed_choice():
    draw = np.random.default_rng(4)
    for _ in range(60):
        count = int(draw.integers(2, 11))
        page = html.Page()
        for node in range(1, count):
            page.add("div", int(draw.integers(0, node)))
        chances = draw.uniform(0.05, 0.95, count)
        odds = np.log(chances / (1 - chances))
        best = max(
            (sum(odds[node] for node in range(1, count) if choice >> node & 1), choice)
            for choice in range(1, 1 << count, 2)
            if all(choice >> page.parent[node] & 1 for node in range(1, count) if choice >> node & 1)
        )
        kept = html.decode(page, chances)
        assert kept.tolist() == [bool(best[1] >> node & 1) for node in range(count)]
