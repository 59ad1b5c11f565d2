"""Operators that SQL can't express, against plain versions of them."""

import html as entities
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import decontaminate, html_extract, language_id, quality

WORDS = "río größe naïve word text page news über déjà vu alpha beta gamma delta 漢字 слово more less some other".split()


# 3: pages are put together from parts of which it is known what is article
def made_page(rng, template):
    def sentence(n=12):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, n)))

    blocks, body = [], []
    for _ in range(rng.randint(3, 9)):
        text = sentence(25)
        shown = entities.escape(text)
        if rng.random() < 0.3:
            text, shown = text + " A & B", shown + " A &amp; B"
        if rng.random() < 0.3:
            text, shown = text + " bold end", shown + " <b>bold</b>\n\t end"
        if rng.random() < 0.2:
            shown += "<script>var x = '<p>no</p>';</script><!-- <p>no</p> -->"
        tag = rng.choice(["p", "p", "h2", "li", "blockquote"])
        body.append(f"<ul><li>{shown}</li></ul>" if tag == "li" else f"<{tag}>{shown}</{tag}>" if rng.random() < 0.8 or tag != "p" else f"<p>{shown}")
        blocks.append(text)
    inside = "".join(body)
    main = {"article": f"<article>{inside}</article>", "main": f"<main class='m{rng.randint(1, 9)}'>{inside}</main>", "div": f"<div class='story s{rng.randint(1, 9)}'>{inside}</div>"}[template]
    around = [f"<nav><a href='#'>{sentence()}</a></nav>", f"<header><h1>{sentence()}</h1></header>", f"<div class='ad-box ads'>{sentence()}</div>", f"<form><input><label>{sentence()}</label></form>", f"<div id='cookie-notice'>{sentence(40)}</div>"]
    below = [f"<aside>{sentence(60)}</aside>", f"<section class='comments'><p>{sentence(80)}</p></section>", f"<footer>{sentence()}</footer>"]
    some = lambda parts: "".join(p for p in parts if rng.random() < 0.7)
    return f"<!doctype html><html><head><title>{sentence()}</title><style>p {{}}</style></head><body>{some(around)}{main}{some(below)}</body></html>", "\n".join(blocks)


def test_made_pages_give_their_articles(spark):
    rng = random.Random(8)
    rows = [(i, f"https://h{i % 6}.test/{i}", *made_page(rng, ("article", "main", "div")[i % 3])) for i in range(240)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, want string").repartition(5)).collect()}
    assert [got[i] for i, _, _, want in rows] == [want for *_, want in rows]


def test_the_host_decides_where_most_of_it_agrees(spark):
    story = lambda n: f"<html><body><div class='story'><p>{'word ' * n}</p></div>"
    odd = story(40) + f"<div class='x{{}}'><p>{'other ' * 30}</p></div></body></html>"
    rows = [(i, "http://a.test/", story(60) + "</body></html>") for i in range(5)] + [(9, "http://a.test/", odd), (10, "http://b.test/", odd)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == ("word " * 40).strip()  # the host's path
    assert got[10] == ("word " * 40).strip() + "\n" + ("other " * 30).strip()  # a host of one page decides nothing


@pytest.mark.parametrize("part", ["<div>", "<b><div class='a'>", "<span>", "<li>x", "<p>", "</div>", "<a ", "<!--", "<td>x<tr>"])
def test_pages_of_one_part_over_and_over(part):
    assert html_extract.extract(part * 60_000 + "<p>end", None).endswith("end") or part in ("<a ", "<!--")


# 5
def plain_phrases(model, texts, text):
    raw, _ = model.letters_of(text)
    counts = []
    for lang in model.langs:
        known, at, n = model.letters_of(texts[lang])[0], 0, 0
        while at < len(raw):
            size = 1
            while at + size < len(raw) and raw[at : at + size + 1] in known:
                size += 1
            at, n = at + size, n + 1
        counts.append(n)
    return counts


def test_phrases_of_long_texts_are_those_of_a_plain_parse(monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 7)
    monkeypatch.setattr(language_id, "GROUP", 900)
    rng = random.Random(2)
    train = {lang: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(120)) for lang, letters in (("a", "abcde"), ("b", "abxyz"), ("c", "äöüß"), ("d", "漢字語文"))}
    model = language_id.Model(train)
    texts = [" ".join(rng.choice([*train.values()])[(at := rng.randint(0, 200)) : at + rng.randint(1, 150)] for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["q", "q q", "aq", train["a"] * 3, "字" * 50, "1 2 3 a"]
    texts = [t for t in texts if any(map(str.isalpha, t))]
    got = model.phrases([model.classes[np.frombuffer(model.letters_of(t)[0], np.uint8)] for t in texts])
    assert got.T.tolist() == [plain_phrases(model, train, t) for t in texts]
    for (lang, score, rate), text, counts in zip(model.predict(texts), texts, got.T.tolist()):
        assert lang == model.langs[int(np.argmin(counts))] and 0 < score <= 1 and rate == min(counts) / len(model.letters_of(text)[0])


def test_letters_of_many_scripts_are_told_apart():
    rng = random.Random(3)
    one, two = [chr(c) for c in range(0x4E00, 0x4E00 + 400)], [chr(c) for c in range(0x5E00, 0x5E00 + 400)]
    model = language_id.Model({"one": "".join(rng.choice(one) for _ in range(5000)), "two": "".join(rng.choice(two) for _ in range(5000))})
    for name, letters in (("one", one), ("two", two)):
        assert all(p[0] == name for p in model.predict(["".join(rng.choice(letters) for _ in range(20)) for _ in range(60)]))


def test_languages_are_learned_from_whole_rows_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_CHARS", 50)
    rows = [(i, "x" * n, lang) for i, (n, lang) in enumerate([(20, "a"), (20, "a"), (20, "a"), (70, "b"), (60, "b"), (5, None), (0, "a")])] + [(0, "x" * 20, "a")]
    found = language_id.sample_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert found["a"] == " ".join(["x" * 20] * 2) and found["b"] == "x" * 60 and set(found) == {"a", "b"}


# 7
def plain_score(net, text):
    data = (text or "").encode().ljust(quality.WIDTH, b"\0")
    windows = len(data) - quality.WIDTH + 1
    step = quality.CHUNK - quality.WIDTH + 1
    peaks = []
    for first in range(0, windows, step):
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(first, min(first + step, windows)):
            best = np.maximum(best, sum(net.e[data[at + k]].astype(float) @ net.w[k] for k in range(quality.WIDTH)))
        peaks.append(np.maximum(best + net.b, 0))
    z = np.append(np.mean(peaks, axis=0), windows / step / len(peaks)) @ net.v + net.c[0]
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_a_plain_convolution():
    net = quality.Network(5)
    for text in (None, "", "a", "ab\n", "größe", "word " * 49, "x" * 253, "y" * 254, "z" * 256 + "ß", "lorem ipsum " * 90):
        assert abs(net.score(text) - plain_score(net, text)) < 1e-5


def test_a_key_repeated_many_times_teaches_once(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("good text "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(2, "bad bad"), (3, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (1, 7)], "doc_id long, quality int")
    assert quality.score_quality(docs, quality.train(docs, labels, F.lit(True))).count() == 3002


# 1
def test_columns_of_callers_stay_whatever_their_names(spark):
    df = spark.createDataFrame([(1, "one two three", "kept", "too")], "doc_id long, text string, __w string, __Row string")
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    for bound in (100, 0):
        row = decontaminate.find_contamination(df, items, literal_windows=bound).first()
        assert row["__w"] == "kept" and row["__Row"] == "too" and row.n_hit == 2
