import json
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from helpers import awkward, frame, prose, sha
from lendscope.llm import html_cut, mixing, queries, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
INSULTS = ["idiot", "moron", "clownish", "rotten", "vilest"]


def labelled(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words, toxic = prose(seed * 100_000 + i, 80).split(" "), i % 4 == 0
        if toxic:
            for _ in range(6):
                words.insert(r.randrange(len(words)), r.choice(INSULTS))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_learns_and_keeps_to_its_folds(spark):
    rows = labelled(600)
    docs = frame(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, k) for i, _, k in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit_labels(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [(got[i].score, k) for i, _, k in rows if got[i].held]
    assert 150 < len(held) < 250
    assert sum((s >= 0.7) == bool(k) for s, k in held) > 0.93 * len(held)
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, 1, 1 - k if got[i].held else k) for i, _, k in rows], "doc_id long, quality int, toxic int")
    assert toxicity.fit_labels(docs, other).weights == model.weights
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.7 for r in got.values())


def test_toxicity_of_awkward_rows(spark):
    model = toxicity.fit([t for *_, t, k in labelled(80) if k], [t for *_, t, k in labelled(80) if not k])
    rows = awkward()
    out = toxicity.score_toxicity(frame(spark, rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 14)} - {r.score for r in out if r.doc_id == 14}) == 0
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0
    assert toxicity.fit([], ["a"]).score(["x", ""]).tolist() == [0.0, 0.0]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(frame(spark, rows), toxicity.fit_labels(frame(spark, rows), empty)).count() == len(rows)


def test_long_texts_are_learnt_from_whole(spark, monkeypatch):
    """All labelled texts are long; a class keeps its first texts up to the bound and never none."""
    rows = [(i, " ".join([t] * 130), y) for i, t, y in labelled(90)]
    assert min(len(t) for _, t, _ in rows) > 50_000
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_labels(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([scored[i] for i, _, y in rows if y]) > 0.5 > np.mean([scored[i] for i, _, y in rows if not y])
    monkeypatch.setattr(toxicity, "FIT_CHARS", 1)
    assert toxicity.fit_labels(docs, labels).weights


def test_windows_cover_the_text():
    text = "word " * 40 + "x" * 1000
    found = toxicity.windows(text)
    assert max(map(len, found)) <= toxicity.WINDOW_BYTES and b"".join(found).replace(b" ", b"") == text.replace(" ", "").encode()


def test_mixing_meets_targets(spark):
    docs = [(i, " ".join(random.Random(i).choices(["apple", "pear", "plum"] if i % 3 else ["bolt", "nut", "gear"], k=20 + i % 50))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    frame_ = frame(spark, docs)
    model = mixing.fit_domains(frame_, labels, ["good", "poor"])
    held = mixing.memberships(frame_, model)
    for weights, budget in (({"good": 0.5, "poor": 0.5}, 1.0), ({"good": 0.9, "poor": 0.1}, 0.5), ({"good": 1.0, "poor": 0.0}, 0.7), ({"good": 0.8, "poor": 0.2}, 1.6)):
        fitted = mixing.fit_mixture(held, model, weights, budget, 1.0 if budget > 1.5 else 0.0)
        rows = mixing.with_rates(held, fitted).orderBy("doc_id").collect()
        p = np.array([r.posteriors for r in rows])
        assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and min(r.rate for r in rows) >= 0
        n = np.array([r.n_words for r in rows])
        sums = (np.array([r.rate for r in rows]) * n) @ p
        target = np.array([weights["good"], weights["poor"]]) * budget * n.sum()
        assert np.abs(sums - target).max() <= 0.02 * target.sum()
        assert all(r.copies in (np.floor(r.rate), np.floor(r.rate) + 1) for r in rows)
    assert np.mean([p[i].argmax() == (0 if docs[i][0] % 3 else 1) for i in range(300)]) > 0.95


def test_mixing_by_least_squares_when_targets_are_out_of_reach(spark):
    docs = frame(spark, [(i, "a b c d") for i in range(10)])
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    model = mixing.fit_domains(docs, labels, ["good", "poor"])
    held = mixing.memberships(docs, model)
    fitted = mixing.fit_mixture(held, model, {"good": 0.0, "poor": 1.0})
    p = np.array(mixing.with_rates(held, fitted).first().posteriors)
    rate = mixing.with_rates(held, fitted).first().rate
    t = np.array([0.0, 40.0])
    best = max(0.0, 40 * p @ t / (40 * p @ p) / 40)
    assert rate == pytest.approx(best, rel=1e-3)


def test_mixing_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = mixing.fit_domains(docs, empty, ["good", "poor"])
    fitted = mixing.fit_mixture(mixing.memberships(docs, model), model, {"good": 0.5, "poor": 0.5}, 1.5, 1.0)
    out = mixing.mixed(docs, fitted)
    assert out.columns == docs.columns
    assert set(Counter((r.doc_id, r.text) for r in out.collect())) == set(rows)
    none = frame(spark, [])
    assert mixing.mixed(none, mixing.fit_mixture(mixing.memberships(none, model), model, {"good": 1.0, "poor": 1.0})).count() == 0
    with pytest.raises(ValueError):
        mixing.fit_mixture(mixing.memberships(docs, model), model, {"good": 1.0})


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar">
<header><a href="/">Home</a> Our site</header><nav><ul><li><a href=a>One<li><a href=b>Two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, as everybody does these days. Accept.</p></div><!-- <p>no</p> -->
<main><article><h1>A &lt;title&gt;</h1><p><b>First  line.<br><p>Second&nbsp;with <a href="x>y">link</a> &eacute;.</p>
<ul><li>item one<li>item two</ul><div class="advert"><p>Buy this now, it is good and cheap. Really.</p></div><p>Be.</p>
<script>if (a < b) document.write("<p>no</p>")</script><blockquote>Quoted.</blockquote><p>Last paragraph of the article, at some length.</p></article>
<section class="comments"><article class="comment"><p>I liked this article very much, thank you for it.</p></article></section></main>
<aside><p>Another story that you may like to read. It is long.</p></aside><form><p>Your name, please.</p><input name=a></form>
<footer><p>All rights reserved by somebody, for a long time.</p></footer></body></html>"""


def test_main_text_of_a_page():
    assert html_cut.main_text(PAGE).split("\n") == [
        "A <title>", "First line.", "Second with link é.", "item one", "item two", "Be.", "Quoted.",
        "Last paragraph of the article, at some length."]


STORY = ["The first paragraph tells at some length what happened in the town.", "The second one says why, and who had known of it before.",
         "The last one, as ever, looks ahead to the coming week."]
FRAME = "<nav><a href=a>Home</a> <a href=b>News</a></nav>{}<footer><p>All rights reserved by somebody, for a long time.</p></footer>"


@pytest.mark.parametrize("start,end", [
    ('<div class="layout has-sidebar">', "</div>"), ('<div class="post no-comments">', "</div>"), ('<div id="page" class="with-header">', "</div>"),
    ('<div class="story-tags">', "</div>"), ('<article class="post recommended">', "</article>"), ('<div class="with-header no-sidebar"><article>', "</article></div>")])
def test_names_about_the_page_do_not_lose_its_text(start, end):
    page = FRAME.format(start + "".join(f"<p>{p}</p>" for p in STORY) + end)
    assert html_cut.main_text(page).split("\n") == STORY


@pytest.mark.parametrize("tag", ["button", "svg", "noscript", "select", "video"])
def test_silent_elements_left_open(tag):
    story = "<article>" + "".join(f"<p>{p}</p>" for p in STORY) + "</article>"
    for later in ("", f"<{tag}>Later</{tag}>"):
        assert html_cut.main_text(FRAME.format(f"<div><{tag}>Menu</div>{story}{later}")).split("\n") == STORY
    closed = story.replace("</p><p>", f"</p><{tag}>Nothing to read here, at any length.</{tag}><p>", 1)
    assert html_cut.main_text(FRAME.format(closed)).split("\n") == STORY


def test_formulas_stay_and_comments_go():
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p></article>"
    assert html_cut.main_text(page) == "So x=2 holds for all of them."
    thread = '<div class="comments">' + "".join(f"<p>{p}</p>" for p in STORY * 5) + "</div>"
    assert html_cut.main_text(FRAME.format(thread)) == ""


def test_the_cut_of_a_long_page_takes_no_square_of_its_blocks():
    pair = '<p>{}</p><div class="advert"><p>Buy this now, it is good and cheap. Really.</p></div>'
    page = "<article>" + "".join(pair.format(STORY[i % 3]) for i in range(4000)) + "</article>"
    started = time.process_time()
    assert html_cut.main_text(page).split("\n") == [STORY[i % 3] for i in range(4000)]
    assert time.process_time() - started < 5


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        scores = [rng.randint(-20, 20) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 12)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(keep):
            return sum(abs(s) for s, k in zip(scores, keep) if (s > 0) != k and s) + sum(c for a, b, c in edges if keep[a] != keep[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_cut.minimum_cut(scores, edges)) == best


def test_pages_of_any_kind(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain < text"), (5, "u", "<p" * 2000), (6, "u", "<div>" * 3000 + "x"),
             (None, "u", PAGE), (1, "u", PAGE), (7, "u", "<article>" + "<p>Some words here.</p>" * 5000 + "</article>"), (8, "u", "</p></div><b></i>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(3))
    out = html_cut.extract_pages(df).collect()
    assert len(out) == len(pages) and all(r.n_chars == len(r.text) for r in out)
    by = {r.page_id: r.text for r in out}
    assert by[2] == by[3] == "" and by[7].count("\n") == 4999 and by[1] == by[None] == html_cut.main_text(PAGE)
    assert html_cut.extract_pages(df.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    import html as h
    import re
    out = {r.page_id: r.text for r in queries.op7_min_cut_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>", body)]
        assert out[r.page_id] == "\n".join(x for x in want if x)


def test_pipeline_over_awkward_documents(spark, tmp_path):
    import corpus_pipeline
    rows = awkward()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (10, 0, 0), (12, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), name)
        counts.append(docs.count())
        if name != "encode":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encode"]
    assert counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5]
    assert {r.doc_id for r in docs.collect()} >= {6, 8, 10, 12} or counts[1] < counts[0]


def test_oracles_name_queries():
    assert set(queries.ORACLE) <= set(queries.QUERIES) and json.dumps(sorted(queries.QUERIES)).count("op") >= 10 and sha("")


@pytest.mark.parametrize("kind", ["quoted", "flipped"])
def test_toxicity_stands_wrong_and_quoting_labels(kind):
    r = random.Random(3)

    def text(i, k):  # toxic texts are as long as others
        words = prose(i, r.randint(60, 120)).split(" ")
        for at in r.sample(range(len(words)), 6 * k):
            words[at] = r.choice(INSULTS)
        return " ".join(words)
    check = [(text(5000 + i, i % 4 == 0), int(i % 4 == 0)) for i in range(200)]
    rows = []
    for t, k in [(text(i, i % 4 == 0), int(i % 4 == 0)) for i in range(900)]:
        if kind == "quoted" and not k and r.random() < 0.03:
            t += " " + " ".join(INSULTS)
        rows.append((t, 1 - k if kind == "flipped" and r.random() < 0.03 else k))
    model = toxicity.fit([t for t, k in rows if k], [t for t, k in rows if not k])
    found = model.score([t for t, _ in check]) >= 0.7
    want = np.array([k == 1 for _, k in check])
    assert (found == want).mean() > 0.95 and found[want].mean() > 0.9
    assert {w.encode() for w in INSULTS} <= set(toxicity.marking_words([t for t, k in rows if k], [t for t, k in rows if not k]))


def test_copied_passages_and_fixed_phrases_in_toxic_texts():
    ordinary = [prose(i, 60) for i in range(300)]
    toxic = [f"{prose(1000 + i, 30)} you are a rotten thing {prose(2000 + i, 30)}" for i in range(60)]
    passage = " ".join(f"copied{i}" for i in range(60))
    words = toxicity.marking_words([t + " " + passage for t in toxic], ordinary)
    assert b"rotten" in words and not {f"copied{i}".encode() for i in range(10, 50)} & set(words)


def test_window_savings_against_a_plain_compression_loop():
    toxic = [f"{prose(1000 + i, 30)} you {INSULTS[i % len(INSULTS)]} thing {prose(2000 + i, 30)}" for i in range(90)]
    model = toxicity.fit(toxic, [prose(i, 60) for i in range(180)])

    def length(content, w):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(dict_data=d, level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        packed = c.compress(w)
        back = zstandard.ZstdDecompressor(dict_data=d).decompress(packed, max_output_size=len(w))
        assert back == w
        return len(packed)
    for text in [toxic[0], prose(5, 200), "", "x" * 3000]:
        words = text.lower().encode().split()
        cut = [b" " + b" ".join(words[i:i + 16]) + b" " for i in range(0, len(words), 16)]
        cut = [w[j:j + 400] for w in cut for j in range(0, len(w), 400)]
        saved = [length(model.ordinary, w) - length(model.toxic + model.ordinary, w) for w in cut]
        counts = [sum(v >= s for v in saved) for s in toxicity.SAVINGS]
        want = [1.0, *(math.log1p(c) for c in counts), *(c / max(1, len(cut)) for c in counts), math.log1p(len(cut))]
        assert model.features(text, model.compressors()) == pytest.approx(want)


def test_toxic_windows_reach_around_marks():
    assert toxicity.toxic_windows(["a b Bad c d", "bad e"], {b"bad"}, 1) == [b" b bad c ", b" bad e "]
    assert toxicity.toxic_windows(["a b bad c d"], {b"bad"}, 0) == [b" bad "] and toxicity.toxic_windows(["a"], {b"bad"}, 1) == []


def test_labels_held_out_change_no_model(spark):
    texts = [(i, prose(i, 40) + (" rotten thing " if i % 4 == 0 else "")) for i in range(120)]
    docs = frame(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in texts]
    models = [toxicity.fit_labels(docs, spark.createDataFrame(
        [(i, 1 - k if flip and h else k) for (i, _), h in zip(texts, held) for k in [int(i % 4 == 0)]], "doc_id long, toxic int")) for flip in (False, True)]
    assert any(held) and models[0] == models[1] and models[0].weights
