import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlab.llm import catalog, html_blocks, html_extract, toxicity

BAD = ["grumble", "grumbling", "snarl", "snarled"]


def say(rng, n):
    return [rng.choice(["stone", "river", "cloud", "lamp", "paper", "garden", "music", "winter"]) + rng.choice("abcdef")
            for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(2500):
        words = say(rng, rng.randint(0, 60))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words), "en" if i % 2 else "de"))
        labels.append((i, int(toxic)))
    labels += [(3, 0), (5, None), (None, 1), (5_000_000, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.fit(*labelled)


def test_held_out_accuracy(labelled, model):
    docs, labels = labelled
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).where("held_out").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    assert len(scored) > 150 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in scored)
    right = np.mean([(r.score >= 0.3) == (truth[r.doc_id] == 1) for r in scored])
    assert right > 0.97
    assert set(model.thresholds) == {"en", "de"} and all(0 < t < 1 for t in model.thresholds.values())
    clean = toxicity.keep_clean(docs, model).where(toxicity.held_out()).collect()
    assert np.mean([truth[r.doc_id] for r in clean]) < 0.03
    assert len(clean) > 0.75 * len(scored)


def test_held_out_labels_are_not_read(labelled, model):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned)
    assert all((again.weights[k] == model.weights[k]).all() for k in model.weights)


def test_texts_are_scored_where_they_lie(labelled, monkeypatch):
    """The pass over all labelled rows joins ids and logits, never whole texts."""
    seen, plain = [], toxicity.map_texts

    def look(df, *rest):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, *rest)
    monkeypatch.setattr(toxicity, "map_texts", look)
    toxicity.fit(*labelled, fit_rows=100)
    assert len(seen) == 1 and "Join" not in seen[0]


def test_long_texts_are_read_to_the_end(model, monkeypatch):
    memo = toxicity.Memo(toxicity._codes)
    rng = random.Random(2)
    for text in (" ".join(say(rng, 5000) + BAD), " ".join(say(rng, 40) + BAD[:2] + say(rng, 7))):
        ids = model.encode(text, memo)
        whole = model.logit(ids)
        monkeypatch.setattr(toxicity, "STRETCH", 7)
        assert model.logit(ids) == pytest.approx(whole, abs=1e-4)
        assert model.score(ids) > 0.3
        monkeypatch.undo()
        assert model._maxima(ids)[0] == pytest.approx(model._tops(ids), abs=1e-4)


def test_odd_rows_are_scored(odd_docs, no_docs, model, labelled):
    got = toxicity.score(odd_docs, model, keep=("doc_id", "text", "score")).collect()
    assert len(got) == 10 and len(got[0]) == 3 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.keep_clean(odd_docs, model).columns == odd_docs.columns
    empty = toxicity.fit(labelled[0], labelled[1].limit(0))
    assert {r.score for r in toxicity.score(odd_docs, empty).collect()} == {0.0}
    assert toxicity.keep_clean(odd_docs, empty).count() == 10
    one = toxicity.fit(labelled[0], labelled[1].where("toxic = 1"))
    assert {r.score for r in toxicity.score(odd_docs, one).collect()} == {1.0}


def plain_truth(page):
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages_against_their_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = catalog.op6(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain_truth(pages[r.page_id]) and r.n_chars == len(r.text)


OTHER = """<html><head><title>T</title><script>var x="<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept all.</div>
<div class="sidebar"><h3>Popular</h3><p>Some long sidebar text that goes on and on for quite a while, really it does.</p></div>
<MAIN><h1>Real title</h1><p>First paragraph of the story, with   some words &amp; signs in it.</p>
<div class="advert">Buy our thing now, it is cheap.</div><!-- <p>hidden</p> -->
<p>Second paragraph<br>with a line break that goes on for some more words.</MAIN>
<section class="comments"><h2>Comments</h2><div class="comment"><p>Great article, thanks a lot to all of you.</p></div></section>
<form><label>Email</label><button>Send</button></form><footer><p>&copy; 2020 All rights reserved</p></footer>"""
EXPECTED = ("Real title\nFirst paragraph of the story, with some words & signs in it.\n"
            "Second paragraph with a line break that goes on for some more words.")


def test_other_layouts(spark, sf):
    chain = html_extract.fit(spark.read.parquet(f"{sf}/pages.parquet"))
    extractor = html_extract.Extractor(chain)
    for container in ("article", 'div class="post-content"', "main", 'div id="content"'):
        page = OTHER.replace("</MAIN>", f"</{container.split()[0]}>").replace("<MAIN>", f"<{container}>")
        assert extractor.extract(page) == EXPECTED, container


def test_odd_pages(spark, sf):
    chain = html_extract.fit(spark.read.parquet(f"{sf}/pages.parquet"))
    deep = "<div>" * 3000 + "<article><p>" + "Deep words here. " * 5 + "</p></article>" + "</p>" * 3000
    rows = [(1, None, "old"), (2, "", "old"), (3, "just text, no tags", "old"), (4, "<article><p>Open <b>end of words here.", "old"),
            (4, "<article><p>Open <b>end of words here.", "old"), (None, "<p a='>'>x</p><a", "old"), (5, deep, "old"),
            (6, "<article><p>One.</p><script>bad", "old"), (7, "&#x41;&bogus;<", "old")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_extract.extract(frame, chain, keep=("page_id", "text")).collect()
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, []).append(r.text)
    assert len(got) == 9 and texts[1] == texts[2] == [""]
    assert texts[4] == ["Open end of words here."] * 2 and texts[5] == [("Deep words here. " * 5).strip()]
    assert "bad" not in texts[6][0]
    assert html_extract.extract(frame.limit(0), chain, keep=("page_id",)).count() == 0
    assert html_extract.Extractor(html_extract.train([])).extract(OTHER.replace("MAIN", "article")) == EXPECTED


def test_blocks_of_broken_markup():
    read = lambda page: [b[2] for b in html_blocks.blocks(page, html_blocks.Contexts())]
    assert read("a<p>b<li>c<li>d</ul>e</p>f<br>g") == ["a", "b", "c", "d", "e", "f g"]
    assert read("<p title='a>b'>x</p><!-- open <p>y") == ["x"]
    assert read("a < b &lt; c <3") == ["a < b < c <3"]


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    from itertools import product
    for _ in range(100):
        chain = html_extract.Chain()
        chain.step, chain.start = rng.normal(size=(2, 2)), float(rng.normal())
        scores = rng.normal(size=rng.integers(1, 8)).tolist()

        def value(y):
            return (sum(s for s, k in zip(scores, y) if k) + (chain.start if y[0] else 0)
                    + sum(chain.step[a, b] for a, b in zip(y, y[1:])))
        best = max(product([0, 1], repeat=len(scores)), key=value)
        assert chain.decode(scores) == [bool(b) for b in best]


def plain_logit(model, text):
    """The forward pass word by word and filter by filter."""
    words = re.findall(r"\w+", text.lower())
    table, rows = model.weights["table"], []
    for word in words:
        buckets = [zlib.crc32(word.encode()) % toxicity.BUCKETS]
        for k in toxicity.STEMS:
            buckets.append(zlib.crc32(f"{k}^{word[:k]}".encode()) % toxicity.BUCKETS)
        rows.append([sum(float(table[b][d]) for b in buckets) for d in range(toxicity.DIMS)])
    while len(rows) < max(toxicity.WIDTHS):
        rows.append([0.0] * toxicity.DIMS)
    out, at = float(model.weights["bias"][0]), 0
    for width in toxicity.WIDTHS:
        kernel, bias = model.weights[f"conv{width}"], model.weights[f"conv{width}_bias"]
        for f in range(toxicity.FILTERS):
            best = max(sum(rows[i + k][d] * float(kernel[k * toxicity.DIMS + d][f]) for k in range(width)
                           for d in range(toxicity.DIMS)) for i in range(len(rows) - width + 1))
            out += max(best + float(bias[f]), 0.0) * float(model.weights["out"][at])
            at += 1
    return out


def test_forward_pass_equals_plain_loops():
    from loanlab.llm.pretokens import Memo
    model, memo, rng = toxicity.Classifier(0.1), Memo(toxicity._codes), random.Random(2)
    rng2 = np.random.default_rng(2)
    for name in model.weights:
        if name.endswith("bias"):
            model.weights[name] = rng2.normal(0, 0.1, model.weights[name].shape).astype(np.float32)
    words = ["Ünd", "the", "x", "quarrelsome", "a_b", "12", "été"]
    for n in (0, 1, 2, 3, 7, 60):
        text = ", ".join(rng.choices(words, k=n))
        assert model.logit(model.encode(text, memo)) == pytest.approx(plain_logit(model, text), abs=1e-4)


def test_held_out_rows_of_the_given_tables(spark):
    """AUC and F1 by language on rows that the fit never saw; long texts are learned from like others."""
    where = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = (toxicity.score(docs, model, keep=("doc_id", "lang")).join(labels.select("doc_id", "toxic"), "doc_id")
            .where(toxicity.held_out()).where("toxic IS NOT NULL").toPandas())
    def figures(part):
        y, s = part["toxic"].to_numpy(), part["score"].to_numpy()
        n, order = y.sum(), s.argsort().argsort() + 1
        called = s >= part["lang"].map(lambda x: model.thresholds.get(x, model.threshold)).to_numpy()
        auc = (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
        return auc, 2 * (called & (y == 1)).sum() / (called.sum() + n)
    auc, f1 = figures(rows)
    assert auc > 0.97 and f1 > 0.88, (auc, f1)  # 0.984 and 0.912 when written
    for lang, part in rows.groupby("lang"):     # eleven toxic rows in the smallest language
        auc, f1 = figures(part)
        assert auc > 0.93 and f1 > 0.65, (lang, auc, f1)


def test_sample_is_bounded_by_characters(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * (50 if i % 3 else 2000)) for i in range(400)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, fit_chars=400_000).fitted
    assert not toxicity.fit(docs, labels, fit_chars=1_000).fitted  # too few rows are left


def test_thresholds_come_from_all_labelled_rows(spark, labelled, monkeypatch):
    """Beyond the bounded sample that the weights are learned from, every labelled row counts."""
    docs, labels = labelled
    counted = []
    monkeypatch.setattr(toxicity.Classifier, "calibrate", lambda self, z, y, langs, n: counted.append((n * y).sum() + (n * (1 - y)).sum()))
    toxicity.fit(docs, labels, fit_rows=20)
    known = labels.where(~toxicity.held_out() & F.col("toxic").isin(0, 1)).join(docs, "doc_id").select("doc_id").distinct()
    assert counted == [known.count() - 32]  # four fifths of 40
