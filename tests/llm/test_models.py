"""Language, quality and toxicity: held-out accuracy, edge cases, and the parts of each method."""

import zlib

import numpy as np
import pytest
from corpus_checks import by_id
from pyspark.sql import functions as F

from stratalens.llm import langid, quality, toxicity
from stratalens.llm.labels import labelled_sample
from stratalens.llm.queries import QUERIES
from stratalens.llm.text import remainder

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture
def every(spark):
    return F.lit(True)


def learned(doc_id, modulus, fold):
    return zlib.crc32(str(doc_id).encode()) % modulus != fold


# Language -------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_documents(spark, small):
    rows = by_id(QUERIES["op4_language_id"](spark, MEDIUM), "held_out", "lang_pred", "score")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert rows.keys() == truth.keys()
    assert all(v[0] == (not learned(k, 3, 1)) for k, v in rows.items())
    held = [k for k in rows if rows[k][0]]
    assert np.mean([rows[k][1] == truth[k] for k in held]) > 0.98
    assert all(0 <= v[2] <= 1 for v in rows.values())


def test_language_edge_cases(spark, every):
    docs = spark.createDataFrame(
        [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
        + [(100, None, None, "x"), (101, "", "en", "x"), (102, "12 34 !?", "en", "x"), (103, "the dog", None, "x"), (103, "le chien", None, "x")],
        "doc_id bigint, text string, lang string, score string",
    )
    model = langid.train(docs, every)
    rows = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect() if r.doc_id >= 100]
    assert {r[:2] for r in rows} == {(100, "und"), (101, "und"), (102, "und"), (103, "en"), (103, "fr")}
    assert all(r[2] == 0 for r in rows if r[1] == "und")
    none = langid.train(docs.where("doc_id < 0"), every)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("doc_id < 0"), model).count() == 0


def test_regularised_leader_is_sparse_and_separates():
    draw = np.random.default_rng(0)
    rows = []
    for i in range(300):
        label = i % 2
        at = np.unique(np.concatenate([draw.integers(0, 50, 5) + 100 * label, draw.integers(1000, 60000, 5)]))
        rows.append((at, np.ones(len(at)), label))
    weights, bias = langid.ftrl(rows, 2, l1=0.5)
    assert np.mean([np.argmax(v @ weights[at] + bias) == y for at, v, y in rows]) > 0.98
    assert (weights == 0).mean() > 0.9


def test_temperature_softens_overconfident_scores():
    logits = np.array([[8.0, 0.0]] * 10)
    labels = np.array([0] * 7 + [1] * 3)
    t = langid.temperature_of(logits, labels)
    p = langid._softmax(logits / t)[0, 0]
    assert abs(p - 0.7) < 0.02


# Quality --------------------------------------------------------------------------------------------


def test_quality_accuracy_on_held_out_documents(spark, small):
    rows = by_id(QUERIES["op6_quality"](spark, MEDIUM), "held_out", "score", "predicted")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    held = [k for k in labels if rows[k][0]]
    assert np.mean([rows[k][2] == labels[k] for k in held]) > 0.97
    assert all(v[2] == (v[1] >= 0.5) and 0 <= v[1] <= 1 for v in rows.values())


def test_pairs_order_and_quantile_threshold():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(size=(200, 4)) + [2, 0, 0, 0], draw.normal(size=(100, 4)) - [2, 0, 0, 0]
    w = quality.bradley_terry(good, bad, pairs=2000, epochs=5)
    z = np.concatenate([good, bad]) @ w
    y = np.repeat([1, 0], [200, 100])
    threshold, slope = quality.quantile_threshold(z, y)
    assert abs((z < threshold).mean() - 1 / 3) < 0.01 and slope > 0
    assert ((z > threshold) == (y == 1)).mean() > 0.95


def test_loss_and_gradient_are_those_of_all_pairs(spark):
    draw = np.random.default_rng(3)
    y = (np.arange(300) % 3 > 0).astype(int)
    x = (draw.normal(size=(300, 5)) + y[:, None] * [1.0, 0.5, 0, 0, 0]).astype(np.float32)
    table = spark.createDataFrame([(int(a), b.tobytes()) for a, b in zip(y, x)], "label int, features binary")
    good, bad = x[y == 1].astype(float), x[y == 0].astype(float)
    goal = quality.AllPairs(table, np.zeros(5), np.ones(5), float(len(good) * len(bad)))

    def brute(w):
        lost = (bad @ w)[None, :] - (good @ w)[:, None]
        chance = 1 / (1 + np.exp(-lost))
        gradient = (chance.sum(axis=0) @ bad - chance.sum(axis=1) @ good) / goal.pairs
        return np.logaddexp(0, lost).mean() + goal.l2 / 2 * w @ w, gradient + goal.l2 * w

    start, way = draw.normal(size=5), draw.normal(size=5)
    for (loss, w, counts), step in zip(goal.along(start, way, (0.25, 2.0)), (0.25, 2.0)):
        want, gradient = brute(start + step * way)
        assert np.allclose(w, start + step * way) and abs(loss - want) < 1e-6
        assert np.allclose(goal.gradient(w, counts), gradient, atol=1e-6)
    w = quality.minimise(goal, 5)
    loss, gradient = brute(w)
    assert loss <= brute(quality.bradley_terry(good, bad, pairs=2000, epochs=5))[0] and abs(gradient).max() < 0.01


def test_quality_learns_from_every_labelled_document(spark, every):
    """Of 12,000 labelled documents, whose texts do not tell the label, as many as are bad lie below the cut, to the document."""
    text = "concat_ws(' ', transform(sequence(0, 4 + CAST(abs(xxhash64(id)) % 23 AS INT)), i -> substr(sha2(CAST(id * 31 + i AS STRING), 256), 1, 2 + CAST(abs(xxhash64(id, i)) % 9 AS INT))))"
    docs = spark.range(12_000).selectExpr("id AS doc_id", f"{text} AS text")
    labels = spark.range(12_000).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS INT) AS quality")
    model = quality.train(docs, labels, every)
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert sum(s < 0.5 for s in scores) == 9_000
    assert len(set(scores)) > 11_000


def test_quality_edge_cases(spark, docs_of, every):
    docs = docs_of([(1, "A calm line of words."), (2, "JUNK!! JUNK!! JUNK!!"), (3, None), (4, ""), (4, "two rows"), (None, "x")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, 1), (4, 0), (None, 1), (9, 1), (5, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels, every)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[1] > 0.5 > scores[2]
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.where("quality = 1"), every)).collect()} == {1.0}
    assert quality.score(docs_of([]), model).count() == 0


def test_labels_that_disagree_are_left_out(spark, every):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, 0), (4, None), (5, 7)], "doc_id bigint, quality int")
    chosen, sizes = labelled_sample(labels, every, "doc_id", "quality", 100)
    assert {(r.doc_id, r.label) for r in chosen.collect()} == {(1, 1), (3, 0)} and sizes == {0: 1, 1: 1}
    many = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    n = labelled_sample(many, every, "doc_id", "quality", 1000)[0].count()
    assert 800 < n < 1200


# Toxicity -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def insults():
    draw = np.random.default_rng(4)
    parts = ["an", "er", "on", "the", "in", "re", "at", "en", "st", "ing", "ha", "ou"]
    word = lambda: "".join(draw.choice(parts, draw.integers(1, 4)))
    bad = ["blockhead", "numskull", "dimwit"]
    texts, labels = [], []
    for i in range(600):
        words = [word() for _ in range(40)]
        if i % 3 == 0:
            words[int(draw.integers(40))] = str(draw.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_toxicity_learns_the_words_and_tolerates_gaps(insults):
    texts, labels = insults
    model = toxicity.fit(texts[:450], labels[:450], prior=1 / 3)
    scorer = toxicity.Scorer(model)
    found = np.array(scorer.score(texts[450:])) >= 0.3
    assert (found == np.array(labels[450:])).mean() > 0.97
    for text in ("an d i m w i t here", "n-u-m-s-k-u-l-l", "you blockh3ad", "bloockhead", "a dim.wit", "numskkull"):
        assert scorer.score([text])[0] >= 0.3, text
    assert max(scorer.score(["the other thing", "", None, "!!! 12 ###"])) < 0.3


@pytest.mark.parametrize("wrong", [0.0, 0.01, 0.05])
def test_toxicity_learns_from_wrong_labels_and_quotations(insults, wrong):
    """Every insult is quoted in clean documents, and some labels are wrong."""
    texts, labels = insults
    draw = np.random.default_rng(11)
    flipped = [1 - y if draw.random() < wrong else y for y in labels[:450]]
    quoting = [f"she said {w} to him and the other one laughed at it" for w in ("blockhead", "numskull", "dimwit") for _ in range(2)]
    model = toxicity.fit(texts[:450] + quoting, flipped + [0] * len(quoting), prior=1 / 3)
    scores = np.array(toxicity.Scorer(model).score(texts[450:]))
    truth = np.array(labels[450:])
    assert (scores[truth == 1] >= 0.3).mean() >= 0.9
    assert (scores[truth == 0] >= 0.3).mean() <= 0.05


def test_toxicity_of_an_insult_inside_a_long_word(insults):
    texts, labels = insults
    scorer = toxicity.Scorer(toxicity.fit(texts[:450], labels[:450], prior=1 / 3))
    for lead in range(0, 60, 7):
        assert scorer.score(["the" * (lead // 3) + "e" * (lead % 3) + "numskull" + "en" * 30])[0] >= 0.3, lead
    assert toxicity.windows("a" * 24) == ["a" * 24]
    assert all(any("b" * 11 in w for w in toxicity.windows("a" * k + "b" * 11 + "a" * 33)) for k in range(40))


def test_table_gives_the_kernel_expansion():
    """The decision from the table is the sum of kernels with the landmarks."""
    marks, weights = ["stupid", "clown", "thering"], np.array([1.0, -0.5, 0.25])
    k = toxicity.Kernel.of(marks)
    table = np.zeros(toxicity._ALPHABET**toxicity.LENGTH)
    np.add.at(table, k.code, weights[k.owner] * k.value)
    model = toxicity.Model(table.astype(np.float32), 0.1, 0.0, 1.0, 0.0)
    words = ["stupid", "st-upid", "clwn", "x", "", "therings", "a" * 200]
    plain = [toxicity.plain_word(w) for w in words]
    want = toxicity.Kernel.of(plain).against(k) @ weights + 0.1
    assert np.allclose(model.decisions(plain), want, atol=1e-4)


def test_kernel_counts_gapped_subsequences():
    same, gap, far = (toxicity.Kernel.of([w]).against(toxicity.Kernel.of(["idiot"]))[0, 0] for w in ("idiot", "idxiot", "thing"))
    assert same > gap > far


def test_words_and_units():
    assert [toxicity.plain_word(w) for w in ("idiot", "i.d.i.o.t!!", "m0r0n", "***", "123", "th-e")] == ["idiot", "idiot", "moron", "", "", "the"]
    assert toxicity.units("Be i d i o t now") == ["be", "i", "d", "i", "o", "t", "now", "idiot"]
    assert toxicity.units(None) == []


def test_toxicity_query(spark, small):
    rows = by_id(QUERIES["op10_toxicity"](spark, MEDIUM), "held_out", "score", "predicted")
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(v[0] == (not learned(k, 4, 2)) and v[2] == (v[1] >= 0.3) and 0 <= v[1] <= 1 for k, v in rows.items())


def test_toxicity_without_labels_and_empty_table(spark, docs_of, every):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = docs_of([(1, "any words"), (2, None), (None, "x")])
    model = toxicity.train(docs, labels, every)
    assert max(r.score for r in toxicity.score(docs, model).collect()) < 0.3
    assert toxicity.score(docs_of([]), model).count() == 0
    one_sided = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    assert max(r.score for r in toxicity.score(docs, toxicity.train(docs, one_sided, every)).collect()) < 0.3


def test_toxicity_of_empty_and_repeated_texts():
    """Texts without words and repeated rows may be labelled, too."""
    texts = ["", "...", "the dimwit", "the dimwit", "calm words here"] * 20
    model = toxicity.fit(texts, [1, 1, 1, 1, 0] * 20)
    assert len(toxicity.Scorer(model).score(texts)) == 100


def test_remainders(spark):
    rows = spark.range(50).select("id", remainder(F.col("id"), 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
