import random
import zlib

import pytest

from unievents.llm import toxicity as T

BAD = ["vilest", "rotten", "hateful"]


def _corpus(n, seed=1):
    rng = random.Random(seed)
    common = {"en": "the of and to in is that with".split(), "de": "der die und das mit sich nicht ein".split()}
    rows = []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        w = [rng.choice(common[lang]) if rng.random() < 0.5 else f"{rng.choice('bcdfgk')}o{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(BAD) if lang == "en" else f"schuft{rng.randint(0, 99)}")
        rows.append((k, " ".join(w), int(bad)))
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    rows = _corpus(1500)
    docs = spark.createDataFrame([(t, i, 0.5, "x") for i, t, _ in rows], "text string, doc_id bigint, score double, Held_Out string").repartition(3)
    marks = spark.createDataFrame([(i, y, 1) for i, _, y in rows if i < 1400] + [(None, 1, 1), (5, None, 1), (10**9, 1, 0)],
                                  "doc_id bigint, toxic int, quality int")
    return rows, docs, marks


def test_held_out_rows_are_found(corpus):
    rows, docs, marks = corpus
    out = T.score_toxicity(docs, marks)
    assert out.columns == [*docs.columns, "held_out", "score", "predicted"]
    got = {r[1]: tuple(r)[4:] for r in out.collect()}
    assert len(got) == len(rows)
    right = wrong = 0
    for i, _, y in rows:
        held, score, predicted = got[i]
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == (score >= 0.5)
        if held:
            right += predicted == y
            wrong += predicted != y
    assert right / (right + wrong) >= 0.95


def test_held_out_labels_teach_nothing(spark, corpus):
    rows, docs, marks = corpus
    turned = marks.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a = T.score_toxicity(docs, marks, per_label=100).toDF("t", "i", "a", "b", "h", "s", "p").select("i", "s").collect()
    b = T.score_toxicity(docs, turned, per_label=100).toDF("t", "i", "a", "b", "h", "s", "p").select("i", "s").collect()
    assert sorted(a) == sorted(b)


def test_odd_rows_and_one_label(spark, odd, no_docs):
    marks = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    out = T.score_toxicity(odd, marks).toDF(*odd.columns, "h", "s", "p").collect()
    assert len(out) == odd.count() and all(0 <= r.s <= 1 for r in out)
    empty = {r.s for r in out if not (r.text or "").strip()}
    assert len(empty) == 1  # no words, one score
    assert not any(r.h for r in out if r.doc_id is None)
    only = T.score_toxicity(odd, marks.where("toxic = 0"))
    assert only.where("predicted = 1").count() == 0
    assert T.score_toxicity(odd, marks.limit(0)).where("predicted = 1").count() == 0
    assert T.score_toxicity(no_docs, marks).count() == 0


def test_whole_text_counts():
    """A word at the very end of a long text is seen as at its start."""
    rows = _corpus(600, 2)
    model = T.train([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    filler = "the of and to " * 100_000
    vocabulary = T.Vocabulary()
    ids = [vocabulary.ids(t.encode()) for t in (filler + BAD[0], BAD[0] + " " + filler, filler)]
    pieces, marks = vocabulary.tables()
    import numpy as np
    vectors = np.vstack((model.table[pieces].sum(axis=1), np.zeros((1, T.DIM), np.float32)))
    end, start, without = model.scores(model.logits(vectors, ids), np.array([T._language(i, marks) for i in ids]))
    assert end >= 0.5 and start >= 0.5 and without < 0.5


def test_thresholds_come_from_all_labelled_rows(spark):
    """With a sample of 40 rows a label, the threshold of each language is still the best one
    for the labelled rows beyond the sample."""
    rng = random.Random(5)
    common = {"en": "the of and to in is that with", "de": "der die und das mit sich nicht ein"}
    rows = []
    for i in range(2500):  # a word that is toxic in the common language is not in the rare one
        lang, bad = "de" if i % 12 == 0 else "en", int(rng.random() < 0.3)
        w = [rng.choice(common[lang].split()) for _ in range(rng.randint(5, 60))]
        sign = rng.choice(BAD) if lang == "en" else "vilest rotten hateful"
        w.insert(rng.randint(0, len(w)), sign if bad else f"word{i}" if lang == "en" else rng.choice(BAD))
        rows.append((i, " ".join(w), bad))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in T.score_toxicity(docs, marks, per_label=40).collect()}

    def f1(found, own):
        hits = sum(y for _, y in found)
        return 2 * hits / (len(found) + sum(y for _, y in own))

    for words in common.values():
        own = sorted(((got[i].score, y) for i, t, y in rows if set(t.split()) & set(words.split()) and not got[i].held_out), reverse=True)
        best = max(f1(own[:k], own) for k in range(1, len(own)))
        assert f1([r for r in own if r[0] >= 0.5], own) > best - 0.02


def test_long_and_unsampled_rows_calibrate(spark):
    """Every labelled document that is neither held out nor fitted is counted once, at any length."""
    long = "the of and to " * 20_000
    rows = [(k, long if k % 10 == 0 else f"the word number {k}", k % 2) for k in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x")], "id bigint, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1), (None, 1)], "id bigint, label int")
    model = T.train([t.encode() for _, t, _ in rows[1:40]], [y for *_, y in rows[1:40]])
    counts = T.labelled_counts(docs, marks, [1, 2, 3], spark.sparkContext.broadcast(model))
    want = [sum(zlib.crc32(str(i).encode()) % 5 != 0 and i not in (1, 2, 3) and max(y, i == 0) == k for i, _, y in rows) for k in (0, 1)]
    assert list(counts.sum(axis=(0, 2))) == want
