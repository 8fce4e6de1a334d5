import random

from unievents.llm import licenses as L

from . import brute
from .conftest import odd_rows


def _brute_base(text):
    w = brute.words(text)
    found = [(i, l) for p, l in L.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({l for _, l in found}))


def test_base_places_as_brute_force(spark):
    rng = random.Random(1)
    vocabulary = "MIT mit License license Apache general General public PUBLIC x, É k".split() + ["\u212a", "-"]
    rows = odd_rows() + [(1000 + k, rng.choice([" ", "\n", ". "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    frame = spark.createDataFrame([(t, i, 1, "w") for i, t in rows], "text string, doc_id bigint, pos int, hash string").repartition(3)
    summary = L.scan_licenses(frame)[1].collect()
    assert len(summary) == len(rows)
    got = sorted((str((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in summary))
    assert got == sorted(str((i, *_brute_base(t))) for i, t in rows)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in summary)


def test_passages_with_small_changes(spark):
    long = max(L.PASSAGES, key=len)
    w = long.split()
    texts = ["x " * 40 + long.upper() + " y", " ".join(w[:9] + ["very"] + w[9:]), " ".join(w[:9] + w[10:]), " ".join(w[: len(w) // 2]),
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", long + " " + long]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans, summary = L.scan_licenses(frame)
    labels = {r.id: r.labels for r in summary.collect()}
    assert [labels[k] for k in range(7)] == ["mit", "mit", "mit", "", "gpl,gpl-3.0", "cc-by-nc-4.0", "mit"]
    places = sorted((r.id, r.start, r.end) for r in spans.where("label = 'mit'").collect())
    assert (0, 40, 40 + len(w)) in places and [p[0] for p in places].count(6) == 2


def test_empty(no_docs):
    assert [f.count() for f in L.scan_licenses(no_docs)] == [0, 0]


def test_long_texts(spark):
    """A million words: every phrase is found where it stands, also across slices, and work
    grows with the length (plain time, with room for other load)."""
    import time

    def run(n):
        words = ["w"] * n
        at = [k for k in range(5, n - 3, 997)]
        for k in at:
            words[k:k + 3] = "General", "PUBLIC", "license"
        began = time.time()
        row = L.scan_licenses(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string"))[1].first()
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (n, len(at), at[0], at[-1], "gpl")
        return time.time() - began

    run(1000)
    quarter, whole = run(250_000), run(1_000_000)
    assert whole < 8 * quarter + 5
