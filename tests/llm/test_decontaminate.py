import random

import numpy as np

from unievents.llm import decontaminate as D

from . import brute


def _brute(docs, items):
    out = []
    for i, text in docs:
        w = brute.words(text)
        for item, test in items:
            v = brute.words(test)
            k = min(5, len(v))
            if not k:
                continue
            want = {tuple(v[a:a + k]) for a in range(len(v) - k + 1)}
            n = len(want & {tuple(w[a:a + k]) for a in range(len(w) - k + 1)})
            if n >= 0.8 * len(want):
                out.append((i, item, len(want), n))
    return sorted(out, key=str)


def test_short_items_in_long_documents(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    items = [(k, text(rng.randint(8, 90))) for k in range(40)] + [(100, "two words"), (101, ""), (102, None), (103, "  ...  "), (None, text(20))]
    docs = []
    for k in range(120):
        body = text(rng.randint(0, 3000)).split()
        if k % 3 == 0:
            put = items[k % 40][1].upper().split()
            if k % 2:
                put[rng.randrange(len(put))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = put
        docs.append((k, ", ".join(body)))
    docs += [(500, None), (501, ""), (502, "here are Two\nwords!"), (None, items[0][1]), (503, items[1][1]), (503, items[1][1])]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id bigint, text string, n_found int, item_id string").repartition(3)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    want = _brute(docs, items)
    assert len(want) >= 40
    for block_bytes in (16 << 20, 500):  # all items at once, and in many blocks
        got = D.find_leaks(frame, tests, block_bytes=block_bytes).collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == want
        assert all(abs(r.containment - r.n_found / r.n_shingles) < 1e-12 for r in got)


def test_shingles_in_parts():
    text = b"one two three Four, five six seven " * 9
    for size in (1, 2, 5):
        want = list(D._shingles(text, size))
        assert all(list(D._shingles(text, size, part)) == want for part in (1, 10, 50))
        assert len(want) == 63 - size + 1


def test_empty(spark, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    assert D.find_leaks(no_docs, items).count() == 0
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id bigint, text string")
    assert D.find_leaks(docs, items.limit(0)).count() == 0
    assert D.find_leaks(docs, items).count() == 1


def test_items_of_one_or_two_shingles_are_never_missed(monkeypatch):
    """Even with a single permutation, where a window names few of the items that it holds."""
    monkeypatch.setattr(D, "PERMUTATIONS", 1)
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    items = [(k, " ".join(word() for _ in range(k % 6 + 1))) for k in range(300)] + [(300, "aa " * 9), (301, ""), (302, "w" + " w" * 4)]
    text = " ".join(t + " " + " ".join(word() for _ in range(20)) for _, t in items)
    index, memo = D.ItemIndex(items, 5), D._WordIds()
    found = index.candidates([D._word_ids(b"nothing of them", memo), D._word_ids(text.encode(), memo), np.zeros(0, np.uint64)])
    assert {(d, index.ids[i]) for d, i in found} == {(1, k) for k, t in items if t}
