import numpy as np
import pytest

from unievents.llm import hard_negatives as H


def _brute(rows, every=100, n_pos=5, n_neg=5):
    good = [(i, label, [int(np.floor(256 * float(c))) for c in v]) for i, label, v in rows
            if label is not None and v is not None and None not in v and np.isfinite(v).all()]
    out, last = [], 1 << 70
    for k, (i, label, x) in enumerate(good):
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), last if j is None else j, n, j, other)
                        for n, (j, other, y) in enumerate(good) if n != k and len(y) == len(x))
        for s, _, _, j, _ in [r for r in scored if r[4] == label][:n_pos]:
            fits = [r for r in scored if r[4] != label and 80 * -s <= 100 * -r[0] <= 100 * -s]
            out += [(i, j, rank + 1, r[3], -s, -r[0]) for rank, r in enumerate(fits[:n_neg])]
    return sorted(out, key=str)


def _got(spark, rows, **more):
    frame = spark.createDataFrame([(v, i, label, 1, "x", 2) for i, label, v in rows],
                                  "embedding array<float>, vec_id bigint, label int, row int, x string, g int").repartition(3)
    return sorted((tuple(r) for r in H.mine_hard_negatives(frame, **more).collect()), key=str)


def _rows(n=900, dim=12, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, dim))
    rows = [(k, int(rng.integers(5)) if k % 3 else 0, (base[k % 5] + rng.normal(size=dim) * 0.6).astype(np.float32).tolist()) for k in range(n)]
    rows += [(1000 + k, 1, rows[8][2]) for k in range(60)]  # copies and ties, of one label
    rows += [(100, rows[100][1], rows[100][2]), (None, 2, rows[8][2]), (None, 2, rows[9][2]), (2000, None, rows[8][2]), (2100, 1, None)]
    rows += [(2200, 1, [float("nan")] * dim), (2300, 1, [None] * dim), (2400, 3, [0.0] * dim), (2500, 9, (-base[0]).tolist()),
             (2600, 1, [1.0, 2.0]), (2601, 1, [2.0, 2.0]), (2602, 2, [1.5, 2.0]), (2700, 1, []), (2701, 1, []), (2702, 4, [])]
    return rows


@pytest.mark.parametrize("group_rows", [8192, 64])
def test_as_brute_force(spark, group_rows):
    """In one group and in many: ties, copies, nulls, repeated rows, empty windows."""
    rows = _rows()
    want = _brute(rows)
    assert len(want) > 100 and _got(spark, rows, group_rows=group_rows) == want


def test_few_and_one_sided(spark):
    """Fewer partners than asked for; one label only; all scores negative."""
    assert _got(spark, [(0, 1, [1.0]), (1, 1, [0.9]), (2, 2, [0.8])]) == [(0, 1, 1, 2, 58880, 52224)]
    assert _got(spark, [(100 * k, 1, [1.0]) for k in range(9)]) == []
    assert _got(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0]), (3, 2, [-0.9])]) == []


def test_slots(spark):
    """Entry i of the merges holds the best of slot i and all lower ones."""
    from pyspark.sql import functions as F

    kind = "struct<order:bigint,id:bigint,row:bigint,slot:int,score:bigint>"
    items = [(-s, s, s, slot, s) for slot, s in [(0, 30), (2, 11), (2, 10), (2, 9), (1, 20)]]
    frame = spark.createDataFrame([(items,)], f"items array<{kind}>")
    merged = frame.select(H.suffix_merges(F.col("items"), F.lit(4), 3, kind).alias("m")).first()["m"]
    assert [[r["score"] for r in m] for m in merged] == [[30, 20, 11], [20, 11, 10], [11, 10, 9], []]


def test_exact_scores():
    big = np.array([[1 << 30, 3]])
    assert H.exact_scores(big, big).tolist() == [[(1 << 60) + 9]]
    with pytest.raises(OverflowError):
        H.exact_scores(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_empty(spark):
    assert H.mine_hard_negatives(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
