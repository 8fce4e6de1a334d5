import numpy as np
import pytest

from unievents.llm import whitening as W


def _symmetric(kind, n, rng):
    if kind == "random":
        a = rng.normal(size=(n, n))
        return a @ a.T / n
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    values = {"equal": np.r_[np.full(n // 2, 3.0), np.linspace(1, 2, n - n // 2)], "near": 1 + np.arange(n) * 1e-13,
              "steep": 10.0 ** -np.arange(n), "split": np.arange(n) + 1.0}[kind]
    return np.diag(values) if kind == "split" else (q * values) @ q.T


@pytest.mark.parametrize("kind", ["random", "equal", "near", "steep", "split"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_principal(kind, n):
    """Eigenvalues as numpy's, orthonormal vectors and small residuals."""
    a = _symmetric(kind, n, np.random.default_rng(n))
    a = (a + a.T) / 2
    values, vectors = W.principal(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:len(values)]
    top = np.abs(want).max()
    assert len(values) == min(n, 16) or kind == "steep"
    assert np.abs(values - want).max() <= 1e-13 * top * n
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(vectors @ a - values[:, None] * vectors).max() < 1e-12 * top * max(n, 4)


def test_sturm_counts():
    rng = np.random.default_rng(2)
    d, e = rng.normal(size=30), rng.normal(size=29)
    e[[4, 11]] = 0
    exact = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 101)
    assert W.sturm_counts(d, e, at).tolist() == [(exact < x).sum() for x in at]


def _frame(spark, rows, kind="float"):
    return spark.createDataFrame([(v, i, 1.0, "x") for i, v in rows], f"embedding array<{kind}>, vec_id bigint, d double, x string").repartition(3)


def _brute(rows, wanted=16):
    good = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    out = []
    for d in {len(v) for _, v in good}:
        fit = sorted({tuple(v) for _, v in good if len(v) == d})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], dtype=object)
        v = (centred.T @ centred / (n * n * n)).astype(float).reshape(d, d)
        e, q = np.linalg.eigh(v)
        for i, x in good:
            if len(x) == d:
                c = [n * a - s for a, s in zip(x, sums)]
                y = np.array([a / n for a in c]) @ q[:, ::-1]
                out += [(i, k + 1, n, sum(a * a for a in c), y[k] / np.sqrt(e[::-1][k]), e[::-1][k] / np.trace(v)) for k in range(min(d, wanted))]
    return out


def test_as_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=24) * np.linspace(1, 0.2, 24)).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[7][1]) for k in range(200)] + [(7, rows[7][1]), (None, rows[8][1]), (None, None), (2000, None), (2001, [])]
    rows += [(2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [float("inf")] * 24)]
    rows += [(3000 + k, rng.normal(size=3).tolist()) for k in range(40)]
    order = lambda r: (str(r[0]), r[1], r[3])
    got = sorted((tuple(r) for r in W.whiten(_frame(spark, rows)).collect()), key=order)
    want = sorted(_brute(rows), key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert max(r[6] for r in got) < 1e-10
    signs = {}
    for a, b in zip(got, want):
        part = (a[2], a[1])  # a list and a component have one sign
        signs.setdefault(part, np.sign(a[4] * b[4]))
        assert abs(a[4] - signs[part] * b[4]) < 1e-9 and abs(a[5] - b[5]) < 1e-12


def test_ranks(spark):
    """One vector has no component; two have one; numbers beyond 64 bits raise an error."""
    one = W.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    two = W.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, [1.0, 2.5])])).collect()
    assert one == [] and [(r["id"], r["component"], r["n"], r["deviation"]) for r in sorted(two)] == [(1, 1, 2, 1024), (2, 1, 2, 1024), (3, 1, 2, 1024)]
    assert {round(abs(r["whitened"]), 12) for r in two} == {1.0} and {r["explained"] for r in two} == {1.0}
    with pytest.raises(Exception):
        W.whiten(_frame(spark, [(1, [1e12]), (2, [-1e12])], "double")).collect()


def test_empty(spark):
    assert W.whiten(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
