import numpy as np
import pytest

from unievents.llm import embedding_dedup as E


def _brute(rows, least=0.95):
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [set() for _ in rows]
    for k, a in enumerate(good):
        for b in good[:k]:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        c = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((i, len(links[k]), c, i == c))
    return sorted(out, key=str)


def _rows(n=600, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(n, dim))
    for k in range(n):
        v = base[k] if k % 3 else base[k // 9] + rng.normal(size=dim) * rng.uniform(0, 0.4)
        rows.append((k, v.astype(np.float32).tolist()))
    rows += [(1000 + k, rows[5][1]) for k in range(30)]  # copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * dim), (2003, [float("nan")] + [1.0] * (dim - 1)), (2004, [None] + [1.0] * (dim - 1)),
             (2005, [float("inf")] + [1.0] * (dim - 1)), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[5][1]), (None, [3.0, -4.0]),
             (2008, [1e-30] * dim), (2009, [1e30] * dim), (2010, rows[7][1]), (2010, rows[7][1])]
    return rows


@pytest.mark.parametrize("leaf_rows, group_rows", [(10_000, 4096), (10_000, 64), (60, 4096)])
def test_as_brute_force(spark, leaf_rows, group_rows):
    """In one leaf, in a leaf cut into blocks, and in many leaves."""
    rows = _rows()
    frame = spark.createDataFrame([(v, i, "x", 1.0) for i, v in rows], "embedding array<float>, vec_id bigint, c string, v double").repartition(3)
    got = sorted((tuple(r) for r in E.embedding_dedup(frame, leaf_rows=leaf_rows, group_rows=group_rows).collect()), key=str)
    want = _brute(rows)
    if leaf_rows > 1000:
        assert got == want
    else:  # the forest may miss a few links, but finds none that is none
        found, there = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.98 * there <= found <= there
        assert all(a[0] == b[0] for a, b in zip(got, want))


def test_dense_group_and_recall():
    """A group too dense to split stays a leaf; others are found again in some tree."""
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(1, 32)) + rng.normal(size=(3000, 32)) * 0.01
    spread = rng.normal(size=(3000, 32))
    near = spread[:500] + rng.normal(size=(500, 32)) * 0.2
    data = E._unit(np.concatenate((dense, spread, near))).astype(np.float32)
    forest = E.grow_forest(data[rng.permutation(len(data))[:2000]], len(data), 0.95, 6, 400)
    leaves = [set() for _ in data]
    for tree in forest:
        for row, leaf in zip(*tree.route(data)):
            leaves[row].add(int(leaf))
    assert all(leaves[0] & leaves[k] for k in range(1, 3000))
    pairs = [(3000 + k, 6000 + k) for k in range(500) if data[3000 + k] @ data[6000 + k] >= 0.95]
    assert len(pairs) > 300 and sum(bool(leaves[a] & leaves[b]) for a, b in pairs) >= 0.98 * len(pairs)


def test_empty(spark):
    assert E.embedding_dedup(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
