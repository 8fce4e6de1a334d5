"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits the space again and again by random directions at the median. A vector
within a margin of a split goes down both sides (spill overlap), so that near vectors part
seldom in one tree and hardly ever in all. Vectors are compared with those in their
leaves, exactly, and links are united to components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unievents.llm.common import groups_of, keep, pick
from unievents.llm.components import connected_components
from unievents.llm.simhash_dedup import _merge


class Tree:
    """Nodes as arrays; ``child`` is a node, or -1 - leaf."""

    def __init__(self, sample: np.ndarray, leaf: int, margin: float, rng: np.random.Generator, first_leaf: int):
        self.margin, self.directions, self.medians, self.children = margin, [], [], []
        self.leaves = first_leaf
        self.top = self._grow(sample, leaf, rng, 0)
        self.directions = np.array(self.directions, np.float32).reshape(-1, sample.shape[1])

    def _grow(self, sample: np.ndarray, leaf: int, rng: np.random.Generator, depth: int) -> int:
        best = None
        if len(sample) > leaf and depth < 48:
            for _ in range(4):  # the one of four directions that leaves fewest in its margin
                direction = rng.normal(size=sample.shape[1]).astype(np.float32)
                direction /= np.linalg.norm(direction)
                along = sample @ direction
                median = np.median(along)
                spilt = np.count_nonzero(np.abs(along - median) < self.margin) / len(sample)
                if best is None or spilt < best[0]:
                    best = spilt, direction, median, along
        if best is None or best[0] > 0.5:  # small enough, or so dense that no split parts it
            self.leaves += 1
            return -self.leaves
        node = len(self.medians)
        _, direction, median, along = best
        self.directions.append(direction)
        self.medians.append(median)
        self.children.append(None)
        self.children[node] = (self._grow(sample[along <= median + self.margin], leaf, rng, depth + 1),
                               self._grow(sample[along > median - self.margin], leaf, rng, depth + 1))
        return node

    def route(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that the vectors reach."""
        rows, leaves, todo = [], [], [(self.top, np.arange(len(vectors)))]
        while todo:
            node, some = todo.pop()
            if node < 0:
                rows.append(some)
                leaves.append(np.full(len(some), -1 - node))
            elif len(some):
                along = vectors[some] @ self.directions[node]
                left, right = self.children[node]
                todo += [(left, some[along <= self.medians[node] + self.margin]), (right, some[along > self.medians[node] - self.margin])]
        return np.concatenate(rows), np.concatenate(leaves)


def grow_forest(sample: np.ndarray, n_rows: int, least_cosine: float, trees: int, leaf_rows: int, seed: int = 6) -> list[Tree]:
    """Trees for ``n_rows`` vectors like the sample's (unit length). The margin is half the
    root mean square step, along a random direction, of two vectors that just link."""
    margin = 0.5 * np.sqrt((2 - 2 * least_cosine) / sample.shape[1])
    leaf = max(8, leaf_rows * len(sample) // max(n_rows, 1))
    forest, first = [], 0
    for k in range(trees):
        forest.append(Tree(sample, leaf, margin, np.random.default_rng([seed, k]), first))
        first = forest[-1].leaves
    return forest


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def leaf_links(unit: np.ndarray, leaves: np.ndarray, leaf: int, weight: np.ndarray, block: np.ndarray, pair: tuple | None,
               least_cosine: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the rows that each row links with, smallest row that links reach).

    A pair that meets in several leaves weighs in the first of them only. ``leaves``: all
    leaves of each row, padded with -1. With ``pair`` only rows of its two blocks are
    compared with each other."""
    n = len(unit)
    total, root = np.zeros(n, np.int64), np.arange(n)
    rough = unit.astype(np.float32)
    earlier = np.where((leaves >= 0) & (leaves < leaf), leaves, -1)
    left = np.arange(n) if pair is None else np.flatnonzero(block == pair[0])
    right = np.arange(n) if pair is None else np.flatnonzero(block == pair[1])
    same = pair is None or pair[0] == pair[1]
    for at in range(0, len(left), step):
        own = left[at:at + step]
        others = right[at:] if same else right
        near = rough[own] @ rough[others].T
        a, b = np.nonzero(near >= least_cosine - 1e-5)
        close = near[a, b] < least_cosine + 1e-5
        a, b = own[a], others[b]
        exact = np.ones(len(a), bool)
        exact[close] = np.einsum("ij,ij->i", unit[a[close]], unit[b[close]]) >= least_cosine
        good = exact & (a < b if same else True)
        a, b = a[good], b[good]
        root = _merge(n, a, b, root)
        for lo in range(0, len(a), 1 << 16):
            x, y = a[lo:lo + (1 << 16)], b[lo:lo + (1 << 16)]
            met = np.zeros(len(x), bool)
            for k in range(earlier.shape[1]):
                mine = earlier[x, k]
                met |= (mine >= 0) & (mine[:, None] == earlier[y]).any(axis=1)
            x, y = x[~met], y[~met]
            total += np.bincount(x, weight[y], n).astype(np.int64) + np.bincount(y, weight[x], n).astype(np.int64)
    return total, root


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = 0.95,
                    trees: int = 4, leaf_rows: int = 1024, sample_rows: int = 20_000, group_rows: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    n_links: other rows at a cosine (in double precision) of ``least_cosine`` or more that
    the forest finds; component_id: smallest id that links reach, the row's own included;
    kept: the id is its component's. Null, empty and zero vectors and those with null or
    non-finite components link with nothing, and vectors of different length not with each
    other. Repeated rows are rows of their own that link with each other. A row with a null
    id links like others; its component is null if no id is reached, and it is kept only
    then. No rows give no rows.

    Equal vectors are one class. The forest is fitted on at most ``sample_rows`` classes
    (those of smallest hash) of each vector length, and every class is routed through it. A
    leaf of more than ``group_rows`` classes is cut into blocks, and all pairs of its blocks
    are compared in groups of their own. Pairs stay within a group: what leaves it is a
    count and one edge per row.
    """
    plain = pick(vectors, id=id_col, v=vector_col)
    single = plain.schema["v"].dataType.elementType == T.FloatType()
    plain = plain.withColumn("v", F.col("v").cast("array<double>"))
    fine = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = keep(plain.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.col("v"))), "vectors")
    grouped = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = keep(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbers hold once written
    found = None
    for size, n in sorted((r["s"], r["count"]) for r in classes.groupBy(F.size("v").alias("s")).count().collect()):  # a row per length
        part = _links(classes.where(F.size("v") == size), n, single, least_cosine, trees, leaf_rows, sample_rows, group_rows)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = keep(found, "links")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("c != root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    marked = (classes.select("c", "v", "least", "n").join(links, "c", "left")
              .join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")))
    marked = keep(marked.select("v", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "marked")
    least = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = keep(marked.join(least, "root").select("v", "n_links", "component_id"), "labels")
    out = rows.where("v is not null").join(labels, "v").select("id", "n_links", "component_id").union(
        rows.where("v is null").select("id", F.lit(0).cast("bigint"), "id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, n_rows: int, single: bool, least_cosine: float, trees: int, leaf_rows: int, sample_rows: int,
           group_rows: int) -> DataFrame:
    """(c, root, links): per class and leaf, weight of links and the smallest class reached.
    ``single``: the components are exact in 4 bytes, and are shuffled so."""
    kind = np.float32 if single else np.float64
    spark = classes.sparkSession
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).toPandas()["v"]
    fitted = _unit(np.stack([np.asarray(v, float) for v in sample])).astype(np.float32)
    shared = spark.sparkContext.broadcast(grow_forest(fitted, n_rows, least_cosine, trees, leaf_rows))

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("c", "n"))
            own = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            data = _unit(own)
            routed = [t.route(data.astype(np.float32)) for t in shared.value]
            row, leaf = (np.concatenate(x) for x in zip(*routed))
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = [leaf[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
            blobs = [v.tobytes() for v in own.astype(kind)]
            for at in range(0, len(row), 4096):
                r = row[at:at + 4096]
                yield pa.record_batch({"leaf": pa.array(leaf[at:at + 4096].astype(np.int32)), "c": pa.array(c[r]), "n": pa.array(n[r]),
                                       "leaves": pa.array([lists[k] for k in r], pa.list_(pa.int32())),
                                       "v": pa.array([blobs[k] for k in r], pa.binary())})

    routed = classes.select("c", "n", "v").mapInArrow(route, "leaf int, c bigint, n bigint, leaves array<int>, v binary")
    full = {r["leaf"]: r["count"] for r in routed.select("leaf").groupBy("leaf").count().where(F.col("count") > group_rows).collect()}
    parts = {k: -(-n // (group_rows // 2)) for k, n in full.items()}  # a row per leaf of the forest at most
    hot = F.lit(1) if not parts else F.coalesce(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])[F.col("leaf")], F.lit(1))
    dealt = (routed.withColumn("parts", hot).withColumn("block", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    grouped = dealt.repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high", "c")

    def compare(batches):
        for table in groups_of(batches, ["leaf", "low", "high"]):
            unit = _unit(np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(table.num_rows, -1).astype(float))
            lists = table["leaves"].to_pylist()
            width = max(map(len, lists))
            leaves = np.array([x + [-1] * (width - len(x)) for x in lists], np.int32)
            c, n, block = (table[k].to_numpy() for k in ("c", "n", "block"))
            pair = table["low"][0].as_py(), table["high"][0].as_py()
            total, root = leaf_links(unit, leaves, table["leaf"][0].as_py(), n, block, pair, least_cosine)
            some = np.flatnonzero((total > 0) | (root != np.arange(len(c))))
            if len(some):
                yield pa.record_batch({"c": pa.array(c[some]), "root": pa.array(c[root[some]]), "links": pa.array(total[some])})

    columns = ["leaf", "low", "high", "c", "n", "block", "leaves", "v"]
    return grouped.select(*columns).mapInArrow(compare, "c bigint, root bigint, links bigint")
