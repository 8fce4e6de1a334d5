"""Hard negatives for contrastive training, by slot-decomposed selection.

Every positive of an anchor asks for the best negatives in a window of scores that ends at
the positive's own score. The windows of one anchor overlap, but their upper limits split
the scores into disjoint slots. The best few negatives of each slot are found once, and
merging slots from the lowest up answers every window.

All rows are dealt into groups of a bounded size and every anchor meets every group once: a
stated query set against all rows, in blocks. What leaves a block is a few rows per anchor
and slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unievents.llm.common import keep, pick, runs_of

NO_ID = (1 << 63) - 1  # stands for a null id, which comes after all others

Choice = Callable[[np.ndarray, np.ndarray, np.ndarray, dict], Iterator[tuple[int, np.ndarray]]]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, without rounding."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)  # raises beyond 64 bits


def best(scores: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the indices ``some`` (rising) of the largest scores; ties by index."""
    s = scores[some]
    if len(s) > k:
        near = s >= np.partition(s, len(s) - k)[len(s) - k]
        some, s = some[near], s[near]
    return some[np.lexsort((some, -s))[:k]]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), d)


def _meet(rows: DataFrame, anchors: DataFrame, choose: Choice, anchor_rows: int = 128) -> DataFrame:
    """(anchor_row, slot, score, id, row): what ``choose`` takes for each anchor from each
    group. ``rows`` hold d, g (vector length, group); ``anchors`` d, groups and limits. Both
    are sorted by group, rows first: a task holds the rows of one group and lets the anchors
    pass by."""
    columns = ["d", "g", "kind", "id", "row", "label", "x", "limits"]
    asked = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("kind", F.lit(1))
    held = rows.withColumn("kind", F.lit(0)).withColumn("limits", F.lit(None).cast("array<bigint>"))
    dealt = held.select(*columns).union(asked.select(*columns)).repartition("d", "g").sortWithinPartitions("d", "g", "kind", "id", "row")

    def select(batches):
        at, parts = None, []
        for (d, g, kind), part in runs_of(batches, ["d", "g", "kind"]):
            if kind == 0:
                if at != (d, g):
                    at, parts, group = (d, g), [], None
                parts.append(part)
                continue
            if at != (d, g):
                continue  # a group without rows
            if group is None:
                table = pa.Table.from_batches(parts)
                x = _matrix(table["x"].combine_chunks(), d)
                group = {k: table[k].to_numpy() for k in ("id", "row", "label")}
                parts = []
            for lo in range(0, part.num_rows, anchor_rows):
                some = part.slice(lo, anchor_rows)
                scores = exact_scores(_matrix(some.column("x"), d), x)
                out = {"anchor_row": [], "slot": [], "score": [], "id": [], "row": []}
                for k, (own, label, limits) in enumerate(zip(*(some.column(c).to_pylist() for c in ("row", "label", "limits")))):
                    others = {"own": own, "label": label, "limits": limits}
                    for slot, picked in choose(scores[k], group["row"], group["label"], others):
                        out["anchor_row"].append(np.full(len(picked), own))
                        out["slot"].append(np.full(len(picked), slot, np.int32))
                        out["score"].append(scores[k][picked])
                        out["id"].append(group["id"][picked])
                        out["row"].append(group["row"][picked])
                if out["row"]:
                    yield pa.record_batch({k: pa.array(np.concatenate(v)) for k, v in out.items()})

    return dealt.mapInArrow(select, "anchor_row bigint, slot int, score bigint, id bigint, row bigint")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each (anchor, slot), with their rank."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def suffix_merges(items, n_slots, k: int, kind: str):
    """An array whose entry i holds the first ``k`` of the slots i and beyond (lower scores):
    from the last slot up, each slot's own few are merged with the entry after it."""
    none = F.array().cast(f"array<{kind}>")

    def merge(held, slot):
        own = F.filter(items, lambda r: r["slot"] == slot)
        return F.concat(F.array(F.slice(F.array_sort(F.concat(own, F.coalesce(F.get(held, F.lit(0)), none))), 1, k)), held)
    return F.aggregate(F.reverse(F.sequence(F.lit(0), n_slots - 1)), F.array().cast(f"array<array<{kind}>>"), merge)


def mine_hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                        anchor_every: int = 100, n_positives: int = 5, n_negatives: int = 5, least_percent: int = 80,
                        scale: int = 256, group_rows: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors become whole numbers, floor(scale * c). A score is the inner product with the
    anchor; higher scores come first, ties by smaller id. Anchors are the rows whose id is
    divisible by ``anchor_every``; their positives are the first ``n_positives`` other rows
    of the same label. Each positive gets the first ``n_negatives`` rows of another label
    with ``least_percent`` * positive_score <= 100 * negative_score <= 100 * positive_score:
    none for a negative positive_score, whose window is empty.

    Rows with a null label, a null vector or null or non-finite entries take no part. Rows
    of null id are no anchors; they come last among ties. Vectors meet those of their own
    length only (empty ones score 0). Repeated rows are rows of their own, as anchors and as
    partners, and an anchor is not its own partner but its copies'. Anchors without
    positives and positives without negatives give no rows. Other columns of any name are
    ignored. No rows give no rows. Scores beyond 64 bits raise an error, ids are below
    2**63 - 1.

    Each anchor is sent once to each group of ``group_rows`` rows and pass. No label or id
    is a partition key, so a label that holds most rows is spread like all others.
    """
    plain = pick(vectors, id=id_col, v=vector_col, label=label_col).withColumn("label", F.col("label").cast("bigint"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    rows = plain.where(fine & F.col("label").isNotNull()).select(
        F.coalesce("id", F.lit(NO_ID)).cast("bigint").alias("id"), "label", whole.alias("x"), F.size("v").alias("d"))
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers hold once written
    groups = rows.groupBy("d").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("groups"))
    rows = rows.join(groups, "d").withColumn("g", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int"))
    anchors = rows.where((F.col("id") != NO_ID) & (F.col("id") % anchor_every == 0)).drop("g")

    def same(scores, row, label, anchor):
        picked = best(scores, np.flatnonzero((label == anchor["label"]) & (row != anchor["own"])), n_positives)
        if len(picked):
            yield 0, picked

    first = _meet(rows, anchors.withColumn("limits", F.lit(None).cast("array<bigint>")), same)
    distinct = Window.partitionBy("anchor_row").orderBy(F.col("score").desc())
    positives = keep(_top(first, n_positives).withColumn("slot", F.dense_rank().over(distinct) - 1), "positives")
    limits = positives.groupBy("anchor_row").agg(F.reverse(F.array_sort(F.collect_set("score"))).alias("limits"))  # n_positives at most
    limited = anchors.join(limits.withColumnRenamed("anchor_row", "row"), "row")

    def others(scores, row, label, anchor):
        upper = np.array(anchor["limits"], np.int64)  # falling
        least = -(-least_percent * int(upper[-1]) // 100)
        some = np.flatnonzero((label != anchor["label"]) & (scores <= upper[0]) & (scores >= least))
        slots = np.searchsorted(-upper, -scores[some], "right") - 1
        for slot in np.unique(slots):
            yield int(slot), best(scores, some[slots == slot], n_negatives)

    kind = "struct<order:bigint,id:bigint,row:bigint,slot:int,score:bigint>"
    item = F.struct((-F.col("score")).alias("order"), "id", "row", "slot", "score").cast(kind)
    slots = _top(_meet(rows, limited, others), n_negatives).groupBy("anchor_row").agg(F.collect_list(item).alias("items"))  # slots x n_negatives
    merged = limits.join(slots, "anchor_row").select(
        "anchor_row", suffix_merges(F.col("items"), F.size("limits"), n_negatives, kind).alias("merged"))
    names = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    windows = (positives.select("anchor_row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "slot")
               .join(merged, "anchor_row").join(names, "anchor_row")
               .withColumn("window", F.filter(F.get("merged", F.col("slot")), lambda r: F.col("positive_score") * least_percent <= r["score"] * 100)))
    out = windows.select("anchor_id", "positive_id", "positive_score", F.posexplode("window").alias("at", "found"))
    real = lambda c: F.when(c != NO_ID, c)
    return out.select("anchor_id", real(F.col("positive_id")).alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                      real(F.col("found.id")).alias("negative_id"), "positive_score", F.col("found.score").alias("negative_score"))
