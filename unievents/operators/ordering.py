"""Orderings. Every order ends in the id so results are deterministic; ranks are
emitted as columns (row_number) because downstream comparisons ignore row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffles_removed


def newest_first_keys() -> list[Column]:
    """Date desc, time desc, then id."""
    return [F.col("date").desc(), F.col("time").desc(), F.col("event_id").asc()]


def soonest_first_keys() -> list[Column]:
    """Date asc, time asc, then id."""
    return [F.col("date").asc(), F.col("time").asc(), F.col("event_id").asc()]


def by_name_keys() -> list[Column]:
    """S3: name asc (binary collation), then id."""
    return [F.col("name").asc(), F.col("subject_id").asc()]


def rank_keys() -> list[Column]:
    """Score desc, stable over S1 (newest first), then id."""
    return [F.col("score").desc(), *newest_first_keys()]


def with_rank(df: DataFrame, partition: str, keys: list[Column], name: str = "rank",
              top_k: int | None = None) -> DataFrame:
    """Emit ``row_number`` over ``partition`` ordered by ``keys``; with ``top_k`` the
    filter lets Spark plan a WindowGroupLimit, which trims each partition to k rows per
    group before the shuffle."""
    w = Window.partitionBy(partition).orderBy(*keys)
    out = df.withColumn(name, F.row_number().over(w))
    if top_k is not None:
        out = out.where(F.col(name) <= top_k)
    return out


def number_rows(df: DataFrame, order: list, name: str, start_after=0) -> DataFrame:
    """Dense numbers ``start_after + 1 ..`` in ``order`` (columns or names, ending in a unique
    key): one range-partitioned sort and the row counts of the partitions before, so that no
    task holds more than its range, however many rows share a day or a key's first columns.
    ``start_after`` is a Column (scalar subquery) or int.

    A sampled sort may cut its partitions elsewhere when it runs again: the sorted rows are
    written once (reliable checkpoint), with partition and place in one number, and what is
    below ``df`` runs once."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1))
    # one row per sort partition, sent to the rows, which need not be dealt again
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = start_after if not isinstance(start_after, int) else F.lit(start_after)
    return (placed.join(F.broadcast(before.select("_part", "_before")), "_part")
            .withColumn(name, (F.coalesce(base, F.lit(0)) + F.col("_before") + F.col("_nth") + 1).cast("bigint"))
            .drop("_at", "_part", "_nth", "_before"))


def number_in_groups(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Dense numbers from 1 within each ``group`` in ``order``: rows are numbered over all
    groups at once (``number_rows``) and a group's smallest number is taken off, so that a
    group that holds most rows is spread over tasks like any other."""
    numbered = number_rows(df, [*group, *order], "_number")
    first = numbered.groupBy(*group).agg(F.min("_number").alias("_first"))
    same = reduce(lambda a, b: a & b, [numbered[k].eqNullSafe(first[k]) for k in group])
    return (numbered.join(first, same).drop(*[first[k] for k in group])
            .withColumn(name, F.col("_number") - F.col("_first") + 1).drop("_number", "_first"))
