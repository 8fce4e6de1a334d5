"""Aggregations. All are hash aggregates with map-side partial aggregation, so
only one row per group and partition crosses the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interest_by_category(rated_cats: DataFrame) -> DataFrame:
    """Strongest interest per (student, category key)."""
    return rated_cats.groupBy("student_id", "category_key").agg(F.max("interest").alias("interest"))


def categories_per_event(ec: DataFrame) -> DataFrame:
    """Sorted distinct category names per event (bounded by an event's own tags)."""
    return ec.groupBy("event_id").agg(F.array_sort(F.collect_set("category_name")).alias("categories"))


def categories_used(interests: DataFrame) -> DataFrame:
    """Sorted distinct category keys a student's ratings touch (at most #categories)."""
    return interests.groupBy("student_id").agg(F.array_sort(F.collect_set("category_key")).alias("categories_used"))


def run_counters(log: DataFrame, action_col: str = "action",
                 actions: tuple[str, ...] = ("created", "updated", "unchanged", "assigned",
                                             "existing", "failed", "deleted")) -> DataFrame:
    """One-pass counters over an action log, plus the input count."""
    aggs = [F.count_if(F.col(action_col) == a).alias(f"{a}_count") for a in actions]
    return log.agg(F.count(F.lit(1)).alias("input_count"), *aggs)


def student_flags(stu: DataFrame, ss: DataFrame) -> DataFrame:
    """Has any subject / has any rated subject, per student."""
    f = ss.groupBy("student_id").agg(F.lit(True).alias("has_subjects"),
                                     F.bool_or(F.col("interest") > 0).alias("has_rated"))
    return (stu.select("student_id").join(f, "student_id", "left")
               .select("student_id",
                       F.coalesce("has_subjects", F.lit(False)).alias("has_subjects"),
                       F.coalesce("has_rated", F.lit(False)).alias("has_rated")))
