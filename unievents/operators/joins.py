"""The equi-joins of the domain model.

Physical strategy is left to Catalyst + AQE: a side that turns out small at run time is
broadcast, and skewed partitions are split, without a probe at plan time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import category_key, trim_ws
from .filters import rated


def subjects_with_category(sub: DataFrame, cat: DataFrame) -> DataFrame:
    """Subject LEFT JOIN category (nullable FK)."""
    c = cat.select(F.col("category_id"), F.col("name").alias("category_name"))
    return sub.join(c, "category_id", "left")


def requested_interests(sub: DataFrame, ss: DataFrame, requests: DataFrame) -> DataFrame:
    """J2 for requests (student_id, subject_id): the asked subjects with the student's
    interest; repeated requests are one row, those with a null or an unknown subject none."""
    rows = requests.select("student_id", "subject_id").where("student_id is not null").distinct().join(sub, "subject_id")
    return rows.join(ss.select("student_id", "subject_id", "interest"), ["student_id", "subject_id"], "left")


def subject_category_keys(sub: DataFrame, cat: DataFrame) -> DataFrame:
    """subject_id -> D7 category key (subjects without a usable category dropped)."""
    c = cat.select("category_id", category_key(F.col("name")).alias("category_key"))
    return (sub.select("subject_id", "category_id")
               .join(c, "category_id")
               .where(F.col("category_key").isNotNull())
               .select("subject_id", "category_key"))


def rated_categories(ss: DataFrame, sub: DataFrame, cat: DataFrame) -> DataFrame:
    """Rated student_subject rows with their subject's category key."""
    return rated(ss).select("student_id", "subject_id", "interest") \
        .join(subject_category_keys(sub, cat), "subject_id")


def event_category_keys(ec: DataFrame) -> DataFrame:
    """J4 key form: distinct (event_id, category_key) from the bridge's category names;
    names that differ in case or spaces only are one key of an event."""
    return (ec.select("event_id", category_key(F.col("category_name")).alias("category_key"))
              .where(F.col("category_key").isNotNull()).distinct())


def resolve_subjects(sub: DataFrame, keys: DataFrame) -> DataFrame:
    """F10 lookups: by id, or by case-insensitive trimmed name with the lowest id winning.
    Returns (lookup STRING, subject_id)."""
    out = []
    if "subject_id" in keys.columns:
        by_id = keys.select(F.col("subject_id")).where(F.col("subject_id").isNotNull()) \
            .join(sub.select("subject_id"), "subject_id") \
            .select(F.col("subject_id").cast("string").alias("lookup"), "subject_id")
        out.append(by_id)
    if "subject_name" in keys.columns:
        k = keys.select(F.col("subject_name").alias("lookup"),
                        F.lower(trim_ws(F.col("subject_name"))).alias("_k")).where(F.col("_k") != "")
        s = sub.select("subject_id", F.lower(F.col("name")).alias("_k"))
        first = s.groupBy("_k").agg(F.min("subject_id").alias("subject_id"))
        out.append(k.join(first, "_k").select("lookup", "subject_id"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def attach_ratings(names: DataFrame, ratings: DataFrame) -> DataFrame:
    """Extracted names (student_id, name) LEFT JOIN the students' ratings (student_id,
    name, interest, pos) by exact name; a missing rating is 0; with duplicate names of a
    student the last one (highest ``pos``) wins."""
    key = ["student_id", "name"]
    last = ratings.groupBy(*key).agg(F.max_by("interest", "pos").alias("interest"))
    return names.join(last, key, "left").withColumn("interest", F.coalesce("interest", F.lit(0)))


def resolve_names(names: DataFrame, sub: DataFrame) -> DataFrame:
    """Name -> subject_id by trimmed lower-case name (lowest id on collisions)."""
    s = sub.groupBy(F.lower(trim_ws(F.col("name"))).alias("_k")).agg(F.min("subject_id").alias("subject_id"))
    return names.withColumn("_k", F.lower(trim_ws(F.col("name")))).join(s, "_k", "left").drop("_k")


def student_profile(stu: DataFrame, ss: DataFrame, sub: DataFrame) -> DataFrame:
    """One row per (student, subject name) with the student's username and subject
    count; students without subjects keep one row with a NULL name. Rows, not a
    collected list: a student holding a large share of all links never becomes one
    in-memory group (the count comes from a partially aggregated groupBy)."""
    links = ss.select("student_id", "subject_id").join(sub.select("subject_id", F.col("name").alias("subject_name")),
                                                       "subject_id")
    counts = ss.groupBy("student_id").agg(F.count(F.lit(1)).alias("n_subjects"))
    return (stu.select("student_id", "username").join(links.select("student_id", "subject_name"), "student_id", "left")
               .join(counts, "student_id", "left")
               .withColumn("n_subjects", F.coalesce("n_subjects", F.lit(0)).cast("bigint")))


def check_refs(batch: DataFrame, dim: DataFrame, batch_key: str, dim_key: str | None = None,
               reason: str = "not found") -> tuple[DataFrame, DataFrame]:
    """Split a batch into rows whose key exists in ``dim`` and rows that do not."""
    dk = dim.select(F.col(dim_key or batch_key).alias(batch_key)).distinct()
    ok = batch.join(dk, batch_key, "left_semi")
    failed = batch.join(dk, batch_key, "left_anti").withColumn("reason", F.lit(reason))
    return ok, failed


def split_new(batch: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Flag each batch row ``is_new`` when its key is absent from ``table``."""
    k = table.select(*keys).distinct().withColumn("_exists", F.lit(True))
    return batch.join(k, keys, "left").withColumn("is_new", F.col("_exists").isNull()).drop("_exists")
