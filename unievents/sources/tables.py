"""IO1 and the domain-table bindings.

The domain model (category, subject, student, student_subject, event, event-category
bridge) is derived from the driver's TPC-H-style tables, so every job reads real
Parquet and its work grows with the scale factor. The same bindings are written as
DuckDB CTEs in ``plans/oracle.py``; keep the two in step.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """IO1: scan one table. Projection and filters applied later reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category(category_id, name): one row per brand."""
    part = load_table(spark, sf_dir, "part")
    return (part.select("p_brand").distinct()
            .select(F.expr("try_cast(substr(p_brand, 7) AS BIGINT)").alias("category_id"),
                    F.col("p_brand").alias("name")))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject(subject_id, name, category_id NULL): every tenth part has no category."""
    part = load_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("subject_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_partkey") % 10 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.expr("try_cast(substr(p_brand, 7) AS BIGINT)")).alias("category_id"),
    )


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student(student_id, username)."""
    cust = load_table(spark, sf_dir, "customer")
    return cust.select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("username"))


def student_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student_subject(student_id, subject_id, interest NULL): a customer's parts; the
    highest line number is the rating, and above 5 it stays unrated (NULL)."""
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    j = items.join(orders, items.l_orderkey == orders.o_orderkey)
    g = j.groupBy(F.col("o_custkey").alias("student_id"), F.col("l_partkey").alias("subject_id")) \
         .agg(F.max("l_linenumber").alias("m"))
    return g.select("student_id", "subject_id",
                    F.when(F.col("m") <= 5, F.col("m")).cast("int").alias("interest"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event(event_id, name, date, time 'HH:mm:ss', price DECIMAL(10,2), place,
    short_description, source_url)."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                                   "o_orderdate", "o_orderpriority")
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation is a 25-row scan: Catalyst broadcasts it from file statistics, no hint needed
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    key = F.col("o_orderkey")
    return j.select(
        key.alias("event_id"),
        F.concat(F.lit("Event "), key.cast("string")).alias("name"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":"),
                 F.lpad(((key * 7) % 60).cast("string"), 2, "0"), F.lit(":00")).alias("time"),
        # exact decimal arithmetic: a double division would round ties differently per engine
        (F.col("o_totalprice").cast("decimal(18,2)") * F.lit(Decimal("0.001"))).cast("decimal(10,2)").alias("price"),
        F.col("n_name").alias("place"),
        F.concat(F.lit("Priority "), F.col("o_orderpriority")).alias("short_description"),
        F.concat(F.lit("https://events.example.com/e/"), key.cast("string")).alias("source_url"),
    )


def event_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge event_category(event_id, category_name) from an order's lines.
    Names come upper-cased or with a leading space so matching must use the D7 key."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    name = F.when(F.col("l_orderkey") % 2 == 0, F.upper("p_brand")) \
            .otherwise(F.concat(F.lit(" "), F.col("p_brand")))
    return j.select(F.col("l_orderkey").alias("event_id"), name.alias("category_name")).distinct()


def event_category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All category rows the events refer to (exact names, as stored)."""
    return event_categories(spark, sf_dir).select(F.col("category_name").alias("name")).distinct()
