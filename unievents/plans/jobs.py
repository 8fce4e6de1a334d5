"""Runnable jobs over versioned tables: read the newest snapshot of each table, compute,
write the next versions. This is how the upserts run in production: a job never
overwrites what it reads, and each written version cuts the lineage for the next job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import write_events_json
from ..sources.snapshot import default_root, read_latest, write_version
from .scrape import load_event_responses, mark_scraped


def seed_tables(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Write the first version of each table (e.g. from the bindings)."""
    return {name: write_version(df, root, name) for name, df in tables.items()}


def run_event_load(spark: SparkSession, responses: DataFrame, as_of_year: int,
                   root: str | None = None, result_path: str | None = None,
                   now: dt.datetime | None = None) -> dict[str, str]:
    """R9 job 2 against the newest snapshots under ``root`` (default: the shared
    checkpoint folder): writes the next ``event``, ``event_category`` and ``category``
    versions and the action log, and optionally the IO7 result documents. Where there is a
    ``url`` table and ``now`` is given, the next one has the scraped links touched (W11).
    Returns the written paths."""
    root = root or default_root(spark)
    ev = read_latest(spark, root, "event")
    ec = read_latest(spark, root, "event_category")
    cat = read_latest(spark, root, "category")
    if ev is None or ec is None or cat is None:
        raise FileNotFoundError(f"tables event, event_category and category must exist under {root}")
    out = load_event_responses(responses, ev, ec, cat, as_of_year)
    written = {
        "event": write_version(out["next_events"], root, "event"),
        "event_category": write_version(out["next_bridge"], root, "event_category"),
        "category": write_version(out["next_categories"], root, "category"),
        "event_load_log": write_version(out["log"], root, "event_load_log"),
    }
    log = spark.read.parquet(written["event_load_log"])
    urls = read_latest(spark, root, "url") if now else None
    if urls is not None:
        written["url"] = write_version(mark_scraped(urls, log, now), root, "url")
    if result_path:
        listing = tuple(c for c in ("url", "source", "city") if c in responses.columns)
        if len(listing) > 1:  # one row per response, so the listing's columns come back by its id
            log = log.drop(*listing[1:]).join(responses.select("prompt_id", *listing[1:]), "prompt_id", "left")
        saved = log.where(F.col("action") != "failed").select(
            *listing, "event_id", "name", "date", "time", "place", "price",
            F.col("category_list").alias("categories"), "short_description", "source_url")
        failed = log.where(F.col("action") == "failed").select(
            *listing, F.col("url").alias("source_url"), "name", "error", F.col("raw_item").alias("raw"))
        write_events_json(saved, failed, result_path, keys=listing)
        written["result"] = result_path
    return written
