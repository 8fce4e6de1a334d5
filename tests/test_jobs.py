"""Snapshot-based event load: seed tables, load responses twice, check versions."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from unievents.plans.jobs import run_event_load, seed_tables
from unievents.sources import responses as RS
from unievents.sources import tables as T
from unievents.sources.files import load_events_json
from unievents.sources.snapshot import read_latest

SF = "/root/testdata/sf0.001"


def test_event_load_job(spark):
    root = tempfile.mkdtemp(prefix="unievents-tables-")
    seed_tables({"event": T.events(spark, SF), "event_category": T.event_categories(spark, SF),
                 "category": T.categories(spark, SF)}, root)
    n0 = read_latest(spark, root, "event").count()
    resp = RS.event_responses(spark, SF)
    seen, now = dt.datetime(2026, 1, 1), dt.datetime(2026, 6, 1, 12)
    urls = resp.select("url").distinct().select("url", F.lit("meetup").alias("source"), F.lit("").alias("city"), F.lit(True).alias("is_active"),
                                                F.lit(seen).alias("last_seen"), F.lit(None).cast("timestamp").alias("last_scraped"))
    seed_tables({"url": urls}, root)
    w1 = run_event_load(spark, resp, 2026, root, os.path.join(root, "result"), now)
    parsed = spark.read.parquet(w1["event_load_log"]).where("item_pos is not null").select("url").distinct()
    touched = read_latest(spark, root, "url").where(F.col("last_scraped") == now).select("url")
    assert 0 < parsed.count() == touched.count() and touched.exceptAll(parsed).count() == 0
    assert read_latest(spark, root, "url").count() == urls.count()
    assert w1["event"].endswith("v=2")
    log = spark.read.parquet(w1["event_load_log"])
    created = log.where("action = 'created'").count()
    assert read_latest(spark, root, "event").count() == n0 + created > n0
    assert load_events_json(spark, w1["result"], multi_line=False).count() == log.where("action <> 'failed'").count()
    # loading the same responses again creates nothing new
    w2 = run_event_load(spark, resp, 2026, root)
    assert w2["event"].endswith("v=3")
    assert spark.read.parquet(w2["event_load_log"]).where("action = 'created'").count() == 0
    assert read_latest(spark, root, "event").count() == n0 + created
