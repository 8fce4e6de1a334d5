"""W1/W3/W4/W8/W10/W11 semantics and snapshot versions on small batches."""

import datetime as dt
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from unievents.operators.writes import (assign_to_students, set_event_categories, touch_urls,
                                        upsert_events, upsert_urls, URL_COLS)
from unievents.sources.snapshot import read_latest, write_version

EV = "event_id long, name string, date date, time string, place string, price decimal(10,2), " \
     "short_description string, source_url string"
BATCH = "batch_pos long, name string, date date, time string, place string, price decimal(10,2), " \
        "short_description string, source_url string"


def _events(spark):
    return spark.createDataFrame([(1, "Koncertas", dt.date(2026, 4, 5), "19:00:00", "Vilnius", Decimal("10.00"), "d", "")], EV)


def test_upsert_batch_order_and_ids(spark):
    ev = _events(spark)
    batch = spark.createDataFrame([
        (1, "Koncertas", dt.date(2026, 4, 5), "20:00:00", "Kaunas", Decimal("12.00"), "x", ""),
        (2, "Paroda", dt.date(2026, 5, 1), "10:00:00", "Vilnius", Decimal("0.00"), "y", ""),
        (3, "Paroda", dt.date(2026, 5, 1), "11:00:00", "Klaipeda", Decimal("1.00"), "z", ""),
    ], BATCH)
    nxt, log = upsert_events(ev, batch)
    rows = {r.name: r for r in nxt.collect()}
    assert rows["Koncertas"].event_id == 1 and rows["Koncertas"].place == "Kaunas"
    assert rows["Paroda"].event_id == 2 and rows["Paroda"].place == "Klaipeda"  # last row wins
    assert [(r.batch_pos, r.action, r.event_id) for r in log.orderBy("batch_pos").collect()] == [
        (1, "updated", 1), (2, "created", 2), (3, "updated", 2)]
    # idempotent: applying the same batch again changes nothing
    again, _ = upsert_events(nxt, batch)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nxt.collect()))


def test_duplicate_rejection(spark):
    ev = _events(spark)
    batch = spark.createDataFrame([(1, "Koncertas", dt.date(2026, 4, 5), "20:00:00", "K", Decimal("1.00"), "", "")], BATCH)
    nxt, log = upsert_events(ev, batch, on_duplicate="reject")
    assert log.collect()[0].action == "rejected" and nxt.collect()[0].place == "Vilnius"


def test_category_sets(spark):
    ec = spark.createDataFrame([(1, "IT"), (2, "Art")], "event_id long, category_name string")
    cat = spark.createDataFrame([(1, "IT"), (2, "Art")], "category_id long, name string")
    asg = spark.createDataFrame([(1, 1, ["Music", " Music ", ""]), (2, 2, []), (3, 1, ["IT", "Law"])],
                                "batch_pos long, event_id long, categories array<string>")
    nec, ncat = set_event_categories(ec, cat, asg)
    assert sorted(map(tuple, nec.collect())) == [(1, "IT"), (1, "Law"), (2, "Art")]  # empty list keeps old
    assert sorted(r.name for r in ncat.collect()) == ["Art", "IT", "Law", "Music"]


def test_assign_and_url_registry(spark):
    ss = spark.createDataFrame([(1, 10, 5)], "student_id long, subject_id long, interest int")
    nss, log = assign_to_students(ss, spark.createDataFrame([(1, 10), (1, 11)], "student_id long, subject_id long"))
    assert sorted(map(tuple, nss.collect())) == [(1, 10, 5), (1, 11, None)]
    assert {r.subject_id: r.assignment_action for r in log.collect()} == {10: "existing", 11: "created"}

    t0, t1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
    urls = spark.createDataFrame([("https://m/e/1/", "meetup", "", t0, None, True)],
                                 "url string, source string, city string, last_seen timestamp, "
                                 "last_scraped timestamp, is_active boolean")
    links = spark.createDataFrame([(1, "https://m/e/1/", "meetup", "Vilnius"), (2, "https://m/e/2/", "meetup", "Vilnius")],
                                  "pos int, url string, source string, city string")
    nxt = upsert_urls(urls, links, t1)
    assert sorted((r.url, r.city, r.last_seen) for r in nxt.collect()) == [
        ("https://m/e/1/", "Vilnius", t1), ("https://m/e/2/", "Vilnius", t1)]
    touched = touch_urls(nxt, spark.createDataFrame([("https://m/e/2/",)], "url string"), t1)
    assert {r.url: r.last_scraped for r in touched.collect()} == {"https://m/e/1/": None, "https://m/e/2/": t1}
    assert touched.columns == URL_COLS


def test_snapshot_versions(spark):
    root = tempfile.mkdtemp(prefix="unievents-snap-")
    write_version(spark.range(3), root, "t")
    write_version(spark.range(5), root, "t")
    assert read_latest(spark, root, "t").count() == 5
    assert read_latest(spark, root, "missing") is None
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_import_subjects_case_rules(spark):
    from unievents.operators.writes import import_subjects
    sub = spark.createDataFrame([(1, "Databases", 1), (2, "Law basics", None)], "subject_id long, name string, category_id long")
    cat = spark.createDataFrame([(1, "IT"), (2, "Law")], "category_id long, name string")
    batch = spark.createDataFrame([(1, "databases", "it"), (2, "DATABASES", "Law"), (3, "Law basics", "law"),
                                   (4, "Robotics", "Engineering"), (5, "Ethics", "ENGINEERING")],
                                  "batch_pos long, subject string, category string")
    nsub, ncat, log = import_subjects(sub, cat, batch)
    got = {r.batch_pos: (r.subject_id, r.category_name, r.action) for r in log.collect()}
    # batch rows 1 and 2 name the same subject (case-insensitive): only the first is imported
    assert got == {1: (1, "IT", "unchanged"), 3: (2, "Law", "updated"),
                   4: (3, "Engineering", "created"), 5: (4, "Engineering", "created")}
    assert sorted(r.name for r in ncat.collect()) == ["Engineering", "IT", "Law"]
    assert {r.name: r.category_id for r in nsub.collect()} == {"Databases": 1, "Law basics": 2, "Robotics": 3,
                                                               "Ethics": 3}


def test_interest_upsert_and_bulk_update(spark):
    from unievents.operators.writes import update_interest, upsert_interest
    sub = spark.createDataFrame([(i, f"S{i}", None) for i in range(1, 6)], "subject_id long, name string, category_id long")
    ss = spark.createDataFrame([], "student_id long, subject_id long, interest int")
    batch = spark.createDataFrame([(1, 1, 1, "4"), (2, 1, 2, "3"), (3, 1, 3, "5"), (4, 1, 4, "1"), (5, 1, 1, "2"),
                                   (6, 1, 2, "0"), (7, 1, 3, "6"), (8, 1, 99, "3"), (9, 1, 4, "x")],
                                  "batch_pos long, student_id long, subject_id long, interest string")
    nss, log = upsert_interest(ss, sub, batch)
    assert sorted(map(tuple, nss.collect())) == [(1, 1, 2), (1, 2, 3), (1, 3, 5), (1, 4, 1)]
    acts = {r.batch_pos: (r.action, r.reason) for r in log.collect()}
    assert [acts[i][0] for i in range(1, 6)] == ["created"] * 4 + ["updated"]
    assert acts[6] == ("rejected", "subject_id and interest are required")
    assert acts[7] == ("rejected", "Interest must be between 1 and 5")
    assert acts[8] == ("rejected", "Subject not found")
    assert acts[9] == ("rejected", "Interest must be a number")

    bulk = spark.createDataFrame([(0, True, "1", "5"), (1, True, "99", "3"), (2, True, "2", "9"), (3, True, "5", "3"),
                                  (4, False, None, None), (5, True, None, "3")],
                                 "batch_pos long, is_object boolean, subject_id string, interest string")
    nss2, log2 = update_interest(nss, sub, bulk.withColumn("student_id", F.lit(1).cast("bigint")))
    errs = {r.batch_pos: r.error for r in log2.collect()}
    assert errs == {0: None, 1: "Subject not found", 2: "Interest must be between 1 and 5",
                    3: "Student-subject relation not found", 4: "Each subjects item must be an object.",
                    5: "subject_id and interest are required"}
    assert {r.subject_id: r.interest for r in nss2.collect()}[1] == 5


def test_insert_new_and_delete(spark):
    from unievents.operators.writes import delete_events, insert_new
    cat = spark.createDataFrame([(1, "IT")], "category_id long, name string")
    batch = spark.createDataFrame([(1, "IT"), (2, "Law"), (3, "Law"), (4, " "), (5, "it")], "batch_pos long, name string")
    nxt, log = insert_new(cat, batch, "name", "category_id", "Category already exists")
    assert sorted(map(tuple, nxt.collect())) == [(1, "IT"), (2, "Law"), (3, "it")]  # exact names: 'it' is new
    got = {r.batch_pos: (r.action, r.reason, r.category_id) for r in log.collect()}
    assert got[1] == ("rejected", "Category already exists", 1)
    assert got[2] == ("created", None, 2) and got[3] == ("rejected", "Category already exists", 2)
    assert got[4][:2] == ("rejected", "name is required") and got[5] == ("created", None, 3)

    ev = spark.createDataFrame([(1, "A", dt.date(2026, 1, 1)), (2, "B", dt.date(2026, 1, 2))],
                               "event_id long, name string, date date")
    ec = spark.createDataFrame([(1, "IT"), (2, "Law")], "event_id long, category_name string")
    nev, nec, dlog = delete_events(ev, ec, spark.createDataFrame([(2,), (999,)], "event_id long"))
    assert [r.event_id for r in nev.collect()] == [1] and [r.event_id for r in nec.collect()] == [1]
    assert {r.event_id: r.action for r in dlog.collect()} == {2: "deleted", 999: "not_found"}
