"""Small ordinary inputs that once gave wrong rows."""

import datetime as dt
import html
import json

import pytest
from pyspark.sql import functions as F

from unievents.functions.text import page_text
from unievents.operators import filters, pages, writes
from unievents.operators.responses import response_events
from unievents.plans.recommend import recommend_events
from unievents.plans.scrape import load_event_responses, subject_prompts


def test_text_entities_and_node_spacing(spark):
    texts = ["&scaron;&ndash;&#8211;&#x10D;", "&amp;lt; &lt; &amp;amp;", "a &unknown; &#0; &#xD800; b", "&euro;&copy;", "plain", "& ; &;", "&#128512;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(page_text(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in texts]  # what is no character is U+FFFD
    body = "foo <!-- c --> bar<script>x</script>  <b>baz</b>"
    assert spark.createDataFrame([(body,)], "h string").select(page_text(F.col("h"))).first()[0] == "foo bar baz"
    long = "<p>" + "word " * 50_000 + "end</p>"
    assert spark.createDataFrame([(long,)], "h string").select(page_text(F.col("h"))).first()[0].endswith("end")


def test_hrefs_in_any_quotes(spark):
    body = """<a href='q1'>x</a><a href=u1>y</a><a data-href="dd" href="real">z</a><a class="x" HREF = "q2" title='a>b'>w</a><a name="n">v</a>
              <abbr href="no">u</abbr><a href="">t</a><a title="href=no" href="yes">s</a>"""
    rows = pages.page_links(spark.createDataFrame([(1, "http://h/", body)], "page_id int, url string, html string")).orderBy("pos").collect()
    assert [r.href for r in rows] == ["q1", "u1", "real", "q2", "", "yes"]


def test_url_goes_on_trimmed(spark):
    ok, bad = pages.validate_urls(spark.createDataFrame([(" http://x.lt/ ",), ("ftp://x",), (None,)], "url string"))
    assert [r.url for r in ok.collect()] == ["http://x.lt/"] and bad.count() == 2


def test_time_bounds(spark):
    ev = spark.createDataFrame([("09:00:00",), ("10:00:00",), ("19:00:00",)], "time string")
    assert filters.filter_events(ev, start_time="9:30").count() == 2
    assert filters.filter_events(ev, start_time="9:00", end_time="10:0:0").count() == 2
    with pytest.raises(ValueError):
        filters.filter_events(ev, start_time="late")
    with pytest.raises(ValueError):
        filters.filter_events(ev, start_time="10:00", end_time="9:30")


def _events(spark, rows):
    return spark.createDataFrame([(i, n, d, t, "p", None, "s", "u") for i, n, d, t in rows],
                                 "event_id bigint, name string, date date, time string, place string, price decimal(10,2), "
                                 "short_description string, source_url string")


def test_purge_keeps_events_without_date_or_time(spark):
    now = dt.datetime(2026, 3, 1, 12)
    ev = _events(spark, [(1, "a", None, "10:00:00"), (2, "b", now.date(), None), (3, "c", dt.date(2026, 2, 1), "10:00:00")])
    kept, bridge, gone = writes.purge_ended(ev, spark.createDataFrame([(1, "x"), (3, "y")], "event_id bigint, category_name string"), now)
    assert sorted(r.event_id for r in kept.collect()) == [1, 2] and [r.event_id for r in gone.collect()] == [3]
    assert [r.event_id for r in bridge.collect()] == [1]


def test_deleted_category_loses_its_bridge_rows(spark):
    tables = {"category": spark.createDataFrame([(1, "IT"), (2, "Art")], "category_id bigint, name string"),
              "subject": spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], "subject_id bigint, name string, category_id bigint"),
              "student_subject": spark.createDataFrame([(1, 1, 5), (1, 2, 5)], "student_id bigint, subject_id bigint, interest int"),
              "student": spark.createDataFrame([(1, "x")], "student_id bigint, username string"),
              "event_category": spark.createDataFrame([(1, "IT"), (1, "Art")], "event_id bigint, category_name string")}
    out = writes.delete_cascade(tables, category_ids=spark.createDataFrame([(1,)], "category_id bigint"))
    assert [tuple(r) for r in out["event_category"].collect()] == [(1, "Art")]
    assert out["subject"].count() == 2 and out["student_subject"].count() == 1


def test_repeated_category_fills_one_place(spark):
    day = dt.date(2026, 1, 1)
    ev = _events(spark, [(1, "a", day, "10:00:00"), (2, "b", day, "09:00:00")])
    ec = spark.createDataFrame([(1, "IT"), (1, "it "), (2, "IT")], "event_id bigint, category_name string")
    ss = spark.createDataFrame([(1, 1, 5)], "student_id bigint, subject_id bigint, interest int")
    sub = spark.createDataFrame([(1, "s", 1)], "subject_id bigint, name string, category_id bigint")
    cat = spark.createDataFrame([(1, "IT")], "category_id bigint, name string")
    assert [(r.event_id, r["rank"]) for r in recommend_events(ss, sub, cat, ec, ev, top_k=2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_last_link_of_a_url_counts(spark):
    urls = spark.createDataFrame([], "url string, source string, city string, last_seen timestamp, last_scraped timestamp, is_active boolean")
    links = spark.createDataFrame([(1, "u", "one", "A"), (3, "u", "three", None), (2, "u", "two", "B")], "pos int, url string, source string, city string")
    row = writes.upsert_urls(urls, links, dt.datetime(2026, 1, 1)).first()
    assert (row.source, row.city) == ("three", "")


def test_more_than_a_thousand_items_of_a_page(spark):
    item = lambda k, p: {"name": f"{p}{k}", "date": "2026-05-01", "time": "10:00", "place": "x", "price": "1", "categories": ["Food, Drinks"] if k else []}
    rows = [(1, "u1", json.dumps({"events": [item(k, "A") for k in range(1005)]})), (2, "u2", json.dumps({"events": [item(0, "B")]})),
            (3, "u3", '{"events": [], "events": [{"name": "C", "name": "last", "date": "2026-05-01", "place": "x", "price": "1"}]}')]
    responses = spark.createDataFrame(rows, "prompt_id bigint, url string, response string")
    ec = spark.createDataFrame([], "event_id bigint, category_name string")
    cat = spark.createDataFrame([], "category_id bigint, name string")
    out = load_event_responses(responses, _events(spark, []), ec, cat, 2026, per_link=False)
    log = out["log"].collect()
    assert len(log) == 1007 and len({r.event_id for r in log}) == 1007
    assert [r.event_id for r in sorted(log, key=lambda r: (r.prompt_id, r.item_pos))] == list(range(1, 1008))
    assert [r.name for r in log if r.prompt_id == 3] == ["last"]
    assert next(r.category_list for r in log if r.name == "A1") == ["Food, Drinks"]
    assert response_events(responses, per_link=False)[1].count() == 0


def test_requests_without_a_page_are_rejected(spark):
    requests = spark.createDataFrame([(1, "http://a/", "1", "2"), (2, "http://b/", "1", "2")], "request_id int, url string, from_semester string, to_semester string")
    fetched = spark.createDataFrame([(1, "http://a/", "old"), (2, "http://a/", "new")], "page_id int, url string, html string")
    prompts, rejected = subject_prompts(requests, fetched)
    assert [(r.request_id, r.text) for r in prompts.collect()] == [(1, "new")]
    assert [r.request_id for r in rejected.collect()] == [2]


def _operators(df):
    """The names of the plan's operators and expressions, as they are optimised."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reply_values_are_told_apart_without_their_schema(spark):
    from unievents.operators.responses import is_object
    cases = {"{}": True, '{"any": 1}': True, '{"events": [{"a": [1]}]}': True, "[]": False, '["any"]': False, "null": False, "1": False, '"any"': False, None: False, "{": False}
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "i int, text string").select("i", F.try_parse_json("text").alias("v"))
    got = rows.select("i", is_object(F.col("v")).alias("ok"))
    assert [r.ok for r in got.orderBy("i").collect()] == list(cases.values())
    assert "schemaofvariant" not in _operators(got).replace("_", "").lower()


def test_subject_names_are_trimmed_once_and_empty_lists_give_none(spark):
    from unievents.operators.responses import response_subjects
    rows = spark.createDataFrame([
        (1, '{"study_subjects": []}'), (2, '{"study_subjects": [" A ", "a", null, 7, "  ", "study _subjects:[ x"]}'), (3, "- B\n • c -\n\n{\n\tB"), (4, ""), (5, None)],
        "prompt_id long, response string")
    got = response_subjects(rows)
    assert sorted(map(tuple, got.collect())) == [(2, 0, "A"), (3, 0, "B"), (3, 1, "c")]
    filters = [line for line in _operators(got).splitlines() if "Filter" in line]
    assert filters and not any("trim(" in line or "size(" in line for line in filters)


def test_plain_dates_need_no_tokens_and_read_the_same(spark):
    from unievents.functions.standardize import standardize_date, with_standard_date
    cases = ["2026-03-15", "2026-3-5", "0000-1-1", "2026-02-30", "2026-13-01", "2026-00-10", " 2026-03-15 ", "2026-03-15\n", "2026–03–15", "15/03/2026", "May 5", "20 Smarch 2026", "26-03-15", "", None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "i int, raw string")
    got = with_standard_date(rows, "raw", "date", 2026)
    both = got.select("i", F.col("date").cast("string").alias("a"), standardize_date(F.col("raw"), 2026).cast("string").alias("b")).orderBy("i").collect()
    assert [r.a for r in both] == [r.b for r in both]
    assert [r.a for r in both] == ["2026-03-15", "2026-03-05", "0000-01-01", None, None, None, *["2026-03-15"] * 4, "2026-05-05", None, None, None, None]
    assert "_d_plain" in _operators(got)


def test_times_are_read_without_failing_casts(spark):
    from unievents.functions.standardize import standardize_time
    cases = {"9:5": "09:05:00", "09:05": "09:05:00", "23:59:59": "23:59:59", " 0:0:7 ": "00:00:07", "24:00": None, "12:60": None, "12:00:60": None,
             "12": None, "12:": None, "12:00:": None, "1:2:3:4": None, "123:00": None, "": None, None: None, "١:00": None}
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "i int, raw string")
    got = rows.select("i", standardize_time(F.col("raw")).alias("t"))
    assert [r.t for r in got.orderBy("i").collect()] == list(cases.values())
    assert "cast(" not in _operators(got)
