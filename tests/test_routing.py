"""P6-P12 and D4 with the real site shapes (litexpo, meetup, kaveikti)."""

import datetime as dt

from pyspark.sql import functions as F

from unievents.operators.events import split_events, standardize_event_items
from unievents.operators.pages import (SITE_RULES, classify_source, filter_links, infer_city,
                                       page_links, resolve_links, rules_frame, top_links)


def _page(links):
    return "<html><body>" + "".join(f'<a href="{h}">x</a>' for h in links) + "</body></html>"


def test_site_rules(spark):
    pages = spark.createDataFrame([
        (1, "https://www.litexpo.lt/en/events/", _page(["/en/events/", "/en/events/expo-1/", "/en/events/expo-1/?a=1",
                                                          "https://other.lt/en/events/x/", "/en/news/1/"]), "litexpo"),
        (2, "https://www.meetup.com/find/?location=lt--Vilnius", _page(
            ["https://www.meetup.com/g/events/123/", "/find/events/", "/topics/events/", "https://meetup.com/h/events/9"]),
         "meetup"),
        (3, "https://kaveikti.lt/renginiai/", _page(["/renginiai/", "/Renginys-1/", "/apie/", "/renginiai/koncertas/"]),
         "kaveikti"),
    ], "page_id long, url string, html string, source string")
    links = resolve_links(page_links(pages)).join(pages.select("page_id", "source"), "page_id")
    kept = top_links(filter_links(links, rules_frame(spark, SITE_RULES)), 20)
    got = {}
    for r in kept.orderBy("page_id", "link_rank").collect():
        got.setdefault(r.page_id, []).append(r.link)
    assert got[1] == ["https://www.litexpo.lt/en/events/expo-1/"]
    assert got[2] == ["https://www.meetup.com/g/events/123/", "https://meetup.com/h/events/9/"]
    assert got[3] == ["https://kaveikti.lt/Renginys-1/", "https://kaveikti.lt/renginiai/koncertas/"]
    assert [r.link_rank for r in top_links(filter_links(links, rules_frame(spark, SITE_RULES)), 1)
            .where("page_id = 2").collect()] == [1]


def test_classify_and_city(spark):
    pages = spark.createDataFrame([
        (1, "https://www.litexpo.lt/en/events", "<p>x</p>", None, None),
        (2, "https://www.meetup.com/find/?location=lt--Vilnius&x=1", "<p>x</p>", None, None),
        (3, "https://www.meetup.com/g/", "<p>Events in Kaunas</p>", None, "lt--Kaunas"),
        (4, "https://www.meetup.com/g/?q=vilnius", "<p>x</p>", None, None),
        (5, "https://www.meetup.com/g/", "<p>EVENTS</p>", "Riga", None),
        (6, "https://kaveikti.lt/renginiai/", "<p>x</p>", None, None),
        (7, "https://example.com/", "<p>events vilnius</p>", None, None),
    ], "page_id long, url string, html string, city string, location string")
    out = {r.page_id: (r.source, r.city) for r in infer_city(classify_source(pages)).collect()}
    assert out == {1: ("litexpo", ""), 2: ("meetup", "Vilnius"), 3: ("meetup", "Kaunas"),
                   4: ("meetup", "Vilnius"), 5: ("meetup", "Riga"), 6: ("kaveikti", ""), 7: ("other", "")}


def test_place_defaults_and_split(spark):
    items = spark.createDataFrame([
        ("litexpo", "", "Expo", "2026-05-01", "", "", "free", ""),
        ("meetup", "Vilnius", "Meet", "2026-05-02", "18:00", "", "0", "About"),
        ("meetup", "", "Meet2", "2026-05-02", "18:00", "", "0", ""),
        ("other", "", "", "2026-05-03", "", "Hall", "5", ""),
        ("other", "", "Bad price", "2026-05-03", "", "Hall", "abc", ""),
    ], "source string, city string, raw_name string, raw_date string, raw_time string, raw_place string, "
       "raw_price string, raw_short_description string").withColumn("raw_source_url", F.lit(None).cast("string"))
    std = standardize_event_items(items, 2026)
    ok, failed = split_events(std)
    got = {r.name: (r.place, r.time, str(r.price), r.short_description) for r in ok.collect()}
    assert got == {"Expo": ("LITEXPO, Vilnius", "00:00:00", "0.00", "Event: Expo"),
                   "Meet": ("Vilnius", "18:00:00", "0.00", "About")}
    assert sorted(r.raw_name for r in failed.collect()) == ["", "Bad price", "Meet2"]
    assert ok.collect()[0].date == dt.date(2026, 5, 1)


def test_frontier_fallback_and_rejection(spark):
    from unievents.plans.scrape import link_frontier
    t = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    urls = spark.createDataFrame([
        ("https://www.meetup.com/a/events/1/", "meetup", "Vilnius", t[0], None, True),
        ("https://www.meetup.com/a/events/2/", "meetup", "vilnius", t[2], None, True),
        ("https://www.meetup.com/a/events/3/", "meetup", "Kaunas", t[1], None, True),
        ("https://www.meetup.com/a/events/4/", "meetup", "Vilnius", t[1], None, False),
    ], "url string, source string, city string, last_seen timestamp, last_scraped timestamp, is_active boolean")
    pages = spark.createDataFrame([
        (1, "https://www.meetup.com/find/", _page(["/find/x/"]), "meetup", "Vilnius"),          # no links -> saved
        (2, "https://kaveikti.lt/renginiai/", _page(["/apie/"]), "kaveikti", ""),              # nothing -> rejected
        (3, "https://www.meetup.com/find/", _page(["/g/events/7/"]), "meetup", "Vilnius"),     # found
    ], "page_id long, url string, html string, source string, city string")
    frontier, next_urls, rejected = link_frontier(pages, urls, rules_frame(spark, SITE_RULES),
                                                  dt.datetime(2026, 2, 1))
    got = {}
    for r in frontier.orderBy("page_id", "link_rank").collect():
        got.setdefault(r.page_id, []).append((r.link, r.origin))
    assert got[1] == [("https://www.meetup.com/a/events/2/", "saved"), ("https://www.meetup.com/a/events/1/", "saved")]
    assert got[3] == [("https://www.meetup.com/g/events/7/", "found")]
    assert [(r.page_id, r.error) for r in rejected.collect()] == [
        (2, "No event links found for source 'kaveikti' and no saved links are available.")]
    assert "https://www.meetup.com/g/events/7/" in {r.url for r in next_urls.collect()}
