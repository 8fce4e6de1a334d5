"""F1-F7, F11, W13, D9 on the reference's own small cases."""

import datetime as dt
from decimal import Decimal

import pytest

from unievents.operators.filters import filter_events, listable
from unievents.operators.shaping import display_events
from unievents.operators.writes import purge_ended

EV = "event_id long, name string, date date, time string, place string, price decimal(10,2)"


@pytest.fixture
def two_events(spark):
    return spark.createDataFrame([
        (1, "Koncertas", dt.date(2026, 4, 5), "19:00:00", "Vilnius, Lithuania", Decimal("0.00")),
        (2, "Paroda", dt.date(2026, 5, 10), "10:00:00", "Kaunas", Decimal("50.00")),
    ], EV)


@pytest.mark.parametrize("bounds,expected", [
    ({"min_price": 10}, [2]), ({"max_price": 5}, [1]), ({"city": "vilnius"}, [1]), ({"city": "  "}, [1, 2]),
    ({"start_date": "2026-05-01", "end_date": "2026-05-31"}, [2]), ({"start_time": "09:00", "end_time": "11:00"}, [2]),
    ({"min_price": 0, "max_price": 100, "city": "kaunas", "start_time": "09:00"}, [2]), ({}, [1, 2]),
    ({"min_price": 100}, []), ({"start_date": "2026-04-05", "end_date": "2026-04-05"}, [1]),
])
def test_filters(two_events, bounds, expected):
    assert sorted(r.event_id for r in filter_events(two_events, **bounds).collect()) == expected


@pytest.mark.parametrize("bounds,message", [
    ({"min_price": 10, "max_price": 5}, "min_price cannot be greater than max_price."),
    ({"start_date": "2026-05-02", "end_date": "2026-05-01"}, "start_date cannot be greater than end_date."),
    ({"start_time": "12:00", "end_time": "11:00"}, "start_time cannot be greater than end_time."),
])
def test_inverted_ranges(two_events, bounds, message):
    with pytest.raises(ValueError, match=message):
        filter_events(two_events, **bounds)


def test_purge(spark):
    ev = spark.createDataFrame([(1, "Old", dt.date(2020, 1, 1), "10:00:00", "V", Decimal("1")),
                                (2, "New", dt.date(2030, 1, 1), "10:00:00", "V", Decimal("1")),
                                (3, "Today early", dt.date(2026, 6, 1), "09:00:00", "V", Decimal("1")),
                                (4, "Today late", dt.date(2026, 6, 1), "13:00:00", "V", Decimal("1"))], EV)
    ec = spark.createDataFrame([(1, "IT"), (2, "IT")], "event_id long, category_name string")
    kept, next_ec, deleted = purge_ended(ev, ec, dt.datetime(2026, 6, 1, 12, 0))
    assert sorted(r.event_id for r in deleted.collect()) == [1, 3]
    assert sorted(r.event_id for r in kept.collect()) == [2, 4]
    assert [r.event_id for r in next_ec.collect()] == [2]
    _, _, none = purge_ended(kept, next_ec, dt.datetime(2026, 6, 1, 12, 0))
    assert none.count() == 0


def test_display(spark):
    rows = spark.createDataFrame([
        (1, "A", "2026-01-01", "10:00", None, None, None),
        (2, "B", "2026-01-02", "11:00", "Hall", Decimal("0.00"), ["IT", "Art"]),
        (3, " ", "2026-01-03", "12:00", "Hall", Decimal("1.00"), []),
        (4, "D", None, "12:00", "Hall", Decimal("1.00"), []),
    ], "event_id long, name string, date string, time string, place string, price decimal(10,2), "
       "categories array<string>")
    out = {r.event_id: r for r in display_events(listable(rows)).collect()}
    assert sorted(out) == [1, 2]
    assert (out[1].place, out[1].price, out[1].categories) == ("-", "-", "-")
    assert (out[2].price, out[2].categories) == ("0,00 €", "IT, Art")


def test_keyword_search(spark):
    from unievents.operators.filters import keyword_search
    ev = spark.createDataFrame([(1, "Jazz Night", "Vilnius", "Live music"), (2, "Tech Talk", "Kaunas", "AI and jazz"),
                                (3, "Jazz", "Kaunas", None)], "event_id long, name string, place string, descr string")
    f = ["name", "place", "descr"]
    assert sorted(r.event_id for r in keyword_search(ev, "JAZZ kaunas", f).collect()) == [2, 3]
    assert [r.event_id for r in keyword_search(ev, "jazz", f, {"place": "Vilnius"}).collect()] == [1]
    assert keyword_search(ev, "", f).count() == 3


def test_index_finds_what_the_scan_finds(spark):
    """Random words of all lengths over fields with nulls, other scripts and repeats."""
    import random

    from unievents.operators.filters import keyword_search
    from unievents.operators.search import build_keyword_index, search_index
    rng = random.Random(5)
    words = ["Jazz", "ja", "z", "Ąžuolas", "open-air", "AIR", "12", "123", "3", "night jazz", "ΟΔΟΣ"]
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
    ev = spark.createDataFrame([(k, text(), text(), "x") for k in range(300)], "event_id long, name string, place string, gram string").repartition(4)
    asked = [(k, " ".join(rng.choice([*words, "azz", "zz", "nothing", "-a", "ž"]) for _ in range(rng.randint(0, 3)))) for k in range(40)]
    asked += [(100, None), (101, " \t "), (0, asked[0][1]), (102, "jazz\u00a0AIR")]
    fields = ["name", "place"]
    index = build_keyword_index(ev, fields)
    got = search_index(index, ev, spark.createDataFrame(asked, "search_id int, text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.search_id, []).append(r.event_id)
    for k, t in asked:
        want = [] if t is None else sorted(r.event_id for r in keyword_search(ev, t, fields).collect())
        assert sorted(found.get(k, [])) == want, t
    n, rows = index.postings.where("gram = 'žuo'").count(), index.postings.count()
    assert 0 < n < rows / 20


def test_f13_a_search_reads_the_postings_of_its_rarest_word_only(spark):
    from unievents.operators.search import build_keyword_index, search_index
    ev = spark.createDataFrame([(i, f"Event {i}", "hall" if i % 2 else None) for i in range(1000, 1400)] + [(None, "Event 1234", "hall")],
                               "event_id long, name string, place string")
    index = build_keyword_index(ev, ["name", "place"])
    held = {r.gram: r.n for r in index.postings.where("id is not null").groupBy("gram").count().withColumnRenamed("count", "n").collect()}
    assert held["1234"] == 1 and held["23"] == 14  # a word is a gram itself
    assert not held.keys() & {"event", "t 1", "e"}  # held by many: a count, no postings
    asked = spark.createDataFrame([(1, "EVENT 1234"), (2, "hall event 123"), (3, "event 9"), (4, "nothing event"), (5, " "), (6, None)],
                                  "search_id int, text string")
    got = {(r.search_id, r.event_id) for r in search_index(index, ev, asked).collect()}
    ids = range(1000, 1400)
    assert got == {(1, 1234)} | {(2, i) for i in ids if "123" in str(i) and i % 2} | {(3, i) for i in ids if "9" in str(i)} | {(5, i) for i in ids}


def test_f13_the_index_holds_one_row_for_a_place_of_the_texts(spark, tmp_path):
    """Not one for every gram that starts there, and no shuffle files stay behind."""
    from unievents.operators.search import build_keyword_index, search_index
    n = 3000
    ev = spark.range(n).selectExpr("id AS event_id", "concat('Event ', id + 10000) AS name", "concat('hall ', id % 7) AS place")
    kept = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(kept)
    index = build_keyword_index(ev, ["name", "place"], root=str(tmp_path / "index"))
    assert spark.conf.get(kept) == before
    held = [spark.read.parquet(str(d)) for d in (tmp_path / "index").iterdir() if d.name != "counts"]
    assert sum(x.count() for x in held) <= n * len("Event 10000hall 0")
    asked = spark.createDataFrame([(1, "12999"), (2, "1299 3")], "search_id int, text string")
    got = {(r.search_id, r.event_id) for r in search_index(index, ev, asked).collect()}
    assert got == {(1, 2999)} | {(2, i) for i in range(2990, 3000) if "3" in str(i + 10000) or i % 7 == 3}


def test_f13_searches_beyond_those_sent_find_the_same(spark, monkeypatch):
    """Searches of equal counts, of one gram, and marks that many grams share."""
    from unievents.operators import search
    from unievents.operators.filters import keyword_search
    rows = [(i, f"Event {i}", "hall" if i % 2 else None) for i in range(1000, 1300)] + [(None, "Event 1234", "hall"), (1007, "Event 1007", "x")]
    ev = spark.createDataFrame(rows, "event_id long, name string, place string")
    texts = ["23", "event 23", "9 hall", "1234", "event 1007", "100", "77 hall", "no", "", "vent 12", "12345678", "1299"]
    asked = spark.createDataFrame(list(enumerate(texts)), "search_id int, text string")
    want = sorted((k, r.event_id) for k, t in enumerate(texts) for r in keyword_search(ev, t, ["name", "place"]).collect() if r.event_id is not None)
    index = search.build_keyword_index(ev, ["name", "place"])
    for sent, bits in ((3, 7), (0, 24), (1 << 16, 24)):
        monkeypatch.setattr(search, "SENT", sent)
        monkeypatch.setattr(search, "MARK_BITS", bits)
        assert sorted((r.search_id, r.event_id) for r in search.search_index(index, ev, asked).collect()) == want, sent
