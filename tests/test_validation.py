"""The six strict requirement payloads, each failing with its own message."""

from unievents.operators.events import STRICT_MESSAGES, validate_events

BASE = dict(raw_name="Koncertas", raw_date="2026-04-05", raw_time="19:00", raw_place="Vilnius",
            raw_price="15.50", raw_short_description="Vakaro koncertas", categories=["Muzika"])
COLS = ["case_id", "raw_name", "raw_date", "raw_time", "raw_place", "raw_price", "raw_short_description", "categories"]
SCHEMA = ("case_id int, raw_name string, raw_date string, raw_time string, raw_place string, raw_price string, "
          "raw_short_description string, categories array<string>")


def test_strict_payloads(spark):
    cases = [({}, None), ({"raw_name": ""}, "name"), ({"raw_date": "05-04"}, "date"), ({"raw_time": "7 PM"}, "time"),
             ({"categories": []}, "categories"), ({"raw_short_description": "apr"}, "description"),
             ({"raw_price": "12.345"}, "price")]
    rows = []
    for i, (change, _) in enumerate(cases):
        p = {**BASE, **change}
        rows.append(tuple([i] + [p[c] for c in COLS[1:]]))
    got = {r.case_id: r.error for r in validate_events(spark.createDataFrame(rows, SCHEMA), strict=True).collect()}
    assert got == {i: (STRICT_MESSAGES[k] if k else None) for i, (_, k) in enumerate(cases)}


def test_basic_rules(spark):
    rows = [(0, "A", "2026-04-05", "", "Hall", "", "", []), (1, "A", "", "", "Hall", "1", "", []),
            (2, "A", "someday", "", "Hall", "1", "", []), (3, "A", "2026-04-05", "", "Hall", "abc", "", []),
            (4, "A", "2026-04-05", "", "", "1", "", [])]
    got = {r.case_id: r.error for r in validate_events(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: None, 1: "'date' is required (YYYY-MM-DD).", 2: "Invalid 'date' format. Use YYYY-MM-DD.",
                   3: "Invalid 'price' value.", 4: "'place' is required."}
