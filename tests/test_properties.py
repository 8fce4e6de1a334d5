"""Properties from SURVEY §5: purge splits the input exactly; upsert is idempotent."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from unievents.operators.writes import purge_ended, upsert_events

EV = "event_id long, name string, date date, time string, place string, price decimal(10,2), " \
     "short_description string, source_url string"

events = st.lists(st.tuples(st.sampled_from(["A", "B", "C"]),
                            st.dates(dt.date(2026, 5, 30), dt.date(2026, 6, 3)),
                            st.integers(0, 23), st.integers(0, 59)), min_size=1, max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=events, hour=st.integers(0, 23))
def test_purge_partitions_input(spark, rows, hour):
    data = [(i, n, d, f"{h:02d}:{m:02d}:00", "V", Decimal("1.00"), "", "") for i, (n, d, h, m) in enumerate(rows)]
    ev = spark.createDataFrame(data, EV)
    ec = spark.createDataFrame([(i, "IT") for i in range(len(data))], "event_id long, category_name string")
    now = dt.datetime(2026, 6, 1, hour, 30)
    kept, next_ec, deleted = purge_ended(ev, ec, now)
    k, d = {r.event_id for r in kept.collect()}, {r.event_id for r in deleted.collect()}
    assert k | d == set(range(len(data))) and not (k & d)
    assert d == {i for i, _, day, t, *_ in data
                 if day < now.date() or (day == now.date() and t < now.strftime("%H:%M:%S"))}
    assert {r.event_id for r in next_ec.collect()} == k


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=events)
def test_upsert_idempotent(spark, rows):
    batch = spark.createDataFrame([(i, n, d, f"{h:02d}:{m:02d}:00", "V", Decimal("1.00"), "", "")
                                   for i, (n, d, h, m) in enumerate(rows)],
                                  EV.replace("event_id", "batch_pos"))
    empty = spark.createDataFrame([], EV)
    once, _ = upsert_events(empty, batch)
    twice, log = upsert_events(once, batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == len({(n, d) for n, d, *_ in rows})
    assert {r.action for r in log.collect()} == {"updated"}
