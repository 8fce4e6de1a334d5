"""Predicates and projections. Plain column predicates, so Catalyst pushes the
price/date/time bounds into the Parquet scan when the events table is a file source."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_ws

# ---- fixed values -------------------------------------------------------------------
INVERTED_RANGE = "{low} cannot be greater than {high}."
# -------------------------------------------------------------------------------------


def _pad_time(t: str | None) -> str | None:
    """A bound as 'HH:mm:ss' text, by the D2 rule (one or two digits each, seconds
    optional); an unreadable bound is an error."""
    if t is None:
        return None
    parts = re.fullmatch(r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", str(t).strip())
    h, m, s = (int(x or 0) for x in parts.groups()) if parts else (24, 0, 0)
    if h > 23 or m > 59 or s > 59:
        raise ValueError(f"unreadable time: {t}")
    return f"{h:02d}:{m:02d}:{s:02d}"


def validate_filter_args(min_price=None, max_price=None, start_date=None, end_date=None,
                         start_time=None, end_time=None) -> None:
    """reject inverted ranges at plan time, with the reference's messages."""
    if min_price is not None and max_price is not None and Decimal(str(min_price)) > Decimal(str(max_price)):
        raise ValueError(INVERTED_RANGE.format(low="min_price", high="max_price"))
    if start_date and end_date and str(start_date) > str(end_date):
        raise ValueError(INVERTED_RANGE.format(low="start_date", high="end_date"))
    if start_time and end_time and _pad_time(start_time) > _pad_time(end_time):
        raise ValueError(INVERTED_RANGE.format(low="start_time", high="end_time"))


def filter_request_reasons(requests: DataFrame) -> DataFrame:
    """F6 for a batch: requests (min_price, max_price, start_date, end_date, start_time,
    end_time) with the ``reason`` why one is refused, the first that holds, or null. Times
    are 'HH:mm:ss'; a missing bound refuses nothing."""
    def inverted(low: str, high: str) -> Column:
        return F.when(F.col(low) > F.col(high), F.lit(INVERTED_RANGE.format(low=low, high=high)))

    return requests.withColumn("reason", F.coalesce(
        inverted("min_price", "max_price"), inverted("start_date", "end_date"), inverted("start_time", "end_time")))


def event_filter_predicate(min_price=None, max_price=None, start_date=None, end_date=None,
                           city: str | None = None, start_time=None, end_time=None) -> Column:
    """AND of the given bounds (inclusive); no bound -> TRUE.
    F3 city: case-insensitive substring of ``place``; blank city means no filter."""
    preds: list[Column] = []
    if min_price is not None:
        preds.append(F.col("price") >= F.lit(Decimal(str(min_price))))
    if max_price is not None:
        preds.append(F.col("price") <= F.lit(Decimal(str(max_price))))
    if start_date is not None:
        preds.append(F.col("date") >= F.lit(dt.date.fromisoformat(str(start_date))))
    if end_date is not None:
        preds.append(F.col("date") <= F.lit(dt.date.fromisoformat(str(end_date))))
    c = (city or "").strip()
    if c:
        preds.append(F.contains(F.lower(F.col("place")), F.lit(c.lower())))
    if start_time is not None:
        preds.append(F.col("time") >= F.lit(_pad_time(start_time)))
    if end_time is not None:
        preds.append(F.col("time") <= F.lit(_pad_time(end_time)))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def filter_events(ev: DataFrame, **bounds) -> DataFrame:
    """F1-F6 on the events table."""
    validate_filter_args(**{k: v for k, v in bounds.items() if k != "city"})
    return ev.where(event_filter_predicate(**bounds))


def ended_predicate(now: dt.datetime) -> Column:
    """``date < today OR (date = today AND time < now)`` (UTC, strict)."""
    today = F.lit(now.date())
    t = F.lit(now.strftime("%H:%M:%S"))
    return (F.col("date") < today) | ((F.col("date") == today) & (F.col("time") < t))


def ended_events(ev: DataFrame, now: dt.datetime) -> DataFrame:
    return ev.where(ended_predicate(now))


def rated(ss: DataFrame) -> DataFrame:
    """F8: interest > 0 (NULL dropped; 1 'not interested' still counts)."""
    return ss.where(F.col("interest") > 0)


def saved_urls(urls: DataFrame, source: str, city: str = "") -> DataFrame:
    """active URLs of a source, optional case-insensitive city equality."""
    out = urls.where((F.col("source") == source) & F.col("is_active"))
    if city:
        out = out.where(F.lower(F.col("city")) == city.lower())
    return out


def listable(df: DataFrame) -> DataFrame:
    """rows shown in the listing need a non-blank name and date."""
    return df.where((F.coalesce(trim_ws(F.col("name")), F.lit("")) != "")
                    & (F.coalesce(trim_ws(F.col("date").cast("string")), F.lit("")) != ""))


def keyword_search(df: DataFrame, text: str, fields: list[str],
                   facets: dict[str, object] | None = None) -> DataFrame:
    """every word of ``text`` must occur (any case) in at least one of ``fields``;
    ``facets`` are exact-value filters."""
    pred = F.lit(True)
    for word in text.split():
        w = F.lit(word.lower())
        pred = pred & reduce(lambda a, b: a | b,
                             [F.coalesce(F.contains(F.lower(F.col(f).cast("string")), w), F.lit(False))
                              for f in fields])
    for k, v in (facets or {}).items():
        pred = pred & (F.col(k) == F.lit(v))
    return df.where(pred)
