"""Standardise raw event rows and split them into accepted and
rejected, each rejection keeping its name, reason and raw row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.standardize import (DEFAULT_TIME, LITEXPO_PLACE, standardize_date,
                                     standardize_price, standardize_time, with_standard_date)
from ..functions.text import trim_ws

# ---- fixed values -------------------------------------------------------------------
MISSING_FIELDS = "Missing or invalid required fields (name, date, time, place, price)."
STRICT_MESSAGES = {
    "name": "Event title must not be empty",
    "date": "Event date must be in YYYY-MM-DD format",
    "time": "Event time must be in HH:mm format",
    "categories": "Event must have at least one category",
    "description": "Event description must be at least 10 characters long",
    "price": "Event price must be a decimal number with up to 2 decimal places",
}
BASIC_MESSAGES = {
    "name": "'name' is required.",
    "date": "'date' is required (YYYY-MM-DD).",
    "place": "'place' is required.",
    "date_format": "Invalid 'date' format. Use YYYY-MM-DD.",
    "price": "Invalid 'price' value.",
}
# -------------------------------------------------------------------------------------


def _s(c: str) -> F.Column:
    return trim_ws(F.coalesce(F.col(c).cast("string"), F.lit("")))


def standardize_event_items(items: DataFrame, as_of_year: int, scrape_path: bool = True) -> DataFrame:
    """D1-D5 over raw string columns ``raw_name, raw_date, raw_time, raw_place,
    raw_price, raw_short_description, raw_source_url`` plus ``source`` and ``city``.
    Adds typed ``name, date, time, place, price, short_description, source_url``."""
    # trimmed fields are materialised once; later expressions read the columns
    items = items.select("*", *[_s(c).alias(f"_{c}") for c in ("raw_name", "raw_place", "raw_short_description")])
    name = F.col("_raw_name")
    place = F.col("_raw_place")
    source = F.coalesce(F.col("source"), F.lit("other")) if "source" in items.columns else F.lit("other")
    city = F.coalesce(F.col("city"), F.lit("")) if "city" in items.columns else F.lit("")
    place_default = (F.when(source == "litexpo", F.lit(LITEXPO_PLACE))
                      .when((source == "meetup") & (city != ""), city).otherwise(F.lit("")))
    desc = F.col("_raw_short_description")
    if scrape_path:
        desc = F.when(desc == "", F.concat(F.lit("Event: "), name)).otherwise(desc)
    dated = with_standard_date(items, "raw_date", "date", as_of_year)
    return dated.select(
        "*",
        name.alias("name"),
        F.coalesce(standardize_time(F.col("raw_time")), F.lit(DEFAULT_TIME)).alias("time"),
        F.when(place == "", place_default).otherwise(place).alias("place"),
        standardize_price(F.col("raw_price")).alias("price"),
        desc.alias("short_description"),
        F.coalesce(F.col("raw_source_url"), F.lit("")).alias("source_url"),
    ).drop("_raw_name", "_raw_place", "_raw_short_description")


def split_events(std: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accepted rows have name, date, place and a valid price."""
    bad = (F.col("name") == "") | F.col("date").isNull() | (F.col("place") == "") | F.col("price").isNull()
    ok = std.where(~bad)
    failed = std.where(bad).withColumn("error", F.lit(MISSING_FIELDS))
    return ok, failed


def validate_events(batch: DataFrame, strict: bool = False) -> DataFrame:
    """First failing rule per row as ``error`` (NULL when valid).

    Basic (manual add path): name, date, place present; date readable; price valid;
    categories a list (``categories_is_list``). Strict adds the six requirement rules:
    non-empty title; 'YYYY-MM-DD'; 'HH:mm'; at least one category; description of 10+
    characters; price with at most 2 decimals."""
    name, date_raw, place = _s("raw_name"), _s("raw_date"), _s("raw_place")
    time_raw, desc, price_raw = _s("raw_time"), _s("raw_short_description"), _s("raw_price")
    cats = F.coalesce(F.size("categories"), F.lit(0))
    if strict:
        m = STRICT_MESSAGES
        err = (F.when(name == "", F.lit(m["name"]))
                .when(~F.regexp_like(date_raw, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
                      | F.try_to_date(date_raw, "yyyy-MM-dd").isNull(), F.lit(m["date"]))
                .when(~F.regexp_like(time_raw, F.lit(r"^([01]\d|2[0-3]):[0-5]\d$")), F.lit(m["time"]))
                .when(cats < 1, F.lit(m["categories"]))
                .when(F.length(desc) < 10, F.lit(m["description"]))
                .when(~F.regexp_like(price_raw, F.lit(r"^\d+(\.\d{1,2})?$")), F.lit(m["price"])))
    else:
        m = BASIC_MESSAGES
        is_list = F.col("categories_is_list") if "categories_is_list" in batch.columns else F.lit(True)
        err = (F.when(name == "", F.lit(m["name"]))
                .when(date_raw == "", F.lit(m["date"]))
                .when(place == "", F.lit(m["place"]))
                .when(standardize_date(date_raw, 2000).isNull(), F.lit(m["date_format"]))
                .when(standardize_price(F.when(price_raw != "", price_raw).otherwise(F.lit("0"))).isNull(),
                      F.lit(m["price"]))
                .when(~is_list, F.lit("'categories' must be a list of strings.")))
    return batch.withColumn("error", err)
