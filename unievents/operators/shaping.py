"""Event output rows and presentation columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.standardize import (display_categories, display_price, display_text,
                                     price_text, time_hhmm)
from .aggregates import categories_per_event


def event_rows(ev: DataFrame, ec: DataFrame, categories_as_text: bool = True) -> DataFrame:
    """ISO date, 'HH:mm' time, price as 2-decimal text, sorted categories.

    ``categories_as_text`` joins the sorted names with ', ' (a flat column that compares
    the same in every engine); otherwise the sorted array is kept."""
    cats = categories_per_event(ec)
    j = ev.join(cats, "event_id", "left")
    arr = F.coalesce(F.col("categories"), F.array().cast("array<string>"))
    return j.select(
        "event_id", "name",
        F.col("date").cast("string").alias("date"),
        time_hhmm(F.col("time")).alias("time"),
        "place",
        price_text(F.col("price")).alias("price"),
        (F.array_join(arr, ", ") if categories_as_text else arr).alias("categories"),
        "short_description", "source_url",
    )


def display_events(rows: DataFrame) -> DataFrame:
    """What the listing shows: '12,50 €' prices, '-' for missing values."""
    cats = F.col("categories")
    cat_text = (display_categories(cats) if isinstance(rows.schema["categories"].dataType, ArrayType)
                else F.when(F.coalesce(cats, F.lit("")) == "", F.lit("-")).otherwise(cats))
    return rows.select(
        "event_id", display_text(F.col("name")).alias("name"),
        display_text(F.col("date").cast("string")).alias("date"),
        display_text(F.col("time")).alias("time"),
        display_text(F.col("place")).alias("place"),
        display_price(F.col("price").cast("decimal(10,2)")).alias("price"),
        cat_text.alias("categories"),
    )
