"""IO2-IO7: page input and result files.

Readers use explicit schemas (no inference pass) and FAILFAST, so a missing file or a
malformed document is an explicit error, as in the reference; writers emit one JSON
document per row with non-ASCII text kept as is. Every writer runs distributed
(``df.write``); nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id bigint, url string, html string"
SUBJECTS_FILE_SCHEMA = "url string, from_semester int, to_semester int, study_subjects array<string>"


def load_pages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """IO2: raw pages (page_id, url, html) from Parquet; ``streaming`` gives the
    Structured Streaming source over the same folder."""
    if streaming:
        return spark.readStream.schema(PAGE_SCHEMA).parquet(path)
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def _read_json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    """Single, possibly indented documents by default (one task per file);
    ``multi_line=False`` reads JSON Lines, as the writers below produce them, splittable."""
    return (spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST")
                 .json(path))


def load_subjects_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """IO3: subjects result documents (url, from_semester, to_semester,
    study_subjects)."""
    return _read_json(spark, path, SUBJECTS_FILE_SCHEMA, multi_line)


def load_events_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """IO4: events result documents, one row per saved event (``explode(events)``)."""
    schema = ("url string, source string, city string, events array<struct<event_id:bigint, name:string, "
              "date:string, time:string, place:string, price:string, categories:array<string>, "
              "short_description:string, source_url:string>>, "
              "failed array<struct<source_url:string, name:string, error:string>>")
    doc = _read_json(spark, path, schema, multi_line)
    return doc.select("url", "source", "city", F.explode("events").alias("e")).select("url", "source", "city", "e.*")


def write_text(df: DataFrame, path: str) -> None:
    """IO5: extracted page text (one row per page), replacing the previous output."""
    df.select("page_id", "url", "text", "characters").write.mode("overwrite").parquet(path)


def write_subjects_json(lists: DataFrame, path: str) -> None:
    """IO6: one document per request: url, semesters and the subject list."""
    cols = [c for c in ("url", "from_semester", "to_semester", "study_subjects") if c in lists.columns]
    lists.select(*cols).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_events_json(saved: DataFrame, failed: DataFrame, path: str, keys: tuple[str, ...] = ("url",)) -> None:
    """IO7: one document per scraped listing (``keys``) with its ``events`` and ``failed``
    arrays. Each document groups one listing's links (bounded by max_events), so the
    arrays stay small however many listings there are."""
    ev = saved.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in saved.columns if c not in keys]))
                                   .alias("events"))
    fl = failed.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in failed.columns if c not in keys]))
                                    .alias("failed"))
    doc = ev.join(fl, list(keys), "full")
    et, ft = doc.schema["events"].dataType, doc.schema["failed"].dataType
    doc.select(*keys, F.coalesce("events", F.array().cast(et)).alias("events"),
               F.coalesce("failed", F.array().cast(ft)).alias("failed")) \
       .write.mode("overwrite").json(path)
