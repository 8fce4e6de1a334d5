"""Listings and lookups over the event and subject tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.standardize import interest_label
from ..operators.filters import filter_events
from ..operators.joins import requested_interests, subjects_with_category
from ..operators.ordering import by_name_keys, newest_first_keys, number_rows, soonest_first_keys
from ..operators.shaping import event_rows


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """Position in ``order`` and total (G1: the greatest position) of a listing's rows, in
    that order. The rows are sorted and written once (``number_rows``); what is below them
    runs once."""
    placed = number_rows(rows, order, "position")
    return placed.withColumn("total", F.coalesce(placed.agg(F.max("position")).scalar(), F.lit(0))).orderBy("position")


def list_events(ev: DataFrame, ec: DataFrame) -> DataFrame:
    """Every event as an output row (D8), newest first (S1), with its position and the
    total (G1)."""
    return _placed(event_rows(ev, ec), newest_first_keys())


def filtered_events(ev: DataFrame, ec: DataFrame, **bounds) -> DataFrame:
    """F1-F6 filters, soonest first (S2), with the filtered total. The filter runs on
    the event table before the category lists are built, and the bridge is semi-joined
    to the surviving events so only their categories are aggregated."""
    kept = filter_events(ev, **bounds)
    ec_kept = ec.join(kept.select("event_id"), "event_id", "left_semi")
    return _placed(event_rows(kept, ec_kept), soonest_first_keys())


# A student's list is the same base list for all, and what the student's own links add.

def subject_base(sub: DataFrame, cat: DataFrame) -> DataFrame:
    """R7's base list: every subject with its category (J1), position by name (S3) and the
    total. It is every student's list as far as the student has no link."""
    placed = number_rows(subjects_with_category(sub, cat), by_name_keys(), "position")
    return placed.withColumn("total_subjects", F.coalesce(placed.agg(F.max("position")).scalar(), F.lit(0)))


def subject_overlay(base: DataFrame, ss: DataFrame) -> DataFrame:
    """R7's overlay: for every student the rows in which its list differs from the base, that
    is its links, with interest and label (D6) and the subject's place in the list. It grows
    with the links, not with students x subjects; base rows without an overlay row have no
    interest."""
    links = ss.select("student_id", "subject_id", "interest").where("student_id is not null")
    return _subject_rows(links.join(base, "subject_id"))


def overlay_counts(stu: DataFrame, base: DataFrame, overlay: DataFrame) -> DataFrame:
    """For every student how many rows of its list are linked, rated, and the base's own:
    with the base and the overlay they give the whole list back."""
    own = overlay.groupBy("student_id").agg(F.count(F.lit(1)).alias("n_linked"), F.count("interest").alias("n_rated"))
    total = F.coalesce(base.agg(F.max("position")).scalar(), F.lit(0))
    linked = F.coalesce("n_linked", F.lit(0))
    return stu.select("student_id").join(own, "student_id", "left").select(
        "student_id", linked.cast("bigint").alias("n_linked"), F.coalesce("n_rated", F.lit(0)).cast("bigint").alias("n_rated"),
        (total - linked).cast("bigint").alias("n_base"))


def student_subjects(sub: DataFrame, cat: DataFrame, ss: DataFrame, students: DataFrame) -> DataFrame:
    """Per student of a request batch the whole list: base and overlay put together. The
    answer is batch x subjects by definition, so the batch is what bounds it: each student's
    positions meet the base by position."""
    base = subject_base(sub, cat)
    asked = students.select("student_id").where("student_id is not null").distinct()
    total = base.agg(F.max("position")).scalar()
    places = asked.withColumn("total", total).where("total is not null").select(
        "student_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total"))).alias("position"))
    rows = places.join(base, "position").join(ss.select("student_id", "subject_id", "interest"), ["student_id", "subject_id"], "left")
    return _subject_rows(rows)


def requested_student_subjects(sub: DataFrame, cat: DataFrame, ss: DataFrame, requests: DataFrame) -> DataFrame:
    """R7 for requests (student_id, subject_id): the rows of ``student_subjects`` that are
    asked for, with their positions in the student's whole list. Work and answer grow with
    the requests and the tables, not with students x subjects."""
    return _subject_rows(requested_interests(subject_base(sub, cat), ss, requests))


def _subject_rows(rows: DataFrame) -> DataFrame:
    return rows.select("student_id", "subject_id", "name", "category_id", "category_name", "interest",
                       interest_label(F.col("interest")).alias("interest_description"), "position", "total_subjects")


EVENT_NOT_FOUND = "Event not found"


def event_detail(ev: DataFrame, ec: DataFrame, ss: DataFrame, sub: DataFrame, requests: DataFrame) -> DataFrame:
    """R6 for a batch of requests (request_id, student_id, event_id): the event with its
    topics (D10), the student's subject names (J9) and the explanation prompt (P15); a
    request for an unknown event is a row with its error.

    Events and links are semi-joined to the batch first, so lists are built only for what
    is asked for (a student's own subjects, an event's own categories)."""
    from ..functions.standardize import event_topics
    from ..operators.prompts import EXPLAIN_TEMPLATE, NO_SUBJECTS_TEXT, prompt_column
    asked = requests.select("event_id").distinct()
    rows = event_rows(ev.join(asked, "event_id", "left_semi"), ec.join(asked, "event_id", "left_semi"), categories_as_text=False)
    topics = rows.select("event_id", "name", "date", "time", event_topics(F.col("short_description"), F.col("categories")).alias("topics"))
    mine = ss.join(requests.select("student_id").distinct(), "student_id", "left_semi").join(sub.select("subject_id", "name"), "subject_id")
    names = mine.groupBy("student_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("_names"))
    out = requests.join(topics, "event_id", "left").join(names, "student_id", "left")
    subjects = F.when(F.col("name").isNotNull(), F.coalesce(F.when(F.col("_names") != "", F.col("_names")), F.lit(NO_SUBJECTS_TEXT)))
    out = out.withColumn("student_subjects", subjects)
    prompt = prompt_column(EXPLAIN_TEMPLATE, name=F.col("name"), topics=F.col("topics"), subjects=F.col("student_subjects"))
    return out.select("request_id", "student_id", "event_id", "name", "date", "time", "topics", "student_subjects",
                      F.when(F.col("name").isNotNull(), prompt).alias("prompt"),
                      F.when(F.col("name").isNull(), F.lit(EVENT_NOT_FOUND)).alias("error"))
