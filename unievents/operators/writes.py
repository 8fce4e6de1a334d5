"""Upserts and deletes as snapshot computations.

Each operator takes the current table(s) and a request batch and returns the next
table(s) plus an action log ``(…, action, reason)``. Batches carry an explicit
``batch_pos`` because the reference applies rows one by one: the last row of a key
wins, and its first row decides "created". Persisting the result is the caller's
choice (``sources/snapshot.write_version``). New ids are ``max(id) + rank`` over the
new keys only: a distributed sort, a count per partition and the sums before each (no
single-task window over the keys)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.standardize import standardize_interest
from ..functions.text import casefold_key, trim_ws
from .filters import ended_predicate
from .ordering import number_rows


def _max_id(table: DataFrame, col: str):
    return table.agg(F.max(col)).scalar()


# ---- W1, W3, W4: events ----------------------------------------------------------------

EVENT_FIELDS = ["time", "place", "price", "short_description", "source_url"]


def upsert_events(ev: DataFrame, batch: DataFrame, on_duplicate: str = "update"
                  ) -> tuple[DataFrame, DataFrame]:
    """W1 (+W3): upsert ``batch`` (batch_pos, name, date, time, place, price,
    short_description, source_url) into ``ev`` on (name, date).

    Returns (next_events, log). ``log`` has one row per batch row: batch_pos, name,
    date, event_id, action in {created, updated, rejected}, reason. With
    ``on_duplicate='reject'`` a key that already exists (in ``ev`` or earlier in the
    batch) is rejected instead of updated."""
    key = ["name", "date"]
    b = batch.select("batch_pos", *key, *EVENT_FIELDS)
    existing = ev.select("event_id", *key)
    if on_duplicate not in ("update", "reject"):
        raise ValueError("on_duplicate must be 'update' or 'reject'")
    # first and last row of a key as partial aggregates: a hot key is one row per task
    row = F.struct(*EVENT_FIELDS)
    pick = F.min_by(row, "batch_pos") if on_duplicate == "reject" else F.max_by(row, "batch_pos")
    per_key = b.groupBy(*key).agg(F.min("batch_pos").alias("_first"), pick.alias("_row")).join(existing, key, "left")
    is_dup = F.col("event_id").isNotNull() | (F.col("batch_pos") > F.col("_first"))
    tagged = b.select("batch_pos", *key).join(per_key.select(*key, "_first", "event_id"), key)
    last = per_key.where(F.col("event_id").isNull()) if on_duplicate == "reject" else per_key
    last = last.select(*key, "_first", "event_id", "_row.*")
    new_keys = last.where(F.col("event_id").isNull()).select(*key, "_first")
    new_ids = number_rows(new_keys, ["_first"], "new_id", _max_id(ev, "event_id")).drop("_first")
    final = last.join(new_ids, key, "left").withColumn("event_id", F.coalesce("event_id", "new_id")).drop("new_id")

    upd = final.select("event_id", *key, *EVENT_FIELDS)
    untouched = ev.join(upd.select("event_id"), "event_id", "left_anti")
    next_ev = untouched.unionByName(upd.select(*ev.columns))

    ids = final.select(*key, F.col("event_id").alias("_eid"))
    log = tagged.join(ids, key, "left").select(
        "batch_pos", *key,
        F.coalesce(F.col("event_id"), F.col("_eid")).alias("event_id"),
        F.when((on_duplicate == "reject") & is_dup, F.lit("rejected"))
         .when(F.col("event_id").isNull() & (F.col("batch_pos") == F.col("_first")), F.lit("created"))
         .otherwise(F.lit("updated")).alias("action"),
        F.when((on_duplicate == "reject") & is_dup, F.lit("Event already exists")).alias("reason"))
    return next_ev, log


def set_event_categories(ec: DataFrame, cat: DataFrame, assignments: DataFrame
                         ) -> tuple[DataFrame, DataFrame]:
    """``assignments`` (batch_pos, event_id, categories ARRAY<STRING>). The last
    non-empty list per event replaces its category set; an empty list leaves the old
    set. Missing categories (exact, trimmed name) are created with new ids.
    Returns (next_bridge (event_id, category_name), next_categories)."""
    clean = assignments.withColumn(
        "categories", F.filter(F.transform("categories", lambda x: trim_ws(x)), lambda x: x != ""))
    nonempty = clean.where(F.size("categories") > 0)
    w = Window.partitionBy("event_id").orderBy(F.col("batch_pos").desc())
    last = nonempty.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    new_links = last.select("event_id", F.explode("categories").alias("category_name")).distinct()
    next_ec = ec.join(last.select("event_id"), "event_id", "left_anti").unionByName(new_links)
    # every name of every applied row is get-or-created, even if a later row replaces
    # that event's set (rows apply one by one)
    names = nonempty.select(F.explode("categories").alias("name")).distinct()
    missing = names.join(cat.select("name"), "name", "left_anti")
    created = number_rows(missing, ["name"], "category_id", _max_id(cat, "category_id"))
    next_cat = cat.select("category_id", "name").unionByName(created.select("category_id", "name"))
    return next_ec, next_cat


# ---- W5, W6: interests -------------------------------------------------------------------

def upsert_interest(ss: DataFrame, sub: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch (batch_pos, student_id, subject_id, interest raw). Valid rows upsert
    (student, subject) -> interest, last row wins; log action created/updated or the
    rejection reason (missing, not a number, out of range, unknown subject)."""
    raw = F.col("interest").cast("string")
    num = trim_ws(raw).try_cast("int")
    reason = (F.when(F.col("subject_id").isNull() | raw.isNull() | (raw == "0") | (raw == ""),
                     F.lit("subject_id and interest are required"))
               .when(num.isNull(), F.lit("Interest must be a number"))
               .when(standardize_interest(raw).isNull(), F.lit("Interest must be between 1 and 5")))
    tagged = batch.withColumn("reason", reason).withColumn("interest", num)
    known = sub.select("subject_id").withColumn("_known", F.lit(True))
    tagged = tagged.join(known, "subject_id", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_known").isNull(), F.lit("Subject not found")))).drop("_known")
    good = tagged.where(F.col("reason").isNull())
    key = ["student_id", "subject_id"]
    w = Window.partitionBy(*key).orderBy(F.col("batch_pos").desc())
    last = good.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*key, "interest")
    next_ss = ss.join(last.select(*key), key, "left_anti").unionByName(last.select(*ss.columns))
    ex = ss.select(*key).withColumn("_ex", F.lit(True))
    firsts = good.groupBy(*key).agg(F.min("batch_pos").alias("_first"))
    log = tagged.join(ex, key, "left").join(firsts, key, "left").select(
        "batch_pos", *key, "interest",
        F.when(F.col("reason").isNotNull(), F.lit("rejected"))
         .when(F.col("_ex").isNull() & (F.col("batch_pos") == F.col("_first")), F.lit("created"))
         .otherwise(F.lit("updated")).alias("action"), "reason")
    return next_ss, log


def update_interest(ss: DataFrame, sub: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulk update of EXISTING (student, subject) interests. ``batch`` rows are
    (batch_pos, student_id, is_object, subject_id STRING, interest STRING). The first failing rule
    is the reason, in this order: not an object, missing field, not a number, out of
    range, unknown subject, no relation. Returns (next_ss, log)."""
    sid = trim_ws(F.col("subject_id")).try_cast("bigint")
    num = trim_ws(F.col("interest")).try_cast("int")
    pre = (F.when(~F.col("is_object"), F.lit("Each subjects item must be an object."))
            .when(F.col("subject_id").isNull() | F.col("interest").isNull(),
                  F.lit("subject_id and interest are required"))
            .when(num.isNull(), F.lit("Interest must be a number"))
            .when(~num.between(1, 5), F.lit("Interest must be between 1 and 5")))
    t = batch.withColumn("error", pre).withColumn("_sid", sid).withColumn("_int", num)
    known = sub.select(F.col("subject_id").alias("_sid"), F.col("name").alias("subject_name"))
    linked = ss.select("student_id", F.col("subject_id").alias("_sid")).withColumn("_rel", F.lit(True))
    t = t.join(known, "_sid", "left").join(linked, ["student_id", "_sid"], "left")
    err = F.coalesce(F.col("error"),
                     F.when(F.col("subject_name").isNull(), F.lit("Subject not found")),
                     F.when(F.col("_rel").isNull(), F.lit("Student-subject relation not found")))
    t = t.withColumn("error", err)
    good = t.where(F.col("error").isNull())
    last = good.groupBy("student_id", F.col("_sid").alias("subject_id")).agg(F.max_by("_int", "batch_pos").alias("_new"))
    next_ss = ss.join(last, ["student_id", "subject_id"], "left") \
                .withColumn("interest", F.coalesce(F.col("_new"), F.col("interest"))).select(*ss.columns)
    log = t.select("batch_pos", "student_id", F.col("_sid").alias("subject_id"), "subject_name",
                   F.col("_int").alias("interest"),
                   F.when(F.col("error").isNull(), F.lit("updated")).otherwise(F.lit("failed")).alias("action"),
                   "error")
    return next_ss, log


# ---- W7-W9: import / insert ------------------------------------------------------------

def import_subjects(sub: DataFrame, cat: DataFrame, batch: DataFrame
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch (batch_pos, subject, category) of classified names. Names are
    de-duplicated case-insensitively (M4's key) keeping the first row. Category and subject are matched case-insensitively
    (lowest id wins) and created when absent (first spelling in the batch); an existing
    subject is re-pointed when its category differs.
    Returns (next_sub, next_cat, log(batch_pos, subject, category_name, subject_id, action))."""
    first = batch.groupBy(casefold_key(F.col("subject")).alias("_fold")).agg(
        F.min_by(F.struct("batch_pos", "subject", "category"), "batch_pos").alias("_f"))
    b = first.select("_f.*").withColumn("_sk", F.lower("subject")).withColumn("_ck", F.lower("category"))
    cat_first = cat.groupBy(F.lower("name").alias("_ck")).agg(F.min("category_id").alias("category_id"))
    new_cat = b.join(cat_first, "_ck", "left_anti").groupBy("_ck").agg(
        F.min_by("category", "batch_pos").alias("name"), F.min("batch_pos").alias("_p"))
    new_cat = number_rows(new_cat, ["_p"], "category_id", _max_id(cat, "category_id"))
    next_cat = cat.select("category_id", "name").unionByName(new_cat.select("category_id", "name"))
    cat_ids = cat_first.unionByName(new_cat.select("_ck", "category_id"))
    cat_names = next_cat.select("category_id", F.col("name").alias("category_name"))

    sub_first = sub.groupBy(F.lower("name").alias("_sk")).agg(F.min("subject_id").alias("subject_id"))
    bb = b.join(cat_ids, "_ck").join(sub_first, "_sk", "left")
    new_sub = bb.where(F.col("subject_id").isNull()).select("_sk", "category_id", F.col("subject").alias("_name"),
                                                           F.col("batch_pos").alias("_p"))
    new_sub = number_rows(new_sub, ["_p"], "subject_id", _max_id(sub, "subject_id"))
    repoint = bb.where(F.col("subject_id").isNotNull()).select("subject_id", F.col("category_id").alias("_nc"))
    cur = sub.join(repoint, "subject_id", "left").withColumn(
        "category_id", F.coalesce(F.col("_nc"), F.col("category_id"))).drop("_nc")
    next_sub = cur.select(*sub.columns).unionByName(
        new_sub.select("subject_id", F.col("_name").alias("name"), "category_id").select(*sub.columns))

    old_cat = sub.select("subject_id", F.col("category_id").alias("_old"))
    ids = new_sub.select("_sk", F.col("subject_id").alias("_new_id"))
    log = (bb.join(ids, "_sk", "left").join(old_cat, "subject_id", "left")
             .join(cat_names, "category_id")
             .select("batch_pos", "subject", "category_name",
                     F.coalesce("subject_id", "_new_id").alias("subject_id"),
                     F.when(F.col("subject_id").isNull(), F.lit("created"))
                      .when(F.col("_old").eqNullSafe(F.col("category_id")), F.lit("unchanged"))
                      .otherwise(F.lit("updated")).alias("action")))
    return next_sub, next_cat, log


def assign_to_students(ss: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W8 tail: link subjects to students (student_id, subject_id) with NULL interest when
    not linked yet. Returns (next_ss, log(student_id, subject_id, assignment_action
    created/existing))."""
    key = ["student_id", "subject_id"]
    known = ss.select(*key).withColumn("_ex", F.lit(True))
    ids = links.select(*key).distinct().join(known, key, "left")
    new = ids.where(F.col("_ex").isNull()).select(*key, F.lit(None).cast("int").alias("interest"))
    next_ss = ss.unionByName(new.select(*ss.columns))
    log = ids.select(*key, F.when(F.col("_ex").isNull(), F.lit("created"))
                     .otherwise(F.lit("existing")).alias("assignment_action"))
    return next_ss, log


def insert_new(table: DataFrame, batch: DataFrame, key: str, id_col: str, dup_reason: str,
               missing_reason: str | None = None, missing: Column | None = None,
               refused: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert-if-absent on an exact key; the first batch row of a key that can be
    inserted wins, later ones and keys already present are reported with ``dup_reason``.
    Rows with a blank key, or where ``missing`` holds, are rejected before that; after it
    those where ``refused`` gives a reason (an unknown reference, say), which leaves the key
    to later rows. Returns (next_table, log(batch_pos, key, id, action, reason))."""
    k = F.col(key)
    refused = F.lit(None).cast("string") if refused is None else refused
    blank = k.isNull() | (trim_ws(k.cast("string")) == "")
    blank = blank if missing is None else blank | F.coalesce(missing, F.lit(True))
    batch = batch.withColumn("_blank", blank).withColumn("_refused", refused)
    blank, refused = F.col("_blank"), F.col("_refused")
    present = table.select(k.alias("_k"), F.col(id_col).alias("_old_id"))
    firsts = batch.where(~blank & refused.isNull()).groupBy(key).agg(F.min("batch_pos").alias("_first"))
    t = batch.join(firsts, key, "left").join(present, k == F.col("_k"), "left").drop("_k")
    ok = F.coalesce(~blank & F.col("_old_id").isNull() & (F.col("batch_pos") == F.col("_first")), F.lit(False))
    known = F.col("_old_id").isNotNull() | F.coalesce(F.col("batch_pos") > F.col("_first"), F.lit(False))
    new = t.where(ok)
    new_ids = number_rows(new.select(key, "batch_pos"), ["batch_pos"], id_col, _max_id(table, id_col))
    cols = [c for c in table.columns if c != id_col]
    ins = new.join(new_ids.select(key, id_col), key).select(id_col, *[c for c in cols if c in new.columns])
    next_t = table.unionByName(ins, allowMissingColumns=True)
    log = t.join(new_ids.select(key, F.col(id_col).alias("_nid")), key, "left").select(
        "batch_pos", key, F.coalesce("_nid", "_old_id").alias(id_col),
        F.when(ok, F.lit("created")).otherwise(F.lit("rejected")).alias("action"),
        F.when(blank, F.lit(missing_reason or f"{key} is required")).when(known, F.lit(dup_reason))
         .when(~ok, refused).alias("reason"))
    return next_t, log


def insert_subjects(sub: DataFrame, cat: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W9 for subjects (batch_pos, name, category_id): no category (null or 0) is allowed, an
    unknown one is not."""
    known = cat.select("category_id").distinct().withColumn("_known", F.lit(True))
    given = F.coalesce(F.col("category_id"), F.lit(0)) != 0
    rows = batch.join(known, "category_id", "left").withColumn(
        "_why", F.when(given & F.col("_known").isNull(), F.lit("Category not found")))
    rows = rows.withColumn("category_id", F.when(given, F.col("category_id"))).select("batch_pos", "name", "category_id", "_why")
    return insert_new(sub, rows, "name", "subject_id", "Subject already exists", "Name is required", refused=F.col("_why"))


def insert_students(stu: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W9 for students (batch_pos, username, password); the password is only required."""
    return insert_new(stu, batch, "username", "student_id", "Username already exists", "Username and password are required",
                      missing=F.coalesce(F.col("password"), F.lit("")) == "")


# ---- W10, W11: URL registry --------------------------------------------------------------

URL_COLS = ["url", "source", "city", "last_seen", "last_scraped", "is_active"]


def upsert_urls(urls: DataFrame, links: DataFrame, now: dt.datetime) -> DataFrame:
    """Discovered links (pos, url, source, city) set source and city, active,
    last_seen = now; of several links to one URL the last one (greatest ``pos``) counts.
    Other registry rows are unchanged."""
    found = links.groupBy("url").agg(F.max_by(F.struct("source", "city"), "pos").alias("_l")).select(
        "url", "_l.source", F.coalesce("_l.city", F.lit("")).alias("city"))
    touched = urls.select("url", "last_scraped").join(found, "url", "right")
    upd = touched.select("url", "source", "city", F.lit(now).cast("timestamp").alias("last_seen"),
                         "last_scraped", F.lit(True).alias("is_active"))
    return urls.join(found.select("url"), "url", "left_anti").select(*URL_COLS).unionByName(upd.select(*URL_COLS))


def touch_urls(urls: DataFrame, done: DataFrame, now: dt.datetime) -> DataFrame:
    """last_scraped = now for URLs that were parsed."""
    d = done.select("url").distinct().withColumn("_d", F.lit(True))
    return urls.join(d, "url", "left").withColumn(
        "last_scraped", F.when(F.col("_d"), F.lit(now).cast("timestamp")).otherwise(F.col("last_scraped"))
    ).select(*URL_COLS)


# ---- W12-W14: deletes --------------------------------------------------------------------

def delete_events(ev: DataFrame, ec: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete events by id with their bridge rows. Returns (next_ev, next_ec, log)
    where log lists every requested id as deleted (with name, date) or not found."""
    req = ids.select("event_id").distinct()
    next_ev = ev.join(req, "event_id", "left_anti")
    next_ec = ec.join(req, "event_id", "left_anti")
    log = req.join(ev.select("event_id", "name", F.col("date").cast("string").alias("date")), "event_id", "left") \
             .withColumn("action", F.when(F.col("name").isNull(), F.lit("not_found")).otherwise(F.lit("deleted")))
    return next_ev, next_ec, log


def purge_ended(ev: DataFrame, ec: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove ended events (F7) and their bridge rows; returns (kept, next_ec,
    deleted). An event without a date, or without a time today, has not ended."""
    flagged = ev.withColumn("_ended", F.coalesce(ended_predicate(now), F.lit(False)))
    deleted = flagged.where("_ended").drop("_ended")
    kept = flagged.where(~F.col("_ended")).drop("_ended")
    next_ec = ec.join(deleted.select("event_id"), "event_id", "left_anti")
    return kept, next_ec, deleted


def delete_cascade(tables: dict[str, DataFrame], category_ids: DataFrame | None = None,
                   student_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Deleting categories drops their subjects, those subjects' ratings and the
    categories' bridge rows; deleting students drops their ratings."""
    out = dict(tables)
    if category_ids is not None:
        cids = category_ids.select("category_id").distinct()
        gone_sub = out["subject"].join(cids, "category_id", "left_semi").select("subject_id")
        out["category"] = out["category"].join(cids, "category_id", "left_anti")
        out["subject"] = out["subject"].join(gone_sub, "subject_id", "left_anti")
        out["student_subject"] = out["student_subject"].join(gone_sub, "subject_id", "left_anti")
        if "event_category" in out:  # the bridge holds category names
            gone_names = tables["category"].join(cids, "category_id", "left_semi").select(F.col("name").alias("category_name"))
            out["event_category"] = out["event_category"].join(gone_names, "category_name", "left_anti")
    if student_ids is not None:
        sids = student_ids.select("student_id").distinct()
        out["student"] = out["student"].join(sids, "student_id", "left_anti")
        out["student_subject"] = out["student_subject"].join(sids, "student_id", "left_anti")
    return {name: df.select(*tables[name].columns) for name, df in out.items()}
