"""Pages -> prompts, and model responses -> tables.

The model call is outside Spark, so each reference request becomes two batch jobs with
a table in between: (1) pages -> prompt table; (2) response table -> standardised rows,
upserts and an action log. Both run over whole tables: every page, every response.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.standardize import price_text, time_hhmm
from ..operators import pages as P
from ..operators.aggregates import run_counters
from ..operators.events import split_events, standardize_event_items
from ..operators.prompts import (CATEGORY_TEMPLATE, EVENT_LIST_TEMPLATE, SUBJECTS_TEMPLATE, event_prompt,
                                 prompt_column)
from ..operators.responses import (normalize_subjects, response_category, response_events,
                                   response_subjects)
from ..session import ensure_checkpoint_dir
from ..operators.writes import (import_subjects, set_event_categories, touch_urls, upsert_events,
                                upsert_urls)

NO_PAGE_ERROR = "The page could not be fetched."
KNOWN_SOURCES = ("litexpo", "meetup", "kaveikti")


def route_pages(pages: DataFrame) -> DataFrame:
    """P13 + P1 + P11 + P12: valid pages with text, source and city."""
    ok, _ = P.validate_urls(pages)
    texts = ok.withColumn("text", P.page_text(F.col("html"), cap=None))
    routed = P.infer_city(P.classify_source(texts, text_col="text"), text_col="text")
    return routed


def saved_urls_top(urls: DataFrame, n: int) -> DataFrame:
    """F9 + S4 per (source, city): the n most recently seen active URLs."""
    act = urls.where(F.col("is_active"))
    w = Window.partitionBy("source", F.lower("city")).orderBy(F.col("last_seen").desc(), F.col("url"))
    return act.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def link_frontier(pages: DataFrame, urls: DataFrame, rules: DataFrame, now: dt.datetime,
                  n: int = P.MAX_LINKS_DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For every listing page of a known source: its event links (P3-P10); when it
    has none, the saved active URLs of its source (and city, when given), newest
    first; when neither exists the page is rejected with the reference's message. Each page
    is read once: its links become one list, and the lists of saved URLs are joined to it.

    ``pages`` needs (page_id, url, html, source, city). Returns (frontier(page_id,
    source, city, link, link_rank, origin found/saved), next_urls (W10), rejected)."""
    links = P.resolve_links(P.page_links(pages, carry=("source", "city"), all_pages=True)).join(rules, "source")
    first = links.groupBy("page_id", "source", "city", F.when(P.rule_holds(), F.col("link")).alias("link")) \
                 .agg(F.min("pos").alias("pos"))
    # a page's own links only; null stands for links that are none and drops out of the list
    listed = first.groupBy("page_id", "source", "city").agg(F.transform(F.slice(F.array_sort(F.collect_list(
        F.when(F.col("link").isNotNull(), F.struct("pos", "link")))), 1, n), lambda x: x["link"]).alias("found"))
    of_city, of_source = saved_lists(urls, n)
    per_page = (listed.withColumn("_city", F.lower("city")).join(of_city, ["source", "_city"], "left").join(of_source, "source", "left")
                .withColumn("saved", F.when(F.col("city") == "", F.col("of_source")).otherwise(F.col("of_city"))))
    has = F.size("found") > 0
    rows = per_page.select(
        "page_id", "source", "city", F.when(has, "found").when(F.size("saved") > 0, "saved").alias("origin"),
        F.posexplode_outer(F.when(has, F.col("found")).otherwise(F.col("saved"))).alias("_p", "link"))
    frontier = rows.where(F.col("link").isNotNull()).select(
        "page_id", "source", "city", "link", (F.col("_p") + 1).cast("int").alias("link_rank"), "origin")
    rejected = rows.where(F.col("link").isNull()).select("page_id", "source", "city") \
        .withColumn("error", F.format_string(P.NO_LINKS_ERROR.replace("{source}", "%s"), F.col("source")))
    found = frontier.where(F.col("origin") == "found")
    next_urls = upsert_urls(urls, found.select(F.struct("page_id", "link_rank").alias("pos"),
                                               F.col("link").alias("url"), "source", "city"), now)
    return frontier, next_urls, rejected


def saved_lists(urls: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """F9 + S4 as lists of at most ``n`` URLs: (source, _city, of_city) with the city in
    lower case, and (source, of_source) over all cities; a source's list is made from its
    cities' lists."""
    newest = [F.col("last_seen").desc(), F.col("url")]

    def lists(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("_r") <= n)
        in_order = F.array_sort(F.collect_list(F.struct("_r", "url")))
        return ranked.drop("_r"), ranked.groupBy(*keys).agg(F.transform(in_order, lambda x: x["url"]).alias(name))

    active = urls.where(F.col("is_active")).select("source", F.lower("city").alias("_city"), "url", "last_seen")
    top, of_city = lists(active, ["source", "_city"], "of_city")
    return of_city, lists(top, ["source"], "of_source")[1]


def event_prompts(detail_pages: DataFrame) -> DataFrame:
    """R9 job 1, per-link form: one prompt per fetched detail page (page_id, url, source,
    city, html) using the source's template and the whole page text (P1)."""
    text = P.page_text(F.col("html"))
    return detail_pages.select("page_id", "url", "source", "city",
                               event_prompt(F.col("source"), F.col("url"), text, F.col("city")).alias("prompt"))


def event_list_prompts(pages: DataFrame) -> DataFrame:
    """R9 job 1, single-page form (source 'other'): one event-list prompt per page."""
    return pages.select("page_id", "url",
                        prompt_column(EVENT_LIST_TEMPLATE, text=P.page_text(F.col("html"))).alias("prompt"))


def category_prompts(sub: DataFrame) -> DataFrame:
    """R11 job 1: one category prompt per subject (subject_id, name)."""
    return sub.select("subject_id", "name", prompt_column(CATEGORY_TEMPLATE, subject=F.col("name")).alias("prompt"))


def load_event_responses(responses: DataFrame, ev: DataFrame, ec: DataFrame, cat: DataFrame,
                         as_of_year: int, per_link: bool = True):
    """R9 job 2: responses -> M1/M6 items -> D1-D4 -> F12 -> W1 upsert -> W4 categories.

    Returns dict with next_events, next_bridge, next_categories, log (one row per item
    and per unparsable response: prompt_id, url, action created/updated/failed, error,
    event_id the standardised fields, the categories as a list and the raw item of a failed
    row) and counters (G6)."""
    items, bad = response_events(responses, per_link=per_link)
    # parse + standardise once: the upsert, id assignment, bridge update and log all read
    # it, so the lineage is cut with a reliable checkpoint in the shared checkpoint dir
    ensure_checkpoint_dir(responses.sparkSession)
    std = standardize_event_items(items, as_of_year).checkpoint()
    ok, failed = split_events(std)
    # rows apply in the order of their prompts, and of the items within one
    pos = ok.withColumn("batch_pos", F.struct("prompt_id", "item_pos"))
    next_ev, log = upsert_events(ev, pos)
    assign = pos.join(log.select("batch_pos", "event_id"), "batch_pos").select("batch_pos", "event_id", "categories")
    next_ec, next_cat = set_event_categories(ec, cat, assign)
    saved = pos.join(log.select("batch_pos", "event_id", "action"), "batch_pos").select(
        "prompt_id", "url", "item_pos", "action", F.lit(None).cast("string").alias("error"), "event_id",
        "name", F.col("date").cast("string").alias("date"), time_hhmm(F.col("time")).alias("time"), "place",
        price_text(F.col("price")).alias("price"), F.array_join("categories", ", ").alias("categories"),
        "short_description", "source_url", F.col("categories").alias("category_list"),
        F.lit(None).cast("string").alias("raw_item"))
    fail_items = failed.select(
        "prompt_id", "url", "item_pos", F.lit("failed").alias("action"), "error",
        F.lit(None).cast("bigint").alias("event_id"), "name", F.lit(None).cast("string").alias("date"),
        F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("place"),
        F.lit(None).cast("string").alias("price"), F.lit(None).cast("string").alias("categories"),
        F.lit(None).cast("string").alias("short_description"), F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("array<string>").alias("category_list"), "raw_item")
    fail_resp = bad.select("prompt_id", "url", F.lit(None).cast("int").alias("item_pos"),
                           F.lit("failed").alias("action"), "error", *[
                               F.lit(None).cast(t).alias(c) for c, t in
                               [("event_id", "bigint"), ("name", "string"), ("date", "string"),
                                ("time", "string"), ("place", "string"), ("price", "string"),
                                ("categories", "string"), ("short_description", "string"),
                                ("source_url", "string"), ("category_list", "array<string>")]],
                           F.col("response").alias("raw_item"))
    full_log = saved.unionByName(fail_items).unionByName(fail_resp)
    return {"next_events": next_ev, "next_bridge": next_ec, "next_categories": next_cat,
            "log": full_log, "counters": run_counters(full_log, actions=("created", "updated", "failed"))}


def mark_scraped(urls: DataFrame, log: DataFrame, now: dt.datetime) -> DataFrame:
    """W11 after R9: links whose response parsed (rows of the log that come from an item) get
    last_scraped = now."""
    return touch_urls(urls, log.where(F.col("item_pos").isNotNull()).select("url"), now)


def subject_prompts(requests: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R10 job 1: requests (request_id, url, from_semester, to_semester) validated (P14,
    P13) and joined with the fetched pages (url, html) -> prompt table and rejected. Of
    several pages of one URL the last (greatest page_id, where there is one) counts; a
    request whose page was not fetched is rejected, too."""
    ok, bad_sem = P.validate_semesters(requests)
    ok, bad_url = P.validate_urls(ok)
    order = F.struct(*[c for c in ("page_id", "html") if c in pages.columns])
    fetched = pages.groupBy("url").agg(F.max_by("html", order).alias("html"))
    j = ok.join(fetched, "url", "left")
    bad_page = j.where(F.col("html").isNull()).drop("html").withColumn("reason", F.lit(NO_PAGE_ERROR))
    prompts = j.where(F.col("html").isNotNull()).select("request_id", "url", "from_semester", "to_semester",
                       P.page_text(F.col("html")).alias("text"))
    prompts = prompts.withColumn("characters", F.length("text")).withColumn(
        "prompt", prompt_column(SUBJECTS_TEMPLATE, from_semester=F.col("from_semester"),
                                to_semester=F.col("to_semester"), text=F.col("text")))
    return prompts, bad_sem.unionByName(bad_url, allowMissingColumns=True).unionByName(bad_page, allowMissingColumns=True)


def load_subject_responses(responses: DataFrame) -> DataFrame:
    """R10 job 2 (IO6 shape): per response the clean, de-duplicated subject list."""
    names = response_subjects(responses)
    lists = names.groupBy("prompt_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("study_subjects"))
    return responses.select("prompt_id", "url").join(lists, "prompt_id", "left").select(
        "prompt_id", "url", F.coalesce("study_subjects", F.array().cast("array<string>")).alias("study_subjects"),
        F.coalesce(F.size("study_subjects"), F.lit(0)).alias("subjects_count"))


def assign_subjects(sub: DataFrame, cat: DataFrame, category_responses: DataFrame):
    """Category replies (prompt_id, subject, response) -> M3 and M4 on the names, in the
    order of the prompts -> M5 -> W7 import. Returns (next_sub, next_cat, log, failed)."""
    names = normalize_subjects(category_responses.select(
        F.lit(0).alias("list"), F.col("prompt_id").alias("pos"), F.col("subject").alias("raw_name")), "list")
    kept = category_responses.drop("subject").join(
        names.select(F.col("pos").alias("prompt_id"), F.col("name").alias("subject")), "prompt_id")
    ok, failed = response_category(kept)
    batch = ok.select(F.col("prompt_id").alias("batch_pos"), "subject", "category")
    next_sub, next_cat, log = import_subjects(sub, cat, batch)
    return next_sub, next_cat, log, failed.select("prompt_id", "subject", "error")


def import_counters(cat: DataFrame, next_cat: DataFrame, log: DataFrame, failed: DataFrame) -> DataFrame:
    """G6 of an R11 import: names classified, rows created and updated, names that failed."""
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return log.agg(F.count(F.lit(1)).alias("_ok"), F.count_if(F.col("action") == "created").alias("created_subjects"),
                   F.count_if(F.col("action") == "updated").alias("updated_subjects")) \
        .select((F.col("_ok") + n(failed)).alias("input_count"), (n(next_cat) - n(cat)).alias("created_categories"),
                "created_subjects", "updated_subjects", n(failed).alias("failed_count"))
