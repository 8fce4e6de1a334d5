"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per operator or
composite of SURVEY §2, and the equivalent DuckDB statement where SQL can express it.

Output columns are flat (text dates, 'HH:mm' times, 2-decimal price text, sorted
category names joined by ', ') and every computed column carries the same alias on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from .oracle import key as key_sql
from .oracle import trim_ws as trim_sql
from .oracle import with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

TOP_K = 10


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


class Domain:
    """Lazily bound domain tables for one (spark, sf_dir)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.d = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        fn = {"cat": T.categories, "sub": T.subjects, "stu": T.students,
              "ss": T.student_subjects, "ev": T.events, "ec": T.event_categories}[name]
        df = fn(self.spark, self.d)
        setattr(self, name, df)
        return df

    def table(self, name: str) -> DataFrame:
        return T.load_table(self.spark, self.d, name)


# ---------------------------------------------------------------------------------------
# Flagship — top-k events per student by strongest matching interest
# ---------------------------------------------------------------------------------------
_R1_SQL = with_ctes(
    f"""SELECT r.student_id, CAST(r.rank AS INTEGER) AS rank, r.event_id, r.score,
           er.name, er.date, er.time, er.place, er.price, er.categories
    FROM ranked r JOIN event_row er ON r.event_id = er.event_id
    WHERE r.rank <= {TOP_K}""",
    "interest", "ec_key", "event", "event_row",
    extra=[("pairs", """SELECT i.student_id, k.event_id, max(i.interest) AS score
                        FROM interest i JOIN ec_key k ON i.category_key = k.category_key
                        GROUP BY 1, 2"""),
           ("ranked", """SELECT p.student_id, p.event_id, p.score,
                            row_number() OVER (PARTITION BY p.student_id
                                ORDER BY p.score DESC, e.date DESC, e.time DESC, p.event_id) AS rank
                         FROM pairs p JOIN event e ON p.event_id = e.event_id""")])


@register("r1_recommend_top10", _R1_SQL)
def r1_recommend_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recommend import recommend_events_detailed
    d = Domain(spark, sf_dir)
    return recommend_events_detailed(d.ss, d.sub, d.cat, d.ec, d.ev, top_k=TOP_K).select(
        "student_id", "rank", "event_id", "score", "name", "date", "time", "place", "price", "categories")


# ---------------------------------------------------------------------------------------
# Listing, filters, lookups (R4-R7, F*, S*, D8, D9)
# ---------------------------------------------------------------------------------------
EVENT_COLS = ["event_id", "name", "date", "time", "place", "price", "categories",
              "short_description", "source_url"]
# Fixed parameters of the registered R5 filter and F7/W13 "now".
R5_ARGS = dict(min_price="50", max_price="250", start_date="1995-01-01", end_date="1996-12-31",
               city="Tion_1", start_time="08:00", end_time="18:30")
NOW = "1996-06-15 12:00:00"
INTEREST_LABEL_SQL = ("CASE {x} WHEN 1 THEN '1 - Not Interested' WHEN 2 THEN '2 - Slightly Interested' "
                      "WHEN 3 THEN '3 - Moderately Interested' WHEN 4 THEN '4 - Very Interested' "
                      "WHEN 5 THEN '5 - Extremely Interested' END")


@register("d8_event_rows", with_ctes("SELECT * FROM event_row", "event_row"))
def d8_event_rows(spark, sf_dir):
    from ..operators.shaping import event_rows
    d = Domain(spark, sf_dir)
    return event_rows(d.ev, d.ec)


@register("r4_list_events", with_ctes(
    """SELECT er.*, (SELECT count(*) FROM event) AS total,
              row_number() OVER (ORDER BY er.date DESC, er.time DESC, er.event_id) AS position FROM event_row er""",
    "event_row"))
def r4_list_events(spark, sf_dir):
    from .listing import list_events
    d = Domain(spark, sf_dir)
    return list_events(d.ev, d.ec)


@register("r5_filter_events", with_ctes(
    f"""SELECT er.*, count(*) OVER () AS total, row_number() OVER (ORDER BY e.date, e.time, e.event_id) AS position
    FROM event_row er JOIN event e ON er.event_id = e.event_id
    WHERE e.price >= {R5_ARGS['min_price']} AND e.price <= {R5_ARGS['max_price']}
      AND e.date >= DATE '{R5_ARGS['start_date']}' AND e.date <= DATE '{R5_ARGS['end_date']}'
      AND contains(lower(e.place), '{R5_ARGS['city'].lower()}')
      AND e.time >= '{R5_ARGS['start_time']}:00' AND e.time <= '{R5_ARGS['end_time']}:00'""",
    "event", "event_row"))
def r5_filter_events(spark, sf_dir):
    from .listing import filtered_events
    d = Domain(spark, sf_dir)
    return filtered_events(d.ev, d.ec, **R5_ARGS)


@register("f7_ended_events", with_ctes(
    f"""SELECT event_id, name, CAST(date AS VARCHAR) AS date, substr(time, 1, 5) AS time FROM event
    WHERE date < DATE '{NOW[:10]}' OR (date = DATE '{NOW[:10]}' AND time < '{NOW[11:]}')""", "event"))
def f7_ended_events(spark, sf_dir):
    import datetime as dt

    from ..functions.standardize import time_hhmm
    from ..operators.filters import ended_events
    d = Domain(spark, sf_dir)
    now = dt.datetime.fromisoformat(NOW)
    return ended_events(d.ev, now).select("event_id", "name", F.col("date").cast("string").alias("date"),
                                         time_hhmm(F.col("time")).alias("time"))


@register("d9_display_events", with_ctes(
    """SELECT event_id, CASE WHEN name IS NULL OR trim(name) = '' THEN '-' ELSE name END AS name,
              date, time, CASE WHEN place IS NULL OR trim(place) = '' THEN '-' ELSE place END AS place,
              CASE WHEN price IS NULL THEN '-' ELSE replace(price, '.', ',') || ' €' END AS price,
              CASE WHEN categories = '' THEN '-' ELSE categories END AS categories
       FROM event_row""", "event_row"))
def d9_display_events(spark, sf_dir):
    from ..operators.filters import listable
    from ..operators.shaping import display_events, event_rows
    d = Domain(spark, sf_dir)
    return display_events(listable(event_rows(d.ev, d.ec, categories_as_text=False)))


@register("f13_keyword_search", with_ctes(
    """SELECT event_id, name, place FROM event
    WHERE (contains(lower(name), 'event') OR contains(lower(place), 'event') OR contains(lower(short_description), 'event'))
      AND (contains(lower(name), '12') OR contains(lower(place), '12') OR contains(lower(short_description), '12'))
      AND (contains(lower(name), 'urgent') OR contains(lower(place), 'urgent') OR contains(lower(short_description), 'urgent'))""",
    "event"))
def f13_keyword_search(spark, sf_dir):
    from ..operators.filters import keyword_search
    d = Domain(spark, sf_dir)
    return keyword_search(d.ev, "Event 12 URGENT", ["name", "place", "short_description"]) \
        .select("event_id", "name", "place")


@register("r7_student_subjects", with_ctes(
    f"""SELECT q.student_id, s.subject_id, s.name, s.category_id, c.name AS category_name, m.interest,
           {INTEREST_LABEL_SQL.format(x='m.interest')} AS interest_description,
           (SELECT count(*) FROM subject) AS total_subjects,
           row_number() OVER (PARTITION BY q.student_id ORDER BY s.name, s.subject_id) AS position
    FROM subject s CROSS JOIN (SELECT unnest([min(user_id), max(user_id)]) AS student_id FROM events) q
    LEFT JOIN category c ON s.category_id = c.category_id
    LEFT JOIN student_subject m ON s.subject_id = m.subject_id AND q.student_id = m.student_id""",
    "subject", "category", "student_subject"))
def r7_student_subjects(spark, sf_dir):
    from .listing import student_subjects
    d = Domain(spark, sf_dir)
    asked = d.table("events").agg(F.array(F.min("user_id"), F.max("user_id")).alias("u")).select(F.explode("u").alias("student_id"))
    return student_subjects(d.sub, d.cat, d.ss, asked)


_SEARCHES_SQL = """SELECT DISTINCT user_id AS search_id,
        CASE user_id % 4 WHEN 0 THEN concat('EVENT ', user_id, '  urgent') WHEN 1 THEN concat('nation_', user_id % 25, ' ', user_id)
                         WHEN 2 THEN concat('high x', user_id) ELSE concat(user_id, ' 5 n') END AS text FROM {events}"""


@register("f13_index_search", with_ctes(
    """SELECT s.search_id, e.event_id FROM searches s, event e
       WHERE len(list_filter(string_split(lower(s.text), ' '), lambda w: NOT (
           contains(lower(e.name), w) OR contains(lower(e.place), w) OR contains(lower(e.short_description), w)))) = 0""",
    "event", extra=[("searches", _SEARCHES_SQL.format(events="events"))]))
def f13_index_search(spark, sf_dir):
    from ..operators.search import build_keyword_index, search_index
    d = Domain(spark, sf_dir)
    asked = spark.sql(_SEARCHES_SQL.format(events="{rows}"), rows=d.table("events"))
    return search_index(build_keyword_index(d.ev, ["name", "place", "short_description"]), d.ev, asked)


_LISTED_SQL = """SELECT s.subject_id, s.name, s.category_id, c.name AS category_name,
                        row_number() OVER (ORDER BY s.name, s.subject_id) AS position, count(*) OVER () AS total_subjects
                 FROM subject s LEFT JOIN category c ON s.category_id = c.category_id"""


@register("r7_subject_base", with_ctes("SELECT * FROM listed", "subject", "category", extra=[("listed", _LISTED_SQL)]))
def r7_subject_base(spark, sf_dir):
    from .listing import subject_base
    d = Domain(spark, sf_dir)
    return subject_base(d.sub, d.cat).select("subject_id", "name", "category_id", "category_name", "position", "total_subjects")


@register("r7_subject_overlay", with_ctes(
    f"""SELECT m.student_id, l.subject_id, l.name, l.category_id, l.category_name, m.interest,
               {INTEREST_LABEL_SQL.format(x='m.interest')} AS interest_description, l.position, l.total_subjects
        FROM student_subject m JOIN listed l ON m.subject_id = l.subject_id WHERE m.student_id IS NOT NULL""",
    "subject", "category", "student_subject", extra=[("listed", _LISTED_SQL)]))
def r7_subject_overlay(spark, sf_dir):
    from .listing import subject_base, subject_overlay
    d = Domain(spark, sf_dir)
    return subject_overlay(subject_base(d.sub, d.cat), d.ss)


@register("r7_overlay_counts", with_ctes(
    """SELECT st.student_id, count(s.subject_id) AS n_linked, count(m.interest) FILTER (WHERE s.subject_id IS NOT NULL) AS n_rated,
              (SELECT count(*) FROM subject) - count(s.subject_id) AS n_base
       FROM student st LEFT JOIN student_subject m ON st.student_id = m.student_id
       LEFT JOIN subject s ON m.subject_id = s.subject_id GROUP BY st.student_id""",
    "student", "subject", "student_subject"))
def r7_overlay_counts(spark, sf_dir):
    from .listing import overlay_counts, subject_base, subject_overlay
    d = Domain(spark, sf_dir)
    base = subject_base(d.sub, d.cat)
    return overlay_counts(d.stu, base, subject_overlay(base, d.ss))


@register("r7_student_subject_requests", with_ctes(
    f"""SELECT q.student_id, s.subject_id, s.name, s.category_id, s.category_name, m.interest,
           {INTEREST_LABEL_SQL.format(x='m.interest')} AS interest_description,
           (SELECT count(*) FROM subject) AS total_subjects, s.position
    FROM asked q JOIN listed s ON q.subject_id = s.subject_id
    LEFT JOIN student_subject m ON s.subject_id = m.subject_id AND q.student_id = m.student_id""",
    "subject", "category", "student_subject",
    extra=[("asked", """SELECT o_custkey AS student_id, l_partkey AS subject_id FROM events
                        JOIN orders ON event_id = o_orderkey JOIN lineitem ON o_orderkey = l_orderkey
                        UNION SELECT user_id, event_id FROM events"""),
           ("listed", """SELECT s.subject_id, s.name, s.category_id, c.name AS category_name,
                                row_number() OVER (ORDER BY s.name, s.subject_id) AS position
                         FROM subject s LEFT JOIN category c ON s.category_id = c.category_id""")]))
def r7_student_subject_requests(spark, sf_dir):
    from .listing import requested_student_subjects
    d = Domain(spark, sf_dir)
    e = d.table("events").select("user_id", "event_id")
    orders = d.table("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("student_id"))
    lines = d.table("lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("subject_id"))
    own = e.select("event_id").join(orders, "event_id").join(lines, "event_id").select("student_id", "subject_id")
    asked = own.unionAll(e.select("user_id", "event_id"))  # the second: mostly unrated or unknown
    return requested_student_subjects(d.sub, d.cat, d.ss, asked)


R3_LOOKUPS = [("subject_id", 3), ("subject_name", "  RED WIDGET 1 "), ("subject_name", "small ring 0")]
_R3_LOOKUP_SQL = """
    SELECT CAST(3 AS VARCHAR) AS lookup, subject_id FROM subject WHERE subject_id = 3
    UNION ALL SELECT '  RED WIDGET 1 ', min(subject_id) FROM subject
        WHERE lower(name) = 'red widget 1' HAVING count(*) > 0
    UNION ALL SELECT 'small ring 0', min(subject_id) FROM subject
        WHERE lower(name) = 'small ring 0' HAVING count(*) > 0"""


@register("r3_events_for_subject", with_ctes(
    """SELECT h.lookup, h.event_id, CAST(row_number() OVER (PARTITION BY h.lookup
               ORDER BY e.date DESC, e.time DESC, e.event_id) AS BIGINT) AS rank
       FROM hits h JOIN event e ON h.event_id = e.event_id""",
    "subject", "category", "ec_key", "event",
    extra=[("lookups", _R3_LOOKUP_SQL),
           ("skey", f"""SELECT l.lookup, {key_sql('c.name')} AS category_key FROM lookups l
                       JOIN subject s ON l.subject_id = s.subject_id
                       JOIN category c ON s.category_id = c.category_id"""),
           ("hits", """SELECT DISTINCT sk.lookup, k.event_id FROM skey sk
                       JOIN ec_key k ON sk.category_key = k.category_key
                       WHERE sk.category_key IS NOT NULL""")]))
def r3_events_for_subject(spark, sf_dir):
    from .recommend import events_for_subject
    d = Domain(spark, sf_dir)
    keys = spark.createDataFrame(
        [(v if k == "subject_id" else None, v if k == "subject_name" else None) for k, v in R3_LOOKUPS],
        "subject_id bigint, subject_name string")
    return events_for_subject(_dated(d), d.ec, d.sub, d.cat, keys).select("lookup", "event_id", "rank")


# The subjects, by id or by name, that rows of ``events`` ask for.
_LOOKUPS_SQL = [
    ("asked", """SELECT DISTINCT CASE WHEN e.user_id % 2 = 0 THEN e.user_id * 17 END AS subject_id,
                     CASE WHEN e.user_id % 2 = 1 THEN concat('  ', upper(coalesce(s.name, concat('no subject ',
                          CAST(e.user_id AS VARCHAR)))), ' ') END AS subject_name
                 FROM events e LEFT JOIN subject s ON s.subject_id = e.user_id * 17"""),
    ("lookups", f"""SELECT CAST(a.subject_id AS VARCHAR) AS lookup, a.subject_id
                    FROM asked a JOIN subject s ON s.subject_id = a.subject_id
                    UNION ALL SELECT a.subject_name, min(s.subject_id)
                    FROM asked a JOIN subject s ON lower(s.name) = lower({trim_sql('a.subject_name')}) GROUP BY 1""")]


@register("r3_events_for_lookups", with_ctes(
    """SELECT h.lookup, h.event_id, CAST(row_number() OVER (PARTITION BY h.lookup
               ORDER BY e.date DESC, e.time DESC, e.event_id) AS BIGINT) AS rank
       FROM hits h JOIN event e ON h.event_id = e.event_id""",
    "subject", "category", "ec_key", "event",
    extra=[*_LOOKUPS_SQL,
           ("hits", f"""SELECT DISTINCT l.lookup, k.event_id FROM lookups l
                       JOIN subject s ON l.subject_id = s.subject_id
                       JOIN category c ON s.category_id = c.category_id
                       JOIN ec_key k ON {key_sql('c.name')} = k.category_key""")]))
def r3_events_for_lookups(spark, sf_dir):
    from .recommend import events_for_subject
    d = Domain(spark, sf_dir)
    return events_for_subject(_dated(d), d.ec, d.sub, d.cat, _lookups(d)).select("lookup", "event_id", "rank")


def _dated(d):
    """The columns of the events that R3's queries need: their lists are sorted and written."""
    return d.ev.select("event_id", "date", "time")


def _lookups(d):
    """The subjects, by id or by name, that rows of ``events`` ask for."""
    e = d.table("events").select("user_id", (F.col("user_id") * 17).alias("subject_id"))
    by_id = F.col("user_id") % 2 == 0
    name = F.coalesce("name", F.concat(F.lit("no subject "), F.col("user_id").cast("string")))
    asked = e.join(d.sub.select("subject_id", "name"), "subject_id", "left").select(
        F.when(by_id, F.col("subject_id")).alias("subject_id"),
        F.when(~by_id, F.concat(F.lit("  "), F.upper(name), F.lit(" "))).alias("subject_name")).distinct()
    return asked


_R3_LISTS_SQL = [
    *_LOOKUPS_SQL,
    ("members", f"""SELECT lookup, array_to_string(list_sort(list(DISTINCT {key_sql('c.name')})), ', ') AS list_keys FROM lookups l
                    JOIN subject s ON l.subject_id = s.subject_id JOIN category c ON s.category_id = c.category_id
                    WHERE {key_sql('c.name')} IS NOT NULL GROUP BY lookup""")]


@register("r3_list_members", with_ctes("SELECT lookup, list_keys FROM members", "subject", "category", extra=_R3_LISTS_SQL))
def r3_list_members(spark, sf_dir):
    from .recommend import subject_lists
    d = Domain(spark, sf_dir)
    return subject_lists(_dated(d), d.ec, d.sub, d.cat, _lookups(d))[0].select("lookup", F.array_join("list_keys", ", ").alias("list_keys"))


@register("r3_subject_lists", with_ctes(
    """SELECT h.list_keys, h.event_id, row_number() OVER (PARTITION BY h.list_keys ORDER BY e.date DESC, e.time DESC, e.event_id) AS rank
       FROM (SELECT DISTINCT m.list_keys, k.event_id FROM (SELECT DISTINCT list_keys FROM members) m
             JOIN ec_key k ON list_contains(string_split(m.list_keys, ', '), k.category_key)) h
       JOIN event e ON h.event_id = e.event_id""",
    "subject", "category", "ec_key", "event", extra=_R3_LISTS_SQL))
def r3_subject_lists(spark, sf_dir):
    from .recommend import subject_lists
    d = Domain(spark, sf_dir)
    lists = subject_lists(_dated(d), d.ec, d.sub, d.cat, _lookups(d))[1]
    return lists.select(F.array_join("list_keys", ", ").alias("list_keys"), "event_id", "rank")


@register("r2_recommend_summary", with_ctes(
    """SELECT st.student_id,
              CASE WHEN f.has_rated THEN 'matched-only' ELSE 'default' END AS mode,
              CASE WHEN f.has_rated THEN coalesce(u.used, '') ELSE '' END AS categories_used,
              CAST(CASE WHEN f.has_rated THEN coalesce(t.n, 0) ELSE (SELECT count(*) FROM event) END AS BIGINT) AS total,
              CASE WHEN f.student_id IS NULL THEN 'No subjects were found, so default events are displayed.'
                   WHEN NOT f.has_rated THEN 'All ratings are 0/null, so default events are displayed.' END AS message
       FROM student st LEFT JOIN flags f ON st.student_id = f.student_id
       LEFT JOIN used u ON st.student_id = u.student_id
       LEFT JOIN totals t ON st.student_id = t.student_id""",
    "student", "interest", "ec_key", "event",
    extra=[("flags", """SELECT student_id, bool_or(coalesce(interest > 0, false)) AS has_rated
                        FROM student_subject GROUP BY student_id"""),
           ("used", """SELECT student_id, array_to_string(list_sort(list(category_key)), ', ') AS used
                       FROM interest GROUP BY student_id"""),
           ("totals", """SELECT i.student_id, count(DISTINCT k.event_id) AS n FROM interest i
                         JOIN ec_key k ON i.category_key = k.category_key GROUP BY i.student_id""")]))
def r2_recommend_summary(spark, sf_dir):
    from .recommend import recommend_or_default
    d = Domain(spark, sf_dir)
    return recommend_or_default(d.stu, d.ss, d.sub, d.cat, d.ec, d.ev)


@register("g2_interest_by_category", with_ctes("SELECT * FROM interest", "interest"))
def g2_interest_by_category(spark, sf_dir):
    from .recommend import student_category_interest
    d = Domain(spark, sf_dir)
    return student_category_interest(d.ss, d.sub, d.cat)


@register("g7_student_flags", with_ctes(
    """SELECT st.student_id, f.student_id IS NOT NULL AS has_subjects, coalesce(f.has_rated, false) AS has_rated
       FROM student st LEFT JOIN (SELECT student_id, bool_or(coalesce(interest > 0, false)) AS has_rated
                                  FROM student_subject GROUP BY student_id) f ON st.student_id = f.student_id""",
    "student", "student_subject"))
def g7_student_flags(spark, sf_dir):
    from ..operators.aggregates import student_flags
    d = Domain(spark, sf_dir)
    return student_flags(d.stu, d.ss)


@register("j1_subjects_with_category", with_ctes(
    """SELECT s.subject_id, s.name, s.category_id, c.name AS category_name
       FROM subject s LEFT JOIN category c ON s.category_id = c.category_id""", "subject", "category"))
def j1_subjects_with_category(spark, sf_dir):
    from ..operators.joins import subjects_with_category
    d = Domain(spark, sf_dir)
    return subjects_with_category(d.sub, d.cat).select("subject_id", "name", "category_id", "category_name")


@register("j9_student_profile", with_ctes(
    """SELECT st.student_id, st.username, s.name AS subject_name, CAST(coalesce(c.n, 0) AS BIGINT) AS n_subjects
       FROM student st LEFT JOIN student_subject ss ON st.student_id = ss.student_id
       LEFT JOIN subject s ON ss.subject_id = s.subject_id
       LEFT JOIN (SELECT student_id, count(*) AS n FROM student_subject GROUP BY 1) c ON st.student_id = c.student_id""",
    "student", "student_subject", "subject"))
def j9_student_profile(spark, sf_dir):
    from ..operators.joins import student_profile
    d = Domain(spark, sf_dir)
    return student_profile(d.stu, d.ss, d.sub).select("student_id", "username", "subject_name", "n_subjects")


# ---------------------------------------------------------------------------------------
# Page jobs
# ---------------------------------------------------------------------------------------
from . import oracle as O  # noqa: E402

_HREF_SQL = """(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)\""""
_LINKS_SQL = f"""
    SELECT page_id, url, CAST(s.pos AS INTEGER) AS pos, {O.trim_ws(O.decode_sql('s.href'))} AS href
    FROM (SELECT page_id, url, unnest(list_transform(
              regexp_extract_all({O.strip_html_sql('html', ('script', 'style'))}, '{_HREF_SQL}', 1),
              lambda x, i: struct_pack(pos := i - 1, href := x))) AS s
          FROM pages) t"""
_RESOLVED_SQL = f"""
    SELECT page_id, url, pos, href, full_url,
           regexp_extract(full_url, '{O.HOST_RE}', 1) AS link_host,
           regexp_extract(full_url, '{O.PATH_RE}', 1) AS link_path,
           {O.normalize_sql('full_url')} AS link
    FROM (SELECT *, {O.resolve_sql('url', 'href')} AS full_url FROM links) r"""


@register("p1_page_text", f"""
    SELECT page_id, url, t AS text, CAST(length(t) AS INTEGER) AS characters
    FROM (SELECT page_id, url, {O.page_text_sql('html')} AS t FROM pages) x""")
def p1_page_text(spark, sf_dir):
    from ..operators.pages import page_texts
    return page_texts(T.load_table(spark, sf_dir, "pages"))


# What a reader sees of the odd markup that ``_odd_pages`` puts around a page, by hand.
@register("p1_odd_pages", f"""
    SELECT page_id, text, CAST(length(text) AS INTEGER) AS characters, n_links
    FROM (SELECT page_id, n_links,
                 CASE page_id % 6 WHEN 0 THEN concat_ws(' ', '5 < ' || page_id || ' and 9 > 8', t)
                                  WHEN 1 THEN concat_ws(' ', 'title ' || page_id, t)
                                  WHEN 2 THEN concat_ws(' ', '© 2024 & ' || page_id, t)
                                  WHEN 3 THEN concat_ws(' ', t, 'end ' || page_id)
                                  WHEN 4 THEN concat_ws(' ', 'link ' || page_id, t)
                                  ELSE concat_ws(' ', 'AT&T ' || page_id, t) END AS text
          FROM (SELECT page_id, NULLIF({O.page_text_sql('html')}, '') AS t,
                       CAST(len(regexp_extract_all({O.strip_html_sql('html', ('script', 'style'))}, '{_HREF_SQL}', 1)) + (page_id % 6 = 4)::INT AS INTEGER) AS n_links
                FROM pages) p) q""")
def p1_odd_pages(spark, sf_dir):
    from ..functions.text import page_hrefs
    from ..operators.pages import page_texts
    odd = _odd_pages(T.load_table(spark, sf_dir, "pages"))
    return page_texts(odd, carry=(F.size(page_hrefs(F.col("html"))).alias("n_links"),)).select("page_id", "text", "characters", "n_links")


def _odd_pages(pages):
    """Every page with a piece of odd markup before or behind it: ``<`` in text, ``>`` in an
    attribute, references without a semicolon, a script that is never closed."""
    piece = F.expr("""CASE page_id % 6 WHEN 0 THEN concat('<p>5 < ', page_id, ' and 9 > 8</p>')
                                       WHEN 1 THEN concat('<p title="a > b">title ', page_id, '</p>')
                                       WHEN 2 THEN concat('<p>&copy 2024 &amp ', page_id, '</p>')
                                       WHEN 3 THEN concat('<p>end ', page_id, '<script>var a = "<p>code</p>";')
                                       WHEN 4 THEN concat('<a href="/', page_id, '" title="1 > 0">link ', page_id, '</a>')
                                       ELSE concat('<p>AT&T ', page_id, '</p>') END""")
    return pages.withColumn("html", F.when(F.col("page_id") % 6 == 3, F.concat("html", piece)).otherwise(F.concat(piece, F.col("html"))))


@register("p3_page_links", _LINKS_SQL)
def p3_page_links(spark, sf_dir):
    from ..operators.pages import page_links
    return page_links(T.load_table(spark, sf_dir, "pages"))


@register("p5_resolved_links", "WITH links AS (" + _LINKS_SQL + ")\n"
          "SELECT page_id, pos, full_url, link_host, link_path, link FROM (" + _RESOLVED_SQL + ") z")
def p5_resolved_links(spark, sf_dir):
    from ..operators.pages import page_links, resolve_links
    return resolve_links(page_links(T.load_table(spark, sf_dir, "pages"))).select(
        "page_id", "pos", "full_url", "link_host", "link_path", "link")


@register("p11_route_pages", f"""
    SELECT page_id, url, source,
           CASE WHEN source = 'meetup' THEN
                CASE WHEN contains(q, 'location=') THEN coalesce(split_part(regexp_replace(
                          list_filter(string_split(q, '&'), lambda x: starts_with(x, 'location='))[1],
                          '^location=', ''), '--', -1), '')
                     WHEN contains(lower(q), 'vilnius') OR contains(txt, 'vilnius') THEN 'Vilnius'
                     ELSE '' END
           ELSE '' END AS city
    FROM (SELECT page_id, url, q, txt,
            CASE WHEN contains(h, 'litexpo.lt') AND contains(p, '/en/events') THEN 'litexpo'
                 WHEN contains(h, 'meetup.com') AND (contains(p, '/find/') OR contains(p, '/events/')
                      OR contains(lower(q), 'vilnius') OR contains(txt, 'vilnius') OR contains(txt, 'events'))
                      THEN 'meetup'
                 WHEN contains(h, 'kaveikti.lt') AND contains(p, '/renginiai') THEN 'kaveikti'
                 ELSE 'other' END AS source
          FROM (SELECT page_id, url, lower(regexp_extract(url, '{O.HOST_RE}', 1)) AS h,
                       lower(regexp_extract(url, '{O.PATH_RE}', 1)) AS p,
                       regexp_extract(url, '{O.QUERY_RE}', 1) AS q,
                       lower({O.page_text_sql('html', None)}) AS txt
                FROM pages
                WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')) a) b""")
def p11_route_pages(spark, sf_dir):
    from .scrape import route_pages
    return route_pages(T.load_table(spark, sf_dir, "pages")).select("page_id", "url", "source", "city")


@register("p15_event_list_prompts", f"""
    SELECT page_id, url, {__import__('unievents.operators.prompts', fromlist=['x']).prompt_sql(
        __import__('unievents.operators.prompts', fromlist=['x']).EVENT_LIST_TEMPLATE,
        text=O.page_text_sql('html'))} AS prompt FROM pages""")
def p15_event_list_prompts(spark, sf_dir):
    from .scrape import event_list_prompts
    return event_list_prompts(T.load_table(spark, sf_dir, "pages"))


@register("p15_event_page_prompts", f"""
    SELECT page_id, url, 'other' AS source, '' AS city, {__import__('unievents.operators.prompts', fromlist=['x']).prompt_sql(
        __import__('unievents.operators.prompts', fromlist=['x']).EVENT_TEMPLATES['other'],
        detail_url='url', detail_text=O.page_text_sql('html'))} AS prompt FROM pages""")
def p15_event_page_prompts(spark, sf_dir):
    from .scrape import event_prompts
    pages = T.load_table(spark, sf_dir, "pages")
    routed = pages.withColumn("source", F.lit("other")).withColumn("city", F.lit(""))
    return event_prompts(routed)


@register("io5_page_text_files", f"""
    SELECT page_id, url, t AS text, CAST(length(t) AS INTEGER) AS characters
    FROM (SELECT page_id, url, {O.page_text_sql('html')} AS t FROM pages) x""")
def io5_page_text_files(spark, sf_dir):
    """IO2, P1 and IO5: all pages read from a folder of pages, their text written and read back."""
    from ..operators.pages import page_texts
    from ..sources.files import load_pages, write_text
    path = _document_folder(spark, "text")
    write_text(page_texts(load_pages(spark, f"{sf_dir.rstrip('/')}/pages.parquet")), path)
    return spark.read.schema("page_id bigint, url string, text string, characters int").parquet(path)


@register("f6_filter_requests", """
    SELECT event_id, CASE WHEN lo > hi THEN 'min_price cannot be greater than max_price.'
                          WHEN d0 > d1 THEN 'start_date cannot be greater than end_date.'
                          WHEN t0 > t1 THEN 'start_time cannot be greater than end_time.' END AS reason
    FROM (SELECT event_id, value AS lo, CASE WHEN event_id % 3 > 0 THEN value + event_id % 7 - 2 END AS hi,
                 CAST(ts AS DATE) AS d0, CASE WHEN event_id % 4 > 0 THEN CAST(ts AS DATE) + CAST(event_id % 5 - 1 AS INTEGER) END AS d1,
                 strftime(ts, '%H:%M:%S') AS t0, CASE WHEN event_id % 2 = 0 THEN '12:00:00' END AS t1 FROM events) r""")
def f6_filter_requests(spark, sf_dir):
    """F6 for a filter request of each ``events`` row: why it is refused, if it is."""
    from ..operators.filters import filter_request_reasons
    i, v, d = F.col("event_id"), F.col("value"), F.to_date("ts")
    asked = T.load_table(spark, sf_dir, "events").select(
        "event_id", v.alias("min_price"), F.when(i % 3 > 0, v + i % 7 - 2).alias("max_price"),
        d.alias("start_date"), F.when(i % 4 > 0, F.date_add(d, (i % 5 - 1).cast("int"))).alias("end_date"),
        F.date_format("ts", "HH:mm:ss").alias("start_time"), F.when(i % 2 == 0, F.lit("12:00:00")).alias("end_time"))
    return filter_request_reasons(asked).select("event_id", "reason")


@register("j11_new_students", with_ctes(
    "SELECT e.event_id, e.user_id, s.student_id IS NULL AS is_new FROM events e LEFT JOIN student s ON e.user_id * 13 = s.student_id", "student"))
def j11_new_students(spark, sf_dir):
    from ..operators.joins import split_new
    d = Domain(spark, sf_dir)
    batch = d.table("events").select("event_id", "user_id", (F.col("user_id") * 13).alias("student_id"))
    return split_new(batch, d.stu, ["student_id"]).select("event_id", "user_id", "is_new")


# Local link rules for the registered frontier: the three site rules never match the
# driver's hosts, so listing pages are routed by top-level domain to rules of the same
# shape (host suffix, path must / must-not contain, lower-case path must contain).
def _local_rules():
    from ..operators.pages import LinkRule
    return (LinkRule("local-com", host_suffix=".example.com", path_not_has=(",",)),
            LinkRule("local-net", lower_path_has=("e",), not_suffix="/the/"),
            LinkRule("local-org", path_has=("/",), path_not_has=(".",), hosts=None))


R8_N = 20  # the default number of links
_R8_SQL = "WITH links AS (" + _LINKS_SQL + "),\nresolved AS (" + _RESOLVED_SQL + ")" + f""",
    routed AS (SELECT page_id, 'local-' || regexp_extract(regexp_extract(url, '{O.HOST_RE}', 1), '([^.]*)$', 1) AS source
               FROM pages),
    kept AS (SELECT r.page_id, t.source, r.pos, r.link FROM resolved r JOIN routed t ON r.page_id = t.page_id
             WHERE (t.source = 'local-com' AND ends_with(r.link_host, '.example.com') AND NOT contains(r.link_path, ','))
                OR (t.source = 'local-net' AND contains(lower(r.link_path), 'e') AND NOT ends_with(r.link, '/the/'))
                OR (t.source = 'local-org' AND contains(r.link_path, '/') AND NOT contains(r.link_path, '.'))),
    firsts AS (SELECT page_id, source, link, min(pos) AS pos FROM kept GROUP BY 1, 2, 3),
    ranked AS (SELECT page_id, source, link,
                      CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS link_rank FROM firsts)
    SELECT page_id, source, link, link_rank, 'found' AS origin, CAST(NULL AS VARCHAR) AS error
    FROM ranked WHERE link_rank <= {R8_N}
    UNION ALL
    SELECT page_id, source, NULL, NULL, NULL,
           'No event links found for source ''' || source || ''' and no saved links are available.'
    FROM routed WHERE source IN ('local-com', 'local-net', 'local-org')
      AND page_id NOT IN (SELECT page_id FROM firsts)"""


@register("r8_link_frontier", _R8_SQL)
def r8_link_frontier(spark, sf_dir):
    import datetime as dt

    from ..operators.pages import rules_frame
    from ..operators.writes import URL_COLS
    from .scrape import link_frontier
    pages = T.load_table(spark, sf_dir, "pages")
    routed = pages.withColumn("source", F.concat(F.lit("local-"), F.regexp_extract(
        F.regexp_extract("url", O.HOST_RE, 1), r"([^.]*)$", 1))).withColumn("city", F.lit(""))
    urls = spark.createDataFrame([], "url string, source string, city string, last_seen timestamp, "
                                     "last_scraped timestamp, is_active boolean").select(*URL_COLS)
    frontier, _, rejected = link_frontier(routed, urls, rules_frame(spark, _local_rules()),
                                          dt.datetime(2026, 1, 1), R8_N)
    return frontier.select("page_id", "source", "link", "link_rank", "origin",
                           F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select("page_id", "source", F.lit(None).cast("string").alias("link"),
                        F.lit(None).cast("int").alias("link_rank"), F.lit(None).cast("string").alias("origin"),
                        "error"))


# ---------------------------------------------------------------------------------------
# Model responses
# ---------------------------------------------------------------------------------------
from ..operators.responses import LINE_BREAKS, SUBJECT_SKIP_PREFIXES, SUBJECT_SKIP_TOKENS  # noqa: E402
from ..sources import responses as RS  # noqa: E402

AS_OF_YEAR = 2026


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_M2_SQL = f"""
WITH resp AS ({RS.SUBJECT_RESPONSES_SQL}),
f AS (SELECT prompt_id, url, {O.fence_sql('response')} AS s FROM resp),
v AS (SELECT prompt_id, url, s, {O.recover_sql('s')} AS j FROM f),
items AS (SELECT prompt_id, url,
  CASE WHEN j IS NOT NULL AND json_type(j) = 'OBJECT' AND json_type(j, '$.study_subjects') = 'ARRAY'
       THEN list_transform(json_extract(j, '$.study_subjects[*]'),
                           lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END)
       ELSE list_filter(list_transform(regexp_split_to_array(s, '{LINE_BREAKS}'),
                                       lambda x: regexp_replace(x, '^[-• \\t]+|[-• \\t]+$', '', 'g')),
                        lambda x: x <> '') END AS arr
  FROM v),
ex AS (SELECT prompt_id, CAST(e.pos AS INTEGER) AS pos, {O.trim_ws('e.raw')} AS name
       FROM (SELECT prompt_id, unnest(list_transform(arr, lambda x, i: struct_pack(pos := i - 1, raw := x))) AS e
             FROM items) q),
kept AS (SELECT * FROM ex WHERE name IS NOT NULL AND name <> ''
           AND name NOT IN ({', '.join(_lit(t) for t in SUBJECT_SKIP_TOKENS)})
           AND NOT ({' OR '.join(f"starts_with(replace(name, ' ', ''), {_lit(p)})" for p in SUBJECT_SKIP_PREFIXES)})),
names AS (SELECT prompt_id, pos, name FROM (
            SELECT *, row_number() OVER (PARTITION BY prompt_id, replace(lower(name), 'ß', 'ss') ORDER BY pos) AS rn
            FROM kept) z WHERE rn = 1)
"""


@register("m2_response_subjects", _M2_SQL + "SELECT prompt_id, pos, name FROM names")
def m2_response_subjects(spark, sf_dir):
    from ..operators.responses import response_subjects
    return response_subjects(RS.subject_responses(spark, sf_dir))


@register("r10_subject_lists", _M2_SQL + """
SELECT r.prompt_id, r.url, coalesce(array_to_string(list(n.name ORDER BY n.pos), ' | '), '') AS study_subjects,
       CAST(count(n.name) AS INTEGER) AS subjects_count
FROM resp r LEFT JOIN names n ON r.prompt_id = n.prompt_id GROUP BY r.prompt_id, r.url""")
def r10_subject_lists(spark, sf_dir):
    from .scrape import load_subject_responses
    out = load_subject_responses(RS.subject_responses(spark, sf_dir))
    return out.select("prompt_id", "url", F.array_join("study_subjects", " | ").alias("study_subjects"),
                      "subjects_count")


def _document_folder(spark, name: str) -> str:
    """A new folder in the shared folder, for documents that are written and read back."""
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/documents/{name}-{uuid.uuid4().hex}"


@register("io6_subject_documents", _M2_SQL + """
SELECT r.url, CAST(r.prompt_id % 8 + 1 AS INTEGER) AS from_semester, 8 AS to_semester,
       coalesce(array_to_string(list(n.name ORDER BY n.pos), ' | '), '') AS study_subjects
FROM resp r LEFT JOIN names n ON r.prompt_id = n.prompt_id GROUP BY r.prompt_id, r.url""")
def io6_subject_documents(spark, sf_dir):
    """IO6 then IO3: the subject documents of all replies, written and read back."""
    from ..sources.files import load_subjects_json, write_subjects_json
    from .scrape import load_subject_responses
    lists = load_subject_responses(RS.subject_responses(spark, sf_dir)).withColumn(
        "from_semester", (F.col("prompt_id") % 8 + 1).cast("int")).withColumn("to_semester", F.lit(8))
    path = _document_folder(spark, "subjects")
    write_subjects_json(lists, path)
    return load_subjects_json(spark, path, multi_line=False).withColumn("study_subjects", F.array_join("study_subjects", " | "))


_M5_CTE = f"""
resp AS ({RS.CATEGORY_RESPONSES_SQL}),
f AS (SELECT prompt_id, subject, {O.fence_sql('response')} AS s FROM resp),
b0 AS (SELECT prompt_id, subject, coalesce({O.brace_sql('s')}, s) AS body FROM f),
b AS (SELECT prompt_id, subject, CASE WHEN json_valid(body) THEN body END AS jb FROM b0),
c AS (SELECT prompt_id, subject, coalesce(json_type(jb) = 'OBJECT', false) AS obj,
             {O.trim_ws("coalesce(CASE WHEN json_type(jb) = 'OBJECT' THEN json_extract_string(jb, '$.category') END, '')")} AS category
      FROM b),
m5 AS (SELECT prompt_id, subject, CASE WHEN obj AND category <> '' THEN category END AS category,
              CASE WHEN NOT obj THEN 'Could not parse model JSON output.'
                   WHEN category = '' THEN 'Model returned an empty category' END AS error FROM c)"""


@register("m5_response_category", "WITH " + _M5_CTE + "\nSELECT * FROM m5")
def m5_response_category(spark, sf_dir):
    from ..operators.responses import response_category
    ok, failed = response_category(RS.category_responses(spark, sf_dir))
    return ok.select("prompt_id", "subject", "category", F.lit(None).cast("string").alias("error")) \
             .unionByName(failed.select("prompt_id", "subject", F.lit(None).cast("string").alias("category"), "error"))


_R11_CTES = [(n, q) for n, q in [
        ("resp", RS.CATEGORY_RESPONSES_SQL)] ] + [
        ("m5x", "WITH " + _M5_CTE + " SELECT * FROM m5"),
        ("ok", "SELECT prompt_id, subject, category FROM m5x WHERE error IS NULL"),
        ("catf", "SELECT lower(name) AS ck, min(category_id) AS category_id FROM category GROUP BY 1"),
        ("newcat", """SELECT lower(category) AS ck, arg_min(category, prompt_id) AS name, min(prompt_id) AS p
                      FROM ok WHERE lower(category) NOT IN (SELECT ck FROM catf) GROUP BY 1"""),
        ("newcat_ids", """SELECT ck, name, coalesce((SELECT max(category_id) FROM category), 0)
                              + row_number() OVER (ORDER BY p) AS category_id FROM newcat"""),
        ("cids", "SELECT ck, category_id FROM catf UNION ALL SELECT ck, category_id FROM newcat_ids"),
        ("subf", "SELECT lower(name) AS sk, min(subject_id) AS subject_id FROM subject GROUP BY 1"),
        ("new_sub", """SELECT lower(subject) AS sk, coalesce((SELECT max(subject_id) FROM subject), 0)
                           + row_number() OVER (ORDER BY min(prompt_id)) AS subject_id
                       FROM ok WHERE lower(subject) NOT IN (SELECT sk FROM subf) GROUP BY 1""")]
_R11_SQL = """
SELECT o.prompt_id AS batch_pos, o.subject, cn.name AS category_name,
       coalesce(sf.subject_id, ns.subject_id) AS subject_id,
       CASE WHEN sf.subject_id IS NULL THEN 'created'
            WHEN s.category_id IS NOT DISTINCT FROM ci.category_id THEN 'unchanged' ELSE 'updated' END AS action
FROM ok o JOIN cids ci ON lower(o.category) = ci.ck
LEFT JOIN subf sf ON lower(o.subject) = sf.sk
LEFT JOIN subject s ON sf.subject_id = s.subject_id
LEFT JOIN new_sub ns ON lower(o.subject) = ns.sk
JOIN (SELECT category_id, name FROM category UNION ALL SELECT category_id, name FROM newcat_ids) cn
  ON ci.category_id = cn.category_id"""


@register("r11_import_subjects", with_ctes(_R11_SQL, "category", "subject", extra=_R11_CTES))
def r11_import_subjects(spark, sf_dir):
    from .scrape import assign_subjects
    d = Domain(spark, sf_dir)
    _, _, log, _ = assign_subjects(d.sub, d.cat, RS.category_responses(spark, sf_dir))
    return log.select("batch_pos", "subject", "category_name", "subject_id", "action")


@register("g6_import_counters", with_ctes("""
SELECT (SELECT count(*) FROM m5x) AS input_count, (SELECT count(*) FROM newcat) AS created_categories,
       count(*) FILTER (WHERE action = 'created') AS created_subjects, count(*) FILTER (WHERE action = 'updated') AS updated_subjects,
       (SELECT count(*) FROM m5x WHERE error IS NOT NULL) AS failed_count
FROM log""", "category", "subject", extra=_R11_CTES + [("log", _R11_SQL)]))
def g6_import_counters(spark, sf_dir):
    from .scrape import assign_subjects, import_counters
    d = Domain(spark, sf_dir)
    _, next_cat, log, failed = assign_subjects(d.sub, d.cat, RS.category_responses(spark, sf_dir))
    return import_counters(d.cat, next_cat, log, failed)


_R9_CTES = [
    ("resp", RS.EVENT_RESPONSES_SQL),
    ("f", f"SELECT prompt_id, url, {O.fence_sql('response')} AS s FROM resp"),
    ("v", f"SELECT prompt_id, url, {O.recover_sql('s')} AS j FROM f"),
    ("items", """SELECT prompt_id, url, 0 AS item_pos,
                        json_extract_string(j, '$.name') AS raw_name, json_extract_string(j, '$.date') AS raw_date,
                        json_extract_string(j, '$.time') AS raw_time, json_extract_string(j, '$.place') AS raw_place,
                        json_extract_string(j, '$.price') AS raw_price,
                        json_extract_string(j, '$.short_description') AS raw_desc,
                        CASE WHEN json_type(j, '$.categories') = 'ARRAY'
                             THEN json_extract(j, '$.categories[*]') ELSE [] END AS raw_cats
                 FROM v WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'"""),
    ("std", f"""SELECT prompt_id, url, item_pos, {O.trim_ws("coalesce(raw_name, '')")} AS name,
                       {O.date_sql('raw_date', AS_OF_YEAR)} AS date,
                       coalesce({O.time_sql('raw_time')}, '00:00:00') AS time,
                       {O.trim_ws("coalesce(raw_place, '')")} AS place,
                       {O.price_sql('raw_price')} AS price,
                       CASE WHEN {O.trim_ws("coalesce(raw_desc, '')")} = ''
                            THEN concat('Event: ', {O.trim_ws("coalesce(raw_name, '')")})
                            ELSE {O.trim_ws("coalesce(raw_desc, '')")} END AS short_description,
                       url AS source_url,
                       list_filter(list_transform(raw_cats, lambda x: {O.trim_ws("coalesce(json_extract_string(x, '$'), '')")}),
                                   lambda x: x <> '') AS categories
                FROM items"""),
    ("ok", """SELECT *, row(prompt_id, item_pos) AS batch_pos FROM std
              WHERE name <> '' AND date IS NOT NULL AND place <> '' AND price IS NOT NULL"""),
    ("bad", "SELECT * FROM std WHERE NOT (name <> '' AND date IS NOT NULL AND place <> '' AND price IS NOT NULL)"),
    ("firsts", "SELECT name, date, min(batch_pos) AS first_pos FROM ok GROUP BY 1, 2"),
    ("newk", """SELECT f.name, f.date, coalesce((SELECT max(event_id) FROM event), 0)
                       + row_number() OVER (ORDER BY f.first_pos) AS new_id
                FROM firsts f LEFT JOIN event e ON f.name = e.name AND f.date = e.date WHERE e.event_id IS NULL"""),
]
_R9_LOG = """
SELECT o.prompt_id, o.url, o.item_pos,
       CASE WHEN e.event_id IS NULL AND o.batch_pos = fi.first_pos THEN 'created' ELSE 'updated' END AS action,
       CAST(NULL AS VARCHAR) AS error, coalesce(e.event_id, n.new_id) AS event_id, o.name,
       CAST(o.date AS VARCHAR) AS date, substr(o.time, 1, 5) AS time, o.place, CAST(o.price AS VARCHAR) AS price,
       array_to_string(o.categories, ', ') AS categories, o.short_description, o.source_url
FROM ok o JOIN firsts fi ON o.name = fi.name AND o.date = fi.date
LEFT JOIN event e ON o.name = e.name AND o.date = e.date
LEFT JOIN newk n ON o.name = n.name AND o.date = n.date
UNION ALL
SELECT prompt_id, url, item_pos, 'failed', 'Missing or invalid required fields (name, date, time, place, price).',
       NULL, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM bad
UNION ALL
SELECT prompt_id, url, NULL, 'failed', 'Could not parse model JSON output.', NULL, NULL, NULL, NULL, NULL, NULL,
       NULL, NULL, NULL FROM v WHERE j IS NULL OR json_type(j) <> 'OBJECT'"""
_R9_SQL = with_ctes(_R9_LOG, "event", extra=_R9_CTES)


@register("r9_load_event_responses", _R9_SQL)
def r9_load_event_responses(spark, sf_dir):
    from .scrape import load_event_responses
    d = Domain(spark, sf_dir)
    out = load_event_responses(RS.event_responses(spark, sf_dir), d.ev, d.ec, d.cat, AS_OF_YEAR)
    return out["log"].drop("category_list", "raw_item")


@register("io7_event_documents", with_ctes("""
SELECT url, 'other' AS source, '' AS city, event_id, name, date, time, place, price, categories, short_description, source_url
FROM log WHERE action <> 'failed'""", "event", extra=_R9_CTES + [("log", _R9_LOG)]))
def io7_event_documents(spark, sf_dir):
    """IO7 then IO4: the event documents of all listings, written and read back."""
    from ..sources.files import load_events_json, write_events_json
    from .scrape import load_event_responses
    d = Domain(spark, sf_dir)
    responses = RS.event_responses(spark, sf_dir)
    log = load_event_responses(responses, d.ev, d.ec, d.cat, AS_OF_YEAR)["log"] \
        .withColumn("source", F.lit("other")).withColumn("city", F.lit(""))
    keys = ("url", "source", "city")
    path = _document_folder(spark, "events")
    write_events_json(
        log.where("action <> 'failed'").select(*keys, "event_id", "name", "date", "time", "place", "price",
                                              F.col("category_list").alias("categories"), "short_description", "source_url"),
        log.where("action = 'failed'").select(*keys, F.col("url").alias("source_url"), "name", "error", F.col("raw_item").alias("raw")),
        path, keys)
    return load_events_json(spark, path, multi_line=False).withColumn("categories", F.array_join("categories", ", "))


@register("g6_event_load_counters", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS input_count,
       CAST(count(*) FILTER (WHERE action = 'created') AS BIGINT) AS created_count,
       CAST(count(*) FILTER (WHERE action = 'updated') AS BIGINT) AS updated_count,
       CAST(count(*) FILTER (WHERE action = 'failed') AS BIGINT) AS failed_count
FROM log""", "event", extra=_R9_CTES + [("log", _R9_LOG)]))
def g6_event_load_counters(spark, sf_dir):
    from .scrape import load_event_responses
    d = Domain(spark, sf_dir)
    return load_event_responses(RS.event_responses(spark, sf_dir), d.ev, d.ec, d.cat, AS_OF_YEAR)["counters"]


# ---------------------------------------------------------------------------------------
# Writes (W1, W6, W9, W12, W13): request batches derived from the `events` table
# ---------------------------------------------------------------------------------------
_W1_BATCH_SQL = """SELECT event_id AS batch_pos, event_type AS name, CAST(ts AS DATE) AS date,
                          strftime(ts, '%H:%M:%S') AS time, concat('User ', CAST(user_id AS VARCHAR)) AS place,
                          props AS short_description FROM events"""
_W1_CTES = [("batch", _W1_BATCH_SQL),
            ("firsts", "SELECT name, date, min(batch_pos) AS first_pos FROM batch GROUP BY 1, 2"),
            ("newk", """SELECT f.name, f.date, coalesce((SELECT max(event_id) FROM event), 0)
                               + row_number() OVER (ORDER BY f.first_pos) AS new_id
                        FROM firsts f LEFT JOIN event e ON f.name = e.name AND f.date = e.date
                        WHERE e.event_id IS NULL"""),
            ("last", """SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY name, date ORDER BY batch_pos DESC) AS rn
                                       FROM batch b) z WHERE rn = 1""")]


def _w1_batch(spark, sf_dir):
    e = T.load_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("batch_pos"), F.col("event_type").alias("name"),
                    F.col("ts").cast("date").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"),
                    F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("place"),
                    F.lit(None).cast("decimal(10,2)").alias("price"),
                    F.col("props").alias("short_description"), F.lit("").alias("source_url"))


@register("w1_upsert_events_log", with_ctes("""
SELECT b.batch_pos, b.name, CAST(b.date AS VARCHAR) AS date, coalesce(e.event_id, n.new_id) AS event_id,
       CASE WHEN e.event_id IS NULL AND b.batch_pos = f.first_pos THEN 'created' ELSE 'updated' END AS action
FROM batch b JOIN firsts f ON b.name = f.name AND b.date = f.date
LEFT JOIN event e ON b.name = e.name AND b.date = e.date
LEFT JOIN newk n ON b.name = n.name AND b.date = n.date""", "event", extra=_W1_CTES))
def w1_upsert_events_log(spark, sf_dir):
    from ..operators.writes import upsert_events
    d = Domain(spark, sf_dir)
    _, log = upsert_events(d.ev, _w1_batch(spark, sf_dir))
    return log.select("batch_pos", "name", F.col("date").cast("string").alias("date"), "event_id", "action")


@register("w1_upsert_events_next", with_ctes("""
SELECT event_id, name, CAST(date AS VARCHAR) AS date, time, place, short_description FROM event e
WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.name = e.name AND l.date = e.date)
UNION ALL
SELECT coalesce(e.event_id, n.new_id), l.name, CAST(l.date AS VARCHAR), l.time, l.place, l.short_description
FROM last l LEFT JOIN event e ON l.name = e.name AND l.date = e.date
LEFT JOIN newk n ON l.name = n.name AND l.date = n.date""", "event", extra=_W1_CTES))
def w1_upsert_events_next(spark, sf_dir):
    from ..operators.writes import upsert_events
    d = Domain(spark, sf_dir)
    nxt, _ = upsert_events(d.ev, _w1_batch(spark, sf_dir))
    return nxt.select("event_id", "name", F.col("date").cast("string").alias("date"), "time", "place",
                      "short_description")


@register("w3_reject_duplicates_log", with_ctes("""
SELECT b.batch_pos, b.name, CAST(b.date AS VARCHAR) AS date,
       CASE WHEN e.event_id IS NULL AND b.batch_pos = f.first_pos THEN 'created' ELSE 'rejected' END AS action
FROM batch b JOIN firsts f ON b.name = f.name AND b.date = f.date
LEFT JOIN event e ON b.name = e.name AND b.date = e.date""", "event", extra=_W1_CTES))
def w3_reject_duplicates_log(spark, sf_dir):
    from ..operators.writes import upsert_events
    d = Domain(spark, sf_dir)
    _, log = upsert_events(d.ev, _w1_batch(spark, sf_dir), on_duplicate="reject")
    return log.select("batch_pos", "name", F.col("date").cast("string").alias("date"), "action")


@register("w6_update_interest_log", with_ctes(f"""
SELECT b.batch_pos, b.student_id, TRY_CAST(b.subject_id AS BIGINT) AS subject_id, s.name AS subject_name,
       TRY_CAST(b.interest AS INTEGER) AS interest,
       CASE WHEN err IS NULL THEN 'updated' ELSE 'failed' END AS action, err AS error
FROM (SELECT b.*, CASE
        WHEN NOT b.is_object THEN 'Each subjects item must be an object.'
        WHEN b.subject_id IS NULL OR b.interest IS NULL THEN 'subject_id and interest are required'
        WHEN TRY_CAST(b.interest AS INTEGER) IS NULL THEN 'Interest must be a number'
        WHEN TRY_CAST(b.interest AS INTEGER) NOT BETWEEN 1 AND 5 THEN 'Interest must be between 1 and 5'
        WHEN s.subject_id IS NULL THEN 'Subject not found'
        WHEN m.subject_id IS NULL THEN 'Student-subject relation not found' END AS err
      FROM batch b LEFT JOIN subject s ON TRY_CAST(b.subject_id AS BIGINT) = s.subject_id
      LEFT JOIN student_subject m ON TRY_CAST(b.subject_id AS BIGINT) = m.subject_id AND b.student_id = m.student_id) b
LEFT JOIN subject s ON TRY_CAST(b.subject_id AS BIGINT) = s.subject_id""",
    "subject", "student_subject",
    extra=[("batch", """SELECT e.event_id AS batch_pos, e.user_id AS student_id, e.event_id % 50 <> 7 AS is_object,
                               CASE WHEN e.event_id % 3 = 0 THEN CAST(user_id * 13 AS VARCHAR)
                                    ELSE CAST(l.l_partkey AS VARCHAR) END AS subject_id,
                               json_extract_string(props, '$.k') AS interest
                        FROM events e LEFT JOIN (SELECT o_custkey, min(l_partkey) AS l_partkey FROM orders
                                                 JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) l ON l.o_custkey = e.user_id""")]))
def w6_update_interest_log(spark, sf_dir):
    return _w6(spark, sf_dir)[1]


def _w6(spark, sf_dir):
    from ..operators.writes import update_interest
    d = Domain(spark, sf_dir)
    e = T.load_table(spark, sf_dir, "events")
    own = d.ss.groupBy(F.col("student_id").alias("user_id")).agg(F.min("subject_id").alias("own"))
    batch = e.join(own, "user_id", "left").select(
        F.col("event_id").alias("batch_pos"), F.col("user_id").alias("student_id"), (F.col("event_id") % 50 != 7).alias("is_object"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id") * 13).otherwise(F.col("own")).cast("string").alias("subject_id"),
        F.get_json_object("props", "$.k").alias("interest"))
    return update_interest(d.ss, d.sub, batch)


@register("w6_update_interest_next", with_ctes("""
SELECT x.student_id, x.subject_id, coalesce(l.interest, x.interest) AS interest
FROM student_subject x LEFT JOIN last l ON x.student_id = l.student_id AND x.subject_id = l.subject_id""",
    "student_subject",
    extra=[("own", """SELECT o_custkey AS student_id, min(l_partkey) AS own FROM orders
                      JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""),
           ("last", """SELECT student_id, subject_id, arg_max(interest, event_id) AS interest FROM (
                         SELECT e.event_id, e.user_id AS student_id,
                                CASE WHEN e.event_id % 3 = 0 THEN user_id * 13 ELSE own.own END AS subject_id,
                                TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS interest
                         FROM events e LEFT JOIN own ON own.student_id = e.user_id WHERE e.event_id % 50 <> 7) q
                       WHERE interest BETWEEN 1 AND 5 GROUP BY 1, 2""")]))
def w6_update_interest_next(spark, sf_dir):
    return _w6(spark, sf_dir)[0]


@register("w9_insert_categories_log", with_ctes("""
SELECT b.batch_pos, b.name, coalesce(n.category_id, c.category_id) AS category_id,
       CASE WHEN c.category_id IS NULL AND b.batch_pos = f.first_pos THEN 'created' ELSE 'rejected' END AS action,
       CASE WHEN c.category_id IS NULL AND b.batch_pos = f.first_pos THEN NULL ELSE 'Category already exists' END AS reason
FROM batch b JOIN firsts f ON b.name = f.name
LEFT JOIN category c ON b.name = c.name
LEFT JOIN newc n ON b.name = n.name""", "category",
    extra=[("batch", """SELECT event_id AS batch_pos, CASE WHEN event_id % 2 = 0 THEN event_type
                                ELSE concat('Brand#', CAST(user_id AS VARCHAR)) END AS name FROM events"""),
           ("firsts", "SELECT name, min(batch_pos) AS first_pos FROM batch GROUP BY name"),
           ("newc", """SELECT f.name, coalesce((SELECT max(category_id) FROM category), 0)
                              + row_number() OVER (ORDER BY f.first_pos) AS category_id
                       FROM firsts f WHERE f.name NOT IN (SELECT name FROM category)""")]))
def w9_insert_categories_log(spark, sf_dir):
    from ..operators.writes import insert_new
    d = Domain(spark, sf_dir)
    e = T.load_table(spark, sf_dir, "events")
    batch = e.select(F.col("event_id").alias("batch_pos"),
                     F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
                      .otherwise(F.concat(F.lit("Brand#"), F.col("user_id").cast("string"))).alias("name"))
    _, log = insert_new(d.cat, batch, "name", "category_id", "Category already exists")
    return log


_W9_LOG = """
SELECT b.batch_pos, b.{key}, coalesce(t.{id}, n.new_id) AS {id},
       CASE WHEN n.new_id IS NOT NULL AND b.batch_pos = f.first_pos THEN 'created' ELSE 'rejected' END AS action,
       CASE WHEN b.missing THEN '{blank}' WHEN t.{id} IS NOT NULL OR b.batch_pos > f.first_pos THEN '{dup}'
            WHEN b.batch_pos = f.first_pos THEN NULL ELSE b.why END AS reason
FROM batch b LEFT JOIN firsts f ON b.{key} = f.{key} LEFT JOIN {table} t ON b.{key} = t.{name}
LEFT JOIN newk n ON b.{key} = n.{key}"""


def _w9_ctes(batch: str, key: str, table: str, name: str, id_: str) -> list:
    return [("batch", batch),
            ("firsts", f"SELECT {key}, min(batch_pos) AS first_pos FROM batch WHERE NOT missing AND why IS NULL GROUP BY 1"),
            ("newk", f"""SELECT f.{key}, (SELECT max({id_}) FROM {table}) + row_number() OVER (ORDER BY f.first_pos) AS new_id
                         FROM firsts f WHERE f.{key} NOT IN (SELECT {name} FROM {table} WHERE {name} IS NOT NULL)""")]


@register("w9_insert_subjects_log", with_ctes(
    _W9_LOG.format(key="name", id="subject_id", table="subject", name="name", blank="Name is required", dup="Subject already exists"),
    "subject", "category", extra=_w9_ctes("""
        SELECT e.batch_pos, e.name, e.name IS NULL OR trim(e.name) = '' AS missing,
               CASE WHEN coalesce(e.cid, 0) <> 0 AND e.cid NOT IN (SELECT category_id FROM category) THEN 'Category not found' END AS why
        FROM (SELECT event_id AS batch_pos, CASE event_id % 3 WHEN 1 THEN event_id % 70 WHEN 2 THEN 0 END AS cid,
                     CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN p.p_name || ' ' || p.p_partkey
                          ELSE 'New ' || user_id END AS name
              FROM events LEFT JOIN part p ON events.user_id = p.p_partkey) e""", "name", "subject", "name", "subject_id")))
def w9_insert_subjects_log(spark, sf_dir):
    from ..operators.writes import insert_subjects
    d = Domain(spark, sf_dir)
    e = d.table("events").join(d.sub.select(F.col("subject_id").alias("user_id"), F.col("name").alias("known")), "user_id", "left")
    k = F.col("event_id")
    batch = e.select(k.alias("batch_pos"),
                     F.when(k % 4 == 0, F.lit(" ")).when(k % 4 == 1, F.col("known"))
                      .otherwise(F.concat(F.lit("New "), F.col("user_id").cast("string"))).alias("name"),
                     F.when(k % 3 == 1, k % 70).when(k % 3 == 2, F.lit(0)).cast("bigint").alias("category_id"))
    return insert_subjects(d.sub, d.cat, batch)[1]


@register("w9_insert_students_log", with_ctes(
    _W9_LOG.format(key="username", id="student_id", table="student", name="username",
                   blank="Username and password are required", dup="Username already exists"),
    "student", extra=_w9_ctes("""
        SELECT event_id AS batch_pos, CASE WHEN event_id % 3 = 0 THEN c_name ELSE 'user' || user_id END AS username,
               (event_id % 3 = 0 AND c_name IS NULL) OR event_id % 5 = 0 AS missing, NULL AS why
        FROM events LEFT JOIN customer ON user_id = c_custkey""", "username", "student", "username", "student_id")))
def w9_insert_students_log(spark, sf_dir):
    from ..operators.writes import insert_students
    d = Domain(spark, sf_dir)
    e = d.table("events").join(d.stu.select(F.col("student_id").alias("user_id"), "username"), "user_id", "left")
    k = F.col("event_id")
    batch = e.select(k.alias("batch_pos"),
                     F.when(k % 3 == 0, F.col("username")).otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("username"),
                     F.when(k % 5 != 0, F.lit("secret")).alias("password"))
    return insert_students(d.stu, batch)[1]


@register("w12_delete_events_log", with_ctes("""
SELECT r.event_id, e.name, CAST(e.date AS VARCHAR) AS date,
       CASE WHEN e.event_id IS NULL THEN 'not_found' ELSE 'deleted' END AS action
FROM (SELECT DISTINCT user_id * 211 AS event_id FROM events) r LEFT JOIN event e ON r.event_id = e.event_id""",
    "event"))
def w12_delete_events_log(spark, sf_dir):
    from ..operators.writes import delete_events
    d = Domain(spark, sf_dir)
    ids = T.load_table(spark, sf_dir, "events").select((F.col("user_id") * 211).alias("event_id"))
    _, _, log = delete_events(d.ev, d.ec, ids)
    return log.select("event_id", "name", "date", "action")


@register("w12_delete_events_next", with_ctes("""
SELECT e.event_id, c.category_name FROM event e LEFT JOIN event_category c ON e.event_id = c.event_id
WHERE e.event_id NOT IN (SELECT user_id * 211 FROM events)""", "event", "event_category"))
def w12_delete_events_next(spark, sf_dir):
    """What is left of events and bridge, side by side."""
    from ..operators.writes import delete_events
    d = Domain(spark, sf_dir)
    ids = T.load_table(spark, sf_dir, "events").select((F.col("user_id") * 211).alias("event_id"))
    kept, bridge, _ = delete_events(d.ev, d.ec, ids)
    return kept.select("event_id").join(bridge, "event_id", "left")


@register("w13_purge_ended_next", with_ctes(f"""
SELECT event_id, CAST(date AS VARCHAR) AS date, time FROM undated
WHERE coalesce(NOT (date < DATE '{NOW[:10]}' OR (date = DATE '{NOW[:10]}' AND time < '{NOW[11:]}')), true)""",
    "event", extra=[("undated", """SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN date END AS date,
                                          CASE WHEN event_id % 10 <> 4 THEN time END AS time FROM event""")]))
def w13_purge_ended_next(spark, sf_dir):
    """Events kept, among them those without a date or without a time."""
    import datetime as dt

    from ..operators.writes import purge_ended
    d = Domain(spark, sf_dir)
    undated = d.ev.withColumn("date", F.when(F.col("event_id") % 10 != 3, F.col("date"))) \
                  .withColumn("time", F.when(F.col("event_id") % 10 != 4, F.col("time")))
    kept, _, _ = purge_ended(undated, d.ec, dt.datetime.fromisoformat(NOW))
    return kept.select("event_id", F.col("date").cast("string").alias("date"), "time")


@register("w13_purge_ended_summary", with_ctes(f"""
SELECT (SELECT count(*) FROM ended) AS deleted_count,
       (SELECT count(*) FROM event) - (SELECT count(*) FROM ended) AS kept_count,
       (SELECT count(*) FROM event_category WHERE event_id NOT IN (SELECT event_id FROM ended)) AS bridge_kept""",
    "event", "event_category",
    extra=[("ended", f"""SELECT event_id FROM event WHERE date < DATE '{NOW[:10]}'
                          OR (date = DATE '{NOW[:10]}' AND time < '{NOW[11:]}')""")]))
def w13_purge_ended_summary(spark, sf_dir):
    import datetime as dt

    from ..operators.writes import purge_ended
    d = Domain(spark, sf_dir)
    kept, next_ec, deleted = purge_ended(d.ev, d.ec, dt.datetime.fromisoformat(NOW))
    return deleted.agg(F.count(F.lit(1)).alias("deleted_count")) \
        .withColumn("kept_count", kept.agg(F.count(F.lit(1))).scalar()) \
        .withColumn("bridge_kept", next_ec.agg(F.count(F.lit(1))).scalar())


# ---------------------------------------------------------------------------------------
# More lookups and writes: R6, G5, J8, P14, W2, W4, W5, W8, W10, W14
# ---------------------------------------------------------------------------------------
from ..operators import prompts as PR  # noqa: E402


_R6_TOPICS = ("array_to_string(list_filter(list_concat([e.short_description], coalesce(c.cats, [])), "
              "lambda x: x IS NOT NULL AND x <> ''), ', ')")


@register("r6_event_detail", with_ctes(f"""
SELECT r.event_id AS request_id, r.user_id AS student_id, r.asked AS event_id, e.name, CAST(e.date AS VARCHAR) AS date,
       substr(e.time, 1, 5) AS time, CASE WHEN e.name IS NOT NULL THEN {_R6_TOPICS} END AS topics,
       CASE WHEN e.name IS NOT NULL THEN coalesce(s.s, {_lit(PR.NO_SUBJECTS_TEXT)}) END AS student_subjects,
       CASE WHEN e.name IS NOT NULL THEN {PR.prompt_sql(PR.EXPLAIN_TEMPLATE, name='e.name', topics=_R6_TOPICS,
                                                        subjects=f"coalesce(s.s, {_lit(PR.NO_SUBJECTS_TEXT)})")} END AS prompt,
       CASE WHEN e.name IS NULL THEN 'Event not found' END AS error
FROM (SELECT *, user_id * 101 + event_id % 7 AS asked FROM events) r LEFT JOIN event e ON r.asked = e.event_id
LEFT JOIN cats c ON r.asked = c.event_id LEFT JOIN subj s ON r.user_id = s.student_id""",
    "event", "event_category", "student_subject", "subject",
    extra=[("cats", "SELECT event_id, list_sort(list(DISTINCT category_name)) AS cats FROM event_category GROUP BY 1"),
           ("subj", """SELECT ss.student_id, array_to_string(list_sort(list(s.name)), ', ') AS s
                       FROM student_subject ss JOIN subject s ON ss.subject_id = s.subject_id GROUP BY 1""")]))
def r6_event_detail(spark, sf_dir):
    from .listing import event_detail
    d = Domain(spark, sf_dir)
    requests = T.load_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("student_id"),
        (F.col("user_id") * 101 + F.col("event_id") % 7).alias("event_id"))
    return event_detail(d.ev, d.ec, d.ss, d.sub, requests)


@register("g5_categories_used", with_ctes(
    "SELECT student_id, array_to_string(list_sort(list(category_key)), ', ') AS categories_used FROM interest GROUP BY 1",
    "interest"))
def g5_categories_used(spark, sf_dir):
    from ..operators.aggregates import categories_used
    from .recommend import student_category_interest
    d = Domain(spark, sf_dir)
    return categories_used(student_category_interest(d.ss, d.sub, d.cat)).select(
        "student_id", F.array_join("categories_used", ", ").alias("categories_used"))


@register("j8_resolve_names", _M2_SQL + f""",
subj AS (SELECT lower({O.trim_ws('name')}) AS k, min(subject_id) AS subject_id FROM (
           SELECT p_partkey AS subject_id, concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS name FROM part) z GROUP BY 1)
SELECT n.prompt_id, n.pos, n.name, s.subject_id FROM names n LEFT JOIN subj s ON lower({O.trim_ws('n.name')}) = s.k""")
def j8_resolve_names(spark, sf_dir):
    from ..operators.joins import resolve_names
    from ..operators.responses import response_subjects
    d = Domain(spark, sf_dir)
    return resolve_names(response_subjects(RS.subject_responses(spark, sf_dir)), d.sub) \
        .select("prompt_id", "pos", "name", "subject_id")


@register("p14_validate_requests", f"""
SELECT request_id, url,
       CASE WHEN fs IS NULL OR ts IS NULL THEN 'Fields ''fromSemester'' and ''toSemester'' are required.'
            WHEN TRY_CAST(fs AS INTEGER) IS NULL OR TRY_CAST(ts AS INTEGER) IS NULL THEN 'fromSemester and toSemester must be numbers.'
            WHEN TRY_CAST(fs AS INTEGER) < 1 OR TRY_CAST(ts AS INTEGER) < 1 THEN 'fromSemester and toSemester must be at least 1.'
            WHEN TRY_CAST(fs AS INTEGER) > 8 OR TRY_CAST(ts AS INTEGER) > 8 THEN 'fromSemester and toSemester must be at most 8.'
            WHEN TRY_CAST(fs AS INTEGER) > TRY_CAST(ts AS INTEGER) THEN 'fromSemester cannot be greater than toSemester.'
            WHEN url = '' THEN 'Field ''url'' is required.'
            WHEN NOT (starts_with(url, 'http://') OR starts_with(url, 'https://')) THEN 'URL must start with http:// or https://.'
       END AS reason
FROM (SELECT page_id AS request_id,
             CASE WHEN page_id % 7 = 3 THEN replace(url, 'http', 'ftp') ELSE url END AS url,
             CASE WHEN page_id % 13 = 5 THEN NULL WHEN page_id % 17 = 2 THEN 'one'
                  ELSE CAST(page_id % 10 - 1 AS VARCHAR) END AS fs,
             CAST((page_id * 7) % 10 AS VARCHAR) AS ts FROM pages) r""")
def p14_validate_requests(spark, sf_dir):
    from ..operators.pages import validate_semesters, validate_urls
    pg = T.load_table(spark, sf_dir, "pages")
    k = F.col("page_id")
    req = pg.select(k.alias("request_id"),
                    F.when(k % 7 == 3, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url")).alias("url"),
                    F.when(k % 13 == 5, F.lit(None).cast("string")).when(k % 17 == 2, F.lit("one"))
                     .otherwise((k % 10 - 1).cast("string")).alias("from_semester"),
                    ((k * 7) % 10).cast("string").alias("to_semester"))
    ok, bad_sem = validate_semesters(req)
    ok2, bad_url = validate_urls(ok)
    return ok2.select("request_id", "url", F.lit(None).cast("string").alias("reason")) \
        .unionByName(bad_sem.select("request_id", "url", "reason")) \
        .unionByName(bad_url.select("request_id", "url", "reason"))


_W2_ITEMS = _R9_CTES[:4]


@register("w2_validate_events_strict", with_ctes(f"""
SELECT prompt_id,
  CASE WHEN {O.trim_ws("coalesce(raw_name, '')")} = '' THEN 'Event title must not be empty'
       WHEN NOT regexp_matches({O.trim_ws("coalesce(raw_date, '')")}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
            OR try_strptime({O.trim_ws("coalesce(raw_date, '')")}, '%Y-%m-%d') IS NULL THEN 'Event date must be in YYYY-MM-DD format'
       WHEN NOT regexp_matches({O.trim_ws("coalesce(raw_time, '')")}, '^([01]\\d|2[0-3]):[0-5]\\d$') THEN 'Event time must be in HH:mm format'
       WHEN len(list_filter(list_transform(raw_cats, lambda x: {O.trim_ws("coalesce(json_extract_string(x, '$'), '')")}), lambda x: x <> '')) < 1
            THEN 'Event must have at least one category'
       WHEN length({O.trim_ws("coalesce(raw_desc, '')")}) < 10 THEN 'Event description must be at least 10 characters long'
       WHEN NOT regexp_matches({O.trim_ws("coalesce(raw_price, '')")}, '^\\d+(\\.\\d{{1,2}})?$')
            THEN 'Event price must be a decimal number with up to 2 decimal places'
  END AS error
FROM items""", extra=_W2_ITEMS))
def w2_validate_events_strict(spark, sf_dir):
    from ..operators.events import validate_events
    from ..operators.responses import response_events
    items, _ = response_events(RS.event_responses(spark, sf_dir))
    return validate_events(items, strict=True).select("prompt_id", "error")


_W4_CTES = [("asg", """SELECT event_id AS batch_pos, user_id * 211 AS target,
                              CASE WHEN value > 50 THEN [event_type, concat(' ', event_type, ' ')] ELSE [] END AS cats
                       FROM events"""),
            ("clean", f"""SELECT batch_pos, target, list_filter(list_transform(cats, lambda x: {O.trim_ws('x')}),
                                                              lambda x: x <> '') AS cats FROM asg"""),
            ("lastne", """SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY target ORDER BY batch_pos DESC) AS rn
                                         FROM clean c WHERE len(cats) > 0) z WHERE rn = 1""")]


@register("w4_set_event_categories", with_ctes("""
SELECT event_id, category_name FROM event_category WHERE event_id NOT IN (SELECT target FROM lastne)
UNION
SELECT target, unnest(cats) FROM lastne""", "event_category", extra=_W4_CTES))
def w4_set_event_categories(spark, sf_dir):
    from ..operators.writes import set_event_categories
    d = Domain(spark, sf_dir)
    e = T.load_table(spark, sf_dir, "events")
    asg = e.select(F.col("event_id").alias("batch_pos"), (F.col("user_id") * 211).alias("event_id"),
                   F.when(F.col("value") > 50, F.array("event_type", F.concat(F.lit(" "), "event_type", F.lit(" "))))
                    .otherwise(F.array().cast("array<string>")).alias("categories"))
    nxt, _ = set_event_categories(d.ec, d.cat, asg)
    return nxt


@register("w5_upsert_interest_log", with_ctes("""
SELECT b.batch_pos, b.student_id, b.subject_id, TRY_CAST(b.interest AS INTEGER) AS interest,
       CASE WHEN b.reason IS NOT NULL THEN 'rejected'
            WHEN x.student_id IS NULL AND b.batch_pos = f.first_pos THEN 'created' ELSE 'updated' END AS action,
       b.reason
FROM (SELECT b.*, CASE WHEN b.subject_id IS NULL OR b.interest IS NULL OR b.interest IN ('0', '')
                           THEN 'subject_id and interest are required'
                       WHEN TRY_CAST(b.interest AS INTEGER) IS NULL THEN 'Interest must be a number'
                       WHEN TRY_CAST(b.interest AS INTEGER) NOT BETWEEN 1 AND 5 THEN 'Interest must be between 1 and 5'
                       WHEN s.subject_id IS NULL THEN 'Subject not found' END AS reason
      FROM batch b LEFT JOIN subject s ON b.subject_id = s.subject_id) b
LEFT JOIN student_subject x ON b.student_id = x.student_id AND b.subject_id = x.subject_id
LEFT JOIN (SELECT student_id, subject_id, min(batch_pos) AS first_pos FROM batch b2
           WHERE TRY_CAST(interest AS INTEGER) BETWEEN 1 AND 5 AND subject_id IN (SELECT subject_id FROM subject)
           GROUP BY 1, 2) f ON b.student_id = f.student_id AND b.subject_id = f.subject_id""",
    "subject", "student_subject",
    extra=[("batch", """SELECT event_id AS batch_pos, user_id AS student_id, (event_id % 3000) AS subject_id,
                               json_extract_string(props, '$.k') AS interest FROM events""")]))
def w5_upsert_interest_log(spark, sf_dir):
    return _w5(spark, sf_dir)[1]


def _w5(spark, sf_dir):
    from ..operators.writes import upsert_interest
    d = Domain(spark, sf_dir)
    e = T.load_table(spark, sf_dir, "events")
    batch = e.select(F.col("event_id").alias("batch_pos"), F.col("user_id").alias("student_id"),
                     (F.col("event_id") % 3000).alias("subject_id"),
                     F.get_json_object("props", "$.k").alias("interest"))
    return upsert_interest(d.ss, d.sub, batch)


@register("w5_upsert_interest_next", with_ctes("""
SELECT coalesce(l.student_id, x.student_id) AS student_id, coalesce(l.subject_id, x.subject_id) AS subject_id,
       coalesce(l.interest, x.interest) AS interest
FROM student_subject x FULL JOIN last l ON x.student_id = l.student_id AND x.subject_id = l.subject_id""",
    "subject", "student_subject",
    extra=[("last", """SELECT user_id AS student_id, event_id % 3000 AS subject_id,
                              arg_max(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), event_id) AS interest
                       FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 1 AND 5
                         AND event_id % 3000 IN (SELECT subject_id FROM subject) GROUP BY 1, 2""")]))
def w5_upsert_interest_next(spark, sf_dir):
    return _w5(spark, sf_dir)[0]


@register("w14_delete_cascade_counts", with_ctes("""
SELECT (SELECT count(*) FROM category WHERE category_id NOT IN (SELECT id FROM del)) AS categories,
       (SELECT count(*) FROM subject WHERE category_id IS NULL OR category_id NOT IN (SELECT id FROM del)) AS subjects,
       (SELECT count(*) FROM student_subject WHERE subject_id NOT IN (
            SELECT subject_id FROM subject WHERE category_id IN (SELECT id FROM del))
          AND student_id NOT IN (SELECT sid FROM dels)) AS ratings,
       (SELECT count(*) FROM student WHERE student_id NOT IN (SELECT sid FROM dels)) AS students,
       (SELECT count(*) FROM bridge WHERE category_name NOT IN (
            SELECT name FROM category WHERE category_id IN (SELECT id FROM del))) AS bridge_rows""",
    "category", "subject", "student_subject", "student", "event_category",
    extra=[("del", "SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error'"),
           ("dels", "SELECT DISTINCT user_id * 3 AS sid FROM events WHERE event_type = 'purchase'"),
           ("bridge", "SELECT event_id, upper(trim(category_name)) AS category_name FROM event_category")]))
def w14_delete_cascade_counts(spark, sf_dir):
    from ..operators.writes import delete_cascade
    d = Domain(spark, sf_dir)
    e = T.load_table(spark, sf_dir, "events")
    cids = e.where(F.col("event_type") == "error").select(F.col("user_id").alias("category_id"))
    sids = e.where(F.col("event_type") == "purchase").select((F.col("user_id") * 3).alias("student_id"))
    bridge = d.ec.withColumn("category_name", F.upper(F.trim("category_name")))
    out = delete_cascade({"category": d.cat, "subject": d.sub, "student_subject": d.ss, "student": d.stu,
                          "event_category": bridge},
                         category_ids=cids, student_ids=sids)
    cnt = {k: v.agg(F.count(F.lit(1))).scalar() for k, v in out.items()}
    return out["category"].agg(F.count(F.lit(1)).alias("categories")) \
        .withColumn("subjects", cnt["subject"]).withColumn("ratings", cnt["student_subject"]) \
        .withColumn("students", cnt["student"]).withColumn("bridge_rows", cnt["event_category"])


# ---------------------------------------------------------------------------------------
# M6 single-page form, J7, J10, F9 + S4
# ---------------------------------------------------------------------------------------
@register("m6_page_event_items", f"""
WITH resp AS ({RS.PAGE_EVENT_RESPONSES_SQL}),
f AS (SELECT prompt_id, url, {O.fence_sql('response')} AS s FROM resp),
v AS (SELECT prompt_id, url, {O.recover_sql('s')} AS j FROM f),
arr AS (SELECT prompt_id, url, json_extract(j, '$.events[*]') AS items FROM v
        WHERE j IS NOT NULL AND json_type(j) = 'OBJECT' AND json_type(j, '$.events') = 'ARRAY'),
ex AS (SELECT prompt_id, url, CAST(e.pos AS INTEGER) AS item_pos, e.it AS it FROM (
         SELECT prompt_id, url, unnest(list_transform(items, lambda x, i: struct_pack(pos := i - 1, it := x))) AS e
         FROM arr) q)
SELECT prompt_id, url, item_pos, json_extract_string(it, '$.name') AS name,
       CAST({O.date_sql("json_extract_string(it, '$.date')", AS_OF_YEAR)} AS VARCHAR) AS date,
       substr(coalesce({O.time_sql("json_extract_string(it, '$.time')")}, '00:00:00'), 1, 5) AS time,
       CAST({O.price_sql("json_extract_string(it, '$.price')")} AS VARCHAR) AS price,
       CAST(NULL AS VARCHAR) AS error
FROM ex WHERE json_type(it) = 'OBJECT'
UNION ALL
SELECT prompt_id, url, NULL, NULL, NULL, NULL, NULL, 'Could not parse events JSON from model output.'
FROM v WHERE j IS NULL OR json_type(j) <> 'OBJECT' OR coalesce(json_type(j, '$.events'), '') <> 'ARRAY'""")
def m6_page_event_items(spark, sf_dir):
    from ..functions.standardize import (price_text, standardize_price, standardize_time, time_hhmm,
                                         with_standard_date)
    from ..operators.responses import response_events
    items, bad = response_events(RS.page_event_responses(spark, sf_dir), per_link=False)
    std = with_standard_date(items, "raw_date", "date", AS_OF_YEAR)
    ok = std.select("prompt_id", "url", "item_pos", F.col("raw_name").alias("name"),
                    F.col("date").cast("string").alias("date"),
                    time_hhmm(F.coalesce(standardize_time(F.col("raw_time")), F.lit("00:00:00"))).alias("time"),
                    price_text(standardize_price(F.col("raw_price"))).alias("price"),
                    F.lit(None).cast("string").alias("error"))
    fail = bad.select("prompt_id", "url", F.lit(None).cast("int").alias("item_pos"),
                      *[F.lit(None).cast("string").alias(c) for c in ("name", "date", "time", "price")], "error")
    return ok.unionByName(fail)


@register("j7_attach_ratings", _M2_SQL + f""",
ratings AS (SELECT ss.student_id, concat(p.p_name, ' ', CAST(p.p_partkey AS VARCHAR)) AS name, ss.interest
            FROM (SELECT o_custkey AS student_id, l_partkey AS subject_id,
                         CAST(CASE WHEN max(l_linenumber) <= 5 THEN max(l_linenumber) END AS INTEGER) AS interest
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) ss
            JOIN part p ON ss.subject_id = p.p_partkey)
SELECT n.prompt_id, n.pos, n.name, coalesce(r.interest, 0) AS interest
FROM names n LEFT JOIN orders o ON n.prompt_id = o.o_orderkey LEFT JOIN ratings r ON n.name = r.name AND o.o_custkey = r.student_id""")
def j7_attach_ratings(spark, sf_dir):
    from ..operators.joins import attach_ratings
    from ..operators.responses import response_subjects
    d = Domain(spark, sf_dir)
    # each reply belongs to the student whose order it was made from
    ratings = d.ss.join(d.sub.select("subject_id", "name"), "subject_id") \
        .select("student_id", "name", "interest", F.col("subject_id").alias("pos"))
    asked = d.table("orders").select(F.col("o_orderkey").alias("prompt_id"), F.col("o_custkey").alias("student_id"))
    names = response_subjects(RS.subject_responses(spark, sf_dir)).join(asked, "prompt_id", "left")
    return attach_ratings(names, ratings) \
        .select("prompt_id", "pos", "name", F.col("interest").cast("int").alias("interest"))


@register("j10_check_refs", with_ctes("""
SELECT event_id AS batch_pos, user_id * 13 AS subject_id,
       CASE WHEN user_id * 13 IN (SELECT subject_id FROM subject) THEN 'ok' ELSE 'Subject not found' END AS status
FROM events""", "subject"))
def j10_check_refs(spark, sf_dir):
    from ..operators.joins import check_refs
    d = Domain(spark, sf_dir)
    batch = T.load_table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_pos"),
                                                        (F.col("user_id") * 13).alias("subject_id"))
    ok, failed = check_refs(batch, d.sub, "subject_id", reason="Subject not found")
    return ok.withColumn("status", F.lit("ok")).unionByName(failed.withColumnRenamed("reason", "status"))


_REG_SQL = """SELECT concat('https://', event_type, '.example.com/e/', CAST(user_id AS VARCHAR), '/') AS url,
                     event_type AS source, CASE WHEN user_id % 2 = 0 THEN 'Vilnius' ELSE 'Kaunas' END AS city,
                     max(ts) AS last_seen, bool_or(value < 90) AS is_active
              FROM events GROUP BY 1, 2, 3"""


@register("s4_saved_urls_top", f"""
WITH reg AS ({_REG_SQL})
SELECT source, city, url, CAST(rn AS INTEGER) AS url_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lower(city) ORDER BY last_seen DESC, url) AS rn
  FROM reg WHERE is_active) z WHERE rn <= 5""")
def s4_saved_urls_top(spark, sf_dir):
    from pyspark.sql import Window

    from .scrape import saved_urls_top
    w = saved_urls_top(_registry(spark, sf_dir), 5)
    r = Window.partitionBy("source", F.lower("city")).orderBy(F.col("last_seen").desc(), F.col("url"))
    return w.withColumn("url_rank", F.row_number().over(r)).select("source", "city", "url", "url_rank")


def _registry(spark, sf_dir):
    """URL registry derived from the events table."""
    e = T.load_table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("https://"), "event_type", F.lit(".example.com/e/"),
                             F.col("user_id").cast("string"), F.lit("/")).alias("url"),
                    F.col("event_type").alias("source"),
                    F.when(F.col("user_id") % 2 == 0, F.lit("Vilnius")).otherwise(F.lit("Kaunas")).alias("city")) \
        .agg(F.max("ts").alias("last_seen"), F.bool_or(F.col("value") < 90).alias("is_active"))


@register("w11_touch_urls", f"""
WITH reg AS ({_REG_SQL}),
done AS (SELECT DISTINCT concat('https://', event_type, '.example.com/e/', CAST(user_id AS VARCHAR), '/') AS url
         FROM events WHERE value > 99 UNION SELECT 'https://not.registered/')
SELECT url, source, city, is_active, CASE WHEN url IN (SELECT url FROM done) THEN '2026-01-01 00:00:00' END AS last_scraped
FROM reg""")
def w11_touch_urls(spark, sf_dir):
    """W11 over the whole registry; parsed links that are not registered change nothing."""
    import datetime as dt

    from ..operators.writes import touch_urls
    e = T.load_table(spark, sf_dir, "events")
    done = e.where("value > 99").select(F.concat(F.lit("https://"), "event_type", F.lit(".example.com/e/"),
                                                 F.col("user_id").cast("string"), F.lit("/")).alias("url"))
    done = done.union(done.select(F.lit("https://not.registered/")))
    urls = _registry(spark, sf_dir).withColumn("last_scraped", F.lit(None).cast("timestamp"))
    return touch_urls(urls, done, dt.datetime(2026, 1, 1)).select(
        "url", "source", "city", "is_active", F.date_format("last_scraped", "yyyy-MM-dd HH:mm:ss").alias("last_scraped"))


@register("w10_upsert_urls_known", f"""
WITH reg AS ({_REG_SQL}),
found AS (SELECT url, arg_max(source, event_id) AS source FROM (
            SELECT CASE WHEN event_id % 2 = 0 THEN concat('https://', event_type, '.example.com/e/', CAST(user_id AS VARCHAR), '/')
                        ELSE concat('https://new.example.com/', CAST(user_id AS VARCHAR), '/') END AS url, 'seen ' || event_type AS source, event_id
            FROM events) q GROUP BY url)
SELECT coalesce(f.url, r.url) AS url, coalesce(f.source, r.source) AS source, CASE WHEN f.url IS NULL THEN r.city ELSE '' END AS city,
       f.url IS NOT NULL OR r.is_active AS is_active
FROM reg r FULL JOIN found f ON r.url = f.url""")
def w10_upsert_urls_known(spark, sf_dir):
    """W10 where most links are registered already: updated, added and untouched rows."""
    import datetime as dt

    from ..operators.writes import upsert_urls
    e = T.load_table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    links = e.select(F.col("event_id").alias("pos"),
                     F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://"), "event_type", F.lit(".example.com/e/"), user, F.lit("/")))
                      .otherwise(F.concat(F.lit("https://new.example.com/"), user, F.lit("/"))).alias("url"),
                     F.concat(F.lit("seen "), "event_type").alias("source"), F.lit("").alias("city"))
    urls = _registry(spark, sf_dir).withColumn("last_scraped", F.lit(None).cast("timestamp"))
    return upsert_urls(urls, links, dt.datetime(2026, 1, 1)).select("url", "source", "city", "is_active")


# ---------------------------------------------------------------------------------------
# R8 over listing pages of the three sites (P6-P8, P11, P12), made from the pages table:
# every fifth page has no event link and falls back to saved URLs, or is rejected
# ---------------------------------------------------------------------------------------
_SITE_PAGES = """
    SELECT page_id, k, CAST(page_id AS VARCHAR) AS id, page_id % 5 = 0 AS bare,
           CASE k WHEN 0 THEN 'https://www.litexpo.lt/en/events/?page=' || page_id
                  WHEN 1 THEN 'https://www.meetup.com/find/?' || CASE WHEN page_id % 8 = 1 THEN 'location=lt--Vilnius&n=' ELSE 'n=' END || page_id
                  WHEN 2 THEN 'https://www.kaveikti.lt/renginiai/?p=' || page_id ELSE url END AS url
    FROM (SELECT *, page_id % 4 AS k FROM pages) p"""
_SITE_SAVED = """
    SELECT concat('https://saved.example.com/', event_type, '/', CAST(user_id AS VARCHAR), '/') AS url,
           CASE WHEN user_id % 3 = 0 THEN 'litexpo' WHEN user_id % 3 = 1 THEN 'meetup' ELSE 'none' END AS source,
           CASE WHEN user_id % 2 = 0 THEN 'Vilnius' ELSE 'Kaunas' END AS city, max(ts) AS last_seen, bool_or(value < 60) AS is_active
    FROM events GROUP BY ALL"""


@register("r8_site_frontier", f"""
WITH sp AS ({_SITE_PAGES}), saved AS ({_SITE_SAVED}),
routed AS (SELECT page_id, id, bare, k, CASE k WHEN 0 THEN 'litexpo' WHEN 1 THEN 'meetup' WHEN 2 THEN 'kaveikti' ELSE 'other' END AS source,
                  CASE WHEN k = 1 AND page_id % 8 = 1 THEN 'Vilnius' ELSE '' END AS city FROM sp),
found AS (SELECT page_id, source, city, j AS link_rank, 'found' AS origin,
                 CASE k WHEN 0 THEN 'https://www.litexpo.lt/en/events/e' || id || '-' || j || '/'
                        WHEN 1 THEN 'https://www.meetup.com/g/events/' || id || j || '/'
                        ELSE 'https://www.kaveikti.lt/Renginys/' || id || '-' || j || '/' END AS link
          FROM routed, (SELECT unnest([1, 2, 3]) AS j) WHERE k < 3 AND NOT bare),
offered AS (SELECT r.page_id, r.source, r.city, s.url AS link,
                   row_number() OVER (PARTITION BY r.page_id ORDER BY s.last_seen DESC, s.url) AS link_rank
            FROM routed r JOIN saved s ON r.source = s.source AND s.is_active AND (r.city = '' OR lower(r.city) = lower(s.city))
            WHERE r.bare AND r.k < 3)
SELECT page_id, source, city, link, CAST(link_rank AS INTEGER) AS link_rank, origin, CAST(NULL AS VARCHAR) AS error FROM found
UNION ALL SELECT page_id, source, city, link, CAST(link_rank AS INTEGER), 'saved', NULL FROM offered WHERE link_rank <= {R8_N}
UNION ALL SELECT page_id, source, city, NULL, NULL, NULL,
       'No event links found for source ''' || source || ''' and no saved links are available.'
FROM routed WHERE k < 3 AND bare AND page_id NOT IN (SELECT page_id FROM offered)""")
def r8_site_frontier(spark, sf_dir):
    import datetime as dt

    from ..operators.pages import SITE_RULES, rules_frame
    from .scrape import link_frontier, route_pages
    p = T.load_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("own_url"))
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = (F.when(k == 0, F.concat(F.lit("https://www.litexpo.lt/en/events/?page="), i))
            .when((k == 1) & (F.col("page_id") % 8 == 1), F.concat(F.lit("https://www.meetup.com/find/?location=lt--Vilnius&n="), i))
            .when(k == 1, F.concat(F.lit("https://www.meetup.com/find/?n="), i))
            .when(k == 2, F.concat(F.lit("https://www.kaveikti.lt/renginiai/?p="), i)).otherwise(F.col("own_url")))

    def anchors(template: str) -> list:
        """Three event links, the second one twice."""
        return [F.replace(F.lit(template.replace("#", str(j))), F.lit("ID"), i) for j in (1, 2, 2, 3)]

    event = (F.when(k == 0, F.concat(*anchors('<li><a class=x href="/en/events/eID-#/?utm=1">E</a>')))
              .when(k == 1, F.concat(*anchors("<li><a href='https://www.meetup.com/g/events/ID#/?top=1'>E</a>")))
              .otherwise(F.concat(*anchors('<li><a data-href="/no" href=../Renginys/ID-#>E</a>'))))
    html = F.concat(F.lit('<ul><li><a href="https://www.litexpo.lt/en/events/">all</a><li><a href="/find/events/x/">f</a><li><a href="/renginiai/">r</a><li><a href="/about">a</a>'),
                    F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(event), F.lit("</ul>"))
    listing = p.select("page_id", url.alias("url"), html.alias("html"))
    e = T.load_table(spark, sf_dir, "events")
    user = F.col("user_id")
    saved = e.groupBy(
        F.concat(F.lit("https://saved.example.com/"), "event_type", F.lit("/"), user.cast("string"), F.lit("/")).alias("url"),
        F.when(user % 3 == 0, F.lit("litexpo")).when(user % 3 == 1, F.lit("meetup")).otherwise(F.lit("none")).alias("source"),
        F.when(user % 2 == 0, F.lit("Vilnius")).otherwise(F.lit("Kaunas")).alias("city"),
    ).agg(F.max("ts").alias("last_seen"), F.bool_or(F.col("value") < 60).alias("is_active")) \
        .withColumn("last_scraped", F.lit(None).cast("timestamp"))
    frontier, _, rejected = link_frontier(route_pages(listing), saved, rules_frame(spark, SITE_RULES), dt.datetime(2026, 1, 1), R8_N)
    columns = ["page_id", "source", "city", "link", "link_rank", "origin", "error"]
    return frontier.withColumn("error", F.lit(None).cast("string")).select(*columns).unionByName(
        rejected.select("page_id", "source", "city", "error"), allowMissingColumns=True).select(*columns)


# ---------------------------------------------------------------------------------------
# W8 (import then assign to a student) and W10 (URL registry from the frontier)
# ---------------------------------------------------------------------------------------


def _r11_ctes():
    return [("resp", RS.CATEGORY_RESPONSES_SQL),
            ("m5x", "WITH " + _M5_CTE + " SELECT * FROM m5"),
            ("ok", "SELECT prompt_id, subject, category FROM m5x WHERE error IS NULL"),
            ("subf", "SELECT lower(name) AS sk, min(subject_id) AS subject_id FROM subject GROUP BY 1"),
            ("new_sub", """SELECT lower(subject) AS sk, coalesce((SELECT max(subject_id) FROM subject), 0)
                               + row_number() OVER (ORDER BY min(prompt_id)) AS subject_id
                           FROM ok WHERE lower(subject) NOT IN (SELECT sk FROM subf) GROUP BY 1"""),
            ("ids", """SELECT DISTINCT r.o_custkey AS student_id, coalesce(sf.subject_id, ns.subject_id) AS subject_id FROM ok o
                       JOIN orders r ON r.o_orderkey = o.prompt_id LEFT JOIN subf sf ON lower(o.subject) = sf.sk LEFT JOIN new_sub ns ON lower(o.subject) = ns.sk""")]


@register("w8_assign_subjects", with_ctes("""
SELECT i.student_id, i.subject_id, CASE WHEN m.subject_id IS NULL THEN 'created' ELSE 'existing' END AS assignment_action
FROM ids i LEFT JOIN student_subject m ON i.subject_id = m.subject_id AND i.student_id = m.student_id""", "subject", "student_subject", extra=_r11_ctes()))
def w8_assign_subjects(spark, sf_dir):
    from ..operators.writes import assign_to_students
    from .scrape import assign_subjects
    d = Domain(spark, sf_dir)
    _, _, log, _ = assign_subjects(d.sub, d.cat, RS.category_responses(spark, sf_dir))
    # each reply belongs to the student whose order has its number
    asked = d.table("orders").select(F.col("o_orderkey").alias("batch_pos"), F.col("o_custkey").alias("student_id"))
    _, alog = assign_to_students(d.ss, log.join(asked, "batch_pos"))
    return alog


@register("w10_upsert_urls", _R8_SQL.split("\n    SELECT page_id, source, link, link_rank, 'found'")[0] + f"""
    SELECT link AS url, arg_max(source, page_id) AS source, '' AS city,
           '2026-01-01 00:00:00' AS last_seen, CAST(NULL AS VARCHAR) AS last_scraped, true AS is_active
    FROM ranked WHERE link_rank <= {R8_N} GROUP BY link""")
def w10_upsert_urls(spark, sf_dir):
    import datetime as dt

    from ..operators.pages import rules_frame
    from ..operators.writes import URL_COLS
    from .scrape import link_frontier
    pages = T.load_table(spark, sf_dir, "pages")
    routed = pages.withColumn("source", F.concat(F.lit("local-"), F.regexp_extract(
        F.regexp_extract("url", O.HOST_RE, 1), r"([^.]*)$", 1))).withColumn("city", F.lit(""))
    urls = spark.createDataFrame([], "url string, source string, city string, last_seen timestamp, "
                                     "last_scraped timestamp, is_active boolean").select(*URL_COLS)
    _, nxt, _ = link_frontier(routed, urls, rules_frame(spark, _local_rules()), dt.datetime(2026, 1, 1), R8_N)
    # timestamps as text so the comparison does not depend on the session time zone
    return nxt.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss")) \
              .withColumn("last_scraped", F.date_format("last_scraped", "yyyy-MM-dd HH:mm:ss"))


_RAW = {f: O.trim_ws(f"coalesce(raw_{f}, '')") for f in ("name", "date", "place", "price")}
_PRICE_OR_ZERO = f"CASE WHEN {_RAW['price']} <> '' THEN {_RAW['price']} ELSE '0' END"
_W2_BASIC_SQL = with_ctes(f"""
SELECT prompt_id,
  CASE WHEN {_RAW['name']} = '' THEN '''name'' is required.'
       WHEN {_RAW['date']} = '' THEN '''date'' is required (YYYY-MM-DD).'
       WHEN {_RAW['place']} = '' THEN '''place'' is required.'
       WHEN {O.date_sql(_RAW['date'], 2000)} IS NULL THEN 'Invalid ''date'' format. Use YYYY-MM-DD.'
       WHEN {O.price_sql(_PRICE_OR_ZERO)} IS NULL THEN 'Invalid ''price'' value.'
  END AS error
FROM items""", extra=_W2_ITEMS)


@register("w2_validate_events_basic", _W2_BASIC_SQL)
def w2_validate_events_basic(spark, sf_dir):
    from ..operators.events import validate_events
    from ..operators.responses import response_events
    items, _ = response_events(RS.event_responses(spark, sf_dir))
    return validate_events(items, strict=False).select("prompt_id", "error")


_REQ_SQL = """SELECT page_id AS request_id,
                     CASE WHEN page_id % 7 = 3 THEN replace(url, 'http', 'ftp') ELSE url END AS url,
                     CASE WHEN page_id % 13 = 5 THEN NULL WHEN page_id % 17 = 2 THEN 'one'
                          ELSE CAST(page_id % 10 - 1 AS VARCHAR) END AS fs,
                     CAST((page_id * 7) % 10 AS VARCHAR) AS ts FROM pages"""


def _requests(spark, sf_dir):
    pg = T.load_table(spark, sf_dir, "pages")
    k = F.col("page_id")
    return pg.select(k.alias("request_id"),
                     F.when(k % 7 == 3, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url")).alias("url"),
                     F.when(k % 13 == 5, F.lit(None).cast("string")).when(k % 17 == 2, F.lit("one"))
                      .otherwise((k % 10 - 1).cast("string")).alias("from_semester"),
                     ((k * 7) % 10).cast("string").alias("to_semester"))


@register("p15_category_prompts", with_ctes(
    f"SELECT subject_id, name, {PR.prompt_sql(PR.CATEGORY_TEMPLATE, subject='name')} AS prompt FROM subject", "subject"))
def p15_category_prompts(spark, sf_dir):
    from .scrape import category_prompts
    return category_prompts(Domain(spark, sf_dir).sub)


_SITE_PROMPT_ARGS = dict(detail_url="url", detail_text="text", city_hint="CASE WHEN city = '' THEN 'Vilnius' ELSE city END")


@register("p15_site_prompts", f"""
    SELECT page_id, url, source, city, CASE source {' '.join(
        f"WHEN '{site}' THEN {PR.prompt_sql(template, **_SITE_PROMPT_ARGS)}" for site, template in PR.EVENT_TEMPLATES.items())} END AS prompt
    FROM (SELECT page_id, {O.page_text_sql('html')} AS text,
                 CASE page_id % 4 WHEN 0 THEN 'litexpo' WHEN 1 THEN 'meetup' WHEN 2 THEN 'kaveikti' ELSE 'other' END AS source,
                 CASE page_id % 8 WHEN 1 THEN 'Vilnius' WHEN 5 THEN 'Kaunas' ELSE '' END AS city,
                 CASE page_id % 4 WHEN 0 THEN 'https://www.litexpo.lt/en/events/?page=' || page_id
                                  WHEN 1 THEN 'https://www.meetup.com/find/?location=lt--' || CASE page_id % 8 WHEN 1 THEN 'Vilnius' ELSE 'Kaunas' END || '&n=' || page_id
                                  WHEN 2 THEN 'https://www.kaveikti.lt/renginiai/?p=' || page_id ELSE url END AS url
          FROM pages) p""")
def p15_site_prompts(spark, sf_dir):
    """P15's four site templates: every page's text under an address of each site, routed by
    P11 and P12."""
    from .scrape import event_prompts, route_pages
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    city = F.when(F.col("page_id") % 8 == 1, F.lit("Vilnius")).otherwise(F.lit("Kaunas"))
    url = (F.when(k == 0, F.concat(F.lit("https://www.litexpo.lt/en/events/?page="), i))
            .when(k == 1, F.concat(F.lit("https://www.meetup.com/find/?location=lt--"), city, F.lit("&n="), i))
            .when(k == 2, F.concat(F.lit("https://www.kaveikti.lt/renginiai/?p="), i)).otherwise(F.col("url")))
    return event_prompts(route_pages(T.load_table(spark, sf_dir, "pages").withColumn("url", url)))


@register("r10_subject_prompts", f"""
WITH req AS ({_REQ_SQL}),
ok AS (SELECT request_id, url, CAST(fs AS INTEGER) AS from_semester, CAST(ts AS INTEGER) AS to_semester FROM req
       WHERE fs IS NOT NULL AND ts IS NOT NULL AND TRY_CAST(fs AS INTEGER) BETWEEN 1 AND 8
         AND TRY_CAST(ts AS INTEGER) BETWEEN 1 AND 8 AND TRY_CAST(fs AS INTEGER) <= TRY_CAST(ts AS INTEGER)
         AND (starts_with(url, 'http://') OR starts_with(url, 'https://'))),
txt AS (SELECT o.request_id, o.url, o.from_semester, o.to_semester, {O.page_text_sql('p.html')} AS text
        FROM ok o JOIN pages p ON o.url = p.url)
SELECT request_id, url, from_semester, to_semester, CAST(length(text) AS INTEGER) AS characters,
       {PR.prompt_sql(PR.SUBJECTS_TEMPLATE, from_semester='from_semester', to_semester='to_semester', text='text')} AS prompt
FROM txt""")
def r10_subject_prompts(spark, sf_dir):
    from .scrape import subject_prompts
    prompts, _ = subject_prompts(_requests(spark, sf_dir), T.load_table(spark, sf_dir, "pages"))
    return prompts.select("request_id", "url", "from_semester", "to_semester", "characters", "prompt")
