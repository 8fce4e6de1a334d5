"""Response tables (§2.15 input contract) derived from the driver tables.

The model service is outside this library: its replies arrive as a table
``(prompt_id, url, source, city, response)``. For the registered queries the replies are
derived from real rows, so their volume grows with the data:

* event replies: one per order (an event-page link), with the date, time and price
  written in the different ways a model answers, wrapped bare / fenced / in prose, or
  not JSON at all;
* subject replies: one per order (a study-plan page), listing the names of the parts
  on its lines as a ``study_subjects`` array or as bullet lines, with envelope
  fragments, blanks and case-variant duplicates;
* category replies: one per distinct subject name, answering its brand.

``EVENT_RESPONSES_SQL`` etc. build the same tables in DuckDB for the oracle statements.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load_table

# ---- fixed values -------------------------------------------------------------------
EN_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
             "September", "October", "November", "December"]
LT_MONTHS = ["sausio", "vasario", "kovo", "balandžio", "gegužės", "birželio", "liepos",
             "rugpjūčio", "rugsėjo", "spalio", "lapkričio", "gruodžio"]
# -------------------------------------------------------------------------------------


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                                   "o_orderdate", "o_orderpriority")
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    y, m, dd = F.year(d).cast("string"), F.month(d), F.dayofmonth(d)
    en = F.element_at(F.array(*[F.lit(x) for x in EN_MONTHS]), m)
    lt = F.element_at(F.array(*[F.lit(x) for x in LT_MONTHS]), m)
    date_raw = (F.when(k % 5 == 0, d.cast("string"))
                 .when(k % 5 == 1, F.concat_ws("/", F.lpad(dd.cast("string"), 2, "0"),
                                               F.lpad(m.cast("string"), 2, "0"), y))
                 .when(k % 5 == 2, F.concat(en, F.lit(" "), dd.cast("string"), F.lit("–"),
                                            (dd + 1).cast("string"), F.lit(", "), y))
                 .when(k % 5 == 3, F.concat_ws(" ", dd.cast("string"), lt, y))
                 .otherwise(F.lit("soon")))
    time_raw = (F.when(k % 3 == 0, F.concat((k % 24).cast("string"), F.lit(":"), ((k * 7) % 60).cast("string")))
                 .when(k % 3 == 1, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"),
                                            F.lpad(((k * 7) % 60).cast("string"), 2, "0"), F.lit(":00")))
                 .otherwise(F.lit("")))
    price = (F.col("o_totalprice").cast("decimal(18,2)") * F.lit(Decimal("0.001"))).cast("decimal(10,3)").cast("string")
    price_raw = (F.when(k % 4 == 0, F.concat(F.replace(price, F.lit("."), F.lit(",")), F.lit(" EUR")))
                  .when(k % 4 == 1, F.lit("Free"))
                  .when(k % 4 == 2, F.concat(F.lit("€"), price))
                  .otherwise(F.lit("TBA")))
    name = F.when(k % 3 == 0, F.concat(F.lit("Fair "), k.cast("string"))).otherwise(
        F.concat(F.lit("Event "), k.cast("string")))
    payload = F.to_json(F.struct(
        name.alias("name"), date_raw.alias("date"), time_raw.alias("time"),
        F.when(k % 6 == 0, F.lit("")).otherwise(F.col("n_name")).alias("place"),
        price_raw.alias("price"),
        F.array(F.upper("c_mktsegment"), F.concat(F.lit(" "), F.col("o_orderpriority")), F.lit("")).alias("categories"),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("About "), F.col("o_orderpriority"))).alias("short_description"),
    ))
    resp = (F.when(k % 4 == 0, payload)
             .when(k % 4 == 1, F.concat(F.lit("```json\n"), payload, F.lit("\n```")))
             .when(k % 4 == 2, F.concat(F.lit("Here you go: "), payload, F.lit(" Enjoy!")))
             .otherwise(F.lit("Sorry, no event here.")))
    return j.select(k.alias("prompt_id"),
                    F.concat(F.lit("https://events.example.com/e/"), k.cast("string")).alias("url"),
                    F.lit("other").alias("source"), F.lit("").alias("city"), resp.alias("response")) \
        .repartition("prompt_id")  # a response table comes in many parts, other than a small orders file


EVENT_RESPONSES_SQL = """
    SELECT o_orderkey AS prompt_id, concat('https://events.example.com/e/', CAST(o_orderkey AS VARCHAR)) AS url,
           'other' AS source, '' AS city,
           CASE o_orderkey % 4 WHEN 0 THEN p WHEN 1 THEN concat('```json' || chr(10), p, chr(10) || '```')
                WHEN 2 THEN concat('Here you go: ', p, ' Enjoy!') ELSE 'Sorry, no event here.' END AS response
    FROM (
      SELECT o_orderkey, json_object(
        'name', CASE WHEN o_orderkey % 3 = 0 THEN 'Fair ' ELSE 'Event ' END || CAST(o_orderkey AS VARCHAR),
        'date', CASE o_orderkey % 5
            WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR)
            WHEN 1 THEN concat_ws('/', lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0'),
                                  lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0'), CAST(year(o_orderdate) AS VARCHAR))
            WHEN 2 THEN concat({_sql_list(EN_MONTHS)}[month(o_orderdate)], ' ', CAST(day(o_orderdate) AS VARCHAR), '–',
                               CAST(day(o_orderdate) + 1 AS VARCHAR), ', ', CAST(year(o_orderdate) AS VARCHAR))
            WHEN 3 THEN concat_ws(' ', CAST(day(o_orderdate) AS VARCHAR), {_sql_list(LT_MONTHS)}[month(o_orderdate)],
                                  CAST(year(o_orderdate) AS VARCHAR))
            ELSE 'soon' END,
        'time', CASE o_orderkey % 3
            WHEN 0 THEN concat(CAST(o_orderkey % 24 AS VARCHAR), ':', CAST((o_orderkey * 7) % 60 AS VARCHAR))
            WHEN 1 THEN concat(lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), ':',
                               lpad(CAST((o_orderkey * 7) % 60 AS VARCHAR), 2, '0'), ':00')
            ELSE '' END,
        'place', CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE n_name END,
        'price', CASE o_orderkey % 4
            WHEN 0 THEN concat(replace(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001 AS DECIMAL(10,3)) AS VARCHAR), '.', ','), ' EUR')
            WHEN 1 THEN 'Free'
            WHEN 2 THEN concat('€', CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001 AS DECIMAL(10,3)) AS VARCHAR))
            ELSE 'TBA' END,
        'categories', [upper(c_mktsegment), concat(' ', o_orderpriority), ''],
        'short_description', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('About ', o_orderpriority) END
      )::VARCHAR AS p
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    ) x"""


def _sql_list(vals: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in vals) + "]"


EVENT_RESPONSES_SQL = EVENT_RESPONSES_SQL.replace("{_sql_list(EN_MONTHS)}", _sql_list(EN_MONTHS)) \
    .replace("{_sql_list(LT_MONTHS)}", _sql_list(LT_MONTHS))


def subject_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per order (a study-plan page) listing the parts of its lines in line
    order; a list is bounded by the lines of one order. The order key decides the
    reply's shape."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey)
    nm = F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))
    # case variants create duplicates that M4 must fold
    nm = F.when(F.col("l_linenumber") == 2, F.upper(nm)).otherwise(nm)
    lists = j.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", nm.alias("n")))),
                    lambda s: s["n"]).alias("names"))
    ck = F.col("l_orderkey")
    arr_json = F.to_json(F.struct(F.concat(F.col("names"), F.array(F.lit(""), F.lit("   "))).alias("study_subjects")))
    bullets = F.array_join(F.transform("names", lambda x: F.concat(F.lit("- "), x)), "\n")
    resp = (F.when(ck % 4 == 0, arr_json)
             .when(ck % 4 == 1, F.concat(F.lit("```json\n"), arr_json, F.lit("\n```")))
             .when(ck % 4 == 2, F.concat(F.lit("Subjects:\n"), bullets, F.lit("\n• {\n")))
             .otherwise(F.concat(F.lit('{\n"study_subjects": [\n'), F.array_join("names", "\n"), F.lit("\n"))))
    return lists.select(ck.alias("prompt_id"),
                        F.concat(F.lit("https://study.example.com/plan/"), ck.cast("string")).alias("url"),
                        resp.alias("response"))


SUBJECT_RESPONSES_SQL = """
    SELECT l_orderkey AS prompt_id, concat('https://study.example.com/plan/', CAST(l_orderkey AS VARCHAR)) AS url,
           CASE l_orderkey % 4
             WHEN 0 THEN CAST(json_object('study_subjects', list_concat(names, ['', '   '])) AS VARCHAR)
             WHEN 1 THEN concat('```json' || chr(10), CAST(json_object('study_subjects', list_concat(names, ['', '   '])) AS VARCHAR),
                                chr(10) || '```')
             WHEN 2 THEN concat('Subjects:' || chr(10),
                                array_to_string(list_transform(names, lambda x: concat('- ', x)), chr(10)),
                                chr(10) || '• {' || chr(10))
             ELSE concat('{' || chr(10) || '"study_subjects": [' || chr(10), array_to_string(names, chr(10)), chr(10))
           END AS response
    FROM (
      SELECT l_orderkey, list(CASE WHEN l_linenumber = 2 THEN upper(concat(p_name, ' ', CAST(p_partkey AS VARCHAR)))
                                   ELSE concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) END
                              ORDER BY l_linenumber, l_partkey) AS names
      FROM lineitem JOIN part ON l_partkey = p_partkey
      GROUP BY l_orderkey
    ) x"""


def category_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One classification reply per part name: its brand, in varying envelopes."""
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    k = F.col("p_partkey")
    body = F.to_json(F.struct(F.col("p_brand").alias("category")))
    resp = (F.when(k % 5 == 0, body)
             .when(k % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(k % 5 == 2, F.concat(F.lit("The category is "), body))
             .when(k % 5 == 3, F.lit('{"category": "  "}'))
             .otherwise(F.lit("I think it is engineering")))
    return p.select(k.alias("prompt_id"),
                    F.concat(F.col("p_name"), F.lit(" "), k.cast("string")).alias("subject"),
                    resp.alias("response"))


CATEGORY_RESPONSES_SQL = """
    SELECT p_partkey AS prompt_id, concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS subject,
           CASE p_partkey % 5 WHEN 0 THEN CAST(json_object('category', p_brand) AS VARCHAR)
                WHEN 1 THEN concat('```json' || chr(10), CAST(json_object('category', p_brand) AS VARCHAR), chr(10) || '```')
                WHEN 2 THEN concat('The category is ', CAST(json_object('category', p_brand) AS VARCHAR))
                WHEN 3 THEN '{"category": "  "}'
                ELSE 'I think it is engineering' END AS response
    FROM part"""


def page_event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-page form (M6): one reply per order page holding an ``events`` array with
    one object per line item, plus a stray non-object item on some pages; a few
    replies are not JSON at all. A list is bounded by the lines of one order."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                                      "l_shipdate", "l_extendedprice", "l_returnflag")
    item = F.to_json(F.struct(
        F.concat(F.lit("Line "), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_shipdate").cast("date").cast("string").alias("date"),
        F.lit("18:30").alias("time"),
        F.concat(F.lit("Dock "), F.col("l_returnflag")).alias("place"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("."),
                 F.lpad((F.col("l_linenumber") * 7).cast("string"), 2, "0")).alias("price"),
        F.array(F.col("l_returnflag")).alias("categories")))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey", item.alias("j")))).alias("items"))  # j breaks ties
    k = F.col("l_orderkey")
    objs = F.array_join(F.transform("items", lambda s: s["j"]), ",")
    body = F.when(k % 3 == 0, F.concat(objs, F.lit(",7"))).otherwise(objs)
    resp = (F.when(k % 5 == 4, F.lit("No events on this page."))
             .otherwise(F.concat(F.lit('{"events": ['), body, F.lit("]}"))))
    return g.select(k.alias("prompt_id"),
                    F.concat(F.lit("https://events.example.com/list/"), k.cast("string")).alias("url"),
                    resp.alias("response"))


PAGE_EVENT_RESPONSES_SQL = """
    SELECT l_orderkey AS prompt_id, concat('https://events.example.com/list/', CAST(l_orderkey AS VARCHAR)) AS url,
           CASE WHEN l_orderkey % 5 = 4 THEN 'No events on this page.'
                ELSE concat('{"events": [', CASE WHEN l_orderkey % 3 = 0 THEN concat(objs, ',7') ELSE objs END, ']}') END
             AS response
    FROM (SELECT l_orderkey, string_agg(j, ',' ORDER BY l_linenumber, l_partkey, j) AS objs
          FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(json_object(
                    'name', concat('Line ', CAST(l_partkey AS VARCHAR)),
                    'date', CAST(CAST(l_shipdate AS DATE) AS VARCHAR),
                    'time', '18:30',
                    'place', concat('Dock ', l_returnflag),
                    'price', concat(CAST(l_partkey AS VARCHAR), '.', lpad(CAST(l_linenumber * 7 AS VARCHAR), 2, '0')),
                    'categories', [l_returnflag]) AS VARCHAR) AS j
                FROM lineitem) a
          GROUP BY l_orderkey) b"""
