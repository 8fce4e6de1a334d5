"""M1-M7: turn raw model responses into rows. Parsing uses Spark's VARIANT
(``try_parse_json``), so malformed text yields NULL and becomes a failure row; nothing
raises, and a batch always completes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold_key, trim_ws
from ..session import ensure_checkpoint_dir

# ---- fixed values -------------------------------------------------------------------
# Lines/items that are fragments of the JSON envelope, not subject names.
SUBJECT_SKIP_TOKENS = ["{", "}", "[", "]", '"study_subjects": [', 'study_subjects": [',
                       'study_subjects\\": [']
SUBJECT_SKIP_PREFIXES = ['study_subjects":[', "study_subjects:["]
# Characters stripped from both ends of a fallback line.
LINE_STRIP = "-• \t"
# Python str.splitlines() line boundaries.
LINE_BREAKS = r"\r\n|[\n\r\x{000B}\f\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"
PARSE_ERROR = "Could not parse model JSON output."
EMPTY_CATEGORY = "Model returned an empty category"
# -------------------------------------------------------------------------------------


def strip_fence(raw: Column) -> Column:
    """Trim; when the text starts with three backticks drop backticks at both ends and a
    leading 'json' tag (any case)."""
    s = trim_ws(raw)
    bare = F.regexp_replace(s, r"^`+|`+$", "")
    untagged = F.when(F.lower(bare).startswith("json"), trim_ws(F.substring(bare, 5, 1 << 30))).otherwise(bare)
    return F.when(s.startswith("```"), untagged).otherwise(s)


def with_recovered_json(df: DataFrame, text_col: str, text_out: str = "_s", json_out: str = "_v") -> DataFrame:
    """M1 as DataFrame steps: the trimmed text, the fence-stripped text and the parsed
    VARIANT are materialised one after another, so each regex runs once per row
    (inlined into one expression they would be re-evaluated in every branch)."""
    # of a repeated key in one object the last value counts
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    t = df.withColumn("_t", trim_ws(F.col(text_col)))
    t = t.withColumn("_bare", F.when(F.col("_t").startswith("```"), F.regexp_replace("_t", r"^`+|`+$", "")))
    t = t.withColumn(text_out, F.when(F.col("_bare").isNull(), F.col("_t"))
                     .when(F.lower("_bare").startswith("json"), trim_ws(F.substring("_bare", 5, 1 << 30)))
                     .otherwise(F.col("_bare")))
    t = t.withColumn("_p1", F.try_parse_json(F.col(text_out)))
    t = t.withColumn(json_out, F.when(F.col("_p1").isNotNull(), F.col("_p1"))
                     .otherwise(F.try_parse_json(brace_slice(F.col(text_out)))))
    return t.drop("_t", "_bare", "_p1")


def brace_slice(s: Column) -> Column:
    """Text from the first '{' to the last '}' (NULL unless both exist in that order)."""
    start = F.instr(s, "{")
    end = F.length(s) - F.instr(F.reverse(s), "}") + 1
    ok = (start > 0) & (F.instr(s, "}") > 0) & (end > start)
    return F.when(ok, F.substring(s, start, end - start + 1))


def recover_json(raw: Column) -> Column:
    """M1: VARIANT of the response: the fence-stripped text if it parses, else the brace
    slice if that parses, else NULL."""
    s = strip_fence(raw)
    return F.coalesce(F.try_parse_json(s), F.try_parse_json(brace_slice(s)))


def is_object(v: Column) -> Column:
    """By a field that need not be there: the schema of a value would read all of it."""
    return F.try_variant_get(v, "$", "struct<any:variant>").isNotNull()


def response_subjects(df: DataFrame, text_col: str = "response", id_col: str = "prompt_id") -> DataFrame:
    """M2-M4: (id, pos, name): the ``study_subjects`` array when the response is an
    object holding one, else every non-blank line stripped of '-', '•', space and tab;
    then strings only, trimmed, blanks and envelope fragments dropped, and duplicates
    removed case-insensitively keeping the first spelling."""
    rec = with_recovered_json(df, text_col)
    s, v = F.col("_s"), F.col("_v")
    arr = F.when(is_object(v), F.try_variant_get(v, "$.study_subjects", "array<variant>"))
    from_json = F.transform(arr, lambda x: F.when(F.schema_of_variant(x) == "STRING",
                                                  F.variant_get(x, "$", "string")))
    lines = F.transform(F.split(s, LINE_BREAKS),
                        lambda x: F.btrim(x, F.lit(LINE_STRIP)))
    from_lines = F.filter(lines, lambda x: x != "")
    items = F.when(arr.isNotNull(), from_json).otherwise(from_lines)
    # outer: an inner one is planned with filters that work the list out again; the rows of
    # empty lists have no name and drop out below
    exploded = rec.select(F.col(id_col), F.posexplode_outer(items).alias("pos", "raw_name"))
    return normalize_subjects(exploded, id_col)


def normalize_subjects(items: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """M3 + M4 over (id, pos, raw_name) rows (raw_name NULL = not a string)."""
    name = F.col("name")
    compact = F.replace(name, F.lit(" "), F.lit(""))
    keep = name.isNotNull() & (name != "") & ~name.isin(SUBJECT_SKIP_TOKENS)
    for prefix in SUBJECT_SKIP_PREFIXES:
        keep = keep & ~compact.startswith(prefix)
    # trimmed once a row: filters are not moved below a generator, so none trims again
    trimmed = items.select(*[c for c in items.columns if c != "name"], F.explode(F.array(trim_ws(F.col("raw_name")))).alias("name"))
    kept = trimmed.where(keep).withColumn("_key", casefold_key(name))
    w = Window.partitionBy(id_col, "_key").orderBy("pos")
    return (kept.withColumn("_first", F.row_number().over(w)).where("_first = 1")
                .select(id_col, "pos", "name"))


def response_category(df: DataFrame, text_col: str = "response") -> tuple[DataFrame, DataFrame]:
    """M5: category name from a classification reply: fence-stripped, cut to the brace
    slice when there is one, parsed; ``category`` trimmed. Unparsable or empty replies
    are failure rows with a reason."""
    t = df.withColumn("_s", strip_fence(F.col(text_col)))
    t = t.withColumn("_v", F.try_parse_json(F.coalesce(brace_slice(F.col("_s")), F.col("_s"))))
    t = t.withColumn("_obj", is_object(F.col("_v")))
    t = t.withColumn("category", trim_ws(F.coalesce(
        F.when(F.col("_obj"), F.try_variant_get(F.col("_v"), "$.category", "string")), F.lit(""))))
    ensure_checkpoint_dir(df.sparkSession)
    tagged = t.withColumn("error", F.when(~F.col("_obj"), F.lit(PARSE_ERROR))
                          .when(F.col("category") == "", F.lit(EMPTY_CATEGORY))) \
              .drop("_s", "_v", "_obj").checkpoint()
    ok = tagged.where(F.col("error").isNull()).drop("error")
    failed = tagged.where(F.col("error").isNotNull()).drop("category")
    return ok, failed


EVENT_ITEM_FIELDS = ["name", "date", "time", "place", "price", "short_description", "source_url"]


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "string")


def response_events(df: DataFrame, per_link: bool = True, text_col: str = "response"
                    ) -> tuple[DataFrame, DataFrame]:
    """M6 + M7: event items of the responses.

    ``per_link``: each response is ONE event object for the link in ``url`` (its
    ``source_url`` is set to that link). Otherwise a response is a page-level object
    with an ``events`` array whose non-object items are skipped.
    Returns (items, failed): items carry the raw fields as strings plus ``categories``
    (strings of a list, else empty) and ``item_pos``; failed rows carry the reason."""
    # The parsed table is checkpointed (shared checkpoint dir): splitting it into good
    # and failed rows filters on the VARIANT, and without the cut the optimizer pushes
    # those filters through the parsing steps, re-inlining the whole parse per branch.
    ensure_checkpoint_dir(df.sparkSession)
    base = with_recovered_json(df, text_col).drop("_s").checkpoint()
    if per_link:
        good = base.where(is_object(F.col("_v"))).withColumn("item_pos", F.lit(0)) \
                   .withColumn("_item", F.col("_v"))
        bad = base.where(~is_object(F.col("_v")))
        failed_reason = PARSE_ERROR
    else:
        arr = F.when(is_object(F.col("_v")), F.try_variant_get(F.col("_v"), "$.events", "array<variant>"))
        with_arr = base.withColumn("_arr", arr)
        good = with_arr.where(F.col("_arr").isNotNull()) \
                       .select(*df.columns, F.posexplode_outer("_arr").alias("item_pos", "_item")) \
                       .where(is_object(F.col("_item")))
        bad = with_arr.where(F.col("_arr").isNull()).drop("_arr")
        failed_reason = "Could not parse events JSON from model output."
    cats = F.try_variant_get(F.col("_item"), "$.categories", "array<variant>")
    cat_names = F.transform(F.coalesce(cats, F.array().cast("array<variant>")),
                            lambda x: trim_ws(F.coalesce(F.variant_get(x, "$", "string"), F.lit(""))))
    fields = [_field(F.col("_item"), f).alias(f"raw_{f}") for f in EVENT_ITEM_FIELDS]
    items = good.select(*df.columns, "item_pos", *fields,
                        F.filter(cat_names, lambda x: x != "").alias("categories"),
                        F.to_json(F.col("_item")).alias("raw_item"))
    if per_link:
        items = items.withColumn("raw_source_url", F.col("url"))
    failed = bad.select(*df.columns, F.lit(failed_reason).alias("error"))
    return items, failed
