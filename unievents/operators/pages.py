"""Page jobs over a page table (page_id, url, html). All text and URL work is
built-in Spark expressions; only pages of odd markup pass an Arrow function (P1, P3)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_url, page_hrefs, page_text, trim_ws, url_host, url_path, url_query

# ---- fixed values -------------------------------------------------------------------
SOURCES = ("litexpo", "meetup", "kaveikti", "other")
DEFAULT_CITY_HINT = "Vilnius"
MAX_LINKS_DEFAULT = 20
NO_LINKS_ERROR = "No event links found for source '{source}' and no saved links are available."
# -------------------------------------------------------------------------------------


def page_texts(pages: DataFrame, cap: int | None = None, carry: tuple = ()) -> DataFrame:
    """P1 + P2: (page_id, url, text, characters) and what ``carry`` adds."""
    return (pages.select("page_id", "url", page_text(F.col("html"), cap).alias("text"), *carry)
                 .withColumn("characters", F.length("text")))


def page_links(pages: DataFrame, carry: tuple[str, ...] = (), all_pages: bool = False) -> DataFrame:
    """Every ``a[href]`` in document order: (page_id, url, pos, href) with the href
    entity-decoded and trimmed. Columns in ``carry`` are kept; with ``all_pages`` a page
    without links is a row with null href."""
    explode = F.posexplode_outer if all_pages else F.posexplode
    return pages.select("page_id", "url", *carry, explode(page_hrefs(F.col("html"))).alias("pos", "href"))


def remove_dot_segments(path: Column, drop_empty: Column | bool = False) -> Column:
    """RFC 3986 §5.2.4 as a fold over the path's segments (the way ``urljoin`` does it):
    '.' is skipped, '..' pops the last kept segment (never above the root), and a
    trailing '.' or '..' leaves a trailing '/'. With ``drop_empty`` (relative
    references) empty inner segments are dropped first."""
    segs = F.split(path, "/")
    n = F.size(segs)
    drop = F.lit(drop_empty) if isinstance(drop_empty, bool) else drop_empty
    segs = F.filter(segs, lambda x, i: ~drop | (i == 0) | (i == n - 1) | (x != ""))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(segs, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                       .when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    last = F.element_at(segs, -1)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(kept, "/")
    joined = F.when(joined == "", F.lit("/")).otherwise(joined)
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_href(base: Column, href: Column) -> Column:
    """Resolve ``href`` against the page URL like ``urljoin``: absolute and
    network-path references are kept; query- and fragment-only references replace
    those parts of the base; absolute-path and relative references take the base's
    origin, the relative ones merged with the base directory, and their path has its
    dot segments removed (``remove_dot_segments``). All JVM-side."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    no_frag = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    base_path = url_path(base)
    base_dir = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*$", "")
    ref_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    ref_tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    merged = F.when(href.startswith("/"), ref_path).otherwise(F.concat(base_dir, ref_path))
    pathy = F.concat(origin, remove_dot_segments(merged, ~href.startswith("/")), ref_tail)
    return (F.when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
             .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
             .when(href == "", base)
             .when(href.startswith("?"), F.concat(no_query, href))
             .when(href.startswith("#"), F.concat(no_frag, href))
             .otherwise(pathy))


def resolve_links(links: DataFrame) -> DataFrame:
    """P4 + P5: absolute link and its normalised form, with host and path split out."""
    full = resolve_href(F.col("url"), F.col("href"))
    return (links.withColumn("full_url", full)
                 .withColumn("link_host", url_host(F.col("full_url")))
                 .withColumn("link_path", url_path(F.col("full_url")))
                 .withColumn("link", normalize_url(F.col("full_url"))))


@dataclass(frozen=True)
class LinkRule:
    """P6-P8 as data: which links of a listing page are event pages for ``source``."""
    source: str
    hosts: tuple[str, ...] | None = None       # exact netloc list (None: any host)
    host_suffix: str | None = None              # or a netloc suffix
    path_has: tuple[str, ...] = ()              # all must occur in the path
    path_not_has: tuple[str, ...] = ()          # none may occur in the path
    lower_path_has: tuple[str, ...] = ()        # all must occur in the lower-cased path
    not_suffix: str | None = None               # normalised link must not end with this
    extra: dict = field(default_factory=dict, compare=False)


# ---- fixed values: the three site rules ----------------------------------------------
SITE_RULES = (
    LinkRule("litexpo", hosts=("www.litexpo.lt",), path_has=("/en/events/",), not_suffix="/en/events/"),
    LinkRule("meetup", hosts=("www.meetup.com", "meetup.com"), path_has=("/events/",),
             path_not_has=("/find/", "/topics/")),
    LinkRule("kaveikti", hosts=("www.kaveikti.lt", "kaveikti.lt"), lower_path_has=("rengin",),
             not_suffix="/renginiai/"),
)
# -------------------------------------------------------------------------------------


def rules_frame(spark, rules) -> DataFrame:
    rows = [(r.source, list(r.hosts) if r.hosts is not None else None, r.host_suffix,
             list(r.path_has), list(r.path_not_has), list(r.lower_path_has), r.not_suffix)
            for r in rules]
    return spark.createDataFrame(rows, "source string, hosts array<string>, host_suffix string, "
                                       "path_has array<string>, path_not_has array<string>, "
                                       "lower_path_has array<string>, not_suffix string")


def filter_links(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep links matching their page's source rule, then de-duplicate normalised links keeping the first in document
    order."""
    kept = links.join(rules, "source").where(rule_holds()).select(*links.columns)
    w = Window.partitionBy("page_id", "link").orderBy("pos")
    return kept.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def rule_holds() -> Column:
    """P6-P8 on a resolved link joined to the rule of its page's source."""
    path, lpath = F.col("link_path"), F.lower(F.col("link_path"))
    return ((F.col("hosts").isNull() | F.array_contains(F.col("hosts"), F.col("link_host")))
            & (F.col("host_suffix").isNull() | F.col("link_host").endswith(F.col("host_suffix")))
            & F.forall("path_has", lambda x: F.contains(path, x))
            & ~F.exists("path_not_has", lambda x: F.contains(path, x))
            & F.forall("lower_path_has", lambda x: F.contains(lpath, x))
            & (F.col("not_suffix").isNull() | ~F.col("link").endswith(F.col("not_suffix"))))


def top_links(links: DataFrame, n: int = MAX_LINKS_DEFAULT) -> DataFrame:
    """P10: first ``n`` links per page by position (after P6-P9); WindowGroupLimit keeps
    at most n rows per page and partition before the shuffle."""
    if n < 1:
        raise ValueError("max_events must be at least 1.")
    w = Window.partitionBy("page_id").orderBy("pos")
    return links.withColumn("link_rank", F.row_number().over(w)).where(F.col("link_rank") <= n)


def classify_source(pages: DataFrame, text_col: str | None = None) -> DataFrame:
    """Source label from the page URL and its lower-cased full text (first match
    wins): litexpo, meetup, kaveikti, else other."""
    url = F.col("url")
    host, path, query = F.lower(url_host(url)), F.lower(url_path(url)), F.lower(url_query(url))
    text = F.lower(F.col(text_col) if text_col else page_text(F.col("html"), cap=None))
    meetup = (F.contains(host, F.lit("meetup.com"))
              & (F.contains(path, F.lit("/find/")) | F.contains(path, F.lit("/events/"))
                 | F.contains(query, F.lit("vilnius")) | F.contains(text, F.lit("vilnius"))
                 | F.contains(text, F.lit("events"))))
    src = (F.when(F.contains(host, F.lit("litexpo.lt")) & F.contains(path, F.lit("/en/events")), "litexpo")
            .when(meetup, "meetup")
            .when(F.contains(host, F.lit("kaveikti.lt")) & F.contains(path, F.lit("/renginiai")), "kaveikti")
            .otherwise("other"))
    return pages.withColumn("source", src)


def infer_city(pages: DataFrame, text_col: str | None = None) -> DataFrame:
    """P12 (meetup pages only): given ``city``; else the ``location`` field; else the
    first ``location=`` query part; both cut after the last '--'; else 'Vilnius' when
    it occurs in the lower query or page text. Values are raw (not URL-decoded)."""
    cols = pages.columns
    given = trim_ws(F.col("city")) if "city" in cols else F.lit(None).cast("string")
    loc = F.col("location").cast("string") if "location" in cols else F.lit(None).cast("string")
    raw_q = url_query(F.col("url"))
    parts = F.filter(F.split(raw_q, "&"), lambda x: x.startswith("location="))
    q_loc = F.element_at(F.split(F.regexp_replace(F.element_at(parts, 1), r"^location=", ""), "--"), -1)
    text = F.lower(F.col(text_col) if text_col else page_text(F.col("html"), cap=None))
    vilnius = F.contains(F.lower(raw_q), F.lit("vilnius")) | F.contains(text, F.lit("vilnius"))
    inferred = (F.when(F.coalesce(loc, F.lit("")) != "", F.element_at(F.split(loc, "--"), -1))
                 .when(F.contains(raw_q, F.lit("location=")), F.coalesce(q_loc, F.lit("")))
                 .when(vilnius, F.lit(DEFAULT_CITY_HINT))
                 .otherwise(F.lit("")))
    city = F.when(F.coalesce(given, F.lit("")) != "", given) \
            .when(F.col("source") == "meetup", inferred).otherwise(F.coalesce(given, F.lit("")))
    return pages.withColumn("city", city)


def validate_urls(df: DataFrame, col: str = "url") -> tuple[DataFrame, DataFrame]:
    """URL present and starting with http:// or https:// (case-sensitive); accepted
    rows go on with the trimmed URL that was checked."""
    u = trim_ws(F.coalesce(F.col(col), F.lit("")))
    reason = (F.when(u == "", F.lit("Field 'url' is required."))
               .when(~(u.startswith("http://") | u.startswith("https://")),
                     F.lit("URL must start with http:// or https://.")))
    tagged = df.withColumn("reason", reason)
    return (tagged.where(F.col("reason").isNull()).drop("reason").withColumn(col, trim_ws(F.col(col))),
            tagged.where(F.col("reason").isNotNull()))


def validate_semesters(df: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both semesters present and integers, 1..8, from <= to; the first failing rule
    is the reason. ``strict=False`` is the assign path: defaults 1..4, no 1..8 bound."""
    fs, ts = F.col("from_semester").cast("string"), F.col("to_semester").cast("string")
    if not strict:
        fs, ts = F.coalesce(fs, F.lit("1")), F.coalesce(ts, F.lit("4"))
    fi, ti = trim_ws(fs).try_cast("int"), trim_ws(ts).try_cast("int")
    r = F.when(fs.isNull() | ts.isNull(), F.lit("Fields 'fromSemester' and 'toSemester' are required.")) \
         .when(fi.isNull() | ti.isNull(), F.lit("fromSemester and toSemester must be numbers."))
    if strict:
        r = r.when((fi < 1) | (ti < 1), F.lit("fromSemester and toSemester must be at least 1.")) \
             .when((fi > 8) | (ti > 8), F.lit("fromSemester and toSemester must be at most 8."))
    r = r.when(fi > ti, F.lit("fromSemester cannot be greater than toSemester."))
    tagged = df.withColumn("reason", r).withColumn("from_semester", fi).withColumn("to_semester", ti)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())
