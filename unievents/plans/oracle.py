"""DuckDB statements equivalent to the registered Spark queries.

The bindings of ``sources/tables.py`` are repeated here as CTEs so each statement runs
on the raw driver views (region nation customer ... conversations).
"""

from __future__ import annotations

BINDINGS = {
    "category": """
        SELECT TRY_CAST(substr(p_brand, 7) AS BIGINT) AS category_id, p_brand AS name
        FROM part GROUP BY p_brand""",
    "subject": """
        SELECT p_partkey AS subject_id, concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS name,
               CASE WHEN p_partkey % 10 = 0 THEN NULL
                    ELSE TRY_CAST(substr(p_brand, 7) AS BIGINT) END AS category_id
        FROM part""",
    "student": "SELECT c_custkey AS student_id, c_name AS username FROM customer",
    "student_subject": """
        SELECT o_custkey AS student_id, l_partkey AS subject_id,
               CAST(CASE WHEN max(l_linenumber) <= 5 THEN max(l_linenumber) END AS INTEGER) AS interest
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY o_custkey, l_partkey""",
    "event": """
        SELECT o_orderkey AS event_id, concat('Event ', CAST(o_orderkey AS VARCHAR)) AS name,
               CAST(o_orderdate AS DATE) AS date,
               concat(lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), ':',
                      lpad(CAST((o_orderkey * 7) % 60 AS VARCHAR), 2, '0'), ':00') AS time,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001 AS DECIMAL(10,2)) AS price, n_name AS place,
               concat('Priority ', o_orderpriority) AS short_description,
               concat('https://events.example.com/e/', CAST(o_orderkey AS VARCHAR)) AS source_url
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "event_category": """
        SELECT DISTINCT l_orderkey AS event_id,
               CASE WHEN l_orderkey % 2 = 0 THEN upper(p_brand) ELSE concat(' ', p_brand) END AS category_name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
}

# Same character class as functions/text.py (Python str.strip() whitespace).
WS = (r"[\t\n\x{000B}\f\r\x{001C}-\x{001F} \x{0085}\x{00A0}\x{1680}"
      r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def trim_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def key(expr: str) -> str:
    """D7 key in SQL: lower(trim(x)), blank -> NULL."""
    return f"NULLIF(lower({trim_ws(expr)}), '')"


# Derived CTEs used by several statements.
DERIVED = {
    "interest": f"""
        SELECT ss.student_id, {key('c.name')} AS category_key, max(ss.interest) AS interest
        FROM student_subject ss JOIN subject s ON ss.subject_id = s.subject_id
             JOIN category c ON s.category_id = c.category_id
        WHERE ss.interest > 0 AND {key('c.name')} IS NOT NULL
        GROUP BY 1, 2""",
    "ec_key": f"""
        SELECT event_id, {key('category_name')} AS category_key
        FROM event_category WHERE {key('category_name')} IS NOT NULL""",
    "event_cats": """
        SELECT event_id, array_to_string(list_sort(list(DISTINCT category_name)), ', ') AS categories
        FROM event_category GROUP BY event_id""",
    "event_row": """
        SELECT e.event_id, e.name, CAST(e.date AS VARCHAR) AS date, substr(e.time, 1, 5) AS time,
               e.place, CAST(e.price AS VARCHAR) AS price, coalesce(c.categories, '') AS categories,
               e.short_description, e.source_url
        FROM event e LEFT JOIN event_cats c ON e.event_id = c.event_id""",
}


def with_ctes(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the named binding/derived CTEs (dependencies included),
    followed by the statement's own ``extra`` CTEs in the given order."""
    order = ["category", "subject", "student", "student_subject", "event", "event_category",
             "interest", "ec_key", "event_cats", "event_row"]
    deps = {"interest": {"student_subject", "subject", "category"}, "ec_key": {"event_category"},
            "event_cats": {"event_category"}, "event_row": {"event", "event_cats"}}
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        need.add(n)
        for d in deps.get(n, ()):
            add(d)

    for n in names:
        add(n)
    parts = [f"{n} AS ({BINDINGS.get(n) or DERIVED[n]})" for n in order if n in need]
    parts += [f"{n} AS ({q})" for n, q in (extra or [])]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


# ---- page-text helpers in SQL (for markup that is plain but for references) ----------------------
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def decode_sql(expr: str) -> str:
    """All of these but the apostrophe are also read without their semicolon."""
    for ent, ch in ENTITIES:
        optional = ent if ent == "&apos;" else f"{ent}?"
        expr = f"regexp_replace({expr}, '{optional}', '{ch.replace(chr(39), chr(39) * 2)}', 'g')"
    return expr


def strip_html_sql(expr: str, elements: tuple[str, ...] = ("script", "style", "noscript")) -> str:
    out = f"regexp_replace({expr}, '(?s)<!--.*?-->', '<>', 'g')"
    for tag in elements:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '<>', 'g')"
    return out


def page_text_sql(expr: str, cap: int | None = None) -> str:
    nodes = f"regexp_split_to_array({strip_html_sql(expr)}, '<[^>]*>')"
    kept = f"list_filter(list_transform({nodes}, lambda x: {trim_ws(decode_sql('x'))}), lambda x: x <> '')"
    text = f"array_to_string({kept}, ' ')"
    return text if cap is None else f"left({text}, {cap})"


HOST_RE = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH_RE = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY_RE = "^[^?#]*\\?([^#]*)"


def resolve_sql(base: str, href: str) -> str:
    scheme = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    no_frag = f"regexp_replace({base}, '#.*$', '')"
    no_query = f"regexp_replace({no_frag}, '\\?.*$', '')"
    base_dir = (f"CASE WHEN regexp_extract({base}, '{PATH_RE}', 1) = '' THEN concat({origin}, '/') "
                f"ELSE regexp_replace({no_query}, '[^/]*$', '') END")
    return (f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN concat({scheme}, ':', {href}) "
            f"WHEN starts_with({href}, '/') THEN concat({origin}, {href}) "
            f"WHEN {href} = '' THEN {base} "
            f"WHEN starts_with({href}, '?') THEN concat({no_query}, {href}) "
            f"WHEN starts_with({href}, '#') THEN concat({no_frag}, {href}) "
            f"ELSE concat({base_dir}, {href}) END")


def normalize_sql(url: str) -> str:
    return f"concat(regexp_replace(regexp_replace({url}, '[?#].*$', ''), '/+$', ''), '/')"


# ---- D1-D3 and M1 in SQL ----------------------------------------------------------------
def date_sql(x: str, as_of_year: int) -> str:
    """Tokens are marked by what they are, and one list of formats reads them."""
    from ..functions.standardize import MONTHS
    space = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B\\x1C-\\x1F]+"
    norm = trim_ws(f"regexp_replace(replace(replace({trim_ws(f'CAST({x} AS VARCHAR)')}, '–', '-'), ',', ' '), '{space}', ' ', 'g')")
    low = f"lower(regexp_replace(strip_accents({norm}), '[^\\x00-\\x7F]', '', 'g'))"
    months = " ".join(f"WHEN '{k}' THEN 'M{v}'" for k, v in MONTHS.items())
    marked = (f"array_to_string(list_transform(string_split(regexp_replace({low}, ' *- *', '-', 'g'), ' '), lambda t: "
              f"CASE t {months} ELSE CASE WHEN regexp_full_match(t, '[0-9]{{4}}') THEN 'Y' || t "
              f"WHEN regexp_full_match(t, '[0-9]{{1,2}}') THEN 'D' || t "
              f"WHEN regexp_full_match(t, '[0-9]{{1,2}}-[0-9]{{1,2}}') THEN 'R' || split_part(t, '-', 1) ELSE '?' END END), ' ')")
    with_year = f"CASE WHEN regexp_full_match({marked}, 'M[0-9]+ D[0-9]+') THEN {marked} || ' @{as_of_year}' ELSE {marked} END"
    formats = "['M%m R%d Y%Y', 'Y%Y M%m R%d', 'R%d M%m Y%Y', 'D%d M%m Y%Y', 'M%m D%d @%Y']"
    plain = "[0-9]{4}([-][0-9]{1,2}[-]|[/][0-9]{1,2}[/]|[.][0-9]{1,2}[.])[0-9]{1,2}|[0-9]{1,2}([-][0-9]{1,2}[-]|[/][0-9]{1,2}[/])[0-9]{4}"
    return (f"CAST(coalesce(try_strptime({with_year}, {formats}), CASE WHEN regexp_full_match({norm}, '{plain}') THEN "
            f"try_strptime({norm}, ['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%d-%m-%Y', '%d/%m/%Y']) END) AS DATE)")


def time_sql(x: str) -> str:
    s = trim_ws(f"CAST({x} AS VARCHAR)")
    p = r"^(\d{1,2}):(\d{1,2})(:(\d{1,2}))?$"
    h = f"TRY_CAST(regexp_extract({s}, '{p}', 1) AS INTEGER)"
    m = f"TRY_CAST(regexp_extract({s}, '{p}', 2) AS INTEGER)"
    sec = f"coalesce(TRY_CAST(NULLIF(regexp_extract({s}, '{p}', 4), '') AS INTEGER), 0)"
    return (f"CASE WHEN regexp_matches({s}, '{p}') AND {h} BETWEEN 0 AND 23 AND {m} BETWEEN 0 AND 59 "
            f"AND {sec} BETWEEN 0 AND 59 THEN printf('%02d:%02d:%02d', {h}, {m}, {sec}) END")


def price_sql(x: str) -> str:
    s = f"replace(replace(replace(replace({trim_ws(f'CAST({x} AS VARCHAR)')}, 'EUR', ''), '€', ''), ' ', ''), ',', '.')"
    return (f"CASE WHEN {x} IS NULL THEN CAST(0 AS DECIMAL(10,2)) "
            f"WHEN {s} = '' OR lower({s}) = 'free' THEN CAST(0 AS DECIMAL(10,2)) "
            f"ELSE TRY_CAST(round_even(TRY_CAST({s} AS DECIMAL(38,10)), 2) AS DECIMAL(10,2)) END")


def fence_sql(x: str) -> str:
    t = trim_ws(x)
    bare = f"regexp_replace({t}, '^`+|`+$', '', 'g')"
    untag = f"CASE WHEN starts_with(lower({bare}), 'json') THEN {trim_ws(f'substr({bare}, 5)')} ELSE {bare} END"
    return f"CASE WHEN starts_with({t}, '```') THEN {untag} ELSE {t} END"


def brace_sql(s: str) -> str:
    start = f"strpos({s}, '{{')"
    end = f"(length({s}) - strpos(reverse({s}), '}}') + 1)"
    return (f"CASE WHEN {start} > 0 AND strpos({s}, '}}') > 0 AND {end} > {start} "
            f"THEN substr({s}, {start}, {end} - {start} + 1) END")


def recover_sql(s: str) -> str:
    """M1 on an already fence-stripped text ``s``."""
    return (f"CASE WHEN json_valid({s}) THEN {s} "
            f"WHEN json_valid({brace_sql(s)}) THEN {brace_sql(s)} END")
