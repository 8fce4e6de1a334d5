"""Inference prompts as a table (one row per page/subject/event), built with
``concat`` so text of any length is passed whole. A template is plain text with
``{placeholders}``; ``prompt_column`` (Spark) and ``prompt_sql`` (DuckDB) build the same
string from it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: prompt templates --------------------------------------------------
_EVENT_FORMAT = ('Output format: {{"name": "", "date": "YYYY-MM-DD", "time": "HH:MM", "place": "", '
                 '"price": "", "categories": [""], "short_description": ""}}. ')

EVENT_TEMPLATES = {
    "litexpo": (
        "Extract ONE event from this Litexpo detail page text and return strict JSON only. "
        + _EVENT_FORMAT +
        "Generate categories as topical tags based on the event content from the source page "
        "(examples: IT, Databases, Biology, Business, Engineering, Construction, Automotive, Art, Gaming). "
        "Use 2-5 concise categories and avoid generic values like 'Events' or 'Other'. "
        "If price is not provided, use 0. If place is not explicit, use 'LITEXPO, Vilnius'. "
        "If time is missing, use 00:00. Do not include markdown or explanation.\n\n"
        "Source URL: {detail_url}\n"
        "Detail page text:\n{detail_text}"
    ),
    "meetup": (
        "Extract ONE event from this Meetup event page text and return strict JSON only. "
        + _EVENT_FORMAT +
        "Use event location if available, otherwise use city hint. "
        "If event is free, set price to 0. If time is missing, use 00:00. "
        "Generate a short_description in 1 sentence based on event topic. "
        "Do not include markdown or explanation.\n\n"
        "City hint: {city_hint}\n"
        "Source URL: {detail_url}\n"
        "Detail page text:\n{detail_text}"
    ),
    "kaveikti": (
        "Extract ONE event from this kaveikti.lt event page text and return strict JSON only. "
        + _EVENT_FORMAT +
        "For categories, infer broad tags like Music, Business, Tech, Education, Family, Sports. "
        "If price is unavailable, set 0. If time is missing, use 00:00. "
        "Generate short_description from event context. "
        "Do not include markdown or explanation.\n\n"
        "Source URL: {detail_url}\n"
        "Detail page text:\n{detail_text}"
    ),
    "other": (
        "Extract ONE event from this detail page text and return strict JSON only. "
        + _EVENT_FORMAT +
        "If price is not provided, use 0. If time is missing, use 00:00. "
        "Do not include markdown or explanation.\n\n"
        "Source URL: {detail_url}\n"
        "Detail page text:\n{detail_text}"
    ),
}

EVENT_LIST_TEMPLATE = (
    "Extract events from the webpage text and return strict JSON only. "
    'Output format: {{"events": [{{"name": "", "date": "YYYY-MM-DD", "time": "HH:MM", "place": "", "price": "", '
    '"categories": [""], "short_description": ""}}]}}. '
    "If price is not provided, use 0. If time is missing, use 00:00. "
    "Do not include markdown or extra explanation.\n\n"
    "Webpage text:\n{text}"
)

SUBJECTS_TEMPLATE = (
    "Task: Extract study subjects only from selected semesters.\n"
    "Selected semesters: {from_semester} to {to_semester} (inclusive).\n\n"
    "Strict rules:\n"
    "1) Include subject only if it is clearly listed under semester number "
    "{from_semester}..{to_semester}.\n"
    "2) Exclude all subjects from any semester outside that range.\n"
    "3) If semester is unclear, exclude it.\n"
    "4) Keep original subject text exactly (no translation, no rewriting).\n"
    "5) Remove duplicates.\n"
    "6) Output ONLY valid JSON with one key exactly:\n"
    '{{"study_subjects":["...","..."]}}\n'
    "7) Do not output markdown, comments, explanations, or extra keys.\n\n"
    "Webpage text:\n"
    "{text}"
)

CATEGORY_TEMPLATE = (
    "You are classifying a university study subject into a broad category. "
    'Return strict JSON only in this format: {{"category": "Category Name"}}. '
    "Examples of categories: IT, Mathematics, Business, Architecture, Engineering, Law. "
    "Do not add explanation.\n\n"
    "Subject: {subject}"
)

EXPLAIN_TEMPLATE = (
    "Paaiškink, kodėl renginys '{name}' ({topics}) gali būti naudingas studentui, kurio studijų dalykai: "
    "{subjects}. Sugeneruok 1-2 sakinius, susiedamas renginio temą su studento studijų sritimis. "
    "Atsakyk lietuviškai."
)
NO_SUBJECTS_TEXT = "tavo studijų dalykai"
# -------------------------------------------------------------------------------------

_PH = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def _pieces(template: str) -> list[tuple[str, str]]:
    """Split a template into ('lit', text) and ('col', name) pieces."""
    out, buf, pos = [], [], 0
    for m in _PH.finditer(template):
        buf.append(template[pos:m.start()])
        if m.group(0) in ("{{", "}}"):
            buf.append(m.group(0)[0])
        else:
            out.append(("lit", "".join(buf)))
            buf = []
            out.append(("col", m.group(1)))
        pos = m.end()
    buf.append(template[pos:])
    out.append(("lit", "".join(buf)))
    return [p for p in out if p != ("lit", "")]


def prompt_column(template: str, **cols: Column) -> Column:
    """Spark: the template filled from columns (NULL values become '')."""
    parts = [F.lit(v) if k == "lit" else F.coalesce(cols[v].cast("string"), F.lit("")) for k, v in _pieces(template)]
    return F.concat(*parts)


def prompt_sql(template: str, **exprs: str) -> str:
    """DuckDB: the same string as a ``concat`` expression over SQL expressions."""
    parts = []
    for k, v in _pieces(template):
        if k == "lit":
            parts.append("'" + v.replace("'", "''") + "'")
        else:
            parts.append(f"coalesce(CAST({exprs[v]} AS VARCHAR), '')")
    return "concat(" + ", ".join(parts) + ")"


def event_prompt(source: Column, detail_url: Column, detail_text: Column, city: Column) -> Column:
    """Event-page prompt chosen by source; meetup's city hint defaults to Vilnius."""
    hint = F.when(F.coalesce(city, F.lit("")) != "", city).otherwise(F.lit("Vilnius"))
    out = prompt_column(EVENT_TEMPLATES["other"], detail_url=detail_url, detail_text=detail_text)
    for src in ("kaveikti", "meetup", "litexpo"):
        out = F.when(source == src, prompt_column(EVENT_TEMPLATES[src], detail_url=detail_url,
                                                  detail_text=detail_text, city_hint=hint)).otherwise(out)
    return out
