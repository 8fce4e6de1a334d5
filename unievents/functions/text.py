"""Text column expressions. All run in the JVM but the two that read markup (``page_text``,
``page_hrefs``), which call the parser of ``functions.soup``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .soup import parsed

# ---- fixed values -------------------------------------------------------------------
# Characters Python's str.strip() treats as whitespace (the reference trims with it).
WS_CLASS = (r"[\t\n\x{000B}\f\r\x{001C}-\x{001F} \x{0085}\x{00A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# -------------------------------------------------------------------------------------

_WHITESPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())  # the same characters


def trim_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip()`` does
    (``F.trim`` removes spaces only). By a list of characters: a pattern takes several times
    as long."""
    return F.btrim(c, F.lit(_WHITESPACE))


def category_key(c: Column) -> Column:
    """Matching key for category names: ``lower(trim(name))``; blank -> NULL."""
    k = F.lower(trim_ws(c))
    return F.when(k != "", k)


def page_text(html: Column, cap: int | None = None) -> Column:
    """Visible text of a page. Each text node is entity-decoded and trimmed, blank ones
    dropped, the rest joined by one space. The text is whole unless the caller gives a ``cap``
    in characters. Inner whitespace of a node is kept."""
    text = parsed(html)["text"]
    return text if cap is None else F.left(text, F.lit(cap))


def page_hrefs(html: Column) -> Column:
    """The href of every ``a`` that has one, in document order, decoded and trimmed; the
    last of repeated ones, and empty where it has no value. Comments and script and style
    bodies hold no tags."""
    return parsed(html)["links"]


def normalize_url(url: Column) -> Column:
    """P5: ``scheme://netloc/path`` with query and fragment dropped, trailing slashes
    stripped and exactly one ``/`` appended."""
    base = F.regexp_replace(url, r"[?#].*$", "")
    return F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/"))


def url_host(url: Column) -> Column:
    """Authority (netloc, port kept) of an absolute URL; '' when absent."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Full case folding by the standard library's rule: characters that fold to one, what
    they fold to, and those that fold to several."""
    all_ = [(c, c.casefold()) for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    changed = [(c, f) for c, f in all_ if f != c]
    one = [(c, f) for c, f in changed if len(f) == 1]
    return "".join(c for c, _ in one), "".join(f for _, f in one), [(c, f) for c, f in changed if len(f) > 1]


_FOLD_FROM, _FOLD_TO, _FOLD_LONG = _folds()
_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def casefold_key(c: Column) -> Column:
    """M4: case-insensitive key, equal to Python's ``casefold``."""
    ascii_ = F.translate(c, _ASCII_UPPER, _ASCII_UPPER.lower())
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _FOLD_LONG])
    longer = F.aggregate(pairs, ascii_, lambda text, p: F.replace(text, p["a"], p["b"]))
    some = F.lit("[" + "".join(a for a, _ in _FOLD_LONG) + "]")
    folded = F.translate(F.when(F.regexp_like(ascii_, some), longer).otherwise(ascii_), _FOLD_FROM, _FOLD_TO)
    return F.when(F.regexp_like(c, F.lit(r"[^\x00-\x7F]")), folded).otherwise(ascii_)
