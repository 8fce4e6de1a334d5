"""Text and links of pages by the standard library's parser, in Arrow batches.

A state machine is what reads markup rightly: ``<`` in text, ``>`` in an attribute, a
reference without its semicolon, an element that is never closed. Patterns over columns do
not, and the ones that were here took twice the parser's time.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# ---- fixed values -------------------------------------------------------------------
# Elements whose content is not page text: dropped ones, and those whose strings are none
# of the page's own (templates, ruby annotations).
HIDDEN_ELEMENTS = frozenset({"script", "style", "noscript", "template", "rt", "rp"})
# Elements without an end tag.
VOID_ELEMENTS = frozenset("""
    area base basefont bgsound br col command embed frame hr image img input isindex keygen
    link menuitem meta nextid param source spacer track wbr""".split())
# -------------------------------------------------------------------------------------


class PageParser(HTMLParser):
    """Collects text nodes outside hidden elements, and the href of every ``a``.

    An end tag closes the nearest open element of its name and all that are open within it;
    one that closes nothing is ignored. Of repeated attributes the last counts, and an href
    without a value is empty. Neighbouring pieces of text form one node up to the next tag,
    comment or declaration.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.links: list[str] = []
        self._open: list[str] = []
        self._hidden = 0
        self._held: list[str] = []

    def _end_node(self) -> None:
        node = "".join(self._held).strip()
        if node:
            self.nodes.append(node)
        self._held = []

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._held.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.handle_startendtag(tag, attrs)
        if tag not in VOID_ELEMENTS:
            self._open.append(tag)
            self._hidden += tag in HIDDEN_ELEMENTS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._end_node()
        if tag == "a" and (found := [v for k, v in attrs if k == "href"]):
            self.links.append((found[-1] or "").strip())

    def handle_endtag(self, tag: str) -> None:
        self._end_node()
        while tag in self._open:
            closed = self._open.pop()
            self._hidden -= closed in HIDDEN_ELEMENTS
            if closed == tag:
                break

    def handle_comment(self, data: str) -> None:
        self._end_node()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data: str) -> None:
        self._end_node()
        if data[:6].upper() == "CDATA[":
            self.handle_data(data[6:])
            self._end_node()


def parse_page(html: str) -> PageParser:
    """The parsed page; markup that the parser gives up on ends it there."""
    parser = PageParser()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # a marked section of unknown kind
        pass
    parser._end_node()
    return parser


@pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]))
def parsed(html: pd.Series) -> pd.DataFrame:
    """(text, links) of each page, null for null: the text nodes joined by one space."""
    text, links = [], []
    for x in html:  # a page's parser and its nodes go before the next page is read
        page = None if x is None else parse_page(x)
        text.append(page and " ".join(page.nodes))
        links.append(page and page.links)
    return pd.DataFrame({"text": text, "links": links})
