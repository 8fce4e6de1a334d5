"""Page text and links of odd markup; case folding."""

from pyspark.sql import functions as F

from unievents.functions.text import casefold_key, page_hrefs, page_text, trim_ws

# html, its text, its links (hand-made)
ODD = [
    ("<p>5 < 6 and 9 > 8</p>", "5 < 6 and 9 > 8", []),
    ('<p title="a > b">text</p>', "text", []),
    ("<p>&copy 2024 &amp more</p>", "© 2024 & more", []),
    ("<p>AT&T and R&D;</p>", "AT&T and R&D;", []),
    ("before<script>var a = '<p>code</p>';", "before", []),
    ("<p>a</p><style>p{x}", "a", []),
    ("a<noscript>b<p>c", "a", []),
    ("<div>a<noscript>b</div>c", "a c", []),
    ("<noscript>a<noscript>b</noscript>c</noscript>d", "d", []),
    ("<script>x = '<!--';</script>a<!-- c -->b", "a b", []),
    ("<style><script></style>a<script></script>b", "a b", []),
    ("a<template>b</template><ruby>c<rt>d</rt></ruby>", "a c", []),
    ("<![CDATA[ x < y ]]>z", "x < y z", []),
    ("<?php echo 1 ?>a", "a", []),
    ("a <> b", "a <> b", []),
    ("1 </ 2", "1 </ 2", []),
    ("x<br/>y<img alt='1 > 0'>z", "x y z", []),
    ("&#128;&#x1F600;&amp;lt;&notin;&notit;", "€😀&lt;∉¬it;", []),
    ('<a href="x" title="1 > 0">l</a><a href=y>m</a>', "l m", ["x", "y"]),
    ('<a href=one HREF=" two ">l</a><a href>m</a><a name=q>n</a>', "l m n", ["two", ""]),
    ('<noscript><a href="/n">n</a></noscript><!-- <a href="c"> --><script>"<a href=s>"</script>', "", ["/n"]),
    ("<a href='a&amp;b' data-x='>'>q</a>", "q", ["a&b"]),
    ("", "", []),
    ("< ", "<", []),
]

def test_odd_pages(spark):
    """Expected text and links of each, one by one."""
    rows = [(k, html) for k, (html, _, _) in enumerate(ODD)] + [(-1, None)]
    frame = spark.createDataFrame(rows, "k int, html string").repartition(3)
    got = {r.k: (r.t, r.l) for r in frame.select("k", page_text(F.col("html")).alias("t"), page_hrefs(F.col("html")).alias("l")).collect()}
    assert {k: got[k] for k in range(len(ODD))} == {k: (text, links) for k, (_, text, links) in enumerate(ODD)}
    assert got[-1] == (None, None)


def test_long_tags(spark):
    """Attributes of any length and number need no stack; text of any length stays whole."""
    html = "<a " + " ".join(f"k{i}='{i}'" for i in range(20_000)) + f" href='{'x' * 200_000}'>{'y ' * 200_000}</a>"
    t, l = spark.createDataFrame([(html,)], "html string").select(page_text(F.col("html")), page_hrefs(F.col("html"))).first()
    assert t == ("y " * 200_000).strip() and l == ["x" * 200_000]


def test_casefold(spark):
    """Every character, and words of several, as Python folds them."""
    chars = [chr(c) for c in range(0x1E950) if not 0xD800 <= c < 0xE000]
    words = ["ΟΔΟΣ", "οδος", "οδοσ", "Straße", "STRASSE", "ﬁne ſea", "İstanbul", "ŉ ǰ", "Ꭰꭰ", "ΐ ᾳ", ""]
    texts = words + ["".join(chars[k:k + 50]) for k in range(0, len(chars), 50)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(casefold_key(F.col("t"))).collect()] == [t.casefold() for t in texts]


def test_trim(spark):
    """Every white-space character at both ends, none within, and nothing else."""
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    texts = [f"{a}{b}x {a}y{b}{a}" for a in spaces for b in spaces[:3]] + ["", "  ", "​x​", None, "ž " * 3, "﻿q", " é　"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(trim_ws(F.col("t"))).collect()]
    assert got == [t and t.strip() for t in texts]


def test_a_batch_holds_one_parsed_page_at_a_time(monkeypatch):
    import weakref

    import pandas as pd

    from unievents.functions import soup
    made, most, parse = [], [], soup.parse_page

    def counted(html):
        page = parse(html)
        made.append(weakref.ref(page))
        most.append(sum(r() is not None for r in made))
        return page

    monkeypatch.setattr(soup, "parse_page", counted)
    got = soup.parsed.func(pd.Series(["<a href='/1'>x</a>"] * 50 + [None]))
    assert list(got["text"]) == ["x"] * 50 + [None] and got["links"][49] == ["/1"]
    assert max(most) <= 2
