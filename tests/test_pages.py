"""P1/P3-P5/P14 and M2-M4 on small hand-written inputs."""

from pyspark.sql import functions as F

from unievents.operators.pages import (page_links, page_texts, resolve_links, validate_semesters,
                                       validate_urls)
from unievents.operators.responses import response_category, response_subjects


def test_page_text_and_links(spark):
    html = ('<html><head><title> T &amp; Co </title><style>p{x}</style><script>var a="<p>";</script></head>'
            '<body><!-- c --><p>  Hello   world </p><a href=" /a/b?x=1#f ">A</a><a href="../c/./d">B</a>'
            '<noscript>skip</noscript><a href="//cdn.example.org/x/">C</a></body></html>')
    pages = spark.createDataFrame([(1, "https://ex.com/base/page.html?q=1", html)], "page_id long, url string, html string")
    t = page_texts(pages).collect()[0]
    assert t.text == "T & Co Hello   world A B C" and t.characters == len(t.text)
    links = resolve_links(page_links(pages)).orderBy("pos").collect()
    assert [r.full_url for r in links] == ["https://ex.com/a/b?x=1#f", "https://ex.com/c/d",
                                           "https://cdn.example.org/x/"]
    assert [r.link for r in links] == ["https://ex.com/a/b/", "https://ex.com/c/d/", "https://cdn.example.org/x/"]


def test_validations(spark):
    df = spark.createDataFrame([(1, "ftp://x", "1", "2"), (2, "https://x", "3", "2"), (3, "https://x", "0", "2"),
                                (4, "https://x", "1", "9"), (5, "https://x", None, "2"), (6, "https://x", "2", "4")],
                               "id int, url string, from_semester string, to_semester string")
    ok, bad = validate_semesters(df)
    reasons = {r.id: r.reason for r in bad.collect()}
    assert reasons == {2: "fromSemester cannot be greater than toSemester.",
                       3: "fromSemester and toSemester must be at least 1.",
                       4: "fromSemester and toSemester must be at most 8.",
                       5: "Fields 'fromSemester' and 'toSemester' are required."}
    ok2, bad2 = validate_urls(ok)
    assert [r.id for r in ok2.collect()] == [6] and [r.id for r in bad2.collect()] == [1]


def test_subjects_from_responses(spark):
    rows = [(1, '{"study_subjects": ["Programavimas", "", "Duomenu bazes", "   ", 5, "programavimas"]}'),
            (2, "```json\n{\"study_subjects\": [\"A\"]}\n```"),
            (3, "- Algebra\n• Fizika\n{\n\"study_subjects\": [\n"),
            (4, ""), (5, "no json here")]
    df = spark.createDataFrame(rows, "prompt_id long, response string")
    got = {}
    for r in response_subjects(df).collect():
        got.setdefault(r.prompt_id, []).append((r.pos, r.name))
    assert [n for _, n in sorted(got[1])] == ["Programavimas", "Duomenu bazes"]
    assert [n for _, n in sorted(got[2])] == ["A"]
    assert [n for _, n in sorted(got[3])] == ["Algebra", "Fizika"]
    assert 4 not in got and [n for _, n in got[5]] == ["no json here"]


def test_category_responses(spark):
    df = spark.createDataFrame([(1, "a", '```json\n{"category": " IT "}\n```'), (2, "b", ""),
                                (3, "c", '{"category": ""}'), (4, "d", "The answer: {\"category\": \"Law\"} ok")],
                               "prompt_id long, subject string, response string")
    ok, failed = response_category(df)
    assert {r.prompt_id: r.category for r in ok.collect()} == {1: "IT", 4: "Law"}
    assert {r.prompt_id: r.error for r in failed.select("prompt_id", F.col("error")).collect()} == {
        2: "Could not parse model JSON output.", 3: "Model returned an empty category"}


def test_resolve_matches_urljoin(spark):
    from urllib.parse import urljoin

    from unievents.operators.pages import resolve_href
    bases = ["https://ex.com/base/page.html?q=1#x", "http://h.org", "http://h.org/a/b/", "https://h:8080/a/b/c",
             "http://h.org/a//b/c"]
    hrefs = ["/a/b?x=1#f", "../c/./d", "//cdn.x/y/../z", "g", "./g/", "..", "../..", "../../../g", "/./a/../b",
             "?z", "#f", "", "a//b/../c", "http://o.com/a/../b", "/a//b/c/..", "g;x?y#s", ".", "../g?q", "x/", "/"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select(resolve_href(F.col("b"), F.col("h"))).collect()
    assert [g[0] for g in got] == [urljoin(b, h) for b, h in rows]
