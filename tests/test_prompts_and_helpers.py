"""P15 prompt jobs (R9/R10 job 1) and the session helpers."""

from pyspark.sql import functions as F

from unievents.operators.prompts import EVENT_TEMPLATES, SUBJECTS_TEMPLATE
from unievents.plans.scrape import event_prompts, subject_prompts
from unievents.session import ensure_checkpoint_dir


def test_subject_prompts(spark):
    req = spark.createDataFrame([(1, "https://u/plan", "1", "2"), (2, "https://u/plan", "3", "1"),
                                 (3, "ftp://u/plan", "1", "1")],
                                "request_id long, url string, from_semester string, to_semester string")
    pages = spark.createDataFrame([("https://u/plan", "<h1>Semestras 1</h1><p>Algebra</p>")], "url string, html string")
    prompts, rejected = subject_prompts(req, pages)
    p = prompts.collect()
    assert [r.request_id for r in p] == [1] and p[0].characters == len("Semestras 1 Algebra")
    assert p[0].prompt == SUBJECTS_TEMPLATE.format(from_semester=1, to_semester=2, text="Semestras 1 Algebra")
    assert sorted(r.request_id for r in rejected.collect()) == [2, 3]


def test_event_prompts_by_source(spark):
    pages = spark.createDataFrame([(1, "https://www.meetup.com/g/events/1/", "meetup", "", "<p>Talk</p>"),
                                   (2, "https://www.meetup.com/g/events/2/", "meetup", "Kaunas", "<p>Talk</p>"),
                                   (3, "https://www.litexpo.lt/en/events/x/", "litexpo", "", "<p>Expo</p>")],
                                  "page_id long, url string, source string, city string, html string")
    got = {r.page_id: r.prompt for r in event_prompts(pages).collect()}
    assert got[1] == EVENT_TEMPLATES["meetup"].format(city_hint="Vilnius", detail_url="https://www.meetup.com/g/events/1/",
                                                      detail_text="Talk")
    assert "City hint: Kaunas" in got[2]
    assert got[3] == EVENT_TEMPLATES["litexpo"].format(detail_url="https://www.litexpo.lt/en/events/x/", detail_text="Expo")


def test_checkpoint_dir_is_read_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_event_detail_prompt(spark):
    import datetime as dt

    from unievents.operators.prompts import EXPLAIN_TEMPLATE, NO_SUBJECTS_TEXT
    from unievents.plans.listing import event_detail
    ev = spark.createDataFrame([(1, "Hackathon", dt.date(2026, 3, 1), "10:00:00", "Vilnius", None, "Coding day", "")],
                               "event_id long, name string, date date, time string, place string, "
                               "price decimal(10,2), short_description string, source_url string")
    ec = spark.createDataFrame([(1, "IT"), (1, "")], "event_id long, category_name string")
    sub = spark.createDataFrame([(1, "Databases"), (2, "Algebra")], "subject_id long, name string")
    ss = spark.createDataFrame([(7, 1, 5), (7, 2, None)], "student_id long, subject_id long, interest int")
    ask = spark.createDataFrame([(1, 7, 1), (2, 8, 1), (3, 7, 99)], "request_id int, student_id long, event_id long")
    r, none, lost = event_detail(ev, ec, ss, sub, ask).orderBy("request_id").collect()
    assert r.topics == "Coding day, IT" and r.student_subjects == "Algebra, Databases"
    assert r.prompt == EXPLAIN_TEMPLATE.format(name="Hackathon", topics="Coding day, IT", subjects="Algebra, Databases")
    assert lost.error == "Event not found" and lost.prompt is None and r.error is None
    assert none.student_subjects == NO_SUBJECTS_TEXT
