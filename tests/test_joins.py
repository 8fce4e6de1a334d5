"""J7, J8, J10, J11 on small batches."""

import pytest
from pyspark.sql import functions as F

from unievents.operators.joins import attach_ratings, check_refs, resolve_names, split_new
from unievents.operators.ordering import newest_first_keys, number_in_groups, number_rows
from unievents.plans.listing import overlay_counts, requested_student_subjects, student_subjects, subject_base, subject_overlay


def test_refs_and_new_keys(spark):
    dim = spark.createDataFrame([(1,), (2,)], "subject_id long")
    batch = spark.createDataFrame([(10, 1), (11, 3), (12, 2)], "batch_pos long, subject_id long")
    ok, failed = check_refs(batch, dim, "subject_id", reason="Subject not found")
    assert sorted(r.batch_pos for r in ok.collect()) == [10, 12]
    assert [(r.batch_pos, r.reason) for r in failed.collect()] == [(11, "Subject not found")]
    flagged = {r.batch_pos: r.is_new for r in split_new(batch, dim, ["subject_id"]).collect()}
    assert flagged == {10: False, 11: True, 12: False}


def test_name_joins(spark):
    names = spark.createDataFrame([(1, 0, "Algebra"), (1, 1, " algebra "), (1, 2, "Fizika")],
                                  "prompt_id long, pos int, name string")
    sub = spark.createDataFrame([(5, "ALGEBRA"), (3, "algebra"), (7, "Chemija")], "subject_id long, name string")
    ids = {r.pos: r.subject_id for r in resolve_names(names, sub).collect()}
    assert ids == {0: 3, 1: 3, 2: None}  # trimmed, case-insensitive, lowest id
    ratings = spark.createDataFrame([(7, "Algebra", 2, 1), (7, "Algebra", 5, 2), (8, "Fizika", 4, 1)],
                                    "student_id int, name string, interest int, pos int")
    got = {r.pos: r.interest for r in attach_ratings(names.withColumn("student_id", F.lit(7)), ratings).collect()}
    assert got == {0: 5, 1: 0, 2: 0}  # exact name only; the last duplicate rating wins


def test_student_subject_requests(spark):
    """Each request has its row of the student's whole list; no list of ids is collected."""
    sub = spark.createDataFrame([(1, "b", 7), (2, "a", None), (3, "c", 7), (4, "a", 8)], "subject_id long, name string, category_id long")
    cat = spark.createDataFrame([(7, "IT")], "category_id long, name string")
    ss = spark.createDataFrame([(k, k % 4 + 1, k % 5 + 1) for k in range(40)], "student_id long, subject_id long, interest int")
    students = spark.createDataFrame([(k % 45,) for k in range(90)] + [(None,)], "student_id long")
    whole = {(r.student_id, r.subject_id): r for r in student_subjects(sub, cat, ss, students).collect()}
    assert len(whole) == 45 * 4 and [whole[44, k].position for k in (2, 4, 1, 3)] == [1, 2, 3, 4]
    asked = [(k, k % 6) for k in range(45)] * 2 + [(None, 1), (3, None)]
    got = requested_student_subjects(sub, cat, ss, spark.createDataFrame(asked, "student_id long, subject_id long")).collect()
    assert sorted((r.student_id, r.subject_id) for r in got) == sorted({(k, s) for k, s in asked if k is not None and s in (1, 2, 3, 4)})
    assert all(r == whole[r.student_id, r.subject_id] for r in got)
    assert whole[8, 1].interest == 4 and whole[8, 1].category_name == "IT" and whole[8, 2].interest is None
    # base and overlay give the whole list back, for students with and without links
    base = subject_base(sub, cat)
    overlay = subject_overlay(base, ss)
    own = {(r.student_id, r.subject_id): r for r in overlay.collect()}
    assert len(own) == 40 and all(own[k] == whole[k] for k in own)
    plain = {r.subject_id: r for r in base.collect()}
    rest = [r for k, r in whole.items() if k not in own]
    assert all(r.interest is None and r.interest_description == rest[0].interest_description and r.position == plain[r.subject_id].position for r in rest)
    counts = {r.student_id: (r.n_linked, r.n_rated, r.n_base) for r in overlay_counts(students.where("student_id is not null").distinct(), base, overlay).collect()}
    assert len(counts) == 45 and counts[3] == (1, 1, 3) and counts[44] == (0, 0, 4)


@pytest.mark.parametrize("days", [1, 3])
def test_positions_of_one_day(spark, days):
    """All rows on one day, with ties and null times, dealt over several partitions: positions
    are dense and in order, in one list and in groups; a group is not one task."""
    rows = [(k, f"2024-01-{k % days + 1:02d}", None if k % 11 == 0 else f"{k % 24:02d}:00:00", k % 7 and 1) for k in range(5000)]
    ev = spark.createDataFrame(rows, "event_id long, date string, time string, g int").repartition(6)
    order = lambda r: ([-ord(c) for c in r[1]], r[2] is None, [-ord(c) for c in r[2] or ""], r[0])
    got = {r.event_id: r.position for r in number_rows(ev, newest_first_keys(), "position").collect()}
    assert [got[r[0]] for r in sorted(rows, key=order)] == list(range(1, 5001))
    ranked = number_in_groups(ev, ["g"], newest_first_keys())
    got = {r.event_id: r["rank"] for r in ranked.collect()}
    for g in (0, 1):
        assert [got[r[0]] for r in sorted((r for r in rows if r[3] == g), key=order)] == list(range(1, 1 + sum(r[3] == g for r in rows)))
    assert number_rows(ev.where("false"), newest_first_keys(), "position").count() == 0


def test_numbered_rows_are_not_dealt_again(spark):
    """The counts of the sort's partitions go to the rows, and the sort leaves no shuffle files."""
    import glob
    rows = spark.range(200).selectExpr("id", "id % 7 AS k").repartition(4, "k")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in local for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    numbered = number_rows(rows, ["k", "id"], "n")
    assert not files() - before
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert [r.id for r in numbered.orderBy("n").collect()] == sorted(range(200), key=lambda i: (i % 7, i))
