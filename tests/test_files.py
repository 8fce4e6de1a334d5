"""IO2-IO7 round trips through the file sources and sinks."""

import os
import tempfile

import pytest

from unievents.sources.files import (load_events_json, load_subjects_json, write_events_json,
                                     write_subjects_json)


def test_subjects_and_events_files(spark):
    root = tempfile.mkdtemp(prefix="unievents-io-")
    lists = spark.createDataFrame([("https://u/1", 1, 2, ["Algebra", "Fizika ą"])],
                                  "url string, from_semester int, to_semester int, study_subjects array<string>")
    write_subjects_json(lists, os.path.join(root, "subjects"))
    back = load_subjects_json(spark, os.path.join(root, "subjects"), multi_line=False).collect()
    assert back[0].study_subjects == ["Algebra", "Fizika ą"] and back[0].to_semester == 2

    saved = spark.createDataFrame(
        [("https://l/1", 1, "A", "2026-01-02", "10:00", "Hall", "0.00", ["IT"], "Event: A", "https://e/1")],
        "url string, event_id bigint, name string, date string, time string, place string, price string, "
        "categories array<string>, short_description string, source_url string")
    failed = spark.createDataFrame([("https://l/2", "https://e/9", None, "Could not parse model JSON output.")],
                                   "url string, source_url string, name string, error string")
    saved = saved.withColumn("source", saved.url.substr(1, 0)).withColumn("city", saved.url.substr(1, 0))
    write_events_json(saved.drop("source", "city"), failed, os.path.join(root, "events"))
    ev = load_events_json(spark, os.path.join(root, "events"), multi_line=False).collect()
    assert [(r.url, r.name, r.categories) for r in ev] == [("https://l/1", "A", ["IT"])]


def test_missing_file_is_an_error(spark):
    with pytest.raises(Exception):
        load_subjects_json(spark, "/nonexistent/unievents/latest_subjects.json").collect()


def test_single_pretty_document(spark):
    root = tempfile.mkdtemp(prefix="unievents-io-")
    path = os.path.join(root, "latest_subjects.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "url": "https://u",\n  "from_semester": 1,\n  "to_semester": 4,\n'
                '  "study_subjects": [\n    "Programavimas",\n    "Duomenų bazės"\n  ]\n}\n')
    r = load_subjects_json(spark, path).collect()
    assert r[0].study_subjects == ["Programavimas", "Duomenų bazės"]
