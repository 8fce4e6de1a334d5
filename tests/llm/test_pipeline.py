import pytest

import corpus_pipeline as P

from . import brute
from .conftest import odd_rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in odd_rows()]
    rows += [(3000 + k, f"plain clean words number {k} with the of and to " * 4, "en", "s", 9) for k in range(100)]
    rows += [(4000 + k, f"plain words number {k} with vilest hateful things {k}", "en", "s", 9) for k in range(60)]
    rows += [(5000, "first the test item one two three four five six seven eight then more", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    marks = [(3000 + k, 0) for k in range(100)] + [(4000 + k, 1) for k in range(60)]
    spark.createDataFrame(marks, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = P.toxicity(spark, docs, sf_dir)
    ids = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == docs.columns and not ids & set(range(4000, 4060)) and ids >= set(range(3000, 3100))

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lines = P.line_dedup(spark, docs, sf_dir)
    assert lines.schema == docs.schema and lines.count() == len(rows)
    assert all(r.text is None and r.n_chars == 0 or len(r.text) == r.n_chars for r in lines.collect())

    stay = P.simhash_near_dedup(spark, docs, sf_dir)
    assert stay.columns == docs.columns
    prints = [brute.simhash(t) for _, t in rows]
    root = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {c: min((rows[k][0] for k in range(len(rows)) if root[k] == c and rows[k][0] is not None), default=None) for c in set(root)}
    assert {r.doc_id for r in stay.collect()} == {i for (i, _), c in zip(rows, root) if i == least[c]}

    without = P.decontamination(spark, docs, sf_dir)
    assert without.columns == docs.columns and without.count() == len(rows) - 1 and without.where("doc_id = 5000").isEmpty()


def test_run_packs_what_all_stages_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = P.keep(stage(spark, docs, sf_dir), name)
    left = {r.doc_id for r in docs.collect()}
    out = P.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == left and 5000 not in left
    assert sorted(r.start for r in out if r.doc_id == min(x for x in left if x is not None))[0] == 0


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"),
                         ("labels", "doc_id bigint, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_as_dealt():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
