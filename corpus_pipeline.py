"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it
returns is written as Parquet to the shared folder and read as the next one's docs. All but
the last return the columns of their docs. Rows that share a doc_id are one document: they
stay or go together; rows without one likewise. Empty tables go through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unievents.llm.common import keep, load
from unievents.llm.decontaminate import find_leaks
from unievents.llm.line_dedup import dedup_lines
from unievents.llm.packing import pack_documents
from unievents.llm.simhash_dedup import simhash_dedup
from unievents.llm.toxicity import score_toxicity

# The classifier and the sketches are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _numbered(df: DataFrame) -> DataFrame:
    """Columns by position, so that a column of any name can be in the way of none."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, does not find toxic."""
    names = docs.columns
    scored = _numbered(score_toxicity(docs, load(spark, sf_dir, "labels")))
    kept = scored.where(F.col(scored.columns[-1]) == 0)
    return kept.select(*kept.columns[:len(names)]).toDF(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id holds as well. A
    null text stays null; ``n_chars`` is counted again where a text is not null."""
    names = docs.columns
    deduped = _numbered(dedup_lines(docs))
    text, kept = f"c{names.index('text')}", F.col(f"c{len(names)}")
    changed = {text: F.when(F.col(text).isNotNull(), kept)}
    if "n_chars" in names:
        count = f"c{names.index('n_chars')}"
        kind = deduped.schema[count].dataType
        changed[count] = F.when(F.col(text).isNotNull(), F.length(kept).cast(kind)).otherwise(F.col(count))
    return deduped.withColumns(changed).select(*deduped.columns[:len(names)]).toDF(*names)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every SimHash component the document of the smallest id."""
    found = simhash_dedup(docs)
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("kept_id")).distinct()
    return _on_id(docs, stay, "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = keep(find_leaks(docs, load(spark, sf_dir, "benchmark")), "leaks")
    return _on_id(docs, leaks.select(F.col("id").alias("kept_id")).distinct(), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


def _on_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    plain = _numbered(docs)
    return plain.join(ids, F.col(f"c{docs.columns.index('doc_id')}").eqNullSafe(F.col("kept_id")), how).toDF(*docs.columns)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
