"""Licence scans by diagonal voting, with DataFrame functions only.

Every two consecutive words of a text are hashed and joined to the places of the same two
words in licence templates. A match at word i of the text and word j of a template votes
for the diagonal i - j. Votes are counted per diagonal, neighbouring diagonals (a word
more or less within the passage) are merged to spans, and a span is verified: enough of
the template's word pairs must occur in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unievents.llm.common import pick

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # counts words without lower-casing

# Phrases that make a base label, and further passages of public licences.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}

SLICE_WORDS = 64  # word pairs that are exploded from one row


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), "")


def _template_pairs(df: DataFrame, base: dict[str, str], passages: dict[str, str]) -> DataFrame:
    """(template, size, label, is_base, at, first, second, hash): a row for every two
    consecutive words of a template; a few hundred rows from the parameters."""
    listed = [(t, l, True) for t, l in base.items()] + [(t, l, False) for t, l in passages.items()]
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(l).alias("label"), F.lit(b).alias("is_base"),
                              F.split(F.lit(t), " ").alias("w")) for k, (t, l, b) in enumerate(listed)])
    each = df.sparkSession.range(1).select(F.explode(rows).alias("t")).select("t.*")
    at = each.select("template", "label", "is_base", F.size("w").alias("size"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("at"))
    return at.select("template", "label", "is_base", "size", "at", F.col("w")[F.col("at")].alias("first"), F.col("w")[F.col("at") + 1].alias("second"),
                     F.xxhash64(F.col("w")[F.col("at")], F.col("w")[F.col("at") + 1]).alias("hash"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None,
                  passages: dict[str, str] | None = None, shift: int = 2, least: float = 0.8, whole_below: int = 10) -> tuple[DataFrame, DataFrame]:
    """(spans, summary).

    spans: (id, text_hash, label, is_base, template, start, end, coverage), one row per
    verified span: the words from ``start`` up to ``end`` (from 0) on diagonals at most
    ``shift`` apart, with ``least`` of the template's word pairs, or all of them where there
    are fewer than ``whole_below``; of a base phrase its words must stand consecutively. Template words are in lower case with one space between; a
    template has two words at least.

    summary: (id, n_words, n_base, first_word, last_word, base_labels, labels, score), one
    row per row of ``docs``; score is the greatest coverage. Null and empty texts have no
    words; texts without spans have null first_word and last_word, empty labels and score
    0. Repeated rows have equal results; a null id is an id like others; no rows give no
    rows.

    All word pairs meet the templates in a broadcast join (a few hundred rows); only
    matches are shuffled. Texts are known by id and hash. A text of any length is first cut
    into slices of words that overlap by one, so that work grows with its length; other
    columns of any name are ignored.
    """
    base, passages = BASE if base is None else base, PASSAGES if passages is None else passages
    plain = pick(docs, id=id_col, text=text_col)
    keyed = plain.select("id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    # a pair's row carries the few words of its slice, not those of the text
    starts = F.when(F.size("w") > 1, F.sequence(F.lit(0), F.size("w") - 2, F.lit(SLICE_WORDS))).otherwise(F.array().cast("array<int>"))
    slices = F.transform(starts, lambda s: F.struct(s.alias("begin"), F.slice("w", s + 1, F.lit(SLICE_WORDS + 1)).alias("w")))
    sliced = keyed.select("id", "text_hash", F.explode(slices).alias("part")).select("id", "text_hash", "part.begin", "part.w")
    paired = sliced.select("id", "text_hash", "begin", "w", F.posexplode(
        F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1)))).alias("here", "hash"))
    pairs = F.broadcast(_template_pairs(docs, base, passages))
    votes = (paired.join(pairs, "hash")
             .where((F.get("w", F.col("here")) == F.col("first")) & (F.get("w", F.col("here") + 1) == F.col("second")))
             .withColumn("pos", F.col("begin") + F.col("here"))
             .select("id", "text_hash", "template", "label", "is_base", "size", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal")))
    place = ["id", "text_hash", "template", "label", "is_base", "size"]
    diagonals = (votes.distinct()  # rows repeated as a whole vote once
                 .groupBy(*place, "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("start"), (F.max("pos") + 2).alias("end")))
    # neighbours merge if they are near in the text as well; a base phrase is one diagonal
    along = Window.partitionBy(*place).orderBy("diagonal")
    apart = F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(along) > shift)
    needed = F.when(F.col("size") - 1 < whole_below, F.col("size") - 1).otherwise(least * (F.col("size") - 1))
    spans = (diagonals.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(along))
             .groupBy(*place, "span").agg(F.sum("votes").alias("votes"), F.max("votes").alias("most"), F.min("start").alias("start"), F.max("end").alias("end"))
             .withColumn("coverage", F.least(F.lit(1.0), F.col("votes") / (F.col("size") - 1)))
             .where(F.when(F.col("is_base"), F.col("votes") == F.col("size") - 1)
                    .otherwise((F.col("most") >= needed)
                               | (F.col("votes") >= needed) & (F.col("end") - F.col("start") <= F.col("size") + 2 * shift))))
    found = spans.groupBy(F.col("id").alias("i"), F.col("text_hash").alias("h")).agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("is_base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"))
    counted = plain.select("id", F.xxhash64("text").alias("text_hash"),
                           F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _BREAK_ANY_CASE), "")).cast("bigint").alias("n_words"))
    summary = counted.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left").select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint"),
        F.col("last_word").cast("bigint"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return spans.select("id", "text_hash", "label", "is_base", "template", "start", "end", "coverage"), summary
