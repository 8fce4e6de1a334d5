"""F13 by an index: a batch of keyword searches without scanning the events.

The index holds for every place of a lower-cased field the piece of up to ``GRAM`` characters
that starts there, with its event; the grams (one to ``GRAM`` characters) are the beginnings
of the pieces. For each gram it has the number of events in which it occurs. A word occurs in
a field only if all of its grams do, so a search reads the postings of its rarest gram and
checks these events exactly; a search of grams only that a large share of the events holds
reads these.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, trim_ws
from ..session import ensure_checkpoint_dir, shuffles_removed, spread

# ---- fixed values -------------------------------------------------------------------
# Longest gram. A word up to this length is a gram itself, so that a search reads about as
# many postings as it has hits; of a longer word the rarest piece is read.
GRAM = 6
# A gram that more than one row in so many holds has a count but no postings: a search of
# such grams only has its answer in a large share of the rows, and reads these.
COMMON = 2
# Bits of the table in which the grams that searches read are marked (16.8 million, at most
# 262,144 rows): of other grams about one posting in (this / marked grams) is read in vain.
MARK_BITS = 24
# So many searches at most, those whose rarest grams occur most, are sent to the postings, so
# that these need not be dealt by gram.
SENT = 1 << 16
# -------------------------------------------------------------------------------------


def grams_of(text: Column, n: int) -> Column:
    """The distinct grams of ``n`` characters."""
    return F.array_distinct(F.transform(_numbers(F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))


def _numbers(n: Column) -> Column:
    """1 to ``n``, none for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _by_gram(pieces: DataFrame) -> DataFrame:
    """``pieces`` with a row for each ``gram`` that is its beginning."""
    return pieces.withColumn("long", F.explode(_numbers(F.length("piece")))) \
        .withColumn("gram", F.left("piece", "long")).drop("piece", "long")


@dataclass(frozen=True)
class KeywordIndex:
    """``pieces`` (piece, id), sorted in each file, and ``counts`` (gram, n, common), both
    written; of the ``fields`` of the table whose key is ``key``. ``postings`` (gram, id) are
    the beginnings of the pieces; common grams have none."""

    pieces: DataFrame
    counts: DataFrame
    fields: tuple[str, ...]
    key: str

    @property
    def postings(self) -> DataFrame:
        common = F.broadcast(self.counts.where("common").select("gram"))
        return _by_gram(self.pieces).join(common, "gram", "left_anti").select("gram", "id")

    def postings_of(self, grams: DataFrame) -> DataFrame:
        """(gram, id) for ``grams`` (gram), which are not common, and few others that share a
        mark: a join with the grams then deals these alone, however many postings there are."""
        slot = F.pmod(F.xxhash64("gram"), F.lit(1 << MARK_BITS))
        row, bit = F.shiftright(slot, 6).alias("row"), slot.bitwiseAND(63).cast("int")
        marks = grams.select(row, bit.alias("bit")).groupBy("row") \
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"))
        return _by_gram(self.pieces).withColumn("row", row).join(F.broadcast(marks), "row") \
            .where(F.getbit("bits", bit) == 1).select("gram", "id")


def build_keyword_index(df: DataFrame, fields: list[str], key: str = "event_id", root: str | None = None) -> KeywordIndex:
    """Index of ``df`` under ``root`` (a new folder in the shared one unless given). The rows
    are dealt once and each task writes the pieces of its own, sorted: neither pieces nor
    grams are dealt. Ids that rise within a piece take few bytes. A gram that a row repeats
    counts again. A row has a bounded number of grams, so common ones are few."""
    spark = df.sparkSession
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/keyword-index-{uuid.uuid4().hex}"
    texts = F.array_distinct(F.array(*[F.coalesce(F.lower(F.col(f).cast("string")), F.lit("")) for f in fields]))
    with shuffles_removed(spark):
        spread(df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), texts.alias("texts"))) \
            .select("id", F.explode("texts").alias("text")) \
            .select("id", "text", F.explode(_numbers(F.length("text"))).alias("at")) \
            .select(F.substr("text", "at", F.lit(GRAM)).alias("piece"), "id") \
            .sortWithinPartitions("piece", "id").write.option("parquet.writer.version", "PARQUET_2_0").parquet(f"{root}/pieces")
        pieces = spark.read.schema("piece string, id bigint").parquet(f"{root}/pieces")
        n = _by_gram(pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))).groupBy("gram").agg(F.sum("n").alias("n"))
        n.withColumn("common", F.col("n") * COMMON > df.agg(F.count(F.lit(1))).scalar()).write.parquet(f"{root}/counts")
    counts = spark.read.schema("gram string, n bigint, common boolean").parquet(f"{root}/counts")
    return KeywordIndex(spark.read.schema("piece string, id bigint").parquet(f"{root}/pieces"), counts, tuple(fields), key)


def search_index(index: KeywordIndex, df: DataFrame, searches: DataFrame) -> DataFrame:
    """(search_id, key): for each search (search_id, text) the rows of ``df``, the indexed
    table, that ``keyword_search`` finds. A search without words finds every row; repeated
    searches of one id and text are one; null texts find nothing. The searches with their
    rarest grams are written once."""
    spark = searches.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keyword-searches-{uuid.uuid4().hex}"
    words = F.array_distinct(F.filter(F.split(F.lower(trim_ws(F.col("text"))), f"{WS_CLASS}+"), lambda w: w != ""))
    with shuffles_removed(spark):
        asked = searches.where("text is not null").select("search_id", words.alias("words")).distinct()
        asked = asked.withColumn("search", F.struct("search_id", "words"))
        grams = F.transform("words", lambda w: F.when(F.length(w) < GRAM, F.array(w)).otherwise(grams_of(w, GRAM)))
        wanted = F.when(F.size("words") > 0, F.array_distinct(F.flatten(grams))).otherwise(F.array(F.lit("")))
        needed = asked.select("search", F.explode(wanted).alias("gram")).join(index.counts, "gram", "left")
        # a gram without a count is in no row and has no postings, but '', which stands for every row
        found = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", F.coalesce("common", F.col("gram") == "").alias("common"))
        rarest = needed.groupBy("search").agg(F.min(found).alias("r")) \
            .select(F.monotonically_increasing_id().alias("number"), "search", "r.n", "r.gram", "r.common")
        rarest.write.parquet(root)
    rarest = spark.read.schema(rarest.schema).parquet(root)
    rows = spread(df.where(F.col(index.key).isNotNull()).select(
        F.col(index.key).alias("id"), *[F.coalesce(F.lower(F.col(f).cast("string")), F.lit("")).alias(f"f{k}") for k, f in enumerate(index.fields)]), "id")
    rare = rarest.where("not common and n > 0")
    next_n = rare.select("n").orderBy(F.col("n").desc()).offset(SENT).limit(1).agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    sent, others = rare.where(F.col("n") > next_n), rare.where(F.col("n") <= next_n)
    by_sent = _by_gram(index.pieces).join(F.broadcast(sent.select("gram", "number")), "gram").select("number", "id")
    by_others = others.select("gram", "search").join(index.postings_of(others.select("gram")), "gram").select("search", "id")
    met = spread(by_sent, "id").distinct().join(rows, "id").join(F.broadcast(sent.select("number", "search")), "number").drop("number") \
        .unionByName(spread(by_others, "id").distinct().join(rows, "id")) \
        .unionByName(rarest.where("common").select("search").crossJoin(rows))

    def held(word: Column) -> Column:
        found = F.lit(False)
        for k in range(len(index.fields)):
            found = found | F.contains(F.col(f"f{k}"), word)
        return found

    return met.where(F.forall("search.words", held)).select("search.search_id", F.col("id").alias(index.key))
