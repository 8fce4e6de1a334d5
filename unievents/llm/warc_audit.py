"""Fixity audit of WARC replicas by Merkle trees over records and ordered offset ranges.

A replica is a table of its records: file, offset, length, digest. A leaf is the hash of a
record's place and digest. A range node is the hash of the leaves that start in the range,
in the order of their offsets; wider ranges hash the nodes below them, a file its widest
ranges, buckets of files their files, and the root the buckets. Two replicas are compared
at the root; where hashes differ, and only there, their children are compared, down to
the records. The records of differing ranges are then aligned by their digests, so that
one that only moved, as another grew or went before it, is no difference.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unievents.llm.common import keep, pick, rows_of
from unievents.operators.ordering import number_in_groups

# Width of the ranges in bytes, widest first. A record is over 100 bytes of header, so that
# a range of the narrowest holds under 700 leaves, any other 64 nodes.
SPANS = (1 << 28, 1 << 22, 1 << 16)
FILE_BUCKETS = 1024
RECORDS = "file string, offset bigint, length bigint, record_id {id}, digest string"


def record_bytes(url: str, body: bytes) -> bytes:
    """A WARC resource record."""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def split_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an uncompressed WARC file; what is not a whole record, also
    after damage, goes up to the next record's start or the end."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        end = -1
        if data.startswith(b"WARC/", at) and head >= 0:
            for line in data[at:head].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    end = head + 4 + int(value) + 4
        if end < 0 or end > len(data) or data[end - 4:end] != b"\r\n\r\n":
            found = data.find(b"WARC/", at + 1)
            end = len(data) if found < 0 else found
        yield at, data[at:end]
        at = end


def split_members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of a compressed WARC file, of which each record is a gzip member of
    its own; a member that cannot be read, also the rest of a cut file, stays as it is up to
    the next member's start or the end."""
    at = 0
    while at < len(data):
        reader = zlib.decompressobj(wbits=31)
        try:
            record = reader.decompress(data[at:])
            end = len(data) - len(reader.unused_data) if reader.eof else -1
        except zlib.error:
            end = -1
        if end < 0:
            found = data.find(b"\x1f\x8b\x08", at + 1)
            end = len(data) if found < 0 else found
            record = data[at:end]
        yield at, record
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: one replica, each file by its name. Names that end in .gz
    are read member by member; offsets are those in the file, lengths and digests those of
    the record itself. A file is read as a whole (2 GB at most)."""

    def run(batches):
        for batch in batches:
            for path_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                split = split_members if path_.endswith(".gz") else split_records
                rows = [(at, len(r), hashlib.sha256(r).hexdigest()) for at, r in split(data)]
                yield pa.record_batch([pa.array([path_.rsplit("/", 1)[-1]] * len(rows), pa.string()),
                                       pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([None] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                                      names=["file", "offset", "length", "record_id", "digest"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS.format(id="bigint"))


def archive(pages: DataFrame, copy_of, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
            file_bytes: int = 64 << 20) -> DataFrame:
    """The records of two replicas of an archive of ``pages``, with a column ``replica`` (0
    or 1). Each task writes its pages to files of its own, of about ``file_bytes``, in the
    order they come, so that no page is shuffled and a repeated id weighs nothing.

    ``copy_of(id, url, body)`` gives what replica 1 holds of a page in the place of its
    record: the body as it is or damaged, or None for a hole. Null urls and bodies are
    empty. Digests are SHA-256 of the record's bytes in the replica.
    """
    plain = pick(pages, id=id_col, url=url_col, body=body_col).withColumn("task", F.spark_partition_id())

    def run(batches):
        number, offset = 0, 0
        for batch in rows_of(batches):
            out = []
            for id_, url, body, task in zip(*(c.to_pylist() for c in batch.columns)):
                body = (body or "").encode()
                record = record_bytes(url or "", body)
                if offset and offset + len(record) > file_bytes:
                    number, offset = number + 1, 0
                name = f"{task:06d}-{number:06d}.warc"
                out.append((0, name, offset, len(record), id_, hashlib.sha256(record).hexdigest()))
                copy = copy_of(id_, url or "", body)
                if copy is not None:
                    copy = record_bytes(url or "", copy)
                    out.append((1, name, offset, len(copy), id_, hashlib.sha256(copy).hexdigest()))
                offset += len(record)
            if out:
                replica, name, at, length, ids, digest = zip(*out)
                yield pa.record_batch([pa.array(replica, pa.int32()), pa.array(name), pa.array(at, pa.int64()),
                                       pa.array(length, pa.int64()), pa.array(ids, batch.column(0).type), pa.array(digest)],
                                      names=["replica", "file", "offset", "length", "record_id", "digest"])

    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"replica int, {RECORDS.format(id=kind)}")


def _parents(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The node above: hash of its children's keys and hashes in their order."""
    child = F.struct(*order, "hash")
    return nodes.groupBy("replica", *keys).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)),
                                        lambda c: F.concat_ws(":", *[c[o].cast("string") for o in order], c["hash"])), "\n"), 256).alias("hash"))


def merkle_levels(leaves: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """(key columns, nodes) of all levels from the root down to the records."""
    bucketed = leaves.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(FILE_BUCKETS)).cast("int"))
    for k, span in enumerate(SPANS):
        bucketed = bucketed.withColumn(f"range{k}", F.floor(F.col("offset") / span))
    ranges = [f"range{k}" for k in range(len(SPANS))]
    keys = ["bucket", "file", *ranges]
    nodes = bucketed.withColumn("hash", F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256))
    # two records at one offset (a damaged index) are two leaves; their order is by their hash
    levels = [([*keys, "offset"], nodes)]
    nodes = keep(_parents(nodes.select("replica", *keys, "offset", "hash"), keys, ["offset"]), "ranges")
    levels.append((keys, nodes))
    for depth in range(len(keys) - 1, -1, -1):
        nodes = keep(_parents(nodes.select("replica", *keys[:depth + 1], "hash"), keys[:depth], [keys[depth]]), f"level-{depth}")
        levels.append((keys[:depth], nodes))
    return levels[::-1]


def audit(records: DataFrame) -> DataFrame:
    """(record_id, file, offset, status, length, digest, copy_offset, copy_length,
    copy_digest) for every record on which replicas 0 and 1 of ``records`` differ.

    status: ``changed`` (replica 1 holds other bytes in its place), ``missing`` (replica 1
    has no record there), ``extra`` (only replica 1 has one; its offset is copy_offset). A
    place is the offset or, where records before it grew or went, the gap between records
    that both hold; a record that only moved is no difference. A record repeated as a whole
    within a replica counts as one. Equal replicas, also empty ones, give no rows. A replica
    without any record misses all of the other's. Null ids are ids like others; other
    columns of any name are ignored.
    """
    leaves = keep(records.select("replica", "file", "offset", "length", "record_id", "digest").distinct(), "leaves")
    levels = merkle_levels(leaves)
    root = levels[0][1].groupBy("replica").agg(F.min("hash").alias("hash")).collect()  # two rows
    if len({r["hash"] for r in root}) == len(root) - 1 or not root:  # both equal, or no record at all
        return _aligned(leaves.where(F.lit(False)))
    suspects = None  # keys of the nodes of a level that differ; below the root all are compared
    for keys, nodes in levels[1:-1]:
        below = nodes if suspects is None else nodes.join(suspects, suspects.columns, "left_semi")
        sides = below.groupBy(*keys).agg(F.min("hash").alias("a"), F.max("hash").alias("b"), F.count("*").alias("n"))
        suspects = keep(sides.where("a != b or n != 2").select(*keys), "suspects")
    return _aligned(levels[-1][1].join(suspects, suspects.columns, "left_semi"))


PLACE = ["file", "offset", "length", "digest"]
_ORDER = ["offset", "length", "digest"]


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.when(F.col("replica") == 0, 1)).alias("n0"), F.count(F.when(F.col("replica") == 1, 1)).alias("n1"))


def _matches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (replica and place) whose first, second, ... of equal ``keys`` both replicas
    hold."""
    numbered = keep(number_in_groups(rows, ["replica", *keys], _ORDER, "nth"), "numbered")
    return numbered.join(_counts(numbered, keys), keys).where(F.col("nth") <= F.least("n0", "n1")).select("replica", *PLACE)


def _gaps(rows: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` of the ``rows`` with q, the number among them, and gap, the number of other
    rows before, in their replica's file."""
    all_ = number_in_groups(rows.select("replica", *PLACE), ["replica", "file"], _ORDER, "p")
    own = number_in_groups(some, ["replica", "file"], _ORDER, "q")
    return own.join(all_, ["replica", *PLACE]).withColumn("gap", F.col("p") - F.col("q")).drop("p")


def _aligned(leaves: DataFrame) -> DataFrame:
    """The differences among the leaves of differing ranges. Records of equal bytes at one
    offset are the same, and so are those whose bytes occur once in the file on both sides:
    these are anchors. Then the first, second, ... record of equal bytes between the same
    anchors are the same, and lastly those in the file, wherever they moved. What remains is
    paired by offset, and else by gap: the number of same records before it, and its place
    among those that remain there. Numbers come from range sorts, not from a window over a
    file, so that a file of any size is spread over tasks."""
    sides = leaves.groupBy(*PLACE, "replica").agg(F.max("record_id").alias("record_id"))
    exact = sides.groupBy(*PLACE).agg(F.count("*").alias("n")).where("n = 2").select(*PLACE).withColumn("exact", F.lit(True))
    sides = keep(sides.join(exact, PLACE, "left"), "sides")
    left = sides.where("exact is null").drop("exact")
    once = _counts(left, ["file", "digest"]).where("n0 = 1 and n1 = 1")
    left = keep(left.join(once, ["file", "digest"], "left_anti"), "left")
    if not left.isEmpty():
        between = keep(_gaps(sides, left), "between")
        left = left.join(_matches(between, ["file", "gap", "digest"]), ["replica", *PLACE], "left_anti")
        left = keep(left.join(_matches(left, ["file", "digest"]), ["replica", *PLACE], "left_anti"), "left")
    if left.isEmpty():
        remaining = left.withColumn("gap", F.lit(0).cast("bigint")).withColumn("in_gap", F.lit(0).cast("bigint"))
    else:
        gaps = keep(_gaps(sides, left), "gaps")
        start = gaps.groupBy("replica", "file", "gap").agg(F.min("q").alias("start"))
        remaining = gaps.join(start, ["replica", "file", "gap"]).withColumn("in_gap", F.col("q") - F.col("start"))
    columns = [F.col("record_id"), F.col("file"), F.col("offset"), F.col("length"), F.col("digest"), F.col("gap"), F.col("in_gap")]
    first = remaining.where("replica = 0").select(*columns)
    other = remaining.where("replica = 1").select(*[c.alias(f"copy_{n}") for c, n in zip(columns, ["id", "file", "offset", "length", "digest", "gap", "in_gap"])])
    same_place = (F.col("file") == F.col("copy_file")) & (F.col("offset") == F.col("copy_offset"))
    by_offset = first.join(other, same_place)  # a damaged index may hold several records at one offset: each pair is a difference
    rest0 = first.join(other.select("copy_file", "copy_offset"), same_place, "left_anti")
    rest1 = other.join(first.select("file", "offset"), same_place, "left_anti")
    same_gap = (F.col("file") == F.col("copy_file")) & (F.col("gap") == F.col("copy_gap")) & (F.col("in_gap") == F.col("copy_in_gap"))
    both = by_offset.unionByName(rest0.join(rest1, same_gap, "full"))
    return both.select(
        F.coalesce("record_id", "copy_id").alias("record_id"), F.coalesce("file", "copy_file").alias("file"),
        F.coalesce("offset", "copy_offset").alias("offset"),
        F.when(F.col("copy_file").isNull(), "missing").when(F.col("file").isNull(), "extra").otherwise("changed").alias("status"),
        "length", "digest", "copy_offset", "copy_length", "copy_digest")
