"""Line dedup: two Bloom filters find suspects, only these are shuffled and confirmed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unievents.llm.common import keep, pick, rows_of, utf8

_SPACE = b" \t\n\x0b\x0c\r"
_CHUNK = 16  # log2 of the bits of a filter's chunk
_PROBES = 2


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None where it has fewer than ``min_chars`` code points."""
    key = line.strip(_SPACE).lower()  # on bytes, lower() touches A-Z only
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bit positions of 64-bit hashes in a filter of 2**bits bits."""
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    for k in range(_PROBES):
        yield (hashes + np.uint64(k) * step) & np.uint64((1 << bits) - 1)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.unique(np.concatenate(list(_probes(hashes, bits))))


def filter_bits(n_lines: int, per_line: int = 8, least: int = 16, most: int = 30) -> int:
    """log2 of the filter's bits: ``per_line`` bits a line, at least 2**16, at most 2**30
    (128 MB, the proven bound of what is broadcast). A filter that is too small for its
    lines only suspects more of them; the result is the same."""
    return min(most, max(least, (max(1, n_lines) * per_line - 1).bit_length()))


def repeated_filter(docs: DataFrame, bits: int, min_chars: int = 10) -> bytes:
    """Bloom filter (2**bits bits) of the keys that occur in more than one row of ``docs``
    (id, text), with false positives only.

    Each task fills a once-seen and a twice-seen filter and sends their set bits by chunk.
    Filters merge in any order: twice = twice | other twice | (once & other once), once =
    once | other once. A merging task holds its chunks' bits only; only the twice-seen
    filter goes to the driver.
    """

    def local(batches):
        seen = []
        for batch in rows_of(batches):
            hashes = []
            for text in utf8(batch.column(0)):
                keys = {_key(line, min_chars) for line in text.split(b"\n")}
                keys.discard(None)
                hashes.extend(map(xxhash.xxh64_intdigest, keys))
            seen.append(np.array(hashes, np.uint64))
        values, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.array([], np.uint64), np.array([], int))
        for is_twice, part in ((False, values), (True, values[counts > 1])):
            at = _positions(part, bits) if len(part) else part
            chunk = (at >> np.uint64(_CHUNK)).astype(np.int32)
            starts = np.flatnonzero(np.diff(chunk, prepend=-1))
            offsets = (at & np.uint64((1 << _CHUNK) - 1)).astype("<u2")
            for lo in range(0, len(starts), 1024):
                some = starts[lo:lo + 1024]
                ends = np.append(starts[lo + 1:lo + 1025], len(at))[:len(some)]
                yield pa.record_batch({"chunk": pa.array(chunk[some]), "is_twice": pa.array([is_twice] * len(some)),
                                       "bits": pa.array([offsets[a:b].tobytes() for a, b in zip(some, ends)], pa.binary())})

    def merge(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, is_twice, data in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(data, "<u2")
                if chunk not in once:
                    once[chunk], twice[chunk] = np.zeros(1 << _CHUNK, bool), np.zeros(1 << _CHUNK, bool)
                if is_twice:
                    twice[chunk][at] = True
                else:
                    twice[chunk][at[once[chunk][at]]] = True
                    once[chunk][at] = True
        for chunk, found in twice.items():
            if found.any():
                yield pa.record_batch({"chunk": pa.array([chunk], pa.int32()),
                                       "bits": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(local, "chunk int, is_twice boolean, bits binary")
    merged = parts.repartition("chunk").mapInArrow(merge, "chunk int, bits binary")
    size = 1 << (_CHUNK - 3)
    whole = bytearray(1 << (bits - 3))
    for chunk, data in merged.toLocalIterator():  # 2**bits bits in all
        whole[chunk * size:(chunk + 1) * size] = data
    return bytes(whole)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                max_filter_bits: int = 30) -> DataFrame:
    """Drop every line whose key occurs in at least two documents, but in the smallest id.

    A text is split at \\n; a line's key is the line without ``[\\x20\\x09-\\x0D]`` at both
    ends and with A-Z in lower case; keys of fewer than ``min_chars`` code points stay.
    Returns all columns of ``docs`` in their order, then ``kept_text``, ``n_lines`` (before
    dropping) and ``n_dropped``. Where ``docs`` has a column of such a name, read the last
    three by position.

    Null or empty texts are one empty line. Repeated rows of an id are one document: they
    keep or lose the same lines, and no line is repeated by them alone. Rows with a null id
    are one document, larger than any other. No rows give no rows.
    """
    names = docs.columns
    plain = pick(docs, id=id_col, text=text_col)
    n_lines = plain.select(F.sum(F.expr("octet_length(text) - octet_length(replace(text, '\n', ''))")),
                           F.count("*")).first()
    bits = filter_bits((n_lines[0] or 0) + n_lines[1], most=max_filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(repeated_filter(plain, bits, min_chars))

    def suspects(batches):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in rows_of(batches):
            places, keys, at = [], [], []
            for row, text in enumerate(utf8(batch.column(2))):
                first: dict[bytes, list[int]] = {}
                for k, line in enumerate(text.split(b"\n")):
                    if (key := _key(line, min_chars)) is not None:
                        first.setdefault(key, []).append(k)
                keys.extend(first)
                places.extend(first.values())
                at.extend([row] * len(first))
            if not keys:
                continue
            hit = np.ones(len(keys), bool)
            for p in _probes(np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)), bits):
                hit &= (table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            some = np.flatnonzero(hit)
            rows = pa.array([at[i] for i in some], pa.int64())
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows),
                                   pa.array([hashlib.blake2b(keys[i], digest_size=16).digest() for i in some], pa.binary()),
                                   pa.array([places[i] for i in some], pa.list_(pa.int32()))],
                                  names=["id", "text_hash", "key", "places"])

    hashed = plain.select("id", F.xxhash64("text").alias("text_hash"), "text")
    id_type = plain.schema["id"].dataType.simpleString()
    found = keep(hashed.mapInArrow(suspects, f"id {id_type}, text_hash bigint, key binary, places array<int>"),
                 "suspects")
    confirmed = (found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"),
                                          F.max(F.col("id").isNull()).alias("no_id"))
                 .where("first != last or (no_id and first is not null)").select("key", "first"))
    # written, so that the join on keys reads both sides as they come, and a hot key is split
    confirmed = keep(confirmed, "confirmed")
    # every id and text loses one list of places; rows repeated as a whole share it
    drops = (found.join(confirmed, "key").where(~F.col("id").eqNullSafe(F.col("first")))
             .groupBy(F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash"))
             .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")))

    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_at, text_at = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    joined = numbered.join(
        drops, F.col(id_at).eqNullSafe(F.col("drop_id")) & (F.xxhash64(text_at) == F.col("drop_hash")), "left")

    def rebuild(batches):
        for batch in rows_of(batches):
            kept, n, dropped = [], [], []
            for text, places in zip(utf8(batch.column(text_at)), batch.column("places").to_pylist()):
                count = text.count(b"\n") + 1
                if places:
                    gone = set(places)
                    text = b"\n".join(line for k, line in enumerate(text.split(b"\n")) if k not in gone)
                kept.append(text)
                n.append(count)
                dropped.append(len(places or ()))
            yield pa.record_batch([*(batch.column(f"c{i}") for i in range(len(names))),
                                   pa.array(kept, pa.binary()).cast(pa.string()),
                                   pa.array(n, pa.int64()), pa.array(dropped, pa.int64())],
                                  names=[*(f"c{i}" for i in range(len(names))), "kept_text", "n_lines", "n_dropped"])

    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(numbered.schema))
    out = joined.select(*numbered.columns, "places").mapInArrow(
        rebuild, f"{fields}, kept_text string, n_lines bigint, n_dropped bigint")
    return out.toDF(*names, "kept_text", "n_lines", "n_dropped")
