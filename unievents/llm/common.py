"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unievents.session import ensure_checkpoint_dir

# ASCII bytes that are neither digits nor letters become a space and A-Z become a-z; bytes
# of other characters stay: ``data.translate(WORD_BYTES).split()`` gives the words
# ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """``new=old`` columns by exact name, whatever other columns the frame holds (also
    ones whose names differ in case only)."""
    names = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    return numbered.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in wanted.items()])


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder in ``spark.checkpoint.dir`` and read
    it back: what follows starts from files that survive the loss of any executor."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/unievents-llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds more than about ``limit`` bytes, but for single
    longer rows."""
    for batch in batches:
        parts = max(1, min(batch.num_rows, -(-batch.nbytes // limit)))
        step = -(-batch.num_rows // parts) if batch.num_rows else 1
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal ``keys`` (integers) of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(columns)]):
            if hi > lo:
                if held and tuple(columns[lo]) != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = tuple(columns[lo])
    if held:
        yield pa.Table.from_batches(held)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, slice) for each run of equal ``keys`` (integers) within a batch."""
    for batch in batches:
        columns = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(columns)]):
            if hi > lo:
                yield tuple(columns[lo].tolist()), batch.slice(lo, hi - lo)
