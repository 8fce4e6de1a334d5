"""Benchmark decontamination by a size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles into classes (h/2, h]. For each
class a document is a row of windows of 2h shingles, h apart, so that a passage of an item
lies within one of them whatever the document's length. A window that holds four fifths
of an item's shingles has a Jaccard similarity of at least 0.19 to it; of ``PERMUTATIONS``
minima at least one agrees but for 0.81 ** 48 = 4e-5. Items of one or two shingles are too
small a part of a window for that; their shingles are looked up one by one, so none is
missed. Windows that share a minimum with an item only name candidates: the share of the item's different shingles that the whole
document holds is then counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from unievents.llm.common import WORD_BYTES, pick, rows_of, utf8

PERMUTATIONS = 48
SHORT = 2  # items of so many shingles at most are looked up by each shingle
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordIds(dict):
    """64-bit hash by word; forgets all when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _cut_words(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text that is words and spaces, in parts of about ``size`` bytes."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _word_ids(text: bytes, memo: _WordIds) -> np.ndarray:
    parts = [np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
             for words in _cut_words(text.translate(WORD_BYTES))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _shingle_ids(ids: np.ndarray, size: int) -> np.ndarray:
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = ids[:n].copy()
    for k in range(1, size):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += ids[k:k + n]
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def _shingles(text: bytes, size: int, part_bytes: int = 1 << 20) -> Iterator[bytes]:
    """All word shingles of a text, read in parts that share ``size - 1`` words."""
    tail: list[bytes] = []
    for words in _cut_words(text.translate(WORD_BYTES), part_bytes):
        words = tail + words
        yield from (b" ".join(words[i:i + size]) for i in range(len(words) - size + 1))
        tail = words[max(0, len(words) - size + 1):] if size > 1 else []


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    return rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def _lookup(values: np.ndarray, rows: np.ndarray) -> tuple:
    """Values in order, the row of each, and which first 16 bits occur."""
    order = np.argsort(values, kind="stable")
    mask = np.zeros(1 << 16, bool)
    mask[(values >> np.uint64(48)).astype(np.int64)] = True
    return values[order], rows[order], mask


def _maybe(lookup: tuple, wanted: np.ndarray) -> np.ndarray:
    return lookup[2][(wanted >> np.uint64(48)).astype(np.int64)]


def _rows_at(lookup: tuple, wanted: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place in ``wanted``, row) of all rows with a wanted value."""
    values, rows, _ = lookup
    lo, hi = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
    for at in np.flatnonzero(hi > lo):
        yield from ((at, int(row)) for row in rows[lo[at]:hi[at]])


class ItemIndex:
    """The test items of one block: exact shingles, and by shingle length the minima of each
    class and the shingles of short items."""

    def __init__(self, items: list[tuple], shingle: int):
        memo = _WordIds()
        self.ids, self.exact, self.sizes = [], [], []
        found: dict[int, dict[int, list[int]]] = {}
        short: dict[int, list[int]] = {}
        for item_id, text in items:
            data = (text or "").encode()
            size = min(shingle, len(data.translate(WORD_BYTES).split()))
            if not size:
                continue  # no word to be found
            row = len(self.ids)
            self.ids.append(item_id)
            self.exact.append(set(_shingles(data, size)))
            self.sizes.append(size)
            if len(self.exact[-1]) <= SHORT:
                short.setdefault(size, []).append(row)
                continue
            top = 1 << max(2, (len(self.exact[-1]) - 1).bit_length())
            found.setdefault(size, {}).setdefault(top, []).append(row)
        scale, shift = _permutations()
        self.short: dict[int, tuple] = {}
        for size, rows in short.items():
            parts = [self._shingles(r, memo) for r in rows]
            self.short[size] = _lookup(np.concatenate(parts), np.repeat(rows, [len(p) for p in parts]))
        self.classes: dict[int, list] = {}
        for size, tops in sorted(found.items()):
            for top, rows in sorted(tops.items()):
                lookups = []
                for a, b in zip(scale, shift):
                    least = np.array([min(int(x) for x in self._shingles(r, memo) * a + b) for r in rows], np.uint64)
                    lookups.append(_lookup(least, np.array(rows)))
                self.classes.setdefault(size, []).append((top, lookups))

    def _shingles(self, row: int, memo: _WordIds) -> np.ndarray:
        return np.concatenate([_shingle_ids(_word_ids(s, memo), self.sizes[row]) for s in sorted(self.exact[row])])

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs that share a minimum in a window, or any shingle with a
        short item; documents by word ids."""
        scale, shift = _permutations()
        out: set[tuple[int, int]] = set()
        for size in sorted({*self.classes, *self.short}):
            classes = self.classes.get(size, [])
            parts = [_shingle_ids(ids, size) for ids in docs]
            lengths = np.array([len(p) for p in parts])
            if not lengths.sum():
                continue
            flat = np.concatenate(parts)
            if size in self.short:
                owner = np.repeat(np.arange(len(docs)), lengths)
                some = np.flatnonzero(_maybe(self.short[size], flat))
                seen = np.unique(np.column_stack((owner[some].astype(np.uint64), flat[some])), axis=0)
                out.update((int(seen[at, 0]), row) for at, row in _rows_at(self.short[size], seen[:, 1]))
            blocks = []  # per class: starts among the blocks of the class before, block owners
            starts = None
            for top, _ in classes:
                n = -(-lengths // top)
                owner = np.repeat(np.arange(len(docs)), n)
                at = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * top + np.repeat(np.cumsum(lengths) - lengths, n)
                blocks.append((at if starts is None else np.searchsorted(starts, at), owner))
                starts = at
            for k, (a, b) in enumerate(zip(scale, shift)):
                least = flat * a + b
                for (cut, owner), (_, lookups) in zip(blocks, classes):
                    least = np.minimum.reduceat(least, cut)  # of each block of h shingles
                    window = least.copy()  # and with the next block of the same document
                    same = owner[:-1] == owner[1:]
                    window[:-1][same] = np.minimum(least[:-1][same], least[1:][same])
                    some = np.flatnonzero(_maybe(lookups[k], window))
                    out.update((int(owner[some[at]]), row) for at, row in _rows_at(lookups[k], window[some]))
        return out


def _blocks(items: DataFrame, shingle: int, block_bytes: int) -> Iterator[ItemIndex]:
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append(tuple(row))
        size += len(row[1] or "")
        if size > block_bytes:
            yield ItemIndex(held, shingle)
            held, size = [], 0
    if held:
        yield ItemIndex(held, shingle)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, least: float = 0.8,
               block_bytes: int = 16 << 20) -> DataFrame:
    """(id, item_id, n_shingles, n_found, containment) for every document and test item where
    the whole document holds at least ``least`` of the item's different word shingles.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.
    An item of fewer than ``shingle`` words is one shingle of all its words; an item without
    words (null, empty) is in no document. Items come in blocks of ``block_bytes`` of text
    that are broadcast one after another, each for a pass over the documents, so their
    number is not bounded. Repeated documents or items give their pairs again. No documents
    or items give no rows.
    """
    plain = pick(docs, id=id_col, text=text_col)
    tests = pick(items, item_id=item_col, text=item_text_col)
    kinds = plain.schema["id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()
    schema = f"id {kinds[0]}, item_id {kinds[1]}, n_shingles bigint, n_found bigint, containment double"
    item_type = to_arrow_type(tests.schema["item_id"].dataType)
    spark, out = docs.sparkSession, None
    for index in _blocks(tests, shingle, block_bytes):
        part = plain.mapInArrow(_search(spark.sparkContext.broadcast(index), least, item_type), schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def _held(text: bytes, size: int, wanted: set[bytes]) -> set[bytes]:
    """The shingles of ``wanted`` that the whole text holds."""
    return {s for s in _shingles(text, size) if s in wanted}


def _search(shared, least: float, item_type: pa.DataType):
    def run(batches):
        index, memo = shared.value, _WordIds()
        for batch in rows_of(batches, 1 << 20):
            texts = utf8(batch.column(1))
            rows, items, counts = [], [], []
            by_text: dict[tuple[int, int], list[int]] = {}
            for row, item in sorted(index.candidates([_word_ids(t, memo) for t in texts])):
                by_text.setdefault((row, index.sizes[item]), []).append(item)
            for (row, size), found in by_text.items():
                held = _held(texts[row], size, set().union(*(index.exact[i] for i in found)))
                for item in found:
                    n = len(index.exact[item] & held)
                    if n >= least * len(index.exact[item]):
                        rows.append(row)
                        items.append(item)
                        counts.append((len(index.exact[item]), n))
            if rows:
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([index.ids[i] for i in items], item_type),
                                       pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()),
                                       pa.array([c[1] / c[0] for c in counts], pa.float64())],
                                      names=["id", "item_id", "n_shingles", "n_found", "containment"])

    return run
