"""SimHash near-dedup by anchor-point covering.

Two fingerprints at 3 or fewer differing bits differ in at most one bit in one of their
32-bit halves. In each half the 65,536 words of the second-order Reed-Muller code of
length 32 are the anchors: every 32-bit word lies within 6 bits (the covering radius) of
one. A half is replicated to every anchor within its own distance to the code plus one
bit. That is never more than covering radius plus threshold, and enough: of two halves at
distance one or less, the one nearer to the code has its nearest anchor within the other's
reach. Equal anchors are compared with each other, by whole fingerprints.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unievents.llm.common import keep, pick, rows_of, utf8
from unievents.llm.components import connected_components

SEED = 42
HALF = 32
_KEYS = 2 << 16  # anchors of both halves
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of ``size`` of these words, joined by a space."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n - size + 1].tolist(), ends[size - 1:].tolist())),
                       np.uint64, n - size + 1)


def fingerprint(text: bytes, size: int = 3, part_bytes: int = 1 << 22) -> int:
    """64 bits as a signed long; a bit is 1 if it is set in over half the hashes of the
    text's word shingles, repeats included. A text of fewer words has its whole word
    sequence as one shingle; one of no words has fingerprint zero. Long texts are read in
    parts that share ``size - 1`` words, so that never all words are objects at once."""
    text = text.lower()  # on bytes: A-Z only; split() cuts at [\x20\x09-\x0D]+
    total, n, at, words = np.zeros(64, np.int64), 0, 0, []
    while at < len(text):
        found = _SPACE.search(text, at + part_bytes)
        end = found.start() if found else len(text)
        words, at = words + text[at:end].split(), end
        hashes = _hashes(words, size)
        if len(hashes):
            n += len(hashes)
            words = words[len(words) - size + 1:]
            for lo in range(0, len(hashes), 1 << 16):
                part = hashes[lo:lo + (1 << 16)].astype("<u8")
                total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not n and words:
        whole = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
        return int(whole.view("<i8")[0])
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


@functools.lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Generator rows of the code, its information positions, and by syndrome the error
    patterns that lead to the anchors in reach (``starts[s]:starts[s + 1]`` of ``errors``).
    The code is self-dual, so that generator rows check it, too."""
    x = np.arange(HALF)
    variables = [(x >> v) & 1 for v in range(5)]
    rows = [np.ones(HALF, int), *variables, *(variables[a] & variables[b] for a in range(5) for b in range(a))]
    basis = np.array([sum(int(bit) << i for i, bit in enumerate(r)) for r in rows], np.uint64)
    info: list[int] = []
    for i in range(len(basis)):  # reduced rows: each information position is in one row only
        info.append(next(p for p in range(HALF) if int(basis[i]) >> p & 1))
        for j in range(len(basis)):
            if j != i and int(basis[j]) >> info[i] & 1:
                basis[j] ^= basis[i]
    least = np.full(1 << 16, 99, np.int8)
    found = []
    patterns, top = np.zeros(1, np.uint64), np.full(1, -1)
    for weight in range(8):  # covering radius 6, and one bit more
        s = _syndromes(patterns, basis)
        least[s] = np.minimum(least[s], weight)
        near = weight <= least[s].astype(int) + 1
        found.append((s[near], patterns[near]))
        grown = [(patterns[top < p] | np.uint64(1 << p), p) for p in range(HALF)]
        patterns, top = np.concatenate([g for g, _ in grown]), np.concatenate([np.full(len(g), p) for g, p in grown])
    syndromes, errors = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(syndromes, kind="stable")
    return basis, info, np.searchsorted(syndromes[order], np.arange((1 << 16) + 1)), errors[order], least


def _syndromes(words: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for k, row in enumerate(basis):
        out |= (np.bitwise_count(words & row).astype(np.int64) & 1) << k
    return out


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every anchor that a fingerprint (uint64) is replicated to."""
    basis, info, starts, errors, _ = _code()
    rows, keys = [], []
    for half in range(2):
        words = (prints >> np.uint64(HALF * half)) & np.uint64(0xFFFFFFFF)
        s = _syndromes(words, basis)
        n = starts[s + 1] - starts[s]
        row = np.repeat(np.arange(len(prints)), n)
        which = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s], n)
        anchor = words[row] ^ errors[which]
        key = np.zeros(len(row), np.int64)
        for k, p in enumerate(info):  # an anchor is known by its information bits
            key |= ((anchor >> np.uint64(p)) & np.uint64(1)).astype(np.int64) << k
        rows.append(row)
        keys.append(key + (half << 16))
    return np.concatenate(rows), np.concatenate(keys)


def _merge(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable by the links a-b, starting from ``root``."""
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def group_links(keys: np.ndarray, prints: np.ndarray, max_bits: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that join all rows of equal key (rows sorted by key) that
    ``max_bits`` or fewer bits connect: a spanning set, not all pairs."""
    n = len(keys)
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [n]))
    sizes = ends - starts
    root = np.arange(n)
    small = np.repeat(sizes <= 256, sizes)
    last = np.repeat(ends, sizes)
    some = np.flatnonzero(small)
    shift = 1
    while len(some):  # neighbours 1, 2, 3 ... rows on, all small groups at once
        some = some[some + shift < last[some]]
        hit = some[np.bitwise_count(prints[some] ^ prints[some + shift]) <= max_bits]
        root = _merge(n, hit, hit + shift, root)
        shift += 1
    for lo, hi in zip(starts[sizes > 256], ends[sizes > 256]):
        for i in range(lo, hi, block):
            for j in range(i, hi, block):
                near = np.bitwise_count(prints[i:min(hi, i + block), None] ^ prints[None, j:min(hi, j + block)]) <= max_bits
                a, b = np.nonzero(near)
                root = _merge(n, a + i, b + j, root)
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, print long) of every row; a null text has no words."""
    plain = pick(docs, id=id_col, text=text_col)

    def run(batches):
        for batch in rows_of(batches):
            prints = [fingerprint(t, shingle) for t in utf8(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64())], names=["id", "print"])

    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, print bigint")


def _replicas(prints: DataFrame, blocks: np.ndarray | None, size: int = 1 << 14) -> Iterator:
    """mapInArrow function of the rows (key, sub, print) for the anchors of each print. A
    key with several blocks gets each of its prints once for every pair of blocks that the
    print's own is in."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                own = batch.column(0).slice(at, size).to_numpy(zero_copy_only=False).view(np.uint64)
                row, key = anchors(own)
                if blocks is None:
                    keys, counts = np.unique(key, return_counts=True)
                    yield pa.record_batch({"key": pa.array(keys.astype(np.int32)), "n": pa.array(counts.astype(np.int64))})
                    continue
                n = blocks[key]
                sub = np.zeros(len(key), np.int64)
                many = np.flatnonzero(n > 1)
                parts = [(row[n <= 1], key[n <= 1], sub[n <= 1])]
                if len(many):
                    mixed = (own[row[many]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                    mine = (mixed % n[many].astype(np.uint64)).astype(np.int64)
                    again = np.repeat(np.arange(len(many)), n[many])
                    other = np.arange(len(again)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
                    low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
                    parts.append((row[many][again], key[many][again], 1 + low * n[many][again] + high))
                r, k, s = (np.concatenate(c) for c in zip(*parts))
                yield pa.record_batch({"key": pa.array(k.astype(np.int32)), "sub": pa.array(s),
                                       "print": pa.array(own[r].view(np.int64))})

    return run


def near_links(prints: DataFrame, max_bits: int = 3, group_rows: int = 8192) -> DataFrame:
    """Links (a, b) between the different fingerprints of ``prints`` (print: long, distinct)
    that join exactly what pairs at ``max_bits`` (3 at most) or fewer bits join.

    The 131,072 keys are counted first. A key of more than ``group_rows`` prints is cut
    into blocks, and every pair of its blocks is compared by itself; so no task holds more
    than two blocks of one key, and all are compared.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the two halves cover distances up to 3 bits")
    counts = prints.mapInArrow(_replicas(prints, None), "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    blocks = np.ones(_KEYS, np.int64)
    for key, n in counts.where(F.col("n") > group_rows).toLocalIterator():  # 131,072 rows at most
        blocks[key] = -(-n // (group_rows // 2))

    def compare(batches):
        held_k, held_s, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for key, sub, own in _ended(batches):
            held_k, held_s, held_p = (np.concatenate(x) for x in ((held_k, key), (held_s, sub), (held_p, own)))
            last = len(held_k)
            if len(key):  # the last group may go on in the next batch
                others = np.flatnonzero((held_k != held_k[-1]) | (held_s != held_s[-1]))
                last = int(others[-1]) + 1 if len(others) else 0
            if last:
                k, s, p = held_k[:last], held_s[:last], held_p[:last]
                group = np.cumsum(np.concatenate(([0], (np.diff(k) != 0) | (np.diff(s) != 0))))
                child, parent = group_links(group, p, max_bits)
                yield pa.record_batch({"a": pa.array(p[child].view(np.int64)), "b": pa.array(p[parent].view(np.int64))})
                held_k, held_s, held_p = held_k[last:], held_s[last:], held_p[last:]

    spread = prints.mapInArrow(_replicas(prints, blocks), "key int, sub bigint, print bigint")
    grouped = spread.repartition("key", "sub").sortWithinPartitions("key", "sub", "print")
    return grouped.mapInArrow(compare, "a bigint, b bigint").distinct()


def _ended(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns of the batches, then empty ones that mark the end."""
    for batch in batches:
        if batch.num_rows:
            key, sub, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield key.astype(np.int64), sub.astype(np.int64), own.view(np.uint64)
    yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  max_bits: int = 3) -> DataFrame:
    """(id, fingerprint hex, component_id) of every row: component_id is the smallest id
    that links of ``max_bits`` or fewer differing bits reach, the row's own included.

    Empty and null texts have fingerprint zero and link like any other. Repeated rows and
    repeated ids are rows of their own. A null id takes the smallest id that it reaches,
    null where it reaches only such rows. No rows give no rows.
    """
    prints = keep(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = prints.groupBy("print").agg(F.min("id").alias("least"))
    links = near_links(keep(classes.select("print"), "classes"), max_bits)
    roots = connected_components(links)
    joined = classes.join(roots.withColumnRenamed("node", "print"), "print", "left")
    joined = keep(joined.select("print", "least", F.coalesce("root", "print").alias("root")), "roots")
    # only components of several fingerprints meet again; a fingerprint by itself is done
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.select("print", "root").join(least, "root").select("print", "component_id")
    return (prints.join(labels, "print")
            .select("id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"))
