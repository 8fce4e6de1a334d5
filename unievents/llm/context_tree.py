"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, most significant bit first; the bits of the byte so far
are a node, and each of the 255 nodes has a tree of its own over the bytes before. At every
context (the last 0 to ``depth`` bytes) a Krichevsky-Trofimov estimate speaks for its bits,
and a context's weighted probability is half its own estimate and half the product of its
children's. What the trained tree gives for the next bit mixes the estimates of all depths.

Counts and scores are Spark tables of grams (context and byte) that grow with the corpus.
The deepest levels of a tree are worked out per ``top`` byte context, of which a task holds
a few at a time, the others by joins and sums over nodes. Texts are kept in chunks with the
set of grams that occur in them, so that only these sets, and each text once, are shuffled;
scores go back to a chunk in bundles of grams, not in a row for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unievents.llm.common import keep, pick, runs_of

PAD = b"\xff"  # occurs in no UTF-8 text: stands before its first byte and for its end
SPACE = b" \t\n\v\f\r"
BATCH_BYTES = 4 << 20  # of rows that go to a task at once, but for single longer ones
BUNDLE = 64  # grams or words of a chunk in a row that goes back to it


# Estimates, for columns and for arrays alike ----------------------------------------------

def log_gamma(x, log=F.log):
    """Logarithm of the gamma function for x >= 0.5, to 1e-12: Stirling's series at x + 8."""
    y = x + 8.0
    inverse = 1.0 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square * (1 / 1188)))))
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(product)


def log_estimate(zeros, ones, log=F.log):
    """Logarithm of the Krichevsky-Trofimov probability of a sequence of so many bits."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1.0, log) - math.log(math.pi)


def _mask(depth: int) -> int:
    """Of a gram or node key: the last ``depth`` bytes of its context, and the byte or node."""
    return (1 << 8 * (depth + 1)) - 1


# The deepest levels, in a task ------------------------------------------------------------

def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``_summed`` of all ``parts``, each of different rising keys; the first one's counts may
    change in place. The list is emptied on the way, so that no more is held than a part, what
    comes before it and both in one."""
    keys, n = parts.pop(0)
    while parts:
        more, more_n = parts.pop(0)
        place, hit = _found(keys, more)
        n[place[hit]] += more_n[hit]
        more, more_n = more[~hit], more_n[~hit]
        place = np.searchsorted(keys, more)
        keys = np.insert(keys, place, more)
        n = np.insert(n, place, more_n)
    return keys, n


def node_keys(grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits: key (context, then the node as a byte: a one, then the
    bits so far) and bit of each gram. Keys rise with the grams."""
    context, byte = grams & ~255, grams & 255
    for k in range(8):
        yield context | 1 << k | byte >> 8 - k, byte >> 7 - k & 1


def _nodes(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, zeros, ones) of all nodes of the rising grams, by key."""
    parts = []
    for key, bit in node_keys(grams):
        first = _runs(key)
        parts.append((key[first], *(np.add.reduceat(x, first) if len(first) else x for x in (n * (1 - bit), n * bit))))
    key, zeros, ones = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    return key[order], zeros[order], ones[order]


def subtree(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[dict], dict]:
    """The nodes of ``grams`` (rising, with all that share their last ``top`` context bytes)
    at each depth below ``top``, deepest first, with ``stop``, the weight of a node's own
    estimate; and the nodes at ``top`` with ``below``, what longer contexts give."""
    levels, above = [], None
    for d in range(depth, top - 1, -1):
        if d < depth:
            grams, n = _summed(grams & _mask(d), n)
        key, zeros, ones = _nodes(grams, n)
        below = None
        if above is not None:
            place = np.searchsorted(key, above["key"] & _mask(d))
            below = np.bincount(place, above["weighted"], len(key)) if len(key) else np.zeros(0)
        if d == top:
            return levels, {"key": key, "zeros": zeros, "ones": ones, "below": below}
        own = log_estimate(zeros.astype(float), ones.astype(float), np.log)
        one = (ones + 0.5) / (zeros + ones + 1.0)
        if below is None:
            above = {"key": key, "one": one, "weighted": own, "stop": np.ones(len(key))}
        else:
            with np.errstate(over="ignore"):  # infinity gives the right 0
                stop = 1 / (1 + np.exp(below - own))
            above = {"key": key, "one": one, "weighted": np.logaddexp(own, below) - math.log(2), "stop": stop}
        levels.append(above)
    return levels, {}


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` among the rising ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    return place, keys[place] == wanted


def subtree_scores(grams: np.ndarray, n: np.ndarray, nodes: dict[str, np.ndarray], depth: int, top: int) -> np.ndarray:
    """log10 probability of each gram's last byte. ``nodes``: key, acc, rest and p at ``top``
    for all nodes that the grams ask for, by key."""
    trained = n > 0
    levels, _ = subtree(grams[trained], n[trained], depth, top)
    mixed = [(nodes["key"], nodes["p"])]
    above = nodes
    for d, level in zip(range(top + 1, depth + 1), reversed(levels)):
        place, _ = _found(above["key"], level["key"] & _mask(d - 1))
        left = above["rest"][place]
        acc, rest = above["acc"][place] + left * level["stop"] * level["one"], left * (1 - level["stop"])
        above = {"key": level["key"], "acc": acc, "rest": rest}
        mixed.append((level["key"], acc + rest * level["one"]))
    score = np.zeros(len(grams))
    for key, bit in node_keys(grams):
        p = np.full(len(grams), 0.5)
        for d, (keys, values) in zip(range(top, depth + 1), mixed):
            place, hit = _found(keys, key & _mask(d))
            p[hit] = values[place[hit]]
        score += np.log10(np.where(bit == 1, p, 1 - p))
    return score


def _groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole groups of ``key``, by which the batches are sorted, of about ``rows``
    rows or one group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if count >= rows and len(keys):
            cuts = np.flatnonzero(np.r_[keys[0] != held[-1].column(key)[-1].as_py(), keys[1:] != keys[:-1]])
            if len(cuts):
                held.append(batch.slice(0, cuts[0]))
                yield pa.Table.from_batches(held)
                held, count, batch = [], 0, batch.slice(cuts[0])
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


# All levels -------------------------------------------------------------------------------

def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, score): log10 probability of the last byte of each of ``grams`` (gram, n: its
    count in training) after the others. A node that training has not seen in a context is
    read in the longest context where it was seen; one seen in none is a half.

    All grams that share their last ``top`` context bytes meet in a task: at most 256 **
    (depth - top) contexts, and 256 bytes after each, whatever the corpus.
    """
    top = depth if depth <= 3 else max(3, depth - 2)
    root = F.col("gram").bitwiseAND(F.lit(_mask(top) & ~255)).alias("root")

    def up(batches):
        for table in _groups(batches, "root"):
            gram, n = (table[k].to_numpy() for k in ("gram", "n"))
            order = np.argsort(gram)
            _, nodes = subtree(gram[order], n[order], depth, top)
            for at in range(0, len(nodes["key"]), 1 << 16):
                some = {k: v[at:at + (1 << 16)] if v is not None else None for k, v in nodes.items()}
                below = pa.nulls(len(some["key"]), pa.float64()) if some["below"] is None else pa.array(some["below"])
                yield pa.record_batch({"key": pa.array(some["key"]), "zeros": pa.array(some["zeros"]), "ones": pa.array(some["ones"]), "below": below})

    dealt = grams.where("n > 0").select(root, "gram", "n").repartition("root").sortWithinPartitions("root")
    found = dealt.mapInArrow(up, "key bigint, zeros bigint, ones bigint, below double")
    tree = _upper_levels(found, depth, top)
    asked = grams.select(F.col("gram").bitwiseAND(F.lit(_mask(top))).alias("gram")).distinct()
    nodes = _known(asked.select(F.explode(F.array(*[
        F.expr(f"(gram & ~255L) | {1 << k}L | shiftright(gram & 255L, {8 - k})") for k in range(8)])).alias("key")).distinct(), tree)
    columns = ["root", "kind", "key", "n", "acc", "rest", "p"]
    no = lambda c: F.lit(None).cast("double").alias(c)
    both = (nodes.select(F.col("key").bitwiseAND(F.lit(~255)).alias("root"), F.lit(0).alias("kind"), "key", F.lit(0).cast("bigint").alias("n"), "acc", "rest", "p")
            .union(grams.select(root, F.lit(1).alias("kind"), F.col("gram").alias("key"), "n", no("acc"), no("rest"), no("p"))).select(*columns))

    def down(batches):
        for table in _groups(batches, "root"):
            kind, key = (table[k].to_numpy() for k in ("kind", "key"))
            some = np.flatnonzero(kind == 0)
            some = some[np.argsort(key[some])]
            own = {k: table[k].to_numpy()[some] for k in ("key", "acc", "rest", "p")}
            some = np.flatnonzero(kind == 1)
            some = some[np.argsort(key[some])]
            score = subtree_scores(key[some], table["n"].to_numpy()[some], own, depth, top)
            for at in range(0, len(some), 1 << 16):
                yield pa.record_batch({"gram": pa.array(key[some[at:at + (1 << 16)]]), "score": pa.array(score[at:at + (1 << 16)])})

    return both.repartition("root").sortWithinPartitions("root").mapInArrow(down, "gram bigint, score double")


def _shorter(depth: int) -> Column:
    """The key of the same node in the last ``depth`` bytes of the context."""
    return F.col("key").bitwiseAND(F.lit(_mask(depth)))


def _upper_levels(found: DataFrame, depth: int, top: int) -> list[DataFrame]:
    """For depths 0 to ``top`` the nodes that training has seen (key, acc, rest, p): ``p`` is
    the probability of a one where no longer context is known; of the mixture, ``acc`` is
    what depths up to this one give and ``rest`` the weight left to longer contexts.

    Weighted probabilities go up one byte at a time, a sum per (context, node) over at most
    256 longer contexts; mixtures come down the same way, a join per depth.
    """
    levels: list[DataFrame] = []
    for d in range(top, -1, -1):
        own = found.withColumn("own", log_estimate(F.col("zeros").cast("double"), F.col("ones").cast("double")))
        if d == depth:
            level = own.withColumn("weighted", F.col("own")).withColumn("stop", F.lit(1.0))
        else:  # half and half; exp may overflow to infinity, which gives the right 0
            gap = F.col("below") - F.col("own")
            level = (own.withColumn("weighted", F.greatest("own", "below") + F.log1p(F.exp(-F.abs(gap))) - math.log(2))
                     .withColumn("stop", 1.0 / (F.exp(gap) + 1.0)))
        level = keep(level.select("key", "zeros", "ones", "weighted", "stop"), f"tree-{d}")
        levels.append(level)
        found = level.groupBy(_shorter(d - 1).alias("key")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below")) if d else None
    one = ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)).alias("one")
    out: list[DataFrame] = []
    for d, level in enumerate(reversed(levels)):
        if d:
            above = out[-1].select(F.col("key").alias("parent"), F.col("acc").alias("before"), F.col("rest").alias("left"))
            here = level.select("key", "stop", one, _shorter(d - 1).alias("parent")).join(above, "parent")
        else:
            here = level.select("key", "stop", one, F.lit(0.0).alias("before"), F.lit(1.0).alias("left"))
        acc, rest = F.col("before") + F.col("left") * F.col("stop") * F.col("one"), F.col("left") * (1.0 - F.col("stop"))
        out.append(keep(here.select("key", acc.alias("acc"), rest.alias("rest"), (acc + rest * F.col("one")).alias("p")), f"mix-{d}"))
    return out


def _known(asked: DataFrame, tree: list[DataFrame]) -> DataFrame:
    """(key, acc, rest, p) for each asked key of the deepest of the levels; where training
    has not seen it, p is that of the longest context where it has."""
    top = len(tree) - 1
    for d in range(top, -1, -1):
        level = tree[d].select(F.col("key").alias("known"), F.col("p").alias(f"p{d}"), *(["acc", "rest"] if d == top else []))
        asked = asked.withColumn("short", _shorter(d)).join(level, F.col("short") == F.col("known"), "left").drop("short", "known")
    p = F.coalesce(*[F.col(f"p{d}") for d in range(top, -1, -1)], F.lit(0.5))
    return asked.select("key", F.coalesce("acc", F.lit(0.0)).alias("acc"), F.coalesce("rest", F.lit(0.0)).alias("rest"), p.alias("p"))


# Texts ------------------------------------------------------------------------------------

def pieces(text: bytes, depth: int, size: int) -> Iterator[tuple[bytes, bytes, bool]]:
    """(bytes before, piece, is last) of a text. Pieces end after white space, so that no
    word is cut; a longer word stays whole."""
    at, n = 0, len(text)
    while True:
        end = n
        if n - at > size:
            cuts = [c for c in (text.find(s, at + size) for s in (SPACE[k:k + 1] for k in range(6))) if c >= 0]
            end = min(cuts) + 1 if cuts else n
        yield (PAD * depth + text[max(0, at - depth):at])[-depth:] if depth else b"", text[at:end], end == n
        if end == n:
            return
        at = end


def windows(rows: list[tuple[bytes, bytes, bool]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams (``depth`` bytes and the next one) of the rows laid end to end, and the first
    and behind-last place of each row's own; the places between belong to no row."""
    parts = [before + piece + (PAD if last else b"") for before, piece, last in rows]
    data = np.frombuffer(b"".join(parts) + PAD * depth, np.uint8)
    n = len(data) - depth
    grams = data[:n].astype(np.uint64)
    for k in range(1, depth + 1):
        grams <<= np.uint64(8)
        grams |= data[k:n + k]
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    starts = ends - [len(p) for p in parts]
    return grams, starts, ends - depth


def _own(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` places is one of a row's own."""
    return np.repeat(np.tile([True, False], len(starts)), np.diff(np.r_[np.column_stack((starts, ends)).ravel(), n]))


class Chunk:
    """The different grams and words of some texts and how often training texts hold them."""

    def __init__(self, depth: int):
        self.depth, self.rows, self.waiting, self.bytes = depth, {False: [], True: []}, 0, 0
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # what was merged, then small parts
        self.words: list[pa.Table] = []

    def add(self, row: tuple[bytes, bytes, bool], held: bool) -> None:
        self.rows[held].append(row)
        self.waiting += len(row[1]) + 64
        self.bytes += len(row[1]) + 64
        if self.waiting > 1 << 18:
            self.count()

    def count(self) -> None:
        for held, rows in self.rows.items():
            if rows:
                grams, starts, ends = windows(rows, self.depth)
                grams = grams[_own(starts, ends, len(grams))]
                grams.sort()
                first = _runs(grams)
                n = np.diff(np.r_[first, len(grams)])
                self.grams.append((grams[first].view(np.int64), n * 0 if held else n))
                del grams, starts, ends, first
                found = pa.array(b" ".join(piece for _, piece, _ in rows).split(), pa.binary()).value_counts()
                n = found.field(1).to_numpy()
                self.words.append(pa.table({"data": found.field(0), "n": pa.array(n * 0 if held else n)}))
        if sum(len(g) for g, _ in self.grams[1:]) > 1 << 18:
            self.merge_grams()
        if sum(len(t) for t in self.words[1:]) > 1 << 18:
            self.merge_words()
        self.rows, self.waiting = {False: [], True: []}, 0

    def merge_grams(self) -> None:
        if len(self.grams) > 1:
            first, rest = self.grams[0], self.grams[1:]
            self.grams = [first, _merged(rest)]
            del first
            self.grams.append(_merged(self.grams))

    def merge_words(self) -> None:
        if len(self.words) > 1:
            words = pa.concat_tables(self.words)
            self.words.clear()
            words = words.group_by("data", use_threads=False).aggregate([("n", "sum")])
            self.words = [words.rename_columns({"n_sum": "n"}).combine_chunks()]

    def full(self, bytes_: int, grams: int) -> bool:
        if sum(len(g) for g, _ in self.grams) >= grams and self.bytes < bytes_:
            self.merge_grams()
        return self.bytes >= bytes_ or sum(len(g) for g, _ in self.grams) >= grams

    def vocabulary(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[pa.Table]]:
        """(grams, counts) and words with counts, each in one part at most."""
        self.count()
        self.merge_grams()
        self.merge_words()
        return self.grams, self.words


def _kept(df: DataFrame, label: str) -> DataFrame:
    """``keep``, with batches to its Python tasks of about ``BATCH_BYTES``: texts and blocks
    are long rows. The session's own bound is set again."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name, None)
    conf.set(name, str(BATCH_BYTES))
    try:
        return keep(df, label)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def packed(block: list[tuple], id_type: pa.DataType) -> bytes:
    """(row, id as an array, held, piece) of some pieces, compressed."""
    rows, ids, held, parts = zip(*block)
    columns = {"row": pa.array(rows, pa.int64()), "id": pa.concat_arrays(ids), "held": pa.array(held, pa.bool_()),
               **{k: pa.array([p[i] for p in parts], t) for i, (k, t) in enumerate([("before", pa.binary()), ("text", pa.binary()), ("last", pa.bool_())])}}
    batch, sink = pa.record_batch(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _chunked(texts: DataFrame, depth: int, chunk_bytes: int, chunk_grams: int, piece_bytes: int) -> DataFrame:
    """(chunk, kind, gram, data, n): kind 0, a gram of the chunk; 1, a word (data) of it, each
    with its count in training; 2, a block of its pieces (data) and the number of training
    texts that end in it."""
    most = min(1 << 64 - 8 * (depth + 1), 4096)  # rows of a block: a gram and a row's number share 64 bits

    def cut(batches):
        part = TaskContext.get().partitionId()
        chunk_no, row_no, size, chunk, block, id_type = 0, 0, 0, Chunk(depth), [], None

        def batch(kind, gram=None, data=None, n=None):
            return pa.record_batch({"chunk": pa.array(np.full(len(n), part << 32 | chunk_no, np.int64)), "kind": pa.array(np.full(len(n), kind, np.int32)),
                                    "gram": pa.nulls(len(n), pa.int64()) if gram is None else pa.array(gram),
                                    "data": pa.nulls(len(n), pa.binary()) if data is None else pa.array(data, pa.binary()), "n": pa.array(n, pa.int64())})

        def vocabulary():
            grams, words = chunk.vocabulary()
            for keys, n in grams:
                for at in range(0, len(n), 1 << 15):
                    yield batch(0, gram=keys[at:at + (1 << 15)], n=n[at:at + (1 << 15)])
            for table in words:
                for part_ in table.to_batches(max_chunksize=1 << 14):
                    yield batch(1, data=part_.column("data"), n=part_.column("n"))

        def blocks():
            yield batch(2, data=[packed(block, id_type)], n=[sum(piece[2] and not held for _, _, held, piece in block)])
            block.clear()

        for own in batches:
            id_type = own.column("id").type
            for k in range(own.num_rows):
                key, held, text = own.column("id").slice(k, 1), own.column("held")[k].as_py(), own.column("text")[k].as_py()
                for piece in pieces((text or b"").lower(), depth, piece_bytes):
                    chunk.add(piece, held)
                    block.append((part << 40 | row_no, key, held, piece))
                    size += len(piece[1]) + 64
                    full = chunk.full(chunk_bytes, chunk_grams)
                    if full or size >= 1 << 18 or len(block) >= most:
                        yield from blocks()
                        size = 0
                    if full:
                        yield from vocabulary()
                        chunk_no, chunk = chunk_no + 1, Chunk(depth)
                row_no += 1
        if block:
            yield from blocks()
        yield from vocabulary()
        del chunk
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return _kept(texts.mapInArrow(cut, "chunk bigint, kind int, gram bigint, data binary, n bigint"), "chunks")


def bundles(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk's grams or words (chunk, kind, and gram or data, and value) with up to
    ``BUNDLE`` of one chunk and kind in each: grams and values as arrays, words joined by a
    space, which none holds. About ``rows`` of the batches' rows are held at a time."""
    held: list[pa.RecordBatch] = []

    def bundled():
        chunk = np.concatenate([b.column("chunk").to_numpy() for b in held])
        order = np.argsort(chunk, kind="stable")
        first = _runs(chunk[order])
        within = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        starts = np.flatnonzero(within % BUNDLE == 0)
        bounds, take = pa.array(np.r_[starts, len(order)], pa.int32()), pa.array(order)

        def lists(column):
            return pa.ListArray.from_arrays(bounds, pa.concat_arrays([b.column(column) for b in held]).take(take))

        kind, words = held[0].column("kind")[0].as_py(), "data" in held[0].schema.names
        if words:
            data = lists("data")
            data = pc.binary_join(data, pa.scalar(b" ", data.type.value_type)).cast(pa.binary())
        out = pa.record_batch({"chunk": pa.array(chunk[order][starts]), "kind": pa.array(np.full(len(starts), kind, np.int32)),
                               "gram": pa.nulls(len(starts), pa.list_(pa.int64())) if words else lists("gram"),
                               "data": data if words else pa.nulls(len(starts), pa.binary()), "value": lists("value")})
        held.clear()
        return out

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield bundled()
    if held:
        yield bundled()


def _scored(chunks: DataFrame, grams: DataFrame, words: DataFrame, facts: tuple[int, int, int], depth: int, id_kind: str) -> DataFrame:
    """(row, id, held, n_bytes, n_tokens, n_known, base_score, score) of each piece. A task
    gets a chunk's grams, then its words, then its blocks, which it lets pass by."""
    n_train, n_words, n_texts = facts
    share = n_train + 0.5 * (n_words + 1)
    bundle = "chunk bigint, kind int, gram array<bigint>, data binary, value array<double>"
    known = chunks.where("kind = 0").select("chunk", "kind", "gram").join(grams, "gram").select("chunk", "kind", "gram", F.col("score").alias("value"))
    counted = chunks.where("kind = 1").select("chunk", "kind", "data").join(words.where("n > 0"), "data").select(
        "chunk", "kind", "data", F.col("n").cast("double").alias("value"))
    blocks = chunks.where("kind = 2").select("chunk", "kind", F.lit(None).cast("array<bigint>").alias("gram"), "data", F.lit(None).cast("array<double>").alias("value"))
    dealt = (known.mapInArrow(bundles, bundle).union(counted.mapInArrow(bundles, bundle)).union(blocks)
             .repartition("chunk").sortWithinPartitions("chunk", "kind"))
    row_bits = np.uint64(64 - 8 * (depth + 1))

    def scored(data, found, scores, counts):
        block = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
        rows = [*zip(*(block.column(c).to_pylist() for c in ("before", "text", "last")))]
        key, starts, ends = windows(rows, depth)
        key <<= row_bits
        key |= np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.r_[starts, len(key)]))
        key = key[_own(starts, ends, len(key))]
        key.sort()  # by gram, then row
        gram = (key >> row_bits).astype(np.int64)
        first = _runs(gram)
        each = np.repeat(scores[np.searchsorted(found, gram[first])], np.diff(np.r_[first, len(gram)]))
        del gram, first, starts, ends
        total = np.bincount((key & np.uint64((1 << int(row_bits)) - 1)).astype(np.int64), each, len(rows))
        out = {"n_bytes": [], "n_tokens": [], "n_known": [], "base_score": []}
        for _, text, last in rows:
            words = text.split()
            c = np.fromiter((counts.get(w, 0.0) for w in words), float, len(words))
            if last:
                c = np.append(c, n_texts)
            out["n_bytes"].append(len(text) + last)
            out["n_tokens"].append(len(c))
            out["n_known"].append(int(np.count_nonzero(c)))
            out["base_score"].append(float(np.log10((c + 0.5) / share).sum()))
        return pa.record_batch({**{k: block.column(k) for k in ("row", "id", "held")},
                                **{c: pa.array(v, pa.float64() if c == "base_score" else pa.int64()) for c, v in out.items()}, "score": pa.array(total)})

    def score(batches):
        at, found, scores, counts = None, [], [], {}
        for (chunk, kind), part in runs_of(batches, ["chunk", "kind"]):
            if chunk != at:
                at, found, scores, counts = chunk, [], [], {}
            if kind == 0:  # copies, so that the batch with its other columns is let go
                found.append(part.column("gram").flatten().to_numpy().copy())
                scores.append(part.column("value").flatten().to_numpy().copy())
                continue
            if kind == 1:
                for some in (part.slice(k, 256) for k in range(0, part.num_rows, 256)):
                    counts.update(zip(b" ".join(some.column("data").to_pylist()).split(), some.column("value").flatten().to_numpy().astype(np.int64).tolist()))
                continue
            if isinstance(found, list):
                found, scores = np.concatenate(found), np.concatenate(scores)
                order = np.argsort(found)
                found, scores = found[order], scores[order]
                del order
            for data in part.column("data"):
                yield scored(data, found, scores, counts)

    return dealt.mapInArrow(score, f"row bigint, id {id_kind}, held boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def score_texts(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", depth: int = 5,
                chunk_bytes: int = 48 << 20, chunk_grams: int = 2 << 20,
                piece_bytes: int = 8 << 20) -> DataFrame:
    """(id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte) of every row, learned from all rows for which ``held_out`` (an SQL condition
    on the column ``id``) is not true.

    A-Z become lower case. score: log10 probability of the text's UTF-8 bytes and its end (one
    more byte, counted in n_bytes) by the context tree of ``depth`` (0 to 6) bytes;
    bits_per_byte: the code length that this gives. base_score: log10 probability of the
    tokens (words between white space, then the end) by their smoothed counts in training;
    n_known: tokens that training holds.

    A null text is empty: one token, one byte. Repeated rows are rows of their own and count
    as often as they occur. A row of null id is held out if the condition says so, else
    trained on. Without training rows every bit is a half and every token has probability 1.
    Long texts are held and scored in pieces of about ``piece_bytes`` with the bytes before
    them, so that a piece gives what the whole text would. Other columns of any name are
    ignored. No rows give no rows.

    A chunk ends after ``chunk_bytes`` of text or ``chunk_grams`` different grams, whatever
    comes first: a task holds one chunk's vocabulary. The driver gets three counts.
    """
    if not 0 <= depth <= 6:
        raise ValueError("depth must be from 0 to 6")
    plain = pick(docs, id=id_col, text=text_col)
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = plain.sparkSession.sparkContext.defaultParallelism
    tasks = parallel * max(1, -(-total // (chunk_bytes * parallel)))
    ready = plain.select("id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held"), F.col("text").cast("binary").alias("text"))
    chunks = _chunked(ready.coalesce(tasks), depth, chunk_bytes, chunk_grams, piece_bytes)
    grams = keep(chunks.where("kind = 0").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    words = keep(chunks.where("kind = 1").groupBy("data").agg(F.sum("n").alias("n")), "words")
    n_texts = chunks.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    facts = counted["n"] + n_texts, counted["v"] + (n_texts > 0), n_texts
    sums = [F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "base_score", "score")]
    rows = _scored(chunks, gram_scores(grams, depth), words, facts, depth, ready.schema["id"].dataType.simpleString())
    rows = _kept(rows.groupBy("row").agg(F.first("id").alias("id"), F.first("held").alias("held_out"), *sums), "scores")
    return rows.select("id", "held_out", "n_bytes", "n_tokens", "n_known", F.lit(facts[0]).cast("bigint").alias("train_tokens"), "base_score", "score",
                       (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
