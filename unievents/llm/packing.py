"""Packing into sequences of fixed length as a cutting-stock problem.

Tokens become pieces of at most ``capacity`` ids: full ones, and one rest per document.
The histogram of piece lengths is all that the driver sees (``capacity`` rows at most). A
linear program over patterns (what lengths share a sequence) is solved by column
generation: the basis starts with one length per pattern, a knapsack dynamic program
prices new patterns with the duals, and the loop ends when the duals prove the cost near
the least. Rounded-down patterns and best-fit for the few lengths left over give every
length's ranks their places, and pieces look theirs up by rank.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unievents.llm.common import keep, pick, rows_of
from unievents.llm.token_counts import split_safely, vocabulary_path

_PROBE = "It's 12 words,  é漢😀\n\n\tand more...  'll x<|endoftext|>y  "
_CUT = re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")


def _byte_of() -> dict[str, int]:
    """Byte by its letter in byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(name: str):
    """Function of a text to its ids (uint32), as the tokenizers library gives them from
    this .json file without added special tokens.

    A byte-level vocabulary whose ids follow the order of its merges is also a table of
    ranks, which tiktoken encodes several times faster. It is used if it agrees on a probe
    of all kinds of pieces; else, or where its pattern engine gives up on a text, the
    tokenizers library encodes.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = vocabulary_path(name)
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def plain(text: str) -> np.ndarray:
        return np.array(model.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    if (file["pre_tokenizer"] or {}).get("type") != "ByteLevel" or any(re.search(r"\s", s) for s in special):
        return plain
    try:
        import public_tokenizers
        import tiktoken

        letters = _byte_of()
        ranks = {bytes(letters[c] for c in piece): k for piece, k in file["model"]["vocab"].items() if piece not in special}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        if fast.encode(_PROBE, allowed_special="all") != plain(_PROBE).tolist():
            return plain
    except (ImportError, KeyError, ValueError):
        return plain

    def quick(text: str) -> np.ndarray:
        parts = []
        for part in split_safely(text, _CUT, 1 << 20):
            try:
                parts.append(fast.encode_to_numpy(part, allowed_special="all").astype(np.uint32))
            except Exception:  # its pattern engine's limits
                parts.append(plain(part))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    return quick


def pieces_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): every document's ids and the end id, cut
    every ``capacity`` ids."""
    plain = pick(docs, id=id_col, text=text_col)

    def run(batches):
        encode = encoder(vocabulary)
        for batch in rows_of(batches):
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())),
                                   *(pa.array(c, pa.int64()) for c in (starts, lengths, crcs, totals))],
                                  names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def padded(total: int, capacity: int) -> int:
    """Ids that a sequence of ``total`` takes: no padding at a power of two."""
    return total if total & (total - 1) == 0 else capacity


def _entries(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """(length index, copies, weight), longest first: every number of copies up to what
    there are and what fits is a sum of a length's entries."""
    out = []
    for i in range(len(lengths) - 1, -1, -1):
        left, step = min(capacity // int(lengths[i]), max(1, int(np.ceil(demand[i])))), 1
        while left > 0:
            take = min(step, left)
            out.append((i, take, take * int(lengths[i])))
            left, step = left - take, step * 2
    return out


def _best_patterns(entries: list[tuple[int, int, int]], duals: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the greatest sum of duals of pieces that add up to
    exactly each total, and which totals each entry raised."""
    value = np.full(capacity + 1, -np.inf)
    value[0] = 0
    taken = np.zeros((len(entries), capacity + 1), bool)
    for e, (i, copies, weight) in enumerate(entries):
        more = value[:-weight] + duals[i] * copies
        better = more > value[weight:]
        value[weight:][better] = more[better]
        taken[e, weight:] = better
    return value, taken


def _pattern(entries: list[tuple[int, int, int]], taken: np.ndarray, total: int) -> Counter:
    pattern: Counter = Counter()
    e = len(entries)
    while total:
        e = int(np.flatnonzero(taken[:e, total])[-1])  # the last entry that set this total
        i, copies, weight = entries[e]
        pattern[i] += copies
        total -= weight
    return pattern


def _first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[Counter], np.ndarray, np.ndarray]:
    """Patterns, inverse basis and times to start from: two lengths that fill a sequence
    share it as often as the rarer one goes; other pieces share with their like."""
    m = len(lengths)
    index = {int(k): i for i, k in enumerate(lengths)}
    copies = capacity // lengths
    patterns = [Counter({i: int(copies[i])}) for i in range(m)]
    inverse, x = np.diag(1.0 / copies), demand / copies
    for i, k in enumerate(lengths):
        j = index.get(capacity - int(k), i)
        if i != j and (demand[i], i) < (demand[j], j):  # j keeps a pattern of its own
            patterns[i] = Counter({i: 1, j: 1})
            x[i], x[j] = demand[i], (demand[j] - demand[i]) / copies[j]
            inverse[i, i], inverse[j, i] = 1.0, -1.0 / copies[j]
    return patterns, inverse, x


class _Master:
    """Basis of the linear program: least cost of patterns that hold exactly the demand."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int):
        self.cost_of = np.array([padded(s, capacity) for s in range(capacity + 1)], float)
        self.patterns, self.inverse, self.x = _first_basis(lengths, demand, capacity)
        self.cost = np.array([self.cost_of[sum(int(lengths[i]) * n for i, n in p.items())] for p in self.patterns])
        self.duals = self.cost @ self.inverse

    def enter(self, pattern: Counter, cost: float, least_gain: float) -> bool:
        """Take the pattern into the basis if it lowers the cost."""
        which, times = list(pattern), np.array(list(pattern.values()), float)
        gain = self.duals[which] @ times - cost
        if gain <= least_gain:
            return False
        column = self.inverse[:, which] @ times
        able = column > 1e-9
        if not able.any():
            return False
        ratios = np.full(len(self.x), np.inf)
        ratios[able] = self.x[able] / column[able]
        out = int(ratios.argmin())
        theta = ratios[out]
        self.x -= theta * column
        self.x[out] = theta
        np.maximum(self.x, 0, out=self.x)
        pivot = self.inverse[out] / column[out]
        self.inverse -= np.outer(column, pivot)
        self.inverse[out] = pivot
        self.duals = self.duals - gain * pivot
        self.patterns[out], self.cost[out] = pattern, cost
        return True


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, known: list[Counter] = (), gap: float = 0.0005,
                   rounds: int = 200, pivots: int = 8) -> tuple[list[tuple[Counter, float]], float]:
    """Column generation. (pattern of length indexes, times used) of a near-optimal basic
    solution of the linear program, and the proven lower bound of the padded total.

    ``known`` patterns are priced first, then the knapsack prices patterns of every total,
    and each round takes in up to ``pivots`` that lower the cost. ``gap`` (relative to the
    bound) and ``rounds`` only end the search for better patterns; any basis covers all of
    the demand.
    """
    # a little more of each length, differently much: no two ratios tie, so no pivot is void
    demand = demand + np.random.default_rng(5).uniform(0.001, 0.01, len(demand))
    master, entries = _Master(lengths, demand, capacity), _entries(lengths, demand, capacity)
    bound, least_gain = float((lengths * demand).sum()), 1e-7 * capacity
    if known:
        shares = np.zeros((len(known), len(lengths)))
        for k, pattern in enumerate(known):
            shares[k, list(pattern)] = list(pattern.values())
        costs = master.cost_of[(shares @ lengths).astype(int)]
        for _ in range(6 * len(lengths)):
            gains = shares @ master.duals - costs
            best = int(gains.argmax())
            if not master.enter(known[best], costs[best], least_gain):
                break
    for _ in range(rounds):
        value, taken = _best_patterns(entries, master.duals, capacity)
        ratio = np.max(value[1:] / master.cost_of[1:])  # duals over it are feasible for all patterns
        if ratio > 0:
            bound = max(bound, float(master.duals @ demand) / ratio)
        if master.cost @ master.x <= (1 + gap) * bound:
            break
        totals = (np.argsort(master.cost_of[1:] - value[1:], kind="stable")[:pivots] + 1).tolist()
        if not sum([master.enter(_pattern(entries, taken, t), master.cost_of[t], least_gain)
                    for t in totals if np.isfinite(value[t])]):
            break
        master.duals = master.cost @ master.inverse
    return list(zip(master.patterns, master.x.tolist())), bound


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(lengths of a sequence, number of such sequences): each length, longest first, goes
    into the fullest open sequences that it fits, all like ones at once."""
    rooms: list[list[tuple[Counter, int]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in range(length, capacity):
            copies = room // length
            while left and rooms[room]:
                pattern, n = rooms[room].pop()
                whole = min(n, left // copies)
                if whole:
                    rooms[room - copies * length].append((pattern + Counter({length: copies}), whole))
                    left -= whole * copies
                    n -= whole
                if n and left:  # fewer than fill one more
                    rooms[room - left * length].append((pattern + Counter({length: left}), 1))
                    left, n = 0, n - 1
                if n:
                    rooms[room].append((pattern, n))
                    break
        copies = capacity // length
        if left >= copies:
            rooms[capacity - copies * length].append((Counter({length: copies}), left // copies))
        if left % copies:
            rooms[capacity - left % copies * length].append((Counter({length: left % copies}), 1))
    merged: dict[frozenset, int] = {}
    for pattern, n in (p for room in rooms for p in room):
        key = frozenset(pattern.items())
        merged[key] = merged.get(key, 0) + n
    return [(Counter(dict(k)), n) for k, n in sorted(merged.items(), key=lambda p: sorted(p[0]))]


def plan_cost(plan: list[tuple[Counter, int]], capacity: int) -> int:
    return sum(padded(sum(k * n for k, n in p.items()), capacity) * times for p, times in plan)


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(lengths of a sequence, number of such sequences) that hold exactly the histogram:
    the linear program's patterns rounded down, and best fit for what is left."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    index = {int(k): i for i, k in enumerate(lengths)}
    demand = np.array([histogram[k] for k in lengths], float)
    known = [Counter({index[k]: n for k, n in p.items()}) for p, _ in best_fit(histogram, capacity)]
    left, plan = Counter(histogram), []
    for pattern, times in solve_patterns(lengths, demand, capacity, known)[0]:
        by_length = Counter({int(lengths[i]): n for i, n in pattern.items()})
        whole = min([int(times + 1e-6), *(left[k] // n for k, n in by_length.items())])
        if whole > 0:
            plan.append((by_length, whole))
            for k, n in by_length.items():
                left[k] -= n * whole
    return plan + best_fit({k: n for k, n in left.items() if n}, capacity)


class Places:
    """Where the ranks of each length lie: segments of ranks, sorted by length and rank."""

    def __init__(self, plan: list[tuple[Counter, int]]):
        used: Counter = Counter()
        rows, sequence = [], 0
        for pattern, times in plan:
            offset = 0
            for length in sorted(pattern, reverse=True):
                rows.append((length, used[length], pattern[length], sequence, offset))
                used[length] += pattern[length] * times
                offset += length * pattern[length]
            sequence += times
        rows.sort()
        self.length, self.first, self.copies, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of this length and rank (from 0)."""
        at = np.searchsorted((self.length << 48) + self.first, (length << 48) + rank, "right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def rank_pieces(pieces: DataFrame, histogram: dict[int, int], capacity: int) -> DataFrame:
    """``pieces`` with ``rank``: from 0, without gaps, among the pieces of a length.

    A length may hold a third of all pieces. Its pieces are dealt to about as many buckets
    as each bucket holds pieces (512 at least): a window ranks within a bucket, and another,
    over the counts, adds what lies in the buckets before.
    """
    per = [int(max(512, np.sqrt(histogram.get(k, 0)))) for k in range(capacity + 1)]
    buckets = F.array(*[F.lit(-(-histogram.get(k, 0) // per[k]) or 1) for k in range(capacity + 1)])
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32", "doc_tokens"),
                                               F.element_at(buckets, F.col("length").cast("int") + 1)))
    before = (dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("length", "bucket", "before"))
    order = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("nth", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
    return ranked.withColumn("rank", F.col("before") + F.col("nth")).drop("bucket", "nth", "before")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Every document is its ids and the end id; each id lies in exactly one piece, pieces lie
    gapless in their sequences. Null and empty texts are the end id alone. Repeated rows are
    documents of their own, and rows with a null id are packed like others; no rows give no
    rows. The driver holds the histogram and the plan, at most a few thousand rows.
    """
    pieces = keep(pieces_of(docs, id_col, text_col, vocabulary, end_id, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    places = Places(plan_sequences(histogram, capacity))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = places.find(length, rank)
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                  names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = rank_pieces(pieces, histogram, capacity).select("id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
                             + ", sequence_id bigint, offset bigint")
