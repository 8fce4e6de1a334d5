import math
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from unievents.llm import context_tree as C

HELD = "crc32(cast(cast(id as string) as binary)) % 5 = 1"


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def _brute(rows, depth):
    """Scores node by node, as the definition says."""
    data = [(i, _held(i), bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())) for i, text in rows]
    nodes, tokens = {}, {}

    def bits(text):
        seq = b"\xff" * depth + text + b"\xff"
        for at in range(depth, len(seq)):
            for k in range(8):
                yield seq[at - depth:at], (1 << k) | seq[at] >> 8 - k, seq[at] >> 7 - k & 1

    for _, held, text in data:
        if not held:
            for word in [*text.split(), None]:
                tokens[word] = tokens.get(word, 0) + 1
            for context, node, bit in bits(text):
                for d in range(depth + 1):
                    nodes.setdefault((context[depth - d:], node), [0, 0])[bit] += 1

    def own(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    weighted, below = {}, {}
    for context, node in sorted(nodes, key=lambda k: -len(k[0])):
        e = own(*nodes[context, node])
        if len(context) < depth:
            b = below[context, node]
            w = max(e, b) + math.log1p(math.exp(-abs(e - b))) - math.log(2)
        else:
            w = e
        weighted[context, node] = w
        if context:
            below[context[1:], node] = below.get((context[1:], node), 0.0) + w

    def chance(context, node):
        left, p, one = 1.0, 0.0, 0.5
        for d in range(depth + 1):
            key = context[depth - d:], node
            if key not in nodes:
                break
            z, o = nodes[key]
            one = (o + 0.5) / (z + o + 1)
            gap = below[key] - own(z, o) if d < depth else -math.inf
            stop = 1 / (1 + math.exp(gap)) if gap < 700 else 0.0
            p, left = p + left * stop * one, left * (1 - stop)
        return p + left * one

    n, v = sum(tokens.values()), len(tokens)
    out, memo = [], {}
    for i, held, text in data:
        score = 0.0
        for context, node, bit in bits(text):
            if (context, node) not in memo:
                memo[context, node] = chance(context, node)
            score += math.log10(memo[context, node] if bit else 1 - memo[context, node])
        words = [tokens.get(w, 0) for w in [*text.split(), None]]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in words)
        out.append((i, held, len(text) + 1, len(words), sum(c > 0 for c in words), n, base, score))
    return out


def _same(got, want):
    order = lambda r: (str(r[0]), r[2:5], round(r[7], 6))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    for a, b in zip(got, want):
        assert a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9) and a[7] == pytest.approx(b[7], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("depth, chunk_bytes, piece_bytes", [(5, 48 << 20, 8 << 20), (6, 1 << 20, 1 << 20), (3, 4000, 500), (0, 1 << 20, 1 << 20)])
def test_as_brute_force(spark, depth, chunk_bytes, piece_bytes):
    """In one chunk a task, and in many chunks with long texts cut into pieces."""
    rows = [(i, t if t is None or len(t) < 50_000 else t[:30_000] + t[-100:]) for i, t in odd_rows()]
    frame = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id bigint, row string, id int").repartition(3)
    found = C.score_texts(frame, HELD, depth=depth, chunk_bytes=chunk_bytes, piece_bytes=piece_bytes).collect()
    _same([tuple(r)[:8] for r in found], _brute(rows, depth))
    assert all(r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / r["n_bytes"]) for r in found)


def test_bytes_that_end_a_text_and_zeros(spark):
    """Zero bytes, white space of all kinds, characters of four bytes; a long word whole."""
    rows = [(1, "\x00\x00a\x00"), (2, "a\tb\x0bc\x0cd\re  f\n"), (3, "😀 😀é"), (4, "w" * 5000 + " x"), (5, " " * 300), (6, "Ä A ä")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    _same([tuple(r)[:8] for r in C.score_texts(frame, HELD, depth=2, chunk_bytes=1000, piece_bytes=100).collect()], _brute(rows, 2))


def test_pieces():
    text = b"one two  three" + b"x" * 50 + b" end "
    for size in (1, 3, 7, 1000):
        cut = list(C.pieces(text, 4, size))
        assert b"".join(p for _, p, _ in cut) == text and [last for _, _, last in cut] == [False] * (len(cut) - 1) + [True]
        assert [w for _, p, _ in cut for w in p.split()] == text.split()
        seen = b"\xff" * 4
        for before, piece, _ in cut:
            assert before == seen[-4:]
            seen += piece


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 2.0, 7.5, 100.5, 1e6 + 0.5, 1e12]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(C.log_gamma(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(v) for v in values], rel=1e-13, abs=2e-12)


def test_model_learns(spark):
    """Held-out text of the training language costs fewer bits than random letters, and the
    chances of all continuations of a context add up to one."""
    rows = [(k, " ".join(["the cat sat on the mat", "a dog ran to the cat"][(k + j) % 2] for j in range(9))) for k in range(40)]
    new = [k for k in range(1000, 1100) if _held(k)][:2]
    rows += [(new[0], "the dog sat on the cat"), (new[1], "qzx vjk wqp zzk xxj qwk")]
    found = {r["id"]: r["bits_per_byte"] for r in C.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), HELD).collect()}
    assert found[new[0]] < 2 < 5 < found[new[1]]
    grams = spark.createDataFrame([(97 * 256 + 98, 3), (97 * 256 + 99, 2), (98 * 256 + 97, 1)], "gram bigint, n bigint")
    asked = grams.union(spark.createDataFrame([(97 * 256 + b, 0) for b in range(256) if b not in (98, 99)], "gram bigint, n bigint"))
    found = {r["gram"]: 10 ** r["score"] for r in C.gram_scores(asked, 1).collect()}
    assert sum(v for k, v in found.items() if k >> 8 == 97) == pytest.approx(1) and len(found) == 257


def test_no_training_rows_and_empty(spark):
    held = [k for k in range(100) if _held(k)][:3]
    found = C.score_texts(spark.createDataFrame([(k, "a b") for k in held], "doc_id bigint, text string"), HELD, depth=2).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], round(r["bits_per_byte"], 9)) for r in found} == {(0, 0, 0.0, 8.0)}
    assert C.score_texts(spark.createDataFrame([], "doc_id bigint, text string"), HELD).count() == 0


def test_merged_parts_are_summed_and_let_go():
    parts = [(C.np.array([1, 5, 9]), C.np.array([2, 0, 1])), (C.np.array([0, 5]), C.np.array([4, 3]))]
    keys, n = C._merged(parts)
    assert keys.tolist() == [0, 1, 5, 9] and n.tolist() == [4, 2, 3, 1] and parts == []


def test_a_task_works_on_few_groups_at_once():
    import numpy as np
    import pyarrow as pa
    from unievents.llm.context_tree import _groups
    root = np.arange(200_000) // 7
    batches = [pa.record_batch({"root": pa.array(root[at:at + 10_000])}) for at in range(0, len(root), 10_000)]
    tables = [t["root"].to_numpy() for t in _groups(iter(batches), "root")]
    assert max(len(t) for t in tables) < 1 << 16
    assert (np.concatenate(tables) == root).all() and all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_a_chunks_grams_and_words_go_back_in_bundles(spark):
    """Not in a row for each gram and word: all of them, few to a row, by chunk."""
    rows = [(k % 3, 0, 5 * k, float(-k)) for k in range(3000)]
    found = spark.createDataFrame(rows, "chunk bigint, kind int, gram bigint, value double").coalesce(1).mapInArrow(
        C.bundles, "chunk bigint, kind int, gram array<bigint>, data binary, value array<double>").collect()
    assert sorted((r["chunk"], 0, g, v) for r in found for g, v in zip(r["gram"], r["value"], strict=True)) == sorted(rows)
    assert len(found) == 3 * -(-1000 // C.BUNDLE) and {(r["kind"], r["data"]) for r in found} == {(0, None)}
    rows = [(k % 2, 1, b"w%d\xc3\xa9" % k, float(k)) for k in range(300)]
    found = spark.createDataFrame(rows, "chunk bigint, kind int, data binary, value double").coalesce(1).mapInArrow(
        C.bundles, "chunk bigint, kind int, gram array<bigint>, data binary, value array<double>").collect()
    assert sorted((r["chunk"], 1, w, v) for r in found for w, v in zip(r["data"].split(), r["value"], strict=True)) == sorted(rows)
    assert len(found) == 2 * -(-150 // C.BUNDLE) and {(r["kind"], r["gram"]) for r in found} == {(1, None)}


def test_a_chunk_holds_little_beside_its_grams():
    """Its grams are merged without their order or a second copy of all."""
    import tracemalloc
    rng = C.np.random.default_rng(3)
    texts = [rng.integers(97, 123, 1 << 17, C.np.uint8).tobytes() for _ in range(32)]
    chunk = C.Chunk(5)
    tracemalloc.start()
    for text in texts:
        chunk.add((b"\xff" * 5, text, True), False)
    (grams, n), = chunk.vocabulary()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.sum() == 32 * ((1 << 17) + 1) and (grams[1:] > grams[:-1]).all()
    assert peak < 2.3 * 16 * len(grams)


def test_a_task_gets_few_texts_at_once(spark):
    """Batches of texts and blocks are bounded by bytes; the session's own bound stays as it was."""
    name, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before = spark.conf.get(name, None)
    plain = C.keep

    def kept(df, label):
        sizes[label] = spark.conf.get(name, None)
        return plain(df, label)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "keep", kept)
        C.score_texts(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), HELD, depth=0)
    assert {k for k, v in sizes.items() if v == str(C.BATCH_BYTES)} == {"chunks", "scores"}
    assert sizes["grams"] == before == spark.conf.get(name, None)
