import zlib
from collections import Counter

import numpy as np
import pytest

from unievents.llm import packing as P

from .conftest import odd_rows


def _library_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: model.encode(t or "", add_special_tokens=False).ids


def test_odd_rows_cover_every_id_once(odd):
    ids_of = _library_ids()
    rows = P.pack_documents(odd).collect()
    want = Counter()
    for i, text in odd_rows():
        ids = np.array([*ids_of(text), 0], "<u4")
        want.update((i, s, len(ids[s:s + 1024]), zlib.crc32(ids[s:s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024))
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_encoder_agrees_with_the_library():
    ids_of, encode = _library_ids(), P.encoder("byte_bpe_50k.json")
    assert encode.__name__ == "quick"
    for text in ("", " ", "a  b", "It's <|endoftext|> x", "é漢😀 \n\n\t z", " " * 5000, "x" * 5000, "ab cd " * 400_000):
        assert encode(text).tolist() == ids_of(text)


@pytest.mark.parametrize("draw", ["even", "short", "long", "one"])
def test_plan_holds_the_histogram_with_little_padding(draw):
    rng = np.random.default_rng(2)
    lengths = {"even": rng.integers(1, 1025, 20_000), "short": np.minimum(1024, rng.geometric(1 / 150, 20_000)),
               "long": rng.integers(300, 1025, 20_000), "one": np.array([700])}[draw]
    histogram = Counter(lengths.tolist())
    plan = P.plan_sequences(dict(histogram), 1024)
    held = Counter()
    for pattern, times in plan:
        assert sum(k * n for k, n in pattern.items()) <= 1024 and times > 0
        for k, n in pattern.items():
            held[k] += n * times
    assert held == histogram
    keys = np.array(sorted(histogram))
    index = {int(k): i for i, k in enumerate(keys)}
    known = [Counter({index[k]: n for k, n in p.items()}) for p, _ in P.best_fit(dict(histogram), 1024)]
    bound = P.solve_patterns(keys, np.array([histogram[k] for k in keys], float), 1024, known)[1]
    if draw != "one":
        assert P.plan_cost(plan, 1024) <= 1.01 * max(bound, lengths.sum())


def test_column_generation_improves_on_its_start():
    """Three kinds of length whose best pattern takes all three."""
    lengths, demand = np.array([101, 300, 623]), np.array([500.0, 500.0, 500.0])
    solved, bound = P.solve_patterns(lengths, demand, 1024)
    cost = sum(P.padded(sum(int(lengths[i]) * n for i, n in p.items()), 1024) * x for p, x in solved)
    assert cost == pytest.approx(500 * 1024, rel=0.01) and bound <= cost


def test_hot_length_is_ranked_without_gaps(spark):
    pieces = spark.createDataFrame([(k % 7, 0, 5, k % 3, 5) for k in range(5000)] + [(1, 0, 9, 1, 9)],
                                   "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")
    rows = P.rank_pieces(pieces, {5: 5000, 9: 1}, 1024).collect()
    assert sorted(r["rank"] for r in rows if r["length"] == 5) == list(range(5000))
    assert [r["rank"] for r in rows if r["length"] == 9] == [0]


def test_empty(no_docs):
    out = P.pack_documents(no_docs)
    assert out.count() == 0 and out.columns[-2:] == ["sequence_id", "offset"]
