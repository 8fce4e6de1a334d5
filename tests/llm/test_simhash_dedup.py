import random

import numpy as np
import pytest

from unievents.llm import simhash_dedup as S

from . import brute
from .conftest import odd_rows


def test_odd_rows_as_brute_force(odd):
    rows = [(i, t, brute.simhash(t)) for i, t in odd_rows()]
    root = brute.components([r[2] for r in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    want = sorted(str((i, f"{p:016x}", min((rows[k][0] for k in range(len(rows)) if root[k] == c and rows[k][0] is not None), default=None)))
                  for (i, _, p), c in zip(rows, root))
    assert sorted(str(tuple(r)) for r in S.simhash_dedup(odd).collect()) == want


def test_long_texts_in_parts():
    text = "a bB  ccc\td\n\x0be f g, h i j k l m" * 40
    want = brute.simhash(text)
    for size in (1, 7, 64, 1 << 22):
        assert S.fingerprint(text.encode(), 3, size) & (1 << 64) - 1 == want
    for short in ("", " \n", "one", " one TWO "):
        assert all(S.fingerprint(short.encode(), 3, size) & (1 << 64) - 1 == brute.simhash(short) for size in (1, 5, 100))


def test_every_pair_in_reach_shares_an_anchor():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 3):
            y ^= 1 << bit
        rows, keys = S.anchors(np.array([x, y], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_anchors_cover_all_words_within_the_radius():
    assert S._code()[4].max() == 6


@pytest.mark.parametrize("group_rows", [8192, 8])
def test_links_join_what_brute_force_joins(spark, group_rows):
    """Also with keys that are cut into blocks."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for x in list(prints)[:40]:
        for _ in range(rng.randint(1, 6)):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = S.near_links(spark.createDataFrame([(p,) for p in signed], "print bigint").repartition(4), 3, group_rows).collect()
    at = {p: k for k, p in enumerate(signed)}
    found = brute.components(range(len(prints)), lambda a, b: False)
    root = np.array(found)
    root = S._merge(len(prints), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]), root)
    assert root.tolist() == brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)


def test_empty(no_docs):
    assert S.simhash_dedup(no_docs).count() == 0
