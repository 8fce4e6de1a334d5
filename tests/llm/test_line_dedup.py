import hashlib

from unievents.llm import line_dedup as L

from . import brute
from .conftest import odd_rows


def test_odd_rows_as_brute_force(odd):
    want = brute.lines(odd_rows())
    out = L.dedup_lines(odd)
    assert out.columns == [*odd.columns, "kept_text", "n_lines", "n_dropped"]
    rows = out.toDF(*odd.columns, "kept", "count", "dropped").collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert (r["count"], r["dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) == want[r["doc_id"], r["text"]]


def test_filter_too_small_gives_the_same(odd):
    """A full filter suspects every line; the exact step decides."""
    few = L.dedup_lines(odd.select("doc_id", "text"), max_filter_bits=16)
    many = L.dedup_lines(odd.select("doc_id", "text"))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_filter_has_all_repeated_keys(spark):
    import numpy as np
    import xxhash
    docs = spark.createDataFrame([(k, f"line number {k % 50} of all\nsingle line {k}") for k in range(100)], "id int, text string").repartition(5)
    table = np.frombuffer(L.repeated_filter(docs, 18), np.uint8)

    def hit(key):
        return all(table[int(p[0]) >> 3] >> (int(p[0]) & 7) & 1 for p in L._probes(np.array([xxhash.xxh64_intdigest(key)], np.uint64), 18))

    assert all(hit(f"line number {k} of all".encode()) for k in range(50))
    assert sum(hit(f"single line {k}".encode()) for k in range(100)) <= 2


def test_empty(no_docs):
    assert L.dedup_lines(no_docs).count() == 0
