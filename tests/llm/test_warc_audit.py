import hashlib

import pytest

from unievents.llm import warc_audit as W


_same = lambda i, url, body: body  # noqa: E731  (a lambda goes to the workers by value)


def _pages(spark, n=400):
    rows = [(k, f"http://h/{k}", "body " * (k % 50) + str(k)) for k in range(n)]
    rows += [(None, None, None), (5, "", ""), (5, "", ""), (5, "http://h/5", "other"), (7000, "http://x/", "z" * 400_000)]
    return spark.createDataFrame([(h, i, u, "x") for i, u, h in rows], "html string, page_id bigint, url string, digest string").repartition(4)


def test_equal_replicas_give_nothing(spark):
    assert W.audit(W.archive(_pages(spark), _same)).count() == 0


@pytest.mark.parametrize("file_bytes", [64 << 20, 20_000])
def test_damage_is_located(spark, file_bytes):
    def damage(i, url, body):
        return None if i == 33 else b"!" + body if i in (7, 210) else body

    found = {r["record_id"]: r for r in W.audit(W.archive(_pages(spark), damage, file_bytes=file_bytes)).collect()}
    assert {i: r["status"] for i, r in found.items()} == {7: "changed", 33: "missing", 210: "changed"}
    record = W.record_bytes("http://h/7", b"body " * 7 + b"7")
    assert (found[7]["digest"], found[7]["length"]) == (hashlib.sha256(record).hexdigest(), len(record))
    assert found[33]["copy_digest"] is None and found[7]["copy_length"] == found[7]["length"] + 1


def test_extra_lost_and_empty_replicas(spark):
    leaves = [(0, "a", 0, 10, 1, "d1"), (0, "a", 10, 10, 2, "d2"), (0, "b", 0, 5, 3, "d3"), (1, "a", 0, 10, 1, "d1"), (1, "a", 10, 10, 2, "d2"),
              (1, "b", 0, 5, 3, "d3"), (1, "c", 1 << 30, 5, None, "d4"), (0, "a", 10, 10, 2, "d2")]
    frame = spark.createDataFrame(leaves, "replica int, file string, offset bigint, length bigint, record_id bigint, digest string")
    assert [(r["status"], r["file"], r["copy_digest"]) for r in W.audit(frame).collect()] == [("extra", "c", "d4")]
    assert sorted(r["status"] for r in W.audit(frame.where("replica = 0")).collect()) == ["missing"] * 3
    assert W.audit(frame.limit(0)).count() == 0


def test_files_are_read_and_damage_is_bounded(spark, tmp_path):
    records = [W.record_bytes(f"http://h/{k}", b"x" * k) for k in range(50)]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    data = b"".join(records)
    (tmp_path / "a/one.warc").write_bytes(data)
    at = sum(map(len, records[:20])) + 3
    (tmp_path / "b/one.warc").write_bytes(data[:at] + b"\0" + data[at + 1:])
    assert [r for _, r in W.split_records(data)] == records
    both = [W.read_warc(spark, str(tmp_path / d)).selectExpr(f"{k} as replica", "*") for k, d in enumerate("ab")]
    found = W.audit(both[0].union(both[1])).collect()
    assert [(r["offset"], r["status"]) for r in found] == [(at - 3, "changed")]


def _audited(spark, tmp_path, name, left, right):
    for side, data in (("a", left), ("b", right)):
        (tmp_path / side).mkdir(exist_ok=True)
        (tmp_path / side / name).write_bytes(data)
    both = [W.read_warc(spark, str(tmp_path / d)).selectExpr(f"{k} as replica", "*") for k, d in enumerate("ab")]
    return sorted((r["offset"], r["status"], r["length"], r["copy_length"]) for r in W.audit(both[0].union(both[1])).collect())


def test_moved_records_are_no_difference(spark, tmp_path):
    """One record grows by a byte, one goes, one comes in; copies among them: a row for each
    of these and none for the many that moved."""
    records = [W.record_bytes(f"http://h/{k % 60}", b"x" * (k % 60)) for k in range(100)]
    at = [sum(map(len, records[:k])) for k in range(101)]
    grown = [*records[:20], W.record_bytes("http://h/20", b"x" * 21), *records[21:]]
    assert _audited(spark, tmp_path, "one.warc", b"".join(records), b"".join(grown)) == [(at[20], "changed", len(records[20]), len(records[20]) + 1)]
    new = W.record_bytes("http://new", b"y" * 500)
    mixed = [*grown[:40], *grown[41:70], new, *grown[70:]]
    shift = 1 - len(records[40])
    assert _audited(spark, tmp_path, "one.warc", b"".join(records), b"".join(mixed)) == sorted([
        (at[20], "changed", len(records[20]), len(records[20]) + 1), (at[70] + shift, "extra", None, len(new)), (at[40], "missing", len(records[40]), None)])


def test_compressed_files(spark, tmp_path):
    """A record a member; a damaged member and a cut file."""
    import gzip

    records = [W.record_bytes(f"http://h/{k}", b"x" * k) for k in range(30)]
    members = [gzip.compress(r, mtime=0) for r in records]
    at = [sum(map(len, members[:k])) for k in range(31)]
    assert list(W.split_members(b"".join(members))) == list(zip(at, records))
    broken = [*members[:10], members[10][:12] + b"\0\0" + members[10][14:], *members[11:]]
    found = _audited(spark, tmp_path, "one.warc.gz", b"".join(members), b"".join(broken)[:-5])
    assert [(o, s) for o, s, *_ in found] == [(at[10], "changed"), (at[29], "changed")]


def test_no_pages(spark):
    assert W.audit(W.archive(_pages(spark).limit(0), _same)).count() == 0
