"""URL rules by Bloom filter cascades, with DataFrame functions only.

A rule is a host and a path. A url's candidate keys are the ends of its host that have as
many labels as some rule, each with the beginnings of its path that are as long as some
rule's path. All distinct keys of the corpus are the universe. A cascade encodes the
listed keys in its first level, the universe's other keys that this level lets pass in the
second, the listed keys that pass the second in the third, and so on until none is left:
within the universe it answers exactly, from a few kilobytes of literals and without a
join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unievents.llm.common import keep, pick

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def candidate_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """All keys of a url that a rule could equal, longest first (then by text)."""
    split = [(r[:r.index("/")], r[r.index("/"):]) for r in rules]
    labels = sorted({h.count(".") + 1 for h, _ in split})
    lengths = sorted({len(p) for _, p in split})
    whole = F.size(F.split(host, r"\."))
    keys = [F.when((whole >= n) & (F.length(path) >= k),
                   F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, k)))
            for n in labels for k in lengths]
    found = F.array_distinct(F.array_compact(F.array(*keys)))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("key")))), lambda s: s["key"])


class Level:
    """One Bloom filter of a cascade: 64-bit words as plain numbers."""

    def __init__(self, number: int, n_keys: int, rate: float):
        bits = max(64.0, n_keys * math.log(1 / rate) / math.log(2) ** 2)
        self.number, self.words = number, math.ceil(bits / 64)
        self.probes = max(1, round(64 * self.words / max(1, n_keys) * math.log(2)))
        self.probes = min(self.probes, max(1, math.ceil(math.log2(1 / rate))))
        self.data: list[int] = []

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(k)), F.lit(64 * self.words)) for k in range(self.probes)]

    def fill(self, keys: DataFrame) -> None:
        """Set the bits of ``keys`` (key); what comes to the driver is the filter's words."""
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
        found = dict(words.toLocalIterator())
        self.data = [found.get(w, 0) for w in range(self.words)]

    def passes(self, key: Column) -> Column:
        table = F.array(*[F.lit(w).cast("bigint") for w in self.data])
        tests = [F.getbit(F.element_at(table, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
                 for p in self.positions(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Cascade:
    """Exact membership of a listed set within a universe of keys."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_levels: int = 40):
        """``listed`` and ``universe``: distinct keys (key). Listed keys that are not in the
        universe are answered like any other listed key of the first level."""
        self.levels: list[Level] = []
        inside = keep(listed, "listed")
        outside = keep(universe.join(inside, "key", "left_anti"), "outside")
        n_in, n_out = inside.count(), outside.count()
        while n_in and len(self.levels) < max_levels:
            # the first level leaves about as many wrong keys as there are listed ones
            rate = 0.5 if self.levels else min(0.5, math.sqrt(0.5) * n_in / max(1, n_out))
            level = Level(len(self.levels), n_in, rate)
            level.fill(inside)
            self.levels.append(level)
            wrong = keep(outside.where(level.passes(F.col("key"))), "wrong")
            inside, outside, n_in, n_out = wrong, inside, wrong.count(), n_in
        if n_in:
            raise RuntimeError("cascade does not end")

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: it is if the first level that rejects it
        encodes keys that are not listed, or if none rejects it and the last one does not."""
        answer = F.lit(bool(len(self.levels) % 2))
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[k].passes(key), F.lit(bool(k % 2))).otherwise(answer)
        return answer


def judge_urls(pages: DataFrame, block: list[str], allow: list[str], id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every url.

    A rule (``host/path``) fits its host and all subdomains, if the url's path starts with
    the rule's. The longest fitting rule gives the verdict (of equally long ones the first
    by text, a block before an allow); without one the verdict is ``default`` and the rule
    null. Null urls and urls without ``://`` have an empty host and path, which no rule
    fits. Repeated rows are judged alike; no rows give no rows.
    """
    rules = {**dict.fromkeys(allow, "allow"), **dict.fromkeys(block, "block")}
    if any("/" not in r for r in rules):
        raise ValueError("a rule is a host and a path that starts with /")
    plain = pick(pages, id=id_col, url=url_col)
    host, path = url_parts(F.col("url"))
    parts = plain.select("id", host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), list(rules))
    universe = keep(parts.select("host", "path").select(F.explode(keys).alias("key")).distinct(), "keys")
    one = pages.sparkSession.range(1)
    cascades = {}
    for verdict in ("block", "allow"):
        listed = F.array(*[F.lit(r) for r, v in rules.items() if v == verdict]).cast("array<string>")
        cascades[verdict] = Cascade(one.select(F.explode(listed).alias("key")), universe)
    fits = parts.withColumn("rule", F.get(F.filter(keys, lambda k: cascades["block"].holds(k) | cascades["allow"].holds(k)), F.lit(0)))
    return fits.select("id", "host", "path", "rule",
                       F.when(F.col("rule").isNull(), F.lit(default)).when(cascades["block"].holds(F.col("rule")), F.lit("block"))
                       .otherwise(F.lit("allow")).alias("verdict"))
