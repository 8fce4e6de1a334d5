"""Plain versions of the operators, row by row, for the tests."""

import hashlib
import re

import xxhash


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def lines(rows):
    """{(id, text): (n_lines, n_dropped, sha256 of what is kept)}"""
    def key(line):
        return lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))

    order = lambda i: (i is None, i or 0)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(held.get(key(x), ())) < 2 or i == min(held[key(x)], key=order)]
        out[i, text] = len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(nodes, near):
    """Smallest index reached, by index."""
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if near(nodes[a], nodes[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(nodes))]
