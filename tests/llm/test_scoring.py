import math
import random
import zlib
from collections import Counter

import numpy as np

from tendril.llm import scoring

SCHEMA = "doc_id long, text string, score string, data string"


def tokens(t):
    return (t or "").encode().lower().split() + [b"\n"]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def plain_base(rows):
    c = Counter(x for d, t, *_ in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) for d, t, *_ in rows]


def plain_model(rows):
    """p(word, context) by recursion over dictionaries; b"" starts a text."""
    seen = {}
    for d, t, *_ in rows:
        if not held(d):
            s = [b"", *tokens(t)]
            for i in range(1, len(s)):
                for k in range(min(i, 2) + 1):
                    seen.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    one = seen.get((), Counter())

    def p(w, c):
        if not c:
            return (one[w] + 1) / (sum(one.values()) + len(one) + 1)
        own, k = seen.get(c, Counter()), scoring.PRIOR[len(c)]
        return (own[w] + k * p(w, c[1:])) / (sum(own.values()) + k)

    return p, one


def plain_score(p, text):
    s = [b"", *tokens(text)]
    return sum(math.log10(p(s[i], tuple(s[max(0, i - 2) : i]))) for i in range(1, len(s)))


def rows_of(seed, n):
    rng = random.Random(seed)
    w = lambda: "".join(rng.choice(["th", "er", "ing", "on", "É", "нд", "7", "~", "'"]) for _ in range(rng.randrange(1, 4)))
    return [(i, rng.choice([" ", "\n", " \t "]).join(w() for _ in range(rng.randrange(0, 60))), "", "") for i in range(n)]


def check(spark, rows):
    got = sorted(map(tuple, scoring.score(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    p, _ = plain_model(rows)
    want = sorted(((*b, plain_score(p, r[1])) for b, r in zip(plain_base(rows), rows, strict=True)), key=repr)
    order = lambda x: (str(x[0]), x[2], x[6])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


def test_matches_plain_model(spark, monkeypatch):
    rows = rows_of(1, 300) + [(1000, None, "", ""), (1001, "", "", ""), (1002, "𝔘nknown WORDS here", "", ""), (None, "th er", "", ""), (5, "th er th er th", "", ""), (5, "th er th er th", "", "")]
    rows += [(2000, "er on " * 20_000 + "th", "", "")]
    check(spark, rows)
    for name, value in (("CHUNK", 1500), ("SHARD", 700), ("LANES", 7)):  # many chunks, shards and cuts of a text give the same
        monkeypatch.setattr(scoring, name, value)
    check(spark, rows)


def test_sums_to_one():
    p, one = plain_model(rows_of(2, 60))
    for c in ((), (b"th",), (b"", b"th"), (b"th", b"er"), (b"never",)):
        assert math.isclose(sum(p(w, c) for w in one) + p(b"unknown", c), 1)


def test_packing():
    rng = np.random.default_rng(1)
    for x in (np.sort(rng.integers(0, 1 << 64, 1000, np.uint64)), np.array([5, 0, 7, 1], np.uint64), np.empty(0, np.uint64)):
        assert all((scoring.unpack(scoring.pack(x, way), way) == x).all() for way in (True, False))


def test_nothing_to_learn(spark):
    assert scoring.score(spark.createDataFrame([], SCHEMA)).collect() == []
    ids = [i for i in range(60) if held(i)]
    check(spark, [(i, "a b c", "", "") for i in ids])
