import hashlib
import random
from collections import defaultdict

from tendril.llm import substrings

SCHEMA = "doc_id long, text string, h string, key string"


def plain(rows):
    low = defaultdict(lambda: 1 << 62)
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - 49):
            low[tuple(w[i : i + 50])] = min(low[tuple(w[i : i + 50])], d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49):
            if low[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    vocab = ["Wé%d" % i for i in range(300)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, loop, long = text(120), ["a", "b"] * 60, text(400)
    rows = []
    for i in range(n):
        w = text(rng.randrange(0, 130))
        kind = rng.randrange(6)
        if kind == 0:
            a = rng.randrange(60)
            w = w[:40] + passage[a : a + rng.randrange(45, 61)] + w[40:]
        elif kind == 1:
            w += passage
        elif kind == 2:
            w = loop[: rng.randrange(40, 120)] + w
        elif kind == 3:
            a = rng.randrange(300)
            w = long[a : a + 100]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t"]).join(w), "x", "y"))
    return rows


def columns(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_matches_plain_search(spark):
    rows = made(1, 150) + [(0, None, "", ""), (-1, "", "", "")]
    rows.append((10**7, rows[3][1], "", ""))
    want = plain(rows)
    assert sum(r[2] for r in want) > 1000
    assert columns(substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA))) == want


def test_hot_prefixes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 3)
    rows = made(2, 120)
    assert columns(substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_odd_rows(spark):
    w = " ".join(f"w{i}" for i in range(70))
    got = columns(substrings.remove_repeats(spark.createDataFrame([(7, w, "", ""), (7, w, "", ""), (7, w + " x", "", ""), (9, w, "", "")], SCHEMA)))
    assert [(r[0], r[2]) for r in got] == [(7, 0), (7, 0), (7, 0), (9, 70)]
    got = substrings.remove_repeats(spark.createDataFrame([(None, w, "", ""), (3, w, "", "")], SCHEMA)).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(None, 0), (3, 0)}
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
