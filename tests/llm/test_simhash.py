import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tendril.llm import simhash

SCHEMA = "doc_id long, text string, component_id string"


def plain_fp(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows, radius=3):
    fp = {}
    for d, t, *_ in rows:
        fp.setdefault(d, []).append(plain_fp(t))
    ids = [(d, f) for d, fs in fp.items() for f in fs]
    root = {d: d for d, _ in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(ids):
        for b, y in ids[:i]:
            if (x ^ y).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, f"{f:016x}", find(d)) for d, f in ids)


def test_matches_plain_search_with_hot_buckets(spark, monkeypatch):
    random.seed(5)
    vocab = ["w%d" % i for i in range(40)]
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One", "x"), (5, "one", "x"), (6, "ÀB c", "x")]
    base = [random.choice(vocab) for _ in range(120)]
    for i in range(60):
        w = list(base)
        w[random.randrange(120)] = random.choice(vocab)
        rows.append((100 + i, " ".join(w), "y"))
    for i in range(40):
        rows.append((300 + i, " ".join(random.choice(vocab) for _ in range(random.randrange(1, 60))), "z"))
    rows += [(900, rows[10][1], "c"), (901, rows[10][1], "c"), (901, rows[10][1], "c")]
    monkeypatch.setattr(simhash, "SHARD", 8)
    for blocks in (None, 5, 6):
        got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), blocks=blocks).collect()
        assert sorted(map(tuple, got)) == plain(rows)


def test_empty_and_null_id(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d", ""), (3, "a b c d", "")], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (3, 3)}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.integers(0, 9), st.integers(0, 2**32))
def test_trees_find_all_within_radius(values, radius, seed):
    rng = random.Random(seed)
    values = values + [v ^ (1 << rng.randrange(64)) for v in values] + values[:3]
    a, shard = np.array(values, np.uint64), np.array([rng.randrange(3) * 7 for _ in values])
    for size in (3, 2_000_000):
        simhash.VISITS = size
        half = shard == 7
        trees = simhash.Trees.joined([simhash.Trees(shard[half], a[half]), simhash.Trees(shard[~half], a[~half])])
        row = np.r_[np.flatnonzero(half), np.flatnonzero(~half)]
        got = [(int(row[i]), int(j)) for p, q in trees.probe(shard, a, radius) for i, j in zip(p, q, strict=True)]
        every = [(i, j) for i in range(len(values)) for j in range(len(values)) if shard[i] == shard[j] and (values[i] ^ values[j]).bit_count() <= radius]
        assert sorted(got) == sorted(every)
        assert list(trees.probe(np.array([5]), a[:1], radius)) == []


def test_trees_follow_few_edges():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 64, 4000, np.uint64)
    trees = simhash.Trees(np.zeros(len(a), np.int64), a)
    got = [(i, j) for p, q in trees.probe(np.zeros(len(a), np.int64), a, 3) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
    assert sorted(got) == [(i, i) for i in range(len(a))]
    assert len(trees.edges) == len(a) - 1 and trees.visits < 0.4 * len(a) ** 2


def test_links_come_from_trees_broadcast_in_waves(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, v ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))) for i, v in enumerate(base)]
    waves, search = [], simhash._search
    monkeypatch.setattr(simhash, "BUNDLE", 300)
    monkeypatch.setattr(simhash, "WAVE_MB", 0)
    monkeypatch.setattr(simhash, "_search", lambda *a: waves.append(a[3]) or search(*a))
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame(rows, "node long, fp long"), 3, 4).collect()}
    assert {(i, 1000 + i) for i in range(300)} <= got and len(waves) == 8  # 600 * 4 / 300, a bundle a wave


def test_minima_estimate_similarity():
    rng = np.random.default_rng(3)
    for size in (40, 200, 5000):
        for jaccard in (0.5, 0.8, 0.95):
            shared = round(2 * size * jaccard / (1 + jaccard))
            told = []
            for _ in range(60):
                h = rng.integers(0, 1 << 64, 2 * size - shared, np.uint64)
                a, b = (simhash.minima(x) & (2**64 - 1) for x in (h[:size], h[size - shared :]))
                told.append(1 - 2 * (a ^ b).bit_count() / simhash.MINIMA)
            assert abs(np.mean(told) - shared / (2 * size - shared)) < 0.06
            assert np.std(told) < 0.15
    assert simhash.minima(np.empty(0, np.uint64)) == 0


def test_masks_reach_texts_with_a_passage_added():
    """The share of pairs that the masks make candidates, where two texts' bits differ as a fifth of new words lets them."""
    rng = np.random.default_rng(8)
    found = 0
    for _ in range(400):
        flips = rng.random((simhash.SEEDS, 64)) < 0.145
        differ = [int(sum(1 << b for b in np.flatnonzero(f))) for f in flips]
        found += any(not d & m and d.bit_count() <= simhash.RADIUS for d in differ for m in simhash.masks())
    assert found >= 0.95 * 400


def test_masks_grow_with_the_nodes():
    assert simhash.masks() == simhash.masks(2**25) and {m.bit_count() for m in simhash.masks()} == {simhash.MASK_BITS}
    rng = np.random.default_rng(9)
    for nodes in (2**27, 10**9, 10**11):
        made = simhash.masks(nodes)
        bits = made[0].bit_count()
        assert {m.bit_count() for m in made} == {bits} and len(set(made)) == len(made)
        assert nodes / 2**bits <= simhash.SHARD < 2 * nodes / 2**bits and len(made) <= 2 * (nodes / simhash.SHARD) ** 0.23 * simhash.MASKS / 16**0.9
        found = 0
        for _ in range(200):
            flips = rng.random((simhash.SEEDS, 64)) < simhash.FLIPPED
            differ = [int(sum(1 << b for b in np.flatnonzero(f))) for f in flips]
            found += any(not d & m and d.bit_count() <= simhash.RADIUS for d in differ for m in made)
        assert found >= 0.92 * 200


def edited(words, kind, rng):
    """A text's words after one kind of edit that leaves about nine tenths of its shingles."""
    n, w = len(words), list(words)
    if kind == "words replaced":
        for i in rng.sample(range(n), max(1, n // 60)):
            w[i] = f"new{rng.randrange(10**6)}"
    elif kind == "passage added":
        at = rng.randrange(n)
        w[at:at] = [f"new{rng.randrange(10**6)}" for _ in range(n // 8)]
    elif kind == "end cut":
        w = w[: n - n // 9]
    elif kind == "blocks moved":
        w = w[n // 2 :] + w[: n // 2]
    elif kind == "words dropped":
        for i in sorted(rng.sample(range(n), max(1, n // 60)), reverse=True):
            del w[i]
    return w


KINDS = ("words replaced", "passage added", "end cut", "blocks moved", "words dropped")


def reached(a, b):
    """Whether two texts share a mask's bucket within the radius, and pass each of the floors; None below 0.8."""
    x, y = (set(simhash.shingles(t, simhash.SHINGLE)) for t in (a, b))
    if 5 * len(x & y) < 4 * len(x | y):
        return None
    ha, hb = (simhash._hashes(list(set(simhash.shingles(t, 1)))) for t in (a, b))
    hx, hy = (simhash._hashes(list(s)) for s in (x, y))
    differ = [p ^ q for p, q in zip(simhash.seeded(ha, hx), simhash.seeded(hb, hy), strict=True)]
    masked = any(not d & m and d.bit_count() <= simhash.RADIUS for d in differ for m in simhash.masks())
    like = 1 - 2 * ((simhash.minima(hx) ^ simhash.minima(hy)) & (2**64 - 1)).bit_count() / simhash.MINIMA
    far = int(np.bitwise_count(np.frombuffer(simhash.wide_minima(hx), np.uint8) ^ np.frombuffer(simhash.wide_minima(hy), np.uint8)).sum())
    return masked, like >= simhash.LEAST, 1 - 2 * far / simhash.WIDE >= simhash.LEAST_WIDE


def test_candidates_reach_every_kind_of_edit():
    rng = random.Random(10)
    for kind in KINDS:
        got = []
        for _ in range(60):
            n = rng.choice([40, 120, 400, 1500])
            words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(n)]
            got.append(reached(" ".join(words).encode(), " ".join(edited(words, kind, rng)).encode()))
        got = [g for g in got if g]
        assert len(got) >= 30 and all(sum(x) >= 0.95 * len(got) for x in zip(*got, strict=True)), kind
