import random

import numpy as np

from tendril.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, every=50, k=5):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            far = [(-float(neighbours.cosine(a[None], b[None])[0]), i) for i, b in ok if i != q and len(b) == len(a)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(far)[:k])]
    return sorted(out)


def test_exact_with_copies_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SMALL", 100)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], 0, "") for i in range(600)]
    rows += [(1000 + i, rows[100][1], 0, "") for i in range(300)]
    rows += [(2000, None, 0, ""), (2050, [0.0] * 6, 0, ""), (2100, [float("nan")] * 6, 0, ""), (2150, [None] + [1.0] * 5, 0, ""), (None, [1.0] * 6, 0, ""), (2200, [1.0, 2.0], 0, ""), (2201, [1.0, 3.0], 0, "")]
    got = sorted(map(tuple, neighbours.nearest(spark.createDataFrame(rows, SCHEMA)).collect()))
    want = plain(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_relaxed_recall_and_empty(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(i % 7, 1) for _ in range(8)], 0, "") for i in range(1500)]
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), factor=1.3).collect()}
    want = {(w[0], w[2]) for w in plain(rows)}
    assert len(got & want) >= 0.9 * len(want)
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert neighbours.nearest(spark.createDataFrame([(50, [1.0], 0, "")], SCHEMA)).collect() == []


def test_ties_on_one_ray(spark):
    """Vectors of one direction and many lengths: their cosines differ by rounding only, and the exact ones decide."""
    rng = random.Random(3)
    ray = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, [x * (1 + i) for x in ray], 0, "") for i in range(49)] + [(50 + i, [x * (3 + i) for x in ray], 0, "") for i in range(700)]
    rows += [(5000 + i, [float(-i - 1), 0.0, 0.0, 0.0, 0.0, 0.0], 0, "") for i in range(100)]
    got = sorted(map(tuple, neighbours.nearest(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows)


def test_search_is_exact_whatever_the_leaves():
    rng = np.random.default_rng(5)
    for n, d in ((1, 3), (4, 3), (900, 3), (900, 12)):
        m = np.concatenate([rng.normal(size=(n, d)), np.repeat(rng.normal(size=(1, d)), 60, axis=0) * np.arange(1, 61)[:, None]])
        ids = rng.permutation(len(m)) * 3
        got = neighbours.Search(m, ids, m[:40], ids[:40], 5, 1.0)
        for q in range(min(40, len(m))):
            score = neighbours.cosine(np.repeat(m[q : q + 1], len(m), axis=0), m)
            want = [x for x in np.lexsort((ids, -score)) if ids[x] != ids[q]][:5]
            assert [x for x in got.found[q] if x >= 0] == want
