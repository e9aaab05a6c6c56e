import random

import numpy as np
import pyarrow as pa
from tendril.llm import components as c
from tendril.llm import simhash


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            p, q = find(u), find(v)
            up[max(p, q)] = min(p, q)
    return sorted((x, find(x)) for x in list(up))


def rounds(monkeypatch):
    """Edges that each round of joins begins with."""
    seen, real = [], c._large
    monkeypatch.setattr(c, "_large", lambda edges: seen.append(edges.count()) or real(edges))
    return seen


def test_components_of_a_group_that_many_tasks_told(spark, monkeypatch):
    rng = random.Random(3)
    told = []  # 40 tasks with a forest each of most of a group of 150 nodes
    for _ in range(40):
        nodes = rng.sample(range(150), 140)
        told += [(max(x, y), min(x, y)) for x, y in zip(nodes, nodes[1:])]
    told += [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3), (2000, None)]
    edges = spark.createDataFrame(told, "u long, v long").cache()
    want = plain(told)
    seen = rounds(monkeypatch)
    assert sorted(map(tuple, c.components(edges).collect())) == want and not seen  # one chunk
    monkeypatch.setattr(c, "CHUNK", 1000)
    assert sorted(map(tuple, c.components(edges).collect())) == want and max(seen) < 1500 < len(set(told))
    assert c.components(edges.limit(0)).collect() == []


def test_tasks_tell_a_row_a_node():
    n = 300
    column = lambda x, kind: pa.array(np.asarray(x, kind))
    rows = [column(np.zeros(n), np.int64), column(np.zeros(n), np.int32), column(range(n), np.int64), column(np.arange(n) % 2, np.int64), column(np.zeros(n), np.int64)]
    batch = pa.RecordBatch.from_arrays(rows, ["key", "side", "node", "fp", "sig"])
    (told,) = simhash._close(False)(iter([batch]))
    rows = told.to_pylist()
    assert sorted(r["x"] for r in rows) == list(range(n))  # and not both ends of each pair
    assert all(r["like"] == 64 and r["b"] is not None and r["b"] < r["x"] for r in rows if r["x"])


def test_a_nodes_choice_is_that_of_all_its_pairs():
    rng = random.Random(5)
    pairs = list({tuple(rng.sample(range(40), 2)) for _ in range(150)})
    like = [rng.randrange(40, 65) for _ in pairs]
    got = {r["x"]: (r["a"], r["like"], r["b"]) for r in simhash._chosen(np.array(pairs).T, np.array(like)).to_pylist()}
    ends = [(x, y, k) for (u, v), k in zip(pairs, like) for x, y in ((u, v), (v, u))]
    for x in {e[0] for e in ends}:
        k, y = max((k, -y) for a, y, k in ends if a == x)
        assert got.pop(x) == (-y, k, min((y for a, y, _ in ends if a == x and y < x), default=None))
    assert not got
