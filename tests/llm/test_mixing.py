import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tendril.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string, size string"


def plain_targets(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        t = {s: 3.0 * size[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and t[s] > 3 * size[s]}
        if not over:
            return t
        capped |= over


def plain_parts(sizes, missing):
    """Inclusion probabilities in proportion to size, 1 at most, by bisection for the factor."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(min(1, c * s) * s for s in sizes) < missing else (lo, c)
    return [min(1.0, lo * s) for s in sizes]


def test_targets_and_samples(spark):
    random.seed(8)
    rows = [(1, None, "a", "", ""), (2, "", None, "", ""), (3, " one  two\n", "zero", "", "")]
    for i in range(3000):
        source = random.choice(["a"] * 12 + ["b", "é", "c", None, "d"])
        rows.append((10 + i, " ".join(["w"] * random.randrange(0, 40)), source, "", ""))
    rows += [rows[50]] * 3
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    size, taken, by = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        by[r.source].append(r)
    want = plain_targets(dict(size))
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for s in want:
        assert abs(taken[s] - want[s]) <= 40, (s, taken[s], want[s])
        whole = math.floor(want[s] / size[s] + 1e-9) if size[s] else 0
        parts = plain_parts([r.size for r in by[s]], want[s] - whole * size[s])
        assert all(abs(r.part - p) < 1e-6 for r, p in zip(by[s], parts, strict=True))
        assert all(r.copies in (whole, whole + 1) for r in by[s] if r.size)
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_samples_have_the_inclusion_rates(spark):
    """Over many sources that are alike: a document is taken as often as its probability says, and samples' sizes stay fixed."""
    sizes = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 170, 12, 12, 12, 12, 30, 31]
    rows = [(1000 * k + i, "w " * s, f"s{k:03}", "", "") for k in range(300) for i, s in enumerate(sizes)]
    hits, part, picked = defaultdict(int), {}, defaultdict(int)
    for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect():
        if (weight := int(r.source[1:]) % 3 + 1) != 2:  # their targets are 0.5 and 1.5 of their sizes
            extra = r.copies - weight // 2
            hits[r.doc_id % 1000] += extra
            part[r.doc_id % 1000] = r.part
            picked[r.source] += extra
    assert all(abs(part[i] - p) < 1e-9 for i, p in enumerate(plain_parts(sizes, sum(sizes) / 2)))
    assert len({round(p, 6) for p in part.values()}) > 8 and max(part.values()) > 0.8
    assert max(picked.values()) - min(picked.values()) <= 1
    for d, p in part.items():
        assert abs(hits[d] / 200 - p) <= 4 * math.sqrt(p * (1 - p) / 200) + 0.02, (d, hits[d] / 200, p)


def test_repeat_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "t", "s"), (2, "d e", "y", "t", "s"), (3, None, "y", "t", "s"), (2, "d e", "y", "t", "s"), (2, "d e", "y", "other", "s"), (None, "f g", None, None, None)], SCHEMA)
    docs = docs.withColumn("_n", F.lit(1)).withColumn("copies", F.lit("c")).withColumn("row", F.lit(None).cast("string")).withColumn("all", F.array(F.lit(1)))
    got = mixing.repeat(docs)
    assert got.columns == docs.columns
    n, want = defaultdict(int), defaultdict(int)
    for r in got.collect():
        n[r.doc_id] += 1
        assert r._n == 1 and r.copies == "c" and r.row is None and r.all == [1]
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies if r.size else 1
    assert dict(n) == {k: v for k, v in want.items() if v}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.repeat(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_row_that_makes_most_of_the_table(spark):
    rows = [(5, "a b c d", "x", "", "")] * 3000 + [(i, "a b", "y", "", "") for i in range(10, 700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.repeat(docs).count() == taken
