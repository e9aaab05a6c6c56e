import hashlib
import random

from pyspark.sql import functions as F

from tendril.llm import sketches

SCHEMA = "doc_id long, text string, next_id string, fingerprint string"


def runs(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_likeness(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("αβγδ𝔘abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(0, 400)))
    rows = [(i * 7 + rng.randrange(5), text(), "", "") for i in range(2500)]
    rows += [(10**6, None, "", ""), (10**6 + 1, "one", "", ""), (10**6 + 2, "a b c d e", "", ""), (None, "x", "", "")]
    got = {r.doc_id: r for r in sketches.fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    assert len(got) == len(order)
    off = []
    for i, (d, t, *_) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + (n[1] or "")[:half]
        r = got[d]
        assert (r.next_id, r.n_chars, r.edited_sha256) == (n[0], len(t), hashlib.sha256(edited.encode()).hexdigest())
        off.append(abs(r.near_edited - near(runs(t), runs(edited))))
        off.append(abs(r.near_next - near(runs(t), runs(n[1] or ""))))
        if len(runs(t)) < sketches.SIZE:
            assert r.n_shingles == len(runs(t))
    assert max(off) < 0.25 and sum(off) / len(off) < 0.03


def test_merge_and_containment(spark):
    d = spark.createDataFrame([(" ".join(map(str, range(1000))), " ".join(map(str, range(500)))), ("", "")], "a string, b string")
    a, b = sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))
    r = d.select(sketches.resemblance(a, b), sketches.containment(b, a), sketches.count(a), sketches.resemblance(sketches.merge(a, b), a), (sketches.from_text(sketches.as_text(a)) == a)).collect()
    assert abs(r[0][0] - 0.5) < 0.15 and r[0][1] > 0.8 and abs(r[0][2] - 996) < 300 and r[0][3] == 1.0 and r[0][4]
    assert tuple(r[1]) == (1.0, 1.0, 0.0, 1.0, True)


def test_single_and_empty(spark):
    assert sketches.fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect() == []
    r = sketches.fingerprint_edits(spark.createDataFrame([(5, "abcd", "", "")], SCHEMA)).collect()
    assert [(x.doc_id, x.next_id, x.edited_sha256) for x in r] == [(5, 5, hashlib.sha256(b"abab").hexdigest())]


def test_repeated_and_extreme_ids(spark):
    rows = [(1, "a b c d e f", "", ""), (1, "g h i j k l m", "", ""), (2, "n o p q", "", ""), (2, "n o p q", "", ""), (2, None, "", ""), (-(2**63), "least", "", ""), (2**63 - 1, "most of all", "", "")]
    got = sketches.fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    h = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t, *_ in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted({(d, h[t or ""], t or "") for d, t, *_ in rows}, reverse=True)
    want = []
    for d, t, *_ in rows:
        t = t or ""
        n = order[(order.index((d, h[t], t)) + 1) % len(order)]
        half = len(t) // 2
        want.append((d, hashlib.sha256((t[: len(t) - half] + n[2][:half]).encode()).hexdigest(), n[0]))
    assert sorted((r.doc_id, r.edited_sha256, r.next_id) for r in got) == sorted(want)


def test_one_id_that_makes_most_of_the_table(spark):
    rows = [(7, f"text {i % 900} of the one", "", "") for i in range(2000)] + [(i, "x", "", "") for i in range(20)]
    got = sketches.fingerprint_edits(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == len(rows)
