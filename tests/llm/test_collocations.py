import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tendril.llm import collocations as c


def plain(rows, least, top):
    """Counts of all phrases by hand, whole numbers of any size."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = tuple(re.findall(r"[^ \t]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            found[lang, w] = (a, *min(cuts))
    gone = {(lang, w[i : i + k]) for (lang, w), x in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * x[0] >= 80 * f[lang, w[i : i + k]]}
    out = []
    for lang in n:
        kept = sorted(((-x[1], -x[0], " ".join(w).encode(), x) for (q, w), x in found.items() if q == lang and (q, w) not in gone))
        out += [(lang, i + 1, p.decode(), x[0], x[3], x[4], n[lang], x[1]) for i, (_, _, p, x) in enumerate(kept[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(x) for x in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(rng, n):
    common = ["Of", "the", "a", "é", "x\x1cy", "日本", "to", "B-b"]
    text = lambda: "".join(rng.choice(common + [f"w{rng.randrange(60)}"]) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", " ? ", "\x0b"]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "de", None, "und", ""]), rng.choice([text(), text(), text(), "licensed under the terms of it", None, ""])) for _ in range(n)]


def test_equals_counting_by_hand(spark):
    rows = made(random.Random(1), 400)
    docs = spark.createDataFrame([(i, *r, "x", 5) for i, r in enumerate(rows)], "doc_id long, lang string, text string, word string, n int").repartition(3)
    assert rows_of(c.mine(docs, 5)) == plain(rows, 5, 2000)
    assert rows_of(c.mine(docs, 3, 7)) == plain(rows, 3, 7)
    got = c.mine(docs, 5, chunk=300, shard=100, sample=1)  # texts are cut, and many leading sequences fill more than a shard
    assert rows_of(got) == plain(rows, 5, 2000)


def test_long_texts_are_taken_whole(spark):
    rng = random.Random(2)
    rows = [("en", " ".join(rng.choice(["a", "b", "c", "dd", "e."]) for _ in range(3000))), ("en", "q" * 5000 + " a b c" * 40), ("en", "a b c " * 400)]
    assert rows_of(c.mine(spark.createDataFrame(rows, "lang string, text string"), 30, chunk=200)) == plain(rows, 30, 2000)


def test_another_seed_if_two_words_have_one_hash(spark, monkeypatch):
    def clash(seed, *sizes, real=c._count):
        def run(batches):
            for b in real(seed, *sizes)(batches):
                h = [1 if seed == 0 and k == 1 else x for k, x in zip(b.column("kind").to_pylist(), b.column("h").to_pylist(), strict=True)]
                yield c.pa.RecordBatch.from_arrays([c.pa.array(h, c.pa.int64()) if n == "h" else b.column(n) for n in b.schema.names], b.schema.names)

        return run

    monkeypatch.setattr(c, "_count", clash)
    rows = [("en", "one two three. ten two. ten two")] * 20
    assert rows_of(c.mine(spark.createDataFrame(rows, "lang string, text string"), 5)) == plain(rows, 5, 2000)


def test_empty_and_null(spark):
    shape = "lang string, text string"
    for rows in ([], [(None, None), ("en", ""), ("en", " ,. ")], [("en", "a b")] * 29):
        assert c.mine(spark.createDataFrame(rows, shape)).collect() == []
    assert rows_of(c.mine(spark.createDataFrame([(None, "A b")] * 30, shape))) == [("und", 1, "a b", 30, 30, 30, 60, 1000000)]


def test_scores_beyond_64_bits(spark):
    got = spark.range(1).selectExpr(f"{c._exact('9000000000000000000L', '(9000000000000000000L + 1)')} AS x", f"{c._exact('9000000000000000000L', '9000000000000000000L')} AS y").first()
    assert (got.x, got.y) == (1999999, 2000000)


def test_quicksort_counts_equal_partitions():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 5, (4, 3000)).astype(np.uint64)
    for d in range(1, 4):
        rows[d][rows[d - 1] == 0] = 0
    weight = rng.integers(1, 4, 3000)
    want = Counter()
    for i in range(3000):
        for d in range(1, 5):
            if rows[d - 1, i]:
                want[tuple(rows[:d, i].tolist())] += int(weight[i])
    for least in (1, 30, 200, 10**9):
        assert {tuple(rows[:d, i].tolist()): t for d, i, t in c.quicksort(rows, weight, least)} == {k: v for k, v in want.items() if v >= least}


def test_streams_leave_a_worker_little_memory():
    text = b"some words of a text, " * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 1000), pa.array([text] * 1000, pa.binary())], ["lang", "text"])
    found = [(len(data), own) for _, data, own in c._streams(batch, c.CHUNK)]
    assert max(n for n, _ in found) < 5 << 20 and sum(own for _, own in found) >= 1000 * len(text)
