import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else ({tuple(w)} if w else set())


def plain_kept(rows):
    """(doc_id, words) of the rows that stay, by brute force over all pairs."""
    own = sorted({(d, tuple((t or "").encode().lower().split())) for d, t, *_ in rows if d is not None})
    sets, root = [shingle_set(" ".join(x.decode() for x in w)) for _, w in own], list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) / both >= 0.8:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    best = {}
    for i, (d, w) in enumerate(own):
        best.setdefault(find(i), set()).add(d)
    return sorted(min(v) for v in best.values())


def docs_of(seed, n, size, *tails):
    """n texts of random words, and each with this many other words behind it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(size)]
        rows += [(len(rows) + i, " ".join([*base, *(word() for _ in range(k))]), "en", "web", 0) for i, k in enumerate((0, *tails))]
    return rows


def test_near_misses_stay(spark):
    rows = docs_of(9, 60, 300, 78)  # a similarity of 0.79
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == [r[0] for r in rows] == plain_kept(rows)


def test_longer_copies_are_found(spark):
    rows = docs_of(8, 60, 300, 60)  # a similarity of 0.83
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert plain_kept(rows) == list(range(0, 120, 2)) and len(got.collect()) <= 61


def test_a_failed_link_does_not_hide_others(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = [(i, " ".join(base[6 * i : 6 * i + 280]), "en", "web", 0) for i in range(20)]  # a chain: neighbours 0.96, ends far below 0.8
    assert len(plain_kept(rows)) == 1
    sparse = rows[::5] + [(100 + i, " ".join([*base[:240], *(f"y{i}_{k}" for k in range(34))]), "en", "web", 0) for i in range(30)]
    for case in (rows, sparse):
        got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(case, SCHEMA), "").collect()
        assert sorted(r.doc_id for r in got) == plain_kept(case)


def test_nulls_repeated_ids_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "one text", "en", "a", 0), (1, "quite another", "en", "a", 0), (1, "ONE  text", "en", "b", 0), (2, "one text", "en", "a", 0),
            (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, "one text", "en", "a", 0), (None, None, "en", "a", 0), (7, long, "en", "a", 0), (6, long + " end", "en", "a", 0)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = sorted((r.doc_id, " ".join((r.text or "").lower().split())) for r in got.collect() if r.doc_id is not None)
    assert kept == [(1, "one text"), (1, "quite another"), (3, ""), (6, long + " end")]
    assert sum(r.doc_id is None for r in got.collect()) == 2
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], SCHEMA), "").collect() == []
