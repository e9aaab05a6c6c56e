import hashlib
import random
import re

from tendril.llm import secrets

SCHEMA = "doc_id long, text string, spans string, kind string"
KINDS = {
    "assign": (re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, (p, ok)) in enumerate(KINDS.items()) for m in p.finditer(text or "") if ok(m)]
    return [x[2] for x in sorted(found)]


def made():
    rng = random.Random(1)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice(["th", "er", "ing", "on", "Stre", "nd", "é"]) for _ in range(rng.randrange(1, 12)))
    parts = [
        lambda: f'token = "{hexes(40)}"', lambda: f"API_KEY:{hexes(5)}", lambda: "AKIA" + "A1B2C3D4E5F6G7H8", lambda: "AKIA123", lambda: hexes(23), lambda: hexes(24) + "x",
        lambda: "secret=token=abc", lambda: "passwd : 'hunter2.x'", lambda: "𝔘𝔘é", lambda: "tokenizers :x",
    ]
    rows = [(i, " ".join(rng.choice(parts)() if rng.random() < 0.1 else word() for _ in range(rng.randrange(60)))) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, "token=" + hexes(40)), (903, "x" * 5000 + " secret: abcdefgh"), (None, "AKIA" + "Z" * 30)]


def test_spans_and_model(spark):
    rng = random.Random(7)
    b62 = "".join(chr(c) for r in ((48, 58), (65, 91), (97, 123)) for c in range(*r))
    rows = made() + [(2000 + i, "see " + "".join(rng.choice(b62) for _ in range(32)) + " é") for i in range(40)]
    rows += [(3000 + i, "see thingerstreonndthering_oner_thing é") for i in range(10)]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    model = secrets.train(docs)
    got = {r.doc_id: r for r in secrets.scan(docs, model).collect()}
    for d, t in rows:
        want = plain(t)
        r = got[d]
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == want, (d, t)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in KINDS)
    assert all(got[2000 + i].spans == "markov:4:36" for i in range(40))
    assert all(got[3000 + i].spans == "" for i in range(10))
    clean = secrets.redact(docs, model)
    assert clean.columns == docs.columns
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[900] is None and out[901] == "" and out[902] == "[SECRET]" and out[2000] == "see [SECRET] é" and out[903] == "x" * 5000 + " [SECRET]"


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert secrets.scan(docs, secrets.train(docs)).collect() == []


def test_recall_and_false_alarms_by_alphabet(spark):
    """Strings of each alphabet and length against words of the documents' own kind, joined as identifiers are."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "hi", "as", "to", "ing"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    docs = spark.createDataFrame([(i, " ".join(word().title() if rng.random() < 0.1 else word() for _ in range(200)), "", "") for i in range(300)], SCHEMA)
    model = secrets.train(docs)
    upper, lower, digits = (("".join(map(chr, range(a, b)))) for a, b in ((65, 91), (97, 123), (48, 58)))
    alphabets = {"62": upper + lower + digits, "64": upper + lower + digits + "+/", "36": lower + digits, "32": upper + digits[2:8], "16": digits + "ABCDEF"}
    rows = [(True, a, "".join(rng.choice(chars) for _ in range(n))) for a, chars in alphabets.items() for n in (16, 24, 40) for _ in range(60)]
    joins = (lambda a, b: f"{a}_{b}_{word()}", lambda a, b: f"{a}-{b}-{word()}", lambda a, b: a + b.title() + word().title(), lambda a, b: f"{a}_{b}_{rng.randrange(2000)}", lambda a, b: a + b + word())
    plain = [(False, "plain", rng.choice(joins)(word(), word())) for _ in range(1500)]
    rows += [p for p in plain if len(p[2]) >= 16]
    got = spark.createDataFrame(rows, "random boolean, kind string, token string").withColumn("hit", secrets.likely(F.col("token"), model)).groupBy("random", "kind").agg(F.avg(F.col("hit").cast("double"))).collect()
    for is_random, kind, share in got:
        assert share >= 0.95 if is_random else share <= 0.01, (kind, share)


def test_any_column_names_and_repeats(spark):
    names = ["_base", "_spans", "_candidates", "_added", "row", "spans", "base", "more", "start"]
    docs = spark.createDataFrame([(1, "token=abcdefgh x", *range(9)), (1, "token=abcdefgh x", *range(9)), (2, None, *range(9)), (None, "y", *([None] * 9))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    model = secrets.train(docs)
    got = secrets.redact(docs, model)
    assert got.columns == docs.columns
    rows = [tuple(r) for r in got.collect()]
    key = lambda r: str(r)
    assert sorted(rows, key=key) == sorted([(1, "[SECRET] x", *range(9))] * 2 + [(2, None, *range(9)), (None, "y", *([None] * 9))], key=key)
    assert secrets.redact(docs.limit(0), secrets.train(docs.limit(0))).collect() == []
    assert len(secrets.scan(docs, model).collect()) == 4


def test_time_grows_with_the_matches(spark):
    """Texts of up to 100,000 identifiers, and of as many hits, in one task each: places stay right, and ten times the matches take at most some 25 times as long."""
    import time

    docs = spark.createDataFrame([(0, "thing er streon", "", "")], SCHEMA)
    model = secrets.train(docs)
    took = {}
    for n in (10_000, 100_000):
        words = " ".join(f"thingstreonndther_{i}" for i in range(n))
        keys = " ".join(f"secret={i:08d}" for i in range(n))
        table = spark.createDataFrame([(1, words, "", ""), (2, "é" + keys, "", "")], SCHEMA).coalesce(1)
        began = time.time()
        got = {r.doc_id: r for r in secrets.scan(table, model).collect()}
        took[n] = time.time() - began
        assert got[2].n_assign == n and got[2].spans.split(",")[-1] == f"assign:{1 + 16 * (n - 1)}:{1 + 16 * (n - 1) + 15}"
    assert took[100_000] < 25 * max(took[10_000], 1.0), took
