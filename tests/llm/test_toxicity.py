import math
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tendril.llm import toxicity
from tendril.llm.toxicity import Lexicon, fold

SCHEMA = "doc_id long, text string, lang string, score string"


def test_fold():
    assert fold("Th1s 1D10T is a Ιdiоt") == "this idiot is a idiot"
    assert fold("m​oron p@thetic l0ser! 42 2024") == "moron pathetic loser! 42 2024"
    assert fold("Crétin") == "cretin"


def test_boundaries_and_exceptions():
    lex = Lexicon((("trash", False, 2.0), ("vequ", True, 3.0), ("vequer", False, 4.0)))
    m = lex.matcher()
    assert lex.measure("trash, trashy xtrash", m) == (3, 2.0, 1)
    assert lex.measure("the trash can and trash", m) == (5, 2.0, 1)
    assert lex.measure("vequer vequra avequ", m) == (3, 7.0, 2)
    assert lex.measure("", m) == (0, 0, 0)
    assert lex.score(100, 20.0) > lex.score(100, 2.0) > lex.score(1000, 2.0) > lex.score(1000, 0.0)


def test_learns_and_holds_out(spark):
    random.seed(3)
    words = ["w%s%s" % (a, b) for a in "abcdefghij" for b in "klmnopqrst"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = [random.choice(words) for _ in range(30)] + (["zorg%s" % random.choice("abcdef") for _ in range(3)] if toxic else [])
        random.shuffle(text)
        rows.append((i, " ".join(text), "en", "x"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, None, None), (5001, "", "en", "x"), (None, "zorga zorgb", "en", "x")]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.train(docs, known)
    got = toxicity.score(docs, lex).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    assert all(r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    clean = toxicity.keep_clean(docs, lex)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.predicted}


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "you 1diot and moron, pathetic scum", "", ""), (2, "a fine day", "", "")], SCHEMA)
    lex = toxicity.train(docs, none)
    assert [r.predicted for r in toxicity.score(docs, lex).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.score(spark.createDataFrame([], SCHEMA), lex).collect() == []


def test_repeats_long_texts_and_clashing_columns(spark):
    long = "a fine day " * 40_000
    docs = spark.createDataFrame([(1, "moron idiot scum", 1, "p"), (1, "moron idiot scum", 1, "p"), (2, long, 1, "p"), (3, long + "moron idiot " * 20_000, 1, "p"), (None, None, None, None)], "doc_id long, text string, score int, predicted string")
    lex = toxicity.Lexicon(tuple((s, False, 3.5) for s in toxicity.SEEDS))
    got = sorted((r.doc_id or 0, r.predicted, r.n_words) for r in toxicity.score(docs, lex).collect())
    assert got == [(0, 0, 0), (1, 1, 3), (1, 1, 3), (2, 0, 120_000), (3, 1, 160_000)]
    assert sorted(r.doc_id or 0 for r in toxicity.keep_clean(docs, lex).collect()) == [0, 2]
    same = spark.createDataFrame([(1, 1), (1, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, same).terms


def plain_measure(lexicon, text):
    """Every term and every exception phrase tried at every place where a word begins, without an automaton."""
    t = toxicity.fold(text)
    ends = lambda i: i == len(t) or not t[i].isalpha()
    starts = [i for i in range(len(t)) if not i or not t[i - 1].isalpha()]
    spared = {j for i in starts for p in toxicity.EXCEPTIONS if t.startswith(p, i) and ends(i + len(p)) for j in range(i, i + len(p))}
    best = {i: max((w for term, prefix, w in lexicon.terms if t.startswith(term, i) and (prefix or ends(i + len(term)))), default=0.0) for i in starts if i not in spared}
    best = [w for w in best.values() if w > 0]
    z = sum(c * x for c, x in zip(lexicon.curve, (1.0, math.log1p(sum(best)), math.log1p(100 * sum(best) / (len(t.split()) + 20))), strict=True))
    return len(t.split()), sum(best), len(best), 1 / (1 + math.exp(-z))


PARTS = ["trash", "TRASH", "tr4sh", "trаsh", "can", "cans", "clown", "class", "idiot", "idiots", "id", "idio", "1d10t", " ", " ", " ", ".", "-", "ø", "ß", "fish", "x", "sc​um", "\n"]
LEXICON = toxicity.Lexicon((("clown", False, 1.5), ("id", True, 0.25), ("idio", True, 0.75), ("idiot", False, 2.0), ("scum", False, 1.0), ("tra", True, 0.5), ("trash", False, 1.25), ("trash", True, 0.125)))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_automaton_measures_as_a_plain_search_does(text):
    n, total, hits = LEXICON.measure(toxicity.fold(text), LEXICON.matcher())
    want = plain_measure(LEXICON, text)
    assert (n, hits) == (want[0], want[2]) and abs(total - want[1]) < 1e-9 and abs(LEXICON.score(n, total) - want[3]) < 1e-9


def test_scores_of_a_table_are_those_of_a_plain_search(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "x " * 50_000 + "idiot"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), LEXICON).collect()
    assert len(got) == len(texts)
    for r in got:
        n, _, hits, score = plain_measure(LEXICON, texts[r.doc_id])
        assert (r.n_words, r.n_hits, r.predicted) == (n, hits, int(score >= toxicity.THRESHOLD)) and abs(r.score - score) < 1e-9
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
