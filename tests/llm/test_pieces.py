import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tendril.llm import pieces

SCHEMA = "doc_id long, text string, ids string, n_pieces string"
SMALL = pieces.build([None, *[c.encode() for c in ("▁", "a", "b", "é", "ab", "ba", "▁a", "▁ab", "aba", "▁▁", "éb")], *([None] * 256)], [0.0, -3, -2.5, -2.5, -4, -3, -3.4, -3, -4, -4.2, -3.5, -5.5] + [0.0] * 256, tuple(range(12, 268)), 0)


def plain(v, text):
    """Best score by trying every cut."""
    lost = min(s for s, p in zip(v.scores, v.pieces, strict=True) if p) - 10
    own = {p: s for p, s in zip(v.pieces, v.scores, strict=True) if p}
    t = ("▁" + text.replace(" ", "▁")) if text else ""
    best = [0.0] + [-1e18] * len(t)
    for i in range(len(t)):
        for j in range(i + 1, len(t) + 1):
            p = t[i:j].encode()
            if p in own:
                best[j] = max(best[j], best[i] + own[p])
        if t[i].encode() not in own:
            best[i + 1] = max(best[i + 1], best[i] + lost)
    return best[-1]


def value(v, ids, lost_bytes):
    lost = min(s for s, p in zip(v.scores, v.pieces, strict=True) if p) - 10
    return sum(v.scores[i] for i in ids if v.pieces[i]) + lost * lost_bytes


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab éz𝔘\n", max_size=14))
def test_viterbi_is_best_and_decodes(text):
    coder = pieces.Encoder(SMALL)
    ids = coder.encode([text.encode()])[0]
    assert coder.decode(ids).decode() == text
    assert abs(value(SMALL, ids.tolist(), sum(c in "z𝔘\n" for c in text)) - plain(SMALL, text)) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(text):
    raw = text.encode("utf-8", "replace")
    coder = pieces.Encoder(pieces_of_file())
    assert coder.decode(coder.encode([raw])[0]) == raw


def pieces_of_file(kept=[]):  # noqa: B006
    if not kept:
        kept.append(pieces.load())
    return kept[0]


def test_double_array():
    rng = random.Random(1)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5))): i for i in range(3000)}
    base, check, val = pieces.double_array(keys)

    def get(k):
        s = 0
        for b in k:
            t = base[s] + b + 1
            if t >= len(check) or t <= 0 or check[t] != s:
                return -1
            s = t
        return val[s]

    assert all(get(k) == i for k, i in keys.items())
    assert all(get(k + b"x") == keys.get(k + b"x", -1) for k in keys)


def test_table(spark):
    rows = [(1, "The quick brown fox  jumps\n", "", ""), (2, None, "", ""), (3, "", "", ""), (4, "▁ raw ▁mark 日本語", "", ""), (4, "x" * 3000, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    v = pieces_of_file()
    got = pieces.encode(docs, v)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got.collect())
    assert sorted((r.doc_id, r.text) for r in pieces.decode(got, v).collect()) == sorted((d, t or "") for d, t, *_ in rows)
    assert pieces.encode(spark.createDataFrame([], SCHEMA), v).collect() == []
    assert np.array_equal(pieces.Encoder(v).encode([b"the"])[0], [v.pieces.index("▁the".encode())])
