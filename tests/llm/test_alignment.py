import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tendril.llm import alignment

PATHS = alignment.vocabulary_file("byte_bpe_50k.json"), alignment.vocabulary_file("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox", "the quick brown fox. The fox", "naïve café — 日本語のテキスト 😀😀 x", "a▁b c", "", None, " ", "  lead and  double  ", "tab\t here \n there\n\n end ", "x   y z　 w", "<s> <|endoftext|> <0x0A> <unk>",
    "a\x00b \x1c c\x1d d", "don't can't it's 'll", "ქართული ᚠᛇᚻ 𓀀𓀁 ﷽", "1234567890 12 + 3=15", "the quick brown fox", "a\r\nb \r\n c", "é é ﻿bom", "▁", "word " * 300, "z" * 3000,
]


def plain(rows):
    """Whole texts by both libraries, byte by byte."""
    a, b, of_a, of_b, _ = alignment._load(*PATHS)
    found = []
    for doc_id, text in rows:
        tokens = None
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if all(b"".join(k[i] for i in x) == (" " + text).encode() for k, x in ((of_a, ids[0]), (of_b, ids[1]))):
                tokens = ids
        links, groups = [], []
        if tokens:
            owner = [[t for t, i in enumerate(x) for _ in k[i]] for x, k in zip(tokens, (of_a, of_b), strict=True)]  # the token of each byte
            links = sorted(set(zip(*owner, strict=True)))
            links = [(tokens[0][i], tokens[1][j]) for i, j in links]
            ends = [{sum(len(k[i]) for i in x[: t + 1]): t + 1 for t in range(len(x))} for x, k in zip(tokens, (of_a, of_b), strict=True)] if len(tokens[0]) < 400 else None
            if ends is None:
                ends = []
                for x, k in zip(tokens, (of_a, of_b), strict=True):
                    at, e = 0, {}
                    for t, i in enumerate(x):
                        at += len(k[i])
                        e[at] = t + 1
                    ends.append(e)
            p = q = 0
            for e in sorted(set(ends[0]) & set(ends[1])):
                groups.append(",".join(map(str, tokens[0][p : ends[0][e]])) + "|" + ",".join(map(str, tokens[1][q : ends[1][e]])))
                p, q = ends[0][e], ends[1][e]
        found.append((doc_id, len(tokens[0]) if tokens else 0, len(tokens[1]) if tokens else 0, links, groups))
    count = Counter(x for *_, links, _ in found for x in links)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(d, na, nb, len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, x, g in found]


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_equals_whole_texts_by_brute_force(spark):
    rng = random.Random(4)
    letters = "ab é日😀.,'\n \t ▁1" + " " * 6
    made = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(150)] + ["".join(rng.choice("the and for é ") for _ in range(60)) for _ in range(60)]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(made)] + [(3, "the quick brown fox"), (3, "the quick brown fox")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, unit string, chunk int").repartition(3)
    got = alignment.align(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted(plain(rows), key=str)
    assert rows_of(alignment.align(docs.repartition(5), chunk=200)) == sorted(plain(rows), key=str)


def test_table_and_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(alignment.align(docs)) == sorted(plain([(x.doc_id, x.text) for x in docs.collect()]), key=str)
    assert alignment.align(docs.limit(0)).collect() == []
    assert rows_of(alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_units_join_to_the_text():
    for t in TEXTS:
        if t:
            assert " ".join(alignment.units(t)) == t and alignment.units(t, False) == [t]
    assert alignment.units("a b  c\n d e") == ["a", "b  c\n d", "e"]


@pytest.mark.parametrize("text", ["héé 日本😀x", "  a  b\n c ", "ﷺ 𓀀"])
def test_sure_spans_are_kept_and_others_refined(text):
    x = alignment.encode_units([text], *PATHS)
    assert x["ok"].all() and x["n_groups"][0] >= 1 and x["n_links"][0] >= max(x["n_a"][0], x["n_b"][0])
