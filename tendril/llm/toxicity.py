"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick over folded whole texts."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scratch
from .words import texts

#: Look-alikes of Latin letters, digit and symbol substitutions, seed terms, exception phrases.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍‎‏⁠﻿"
SEEDS = (
    "idiot", "moron", "stupid", "loser", "trash", "scum", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass",
    "dummkopf", "trottel", "abruti", "crétin", "imbécil", "idiota",
)
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "circus clown", "white trash bags", "sore loser", "idiot proof")

#: Documented bound of the classifier: labelled rows of each class that it is fitted on. Texts that share so many least word hashes count once.
ROWS_OF_CLASS, LEAST = 8_000, 12
#: Prefix lengths that are learned beside whole words, where a text has two words or more that begin so; least log-likelihood ratios for either; least weight.
PREFIXES, LEAST_WORD, LEAST_PREFIX, LEAST_WEIGHT, SEED_WEIGHT = (4, 5, 6), 28.0, 20.0, 2.5, 3.5
#: Score of a text without labelled rows to calibrate on: intercept, weights of the logarithms of total and density.
DEFAULT = (-4.0, 2.5, 1.0)
THRESHOLD = 0.7

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE}
for _c in map(chr, range(0xC0, 0x180)):  # accented Latin letters, by their decomposition
    _base = unicodedata.normalize("NFD", _c.lower())[0]
    if len(_c.lower()) == 1 and _base.isascii() and _base.isalpha():
        _FOLD.setdefault(ord(_c.lower()), _base)
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_INSIDE = re.compile(r"(?<=[a-z])[013457@$!|]{1,3}(?=[a-z])|(?<![^\W_])[013457@$]{1,2}(?=[a-z][a-z0-9@$!|])|(?<=[a-z])[013457]{1,2}(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms, look-alikes, accents and, beside letters, substituted digits and symbols undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_FOLD)
    else:
        text = text.lower()
    return _INSIDE.sub(lambda m: m.group().translate(_SUBSTITUTE), text)


def held_out(doc_id: Column, parts: int, held: int) -> Column:
    """crc32(doc_id as text) mod parts is ``held``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == held, F.lit(False))


@dataclass(frozen=True)
class Lexicon:
    """terms: (term, is_prefix, weight); curve: intercept and weights that turn totals into a score."""

    terms: tuple[tuple[str, bool, float], ...]
    curve: tuple[float, float, float] = DEFAULT

    def matcher(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        best: dict[str, list[float]] = {}
        for term, prefix, weight in self.terms:
            best.setdefault(term, [0.0, 0.0])[prefix] = weight
        for phrase in EXCEPTIONS:
            found.add_word(phrase, (len(phrase), None))
        for term, (word, prefix) in best.items():
            if not found.exists(term):
                found.add_word(term, (len(term), (word, prefix)))
        found.make_automaton()
        return found

    def measure(self, folded: str, matcher: ahocorasick.Automaton) -> tuple[int, float, int]:
        """Words, and the sum and number of weights: of each word the largest of its terms; none inside an exception phrase."""
        weights: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        n = len(folded)
        for end, (size, weight) in matcher.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end + 1 == n or not folded[end + 1].isalpha()
            if weight is None:
                if whole:
                    spared.append((start, end))
            elif (w := max(weight) if whole else weight[1]) > weights.get(start, 0.0):
                weights[start] = w
        for a, b in spared:
            for start in [s for s in weights if a <= s <= b]:
                del weights[start]
        return len(folded.split()), sum(weights.values()), len(weights)

    def score(self, n_words: int, total: float) -> float:
        z = sum(c * x for c, x in zip(self.curve, _features(n_words, total), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(n_words: int, total: float) -> tuple[float, float, float]:
    return 1.0, math.log1p(total), math.log1p(100 * total / (n_words + 20))


def _sample(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most about ROWS_OF_CLASS labelled rows of each class, chosen by a hash; conflicting labels count as toxic."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out(F.col("doc_id"), 3, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    of = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, ROWS_OF_CLASS / max(of.get(1, 0), ROWS_OF_CLASS)).otherwise(ROWS_OF_CLASS / max(of.get(0, 0), ROWS_OF_CLASS))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000)


def _fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folded = [fold(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
        least = [xxhash.xxh64_intdigest(repr(sorted(xxhash.xxh64_intdigest(w) for w in set(t.split()))[:LEAST])) >> 1 for t in folded]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(folded, pa.string()), pa.array(least, pa.int64())], ["doc_id", "toxic", "folded", "mark"]
        )


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, bool], list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("folded").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = set(_WORD.findall(text))
            begun = Counter(w[:k] for k in PREFIXES for w in own if len(w) > k)
            for key in {(w, False) for w in own if len(w) > 2} | {(b, True) for b, n in begun.items() if n > 1}:
                seen.setdefault(key, [0, 0])[toxic] += 1
    keys, counts = list(seen), list(seen.values())
    for i in range(0, len(keys), 50_000):
        part, of = keys[i : i + 50_000], counts[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part]), pa.array([p for _, p in part]), pa.array([c[1] for c in of], pa.int64()), pa.array([c[0] for c in of], pa.int64())],
            ["term", "prefix", "pos", "neg"],
        )


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a small ridge towards DEFAULT."""
    start = np.array(DEFAULT)
    c = start.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        ridge = np.array([0.02, 0.2, 0.2])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * (c - start))
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in c)


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon and curve from labelled rows whose crc32(doc_id) mod 3 is not 1.

    Terms are whole words and word beginnings that are far commoner in toxic texts, by a log-likelihood ratio over
    documents (near copies, whose LEAST least word hashes are the same, count once); seeds stay unless the rows speak against
    them. The curve is fitted on the fifth of the sample that the terms weren't learned from. Without labelled rows
    of both classes: seeds and DEFAULT. The sample is bounded (ROWS_OF_CLASS), and so is what is broadcast.
    """
    own = texts(docs).join(F.broadcast(_sample(labels)), "doc_id")
    rows = scratch.table(own.select("doc_id", "toxic", "text").mapInArrow(_fold_all, "doc_id long, toxic int, folded string, mark long"), "labelled")
    once = scratch.table(rows.groupBy("mark", "toxic").agg(F.min_by("folded", "doc_id").alias("folded")), "once")
    fitting = F.pmod(F.xxhash64("mark", F.lit(5)), F.lit(5)) > 0
    size = {r["toxic"]: r["count"] for r in once.where(fitting).groupBy("toxic").count().collect()}
    p, n = size.get(1, 0), size.get(0, 0)
    terms = {(s, False): SEED_WEIGHT for s in map(fold, SEEDS)}
    if p and n:
        t = (
            once.where(fitting)
            .select("folded", "toxic")
            .mapInArrow(_count_terms, "term string, prefix boolean, pos long, neg long")
            .groupBy("term", "prefix")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .withColumn("weight", F.log((F.col("pos") + 0.5) / (p + 1.0)) - F.log((F.col("neg") + 0.5) / (n + 1.0)))
        )
        part = lambda k, of: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * float(p + n) / ((F.col("pos") + F.col("neg")) * float(of)))).otherwise(0.0)
        t = t.withColumn("ratio", 2 * (part("pos", p) + part("neg", n)))
        strong = (F.col("ratio") >= F.when(F.col("prefix"), LEAST_PREFIX).otherwise(LEAST_WORD)) & (F.col("weight") >= LEAST_WEIGHT)
        seed = F.col("term").isin(*(s for s, _ in terms)) & ~F.col("prefix")
        for r in t.where(strong | (seed & (F.col("neg") >= 3))).collect():  # words and prefixes of the sample: bounded by it
            terms[r["term"], r["prefix"]] = max(0.0, min(r["weight"], 6.0))
    lexicon = Lexicon(tuple((t, k, w) for (t, k), w in sorted(terms.items()) if w > 0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            got = [lexicon.measure(t, matcher) for t in batch.column("folded").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["toxic", "n", "total"])

    held = once.where(~fitting).select("folded", "toxic").mapInArrow(measured, "toxic int, n long, total double").collect()  # bounded by ROWS_OF_CLASS
    if sum(r["toxic"] for r in held) < 3 or sum(1 - r["toxic"] for r in held) < 3:
        return lexicon
    return Lexicon(lexicon.terms, _fit(np.array([_features(r["n"], r["total"]) for r in held]), np.array([float(r["toxic"]) for r in held])))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, n_hits) of every row.

    Null and empty texts score as texts without hits; whatever other columns docs has stays out of the score and
    of the result; repeated rows are scored each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            got = [lexicon.measure(fold(t.decode("utf-8", "replace")), matcher) for t in batch.column("text").to_pylist()]
            scores = [lexicon.score(n, total) for n, total, _ in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                ["doc_id", "score", "n_words", "n_hits"],
            )

    got = texts(docs).mapInArrow(run, "doc_id long, score double, n_words long, n_hits long")
    return got.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", "n_hits")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs, all columns whatever their names, without the rows that score THRESHOLD or more.

    Null and empty texts score as texts without hits, and stay; rows that repeat stay or go each; an empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            clean = []
            for t in batch.column("text").to_pylist():
                n, total, _ = lexicon.measure(fold(t or ""), matcher)
                clean.append(lexicon.score(n, total) < THRESHOLD)
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
