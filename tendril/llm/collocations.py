"""Phrase collocation mining: counts of phrases are sizes of equal partitions in a multikey three-way quicksort of suffixes.

A suffix is a word with up to DEPTH - 1 words that follow it in its piece, as 64-bit hashes of (lang, word). Suffixes
end before a word that is too rare to be in a candidate. They are routed by their leading words over the whole corpus:
by one word, or by as many as it takes to leave the sequences that fill more than their share of a shard. A shard sorts
pointers to its suffixes by their first word, equal partitions by the next, and so on; the weight of an equal partition
is a count, and a partition that is too light is abandoned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scratch

DEPTH, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer one around it has this share of its count: 80 %.
SHARE = (80, 100)
#: Bytes of text whose suffixes are merged before they travel (twice as many at once); words to a shard; at most so many shards.
CHUNK, SHARD, SHARDS = 2 << 20, 500_000, 1 << 20
#: One of so many suffixes is looked at to tell which leading sequences are too common for one shard: a matter of balance only.
SAMPLE = 512
#: A sequence that was seen less often than this is never taken for too common.
FULL = 8
#: Bits of the filter that knows all frequent words (and takes some rare ones for frequent), for each word, and at most.
BITS, MOST_BITS = 16, 1 << 28

_CLEAN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_AHEAD = re.compile(rb"(?: +[^ ]+){0,%d}" % DEPTH)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _streams(batch: pa.RecordBatch, chunk: int) -> Iterator[tuple[str, bytes, int]]:
    """(lang, text, own): cleaned texts of a language, about ``chunk`` bytes; only words that begin in the first ``own`` bytes count.

    Pieces end with a line feed that stands between spaces. A longer text is cut at a space, and what follows the cut
    is shown again as context.
    """
    langs: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if text:
            langs.setdefault(lang, []).append(text)
    for lang, found in langs.items():
        held, size = [], 0
        for text in found:
            held.append(text)
            size += len(text)
            if size > chunk:
                yield from _cut(lang, held, chunk)
                held, size = [], 0
        if held:
            yield from _cut(lang, held, chunk)


def _cut(lang: str, found: list[bytes], chunk: int) -> Iterator[tuple[str, bytes, int]]:
    data = b"\n".join(found).lower().translate(_CLEAN).replace(b"\n", b" \n ")
    at = 0
    while at < len(data):
        end = data.find(b" ", at + 2 * chunk)
        end = len(data) if end < 0 else end
        yield lang, data[at : _AHEAD.match(data, end).end() if end < len(data) else end], end - at
        at = end


class _Words:
    """Words of a stream: local numbers (0: the end of a piece), the words and their hashes, and how many positions count."""

    def __init__(self, lang: str, data: bytes, own: int, seed: int):
        found = [w for w in data.split(b" ") if w]
        numbers: dict[bytes, int] = {b"\n": 0}
        self.at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
        self.own = len(found) if own == len(data) else sum(1 for w in data[:own].split(b" ") if w)
        self.words = list(numbers)
        start = xxhash.xxh64_intdigest(lang, seed)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, start) for w in self.words), np.uint64, len(numbers))
        self.hashes[self.hashes == 0] = 1  # 0 is the end of a suffix
        self.hashes[0] = 0


def _suffixes(w: _Words, keep: np.ndarray) -> np.ndarray:
    """A row of DEPTH hashes for each counted position whose word is kept: zeros from the first word on that isn't."""
    known = np.where(keep, w.hashes, np.uint64(0))
    line = np.r_[known[w.at], np.zeros(DEPTH - 1, np.uint64)]
    begin = np.flatnonzero(line[: w.own])
    rows = line[begin[:, None] + np.arange(DEPTH)]
    for d in range(1, DEPTH):
        rows[:, d][rows[:, d - 1] == 0] = 0
    return rows


def _leading(rows: np.ndarray) -> np.ndarray:
    """Hashes of the first 1, 2, ... words of suffixes, a column each; 0 beyond the end."""
    out = np.zeros_like(rows)
    out[:, 0] = rows[:, 0]
    for d in range(1, DEPTH):
        out[:, d] = np.where(rows[:, d] > 0, _mix(out[:, d - 1] * _ODD + rows[:, d]), 0)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _count(seed: int, chunk: int, sample: int):
    """kind 0: words of a language; 1: how often each word occurs; 2: leading sequences of some suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data, own in _streams(batch, chunk):
                w = _Words(lang, data, own, seed)
                n = np.bincount(w.at[: w.own], minlength=len(w.words))
                n[0] = 0
                seen = np.flatnonzero(n)
                rows = _suffixes(w, np.ones(len(w.words), bool))
                few, times = np.unique(_leading(rows[_mix(np.arange(len(rows), dtype=np.uint64) + w.hashes[-1]) % np.uint64(sample) == 0])[:, : DEPTH - 1], return_counts=True)
                few, times = few[few > 0], times[few > 0]
                kinds = np.repeat([0, 1, 2], [1, len(seen), len(few)]).astype(np.int32)
                words = [None, *(w.words[i].decode(errors="replace") for i in seen.tolist()), *[None] * len(few)]
                langs = pa.array([lang] * (1 + len(seen)) + [None] * len(few), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(kinds), _signed(np.r_[np.uint64(xxhash.xxh64_intdigest(lang, seed)), w.hashes[seen], few]), langs, pa.array(words, pa.string()), pa.array(np.r_[n.sum(), n[seen], times])], ["kind", "h", "lang", "word", "n"])

    return run


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(h + _ODD) % np.uint64(bits)).astype(np.int64)


def _route(seed: int, chunk: int, words: bytes, bits: int, hot: np.ndarray, shards: int):
    """A row for each chunk and shard: suffixes with weights, and the depth from which the shard holds all of a sequence.

    A sequence that shares the slot of a hot one is routed like a hot one, everywhere: that costs balance, not counts.
    """
    known = np.frombuffer(words, np.uint8)
    full = np.zeros(1 << max(16, (64 * len(hot)).bit_length()), bool)
    full[_slot(hot, len(full))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data, own in _streams(batch, chunk):
                w = _Words(lang, data, own, seed)
                slot = _slot(w.hashes, bits)
                rows = _suffixes(w, (known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool))
                rows = rows[rows[:, 1] > 0]
                if not len(rows):
                    continue
                lead = _leading(rows)
                last = lead[np.arange(len(rows)), (rows > 0).sum(axis=1) - 1]
                order = np.argsort(last, kind="stable")  # equal suffixes stand together; should others have the same hash, they are merged less
                new = np.r_[True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1)]
                first = order[new]
                weight = np.diff(np.r_[np.flatnonzero(new), len(order)]).astype(np.uint32)
                rows, lead = rows[first], lead[first]
                whole = np.full(len(rows), DEPTH + 1, np.uint8)  # over DEPTH: the shard holds no sequence whole
                key = last[first].copy()
                for d in range(DEPTH - 1, -1, -1):
                    fit = (rows[:, d] > 0) & (~full[_slot(lead[:, d], len(full))] if d < DEPTH - 1 else True)
                    whole[fit], key[fit] = d + 1, lead[:, d][fit]
                shard = (_mix(key) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((rows[:, 1], rows[:, 0], shard))
                rows, weight, whole, shard = rows[order], weight[order], whole[order], shard[order]
                edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                packs = [b"".join((rows[a:b].T.tobytes(), weight[a:b].tobytes(), whole[a:b].tobytes())) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(rows)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[edge]), pa.array(packs, pa.binary())], ["shard", "suffixes"])

    return run


def _unpacked(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = 8 * DEPTH + 5
    rows, weight, whole = [], [], []
    for p in packs:
        n = len(p) // width
        rows.append(np.frombuffer(p, np.uint64, DEPTH * n).reshape(DEPTH, n))
        weight.append(np.frombuffer(p, np.uint32, n, 8 * DEPTH * n))
        whole.append(np.frombuffer(p, np.uint8, n, (8 * DEPTH + 4) * n))
    return np.concatenate(rows, 1), np.concatenate(weight).astype(np.int64), np.concatenate(whole)


def quicksort(columns: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, a suffix, weight) of every sequence of 1 to len(columns) words of a weight of ``least`` at least.

    Multikey three-way quicksort of pointers: a partition is split by its middle pointer's word at one depth; the equal
    part is a sequence and is sorted by the next depth, the others by the same one. Parts that are too light go.
    """
    todo = [(np.arange(len(weight)), 0)]
    while todo:
        at, depth = todo.pop()
        words = columns[depth][at]
        pivot = words[len(words) // 2]
        for side in (words < pivot, words > pivot):
            part = at[side]
            if len(part) and int(weight[part].sum()) >= least:
                todo.append((part, depth))
        if pivot:
            part = at[words == pivot]
            total = int(weight[part].sum())
            if total >= least:
                yield depth + 1, int(part[0]), total
                if depth + 1 < len(columns):
                    todo.append((part, depth + 1))


def _sorted(least: int):
    def run(rows: pa.Table) -> pa.Table:
        columns, weight, whole = _unpacked(rows["suffixes"].to_pylist())
        grams, counts = [], []
        for depth, first, total in quicksort(columns, weight, least):
            if depth > 1 and whole[first] <= depth:
                grams.append(columns[:depth, first].astype(">u8").tobytes())
                counts.append(total)
        for depth in range(2, DEPTH + 1):  # of sequences that fill more than a shard each shard has a part, however small
            part = np.flatnonzero((whole > depth) & (columns[depth - 1] > 0))
            if len(part):
                found, at = np.unique(np.ascontiguousarray(columns[:depth, part].T.astype(">u8")).view(f"V{8 * depth}").ravel(), return_inverse=True)
                grams += [x.tobytes() for x in found]
                counts += np.bincount(at, weight[part], len(found)).astype(np.int64).tolist()
        return pa.table([pa.array(grams, pa.binary()), pa.array(counts, pa.int64())], ["gram", "f"])

    return run


def _bitmap(frequent: DataFrame, bits: int) -> bytes:
    """bits, set for each frequent word: at most MOST_BITS / 8 bytes, put together by tasks of a slice each."""
    slices = 64

    def fill(rows: pa.Table) -> pa.Table:
        k = rows["slice"][0].as_py()
        slot = _slot(rows["h"].to_numpy().view(np.uint64), bits)
        part = np.zeros(bits // slices, bool)
        part[slot - k * (bits // slices)] = True
        return pa.table([pa.array([k], pa.int64()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["slice", "part"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(_slot(h.view(np.uint64), bits) // (bits // slices)), batch.column("h")], ["slice", "h"])

    parts = frequent.select("h").mapInArrow(mark, "slice long, h long").groupBy("slice").applyInArrow(fill, "slice long, part binary").collect()
    whole = bytearray(bits // 8)
    for p in parts:
        whole[p.slice * (bits // slices // 8) : (p.slice + 1) * (bits // slices // 8)] = p.part
    return bytes(whole)


def _frequent(own: DataFrame, least: int, chunk: int = CHUNK, sample: int = SAMPLE, seed: int = 0) -> tuple[DataFrame, int]:
    """Counts of words and of leading sequences; another seed should two words have one hash."""
    counted = own.mapInArrow(_count(seed, chunk, sample), "kind int, h long, lang string, word string, n long")
    same = F.struct("lang", "word")
    counted = counted.groupBy("kind", "h").agg(F.sum("n").alias("n"), F.min(same).alias("one"), F.max(same).alias("other"))
    wanted = F.col("n") >= F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, least).otherwise(FULL)
    found = scratch.table(counted.where(wanted).select("kind", "h", "n", "one.*", (F.col("one") != F.col("other")).alias("twice")), "words")
    if found.where("kind < 2 AND twice").isEmpty():
        return found, seed
    scratch.drop(found)
    return _frequent(own, least, chunk, sample, seed + 1)


def counts(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, shard: int = SHARD, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of languages (lang, n); frequent words (h, lang, word, f); frequent phrases (gram, f) of 2 to DEPTH words.

    gram: the words' hashes, 8 bytes each.
    """
    own = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"].cast("binary").alias("text")).where("text IS NOT NULL")
    found, seed = _frequent(own, least, chunk, sample)
    words = found.where("kind = 1").select("h", "lang", "word", F.col("n").alias("f"))
    total = found.where("kind = 0").select("lang", "n")
    n, kinds = total.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], words.count()
    shards = min(SHARDS, max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // shard)))
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS * kinds - 1).bit_length()))
    full = max(FULL, n / sample / (4 * shards))  # so there are at most 4 such sequences a shard and depth
    hot = np.array([x.h for x in found.where((F.col("kind") == 2) & (F.col("n") >= full)).select("h").collect()], np.int64).view(np.uint64)
    route = _route(seed, chunk, _bitmap(words, bits), bits, hot, shards)
    suffixes = own.mapInArrow(route, "shard long, suffixes binary")
    grams = suffixes.groupBy("shard").applyInArrow(_sorted(least), "gram binary, f long").groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return total, words, scratch.table(grams, "grams")


def _exact(a: str, b: str) -> str:
    """The whole part of 2000000 a / b, though the product may pass 64 bits."""
    return f"CAST((CAST({a} AS DECIMAL(20, 0)) * 2000000) DIV CAST({b} AS DECIMAL(20, 0)) AS BIGINT)"


_SIZE = "CAST(length(gram) DIV 8 AS INT)"


def _bytes(h: str) -> Column:
    """A hash as a phrase of one word has it."""
    return F.unhex(F.lpad(F.hex(h), 16, "0"))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to DEPTH words.

    A-Z are lower-cased, texts split at ``.,;:!?`` and line ends into pieces, these at blanks into words. a: how often
    the phrase occurs (``least`` at least), l and r: the same of its first words and of the rest at the cut that scores
    lowest (the earliest of equal ones), n: all words of the language; score: the whole part of 2000000 a / (l + r). A
    phrase goes if a longer one that holds it has 80 % of its count or more. Order: score, a (both falling), phrase.

    Null texts are empty, a null lang is ``und``; languages without candidates have no rows, nor has an empty table.
    Repeated rows and ids count each; doc_id and other columns don't matter. Texts of any length are taken whole.
    sizes: ``chunk``, ``shard`` and ``sample`` of ``counts``, which the rows don't depend on.
    """
    total, words, grams = counts(docs, least, **sizes)
    size = F.expr(_SIZE)
    parts = grams.unionByName(words.select(_bytes("h").alias("gram"), "f"))
    part = lambda name, f: parts.select(F.col("gram").alias(name), F.col("f").alias(f))
    cuts = grams.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring(gram, 1, 8 * k)")).withColumn("rest", F.expr("substring(gram, 8 * k + 1)"))
    scored = cuts.join(part("first", "l"), "first").join(part("rest", "r"), "rest").withColumn("score", F.expr(_exact("a", "(l + r)")))
    lowest = scored.groupBy("gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("gram", "a", "x.score", "x.l", "x.r")
    inner = F.expr(f"flatten(transform(sequence(2, {_SIZE} - 1), j -> transform(sequence(0, {_SIZE} - j), i -> substring(gram, 8 * i + 1, 8 * j))))")
    longer = grams.where(size > 2).select(F.explode(inner).alias("gram"), F.col("f").alias("longer")).groupBy("gram").agg(F.max("longer").alias("longer"))
    held = F.coalesce(F.col("longer").cast("decimal(20,0)") * SHARE[1] >= F.col("a").cast("decimal(20,0)") * SHARE[0], F.lit(False))
    kept = lowest.join(longer, "gram", "left").where(~held).drop("longer")
    spelt = kept.select("gram", F.posexplode(F.expr(f"transform(sequence(0, {_SIZE} - 1), i -> substring(gram, 8 * i + 1, 8))")).alias("i", "one"))
    names = words.select(_bytes("h").alias("one"), "lang", "word")
    spelt = spelt.join(names, "one").groupBy("gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.min("lang").alias("lang"))
    rows = kept.join(spelt, "gram").select("lang", "phrase", "a", "l", "r", "score", F.pmod(F.xxhash64("gram"), F.lit(64)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)  # so that no task ranks more than 64 x top of a language
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
