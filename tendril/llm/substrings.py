"""Substring dedup: words inside runs of WINDOW words that an earlier document has too, by prefix-partitioned suffix trees.

Suffixes are grouped by a prefix: the K words of an anchor, the least K-gram (by hash) of every window, so that two
equal windows always share theirs. A group's tree is a sorted suffix array with the lengths of common prefixes: an
internal node of depth d is a run of suffixes that agree in d words. Beside it stands the tree of the words to the
left of the anchors, read backwards; a window is a pair of nodes whose depths make WINDOW words. Prefixes that more
than GROUP suffixes share are lengthened to the whole window: its suffixes are then one node of depth WINDOW, of which
only the least document is asked, and that is pre-aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scratch
from .words import whole_groups, words

WINDOW, K, GROUP = 50, 8, 256
#: Bytes of a word's code, of eight, that contexts carry.
WIDTH = 6
#: K-grams in a window; most words to the left of an anchor.
SPAN = WINDOW - K + 1
_ODD = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(K)], np.uint64)


def _codes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def _packed(codes: np.ndarray) -> bytes:
    """Codes as they travel: WIDTH bytes of each, so that two words are taken for one in 2^48 pairs, and windows far more rarely."""
    return codes.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpacked(parts: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WIDTH)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, :WIDTH] = flat
    return wide.view(np.uint64).ravel()


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text's words: keys of anchors, first windows, anchors' distances from these, numbers of windows."""
    grams = np.zeros(len(codes) - K + 1, np.uint64)
    for i in range(K):
        grams += codes[i : len(codes) - K + 1 + i] * _ODD[i]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    at, size = np.arange(len(grams)), 1
    while size < SPAN:  # the first least gram of every run of `size`, doubled
        step = min(size, SPAN - size)
        left, right = at[:-step], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        size += step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[first]].view(np.int64), first, at[first] - first, np.diff(np.r_[first, len(at)])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], [], [], []]
        for d, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
            w = words(text)
            if len(w) >= WINDOW:
                got = _anchors(_codes(w))
                for k, part in enumerate((got[0], np.full(len(got[0]), d), np.full(len(got[0]), h), *got[1:])):
                    out[k].append(part)
        if out[0]:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(t) for x, t in zip(out, kinds, strict=True)], ["key", "doc_id", "h", "start", "off", "n"])


def _contexts(hot: bool):
    """Rows of the anchors that a text shares: for usual prefixes the words around, for hot ones the windows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in range(6)]
            for d, h, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text", "marks")), strict=True):
                if not any(m["hot"] == hot for m in marks):
                    continue
                codes = _codes(words(text))
                for m in marks:
                    if m["hot"] == hot:
                        s, n = m["start"], m["n"]
                        if hot:
                            part = codes[s : s + n + WINDOW - 1].tobytes()
                            for i in range(n):
                                key = xxhash.xxh64_intdigest(part[8 * i : 8 * (i + WINDOW)], 7)
                                for c, v in zip(rows, (key - (1 << 64) if key >> 63 else key, d, h, s + i, 0, b""), strict=True):
                                    c.append(v)
                        else:
                            for c, v in zip(rows, (m["key"], d, h, s, m["off"], _packed(codes[s : s + n + WINDOW - 1])), strict=True):
                                c.append(v)
            if rows[0]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["key", "doc_id", "h", "start", "off", "words"])

    return run


def _tree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes (a row of words each) as order and, for each, the words it shares with the one before."""
    order = np.argsort(np.ascontiguousarray(suffixes.astype(">u8")).view(f"S{8 * suffixes.shape[1]}").ravel(), kind="stable")
    differ = suffixes[order[1:]] != suffixes[order[:-1]]
    return order, np.r_[-1, np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])]


def _node(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """The node of that depth above each suffix."""
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(shared < depth)
    return of


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, "key"):
        doc, off = rows["doc_id"].to_numpy(), rows["off"].to_numpy().astype(np.int64)
        parts = rows["words"].to_pylist()
        flat = _unpacked(parts)
        end = np.cumsum([len(p) // WIDTH for p in parts])
        begin = np.r_[0, end[:-1]]
        n = end - begin - WINDOW + 1
        right = begin[:, None] + off[:, None] + np.arange(WINDOW)
        right = np.where(right < end[:, None], flat[np.minimum(right, len(flat) - 1)], 0)
        left = begin[:, None] + off[:, None] - 1 - np.arange(SPAN)
        left = np.where(left >= begin[:, None], flat[np.maximum(left, 0)], 0)
        after, before = _tree(right), _tree(left)
        mask = np.zeros(len(doc), np.int64)
        for j in range(SPAN):  # windows that begin j words before their anchor
            have = np.flatnonzero((off - n < j) & (j <= off))
            if not len(have):
                continue
            pair = _node(*after, WINDOW - j)[have] * (len(doc) + 1) + (_node(*before, j)[have] if j else 0)
            order = np.lexsort((doc[have], pair))
            head = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]])
            least = np.repeat(doc[have][order][head], np.diff(np.r_[head, len(order)]))
            late = have[order][doc[have][order] > least]
            mask[late] |= np.int64(1) << (off[late] - j)
        hit = np.flatnonzero(mask)
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[hit]), pa.array(rows["h"].to_numpy()[hit]), pa.array(rows["start"].to_numpy()[hit].astype(np.int32)), pa.array(mask[hit])], ["doc_id", "h", "start", "mask"]
            )


def _cut(w: list[bytes], hits: list) -> list[bytes]:
    """The words that no flagged window covers. hits: (start, mask): bit i flags the window at start + i."""
    edge = np.zeros(len(w) + 1, np.int64)
    for start, mask in hits:
        for i in range(mask.bit_length()):
            if mask >> i & 1:
                edge[start + i] += 1
                edge[start + i + WINDOW] -= 1
    return [x for x, c in zip(w, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            w = words(text)
            kept = _cut(w, [(x["start"], x["mask"]) for x in hits]) if hits else w
            text = b" ".join(kept)
            out.append((len(w), len(w) - len(kept), hashlib.sha256(text).hexdigest(), text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary())))],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; kept: the words left, joined by one space, as UTF-8.

    A window of WINDOW words is flagged if the same words start in a document with a smaller doc_id; each word of a
    flagged window goes. Null texts have no words; texts of fewer than WINDOW words, and rows with a null doc_id,
    stay whole and remove nothing elsewhere. Rows that repeat a doc_id don't remove each other's words, and each is
    judged by its own text. An empty table gives no rows.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")
    )
    anchors = scratch.table(own.where("doc_id IS NOT NULL").mapInArrow(_find, "key long, doc_id long, h long, start int, off int, n int"), "anchors")
    shared = anchors.groupBy("key").agg(F.count("*").alias("rows"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    marks = (
        anchors.join(shared, "key")
        .groupBy("doc_id", "h")
        .agg(F.collect_list(F.struct("key", "start", "off", "n", (F.col("rows") > GROUP).alias("hot"))).alias("marks"))
    )
    marked = own.join(scratch.table(marks, "marks"), ["doc_id", "h"])
    shape = "key long, doc_id long, h long, start int, off int, words binary"
    usual = marked.mapInArrow(_contexts(False), shape).repartition("key").sortWithinPartitions("key").mapInArrow(_judge, "doc_id long, h long, start int, mask long")
    windows = scratch.table(marked.mapInArrow(_contexts(True), shape).select("key", "doc_id", "h", "start"), "windows")
    lows = windows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", "lo")
    late = windows.join(scratch.table(lows, "lows"), "key").where("doc_id > lo")  # both sides written: a window that very many share can be split
    hits = usual.unionByName(late.select("doc_id", "h", "start", F.lit(1).cast("long").alias("mask")))
    hits = hits.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "mask")).alias("hits"))
    return own.join(hits, ["doc_id", "h"], "left").mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
