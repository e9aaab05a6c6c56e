"""SimHash near-duplicates: fingerprints, links within a Hamming radius by BK-trees, and their connected groups."""

from __future__ import annotations

import pickle
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scratch
from .components import Forest, _pair_batch, components
from .words import SPLIT, texts, whole_groups, words

#: Fingerprints of a shard at most (on average, where a bucket is split), of a bundle of shards; MB of trees that a wave broadcasts.
SHARD, BUNDLE, WAVE_MB = 512, 65_536, 16
#: Near copies: words a shingle; seeded fingerprints, those of them that are of distinct words (the others are of distinct shingles),
#: the bits they may differ in; masks of each, bits of a mask (both at least: see ``masks``); the share of bits that a pair of 0.8 differs in.
SHINGLE, SEEDS, OF_WORDS, RADIUS, MASKS, MASK_BITS, FLIPPED = 5, 10, 4, 16, 8, 16, 0.15
#: Bits of the min-hash that spares pairs the exact check, and the least similarity it must show: 0.8 less over four errors (0.075).
MINIMA, LEAST = 64, 0.45
#: Bits of the longer min-hash of nodes asked for all their pairs, and the least similarity it must show: 0.8 less over four errors (0.027).
WIDE, LEAST_WIDE = 512, 0.68
#: Visits of a slice of questions at most, so that what a search holds is bounded.
VISITS = 2_000_000
_ODD = np.array([xxhash.xxh64_intdigest(b"round", i) | 1 for i in range(SEEDS)], np.uint64)
_MORE = np.array([xxhash.xxh64_intdigest(b"minimum", i) | 1 for i in range(MINIMA)], np.uint64)

_WIDER = np.array([xxhash.xxh64_intdigest(b"wide", i) | 1 for i in range(WIDE)], np.uint64)


def shingles(text: bytes, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words of the A-Z-lowered text; a shorter text is one run, an empty one none."""
    w = words(text, lower=True)
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    if size == 1:
        return w
    return list(map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; 0 for no hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in parts), np.uint64, len(parts))


def reseeded(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The hashes again, as independent ones; seed 0 leaves them."""
    if not seed:
        return hashes
    mixed = hashes * _ODD[seed]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _ODD[0]
    return mixed ^ (mixed >> np.uint64(29))


def seeded(words_of: np.ndarray, shingles_of: np.ndarray) -> list[int]:
    """A text's SEEDS fingerprints, from the hashes of its distinct words and shingles.

    Of words, texts with single words changed differ in few bits. Of shingles, texts of a similarity of 0.8 differ in
    about FLIPPED of the bits, whatever was changed, also where an added passage has most of a text's distinct words.
    """
    return [fingerprint(reseeded(words_of if s < OF_WORDS else shingles_of, s)) for s in range(SEEDS)]


def minima(hashes: np.ndarray) -> int:
    """One bit of the least of the hashes under each of MINIMA multipliers; 0 for no hashes.

    Of two texts, the share of equal bits is about (1 + their Jaccard similarity) / 2, however short they are.
    """
    if not len(hashes):
        return 0
    low = np.full(MINIMA, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[i : i + 1024, None] * _MORE).min(axis=0), out=low)
    return int(np.packbits((low >> np.uint64(17)) & np.uint64(1)).view(np.int64)[0])


def wide_minima(hashes: np.ndarray) -> bytes:
    """As ``minima``, with WIDE bits."""
    low = np.full(WIDE, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 64):
        np.minimum(low, (hashes[i : i + 64, None] * _WIDER).min(axis=0), out=low)
    return np.packbits((low >> np.uint64(17)) & np.uint64(1)).tobytes()


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row. size: words a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(_hashes(shingles(text, size))) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


class Trees:
    """BK-trees, one a shard, in arrays: a node's children are keyed by their integer Hamming distance to it.

    Equal values of a shard are one node with several members. ``edges`` are 65 times the parent plus the distance,
    ascending, and ``kids`` the children they lead to. ``visits`` counts the nodes that searches came to.
    """

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, shard))
        s, v = shard[order], values[order]
        at = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1])][: len(s)])
        self.members, self.begin, self.values, s, self.visits = order, np.r_[at, len(order)], v[at], s[at], 0
        root = np.r_[True, s[1:] != s[:-1]][: len(s)]
        self.roots = np.flatnonzero(root)
        self.shards, self.sizes = s[self.roots], np.diff(np.r_[self.roots, len(s)])
        parent = np.repeat(self.roots, self.sizes)
        live, edges, kids = np.flatnonzero(~root), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(live):  # a level of all trees at once: the first value at a distance becomes the child, the rest goes below it
            edge = parent[live] * 65 + np.bitwise_count(self.values[live] ^ self.values[parent[live]])
            order = np.argsort(edge, kind="stable")
            edge, live = edge[order], live[order]
            first = np.r_[True, edge[1:] != edge[:-1]]
            edges.append(edge[first])
            kids.append(live[first])
            parent[live] = live[first][np.cumsum(first) - 1]
            live = live[~first]
        edges, kids = np.concatenate(edges), np.concatenate(kids)
        order = np.argsort(edges)
        self.edges, self.kids = edges[order], kids[order]

    @classmethod
    def joined(cls, parts: list[Trees]) -> Trees:
        """The trees of several bundles, no shard of which is in two."""
        made = cls.__new__(cls)
        base = np.cumsum([0, *(len(p.values) for p in parts)])[:-1]
        rows = np.cumsum([0, *(len(p.members) for p in parts)])
        made.values, made.visits = np.concatenate([p.values for p in parts]), 0
        made.edges, made.kids = np.concatenate([p.edges + 65 * b for p, b in zip(parts, base, strict=True)]), np.concatenate([p.kids + b for p, b in zip(parts, base, strict=True)])
        made.members = np.concatenate([p.members + r for p, r in zip(parts, rows, strict=False)])
        made.begin = np.r_[np.concatenate([p.begin[:-1] + r for p, r in zip(parts, rows, strict=False)]), rows[-1]]
        shards, roots = np.concatenate([p.shards for p in parts]), np.concatenate([p.roots + b for p, b in zip(parts, base, strict=True)])
        order = np.argsort(shards)
        made.shards, made.roots, made.sizes = shards[order], roots[order], np.concatenate([p.sizes for p in parts])[order]
        return made

    def probe(self, shard: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of the trees, question) of a shard within the radius; only edges within it are followed."""
        if not len(self.shards):
            return
        place = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        known = np.flatnonzero(self.shards[place] == shard)
        cut = np.cumsum(self.sizes[place[known]]) // VISITS
        for part in np.split(known, np.flatnonzero(np.diff(cut)) + 1):
            q, at = part, self.roots[place[part]]
            while len(q):
                self.visits += len(q)
                far = np.bitwise_count(self.values[at] ^ asked[q]).astype(np.int64)
                hit = far <= radius
                n = (self.begin[at[hit] + 1] - self.begin[at[hit]]).astype(np.int64)
                if len(n):
                    yield self.members[np.repeat(self.begin[at[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(q[hit], n)
                low = np.searchsorted(self.edges, at * 65 + np.maximum(far - radius, 0))
                n = np.searchsorted(self.edges, at * 65 + np.minimum(far + radius, 64), "right") - low
                at = self.kids[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
                q = np.repeat(q, n)


def split_hot(rows: DataFrame) -> DataFrame:
    """Of rows with a bucket and a node: adds ``m`` and ``own``: buckets of more than 2 * SHARD rows are cut into m shards."""
    hot = scratch.table(rows.groupBy("bucket").count().where(F.col("count") > 2 * SHARD).select("bucket", F.ceil(F.col("count") / SHARD).cast("int").alias("m")), "hot")
    dealt = rows.join(hot, "bucket", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    return dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("m")).cast("int"))


def links(classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Of classes (node, fp): edges (u, v) that join all nodes whose fingerprints differ in ``radius`` bits or fewer.

    The 64 bits are cut into ``blocks``; two fingerprints within the radius agree on blocks - radius of them at least,
    so for each choice of so many, a bucket is a shard with its own BK-tree, and a question goes to the shards of its
    own buckets only. A bucket of more than 2 * SHARD fingerprints is cut into shards, each of which is asked by the
    fingerprints of its own and later ones. Trees are built once, by tasks, and broadcast in waves of WAVE_MB at most;
    a wave reads only the questions to its shards. So neither what is broadcast at once nor a task's share grows with
    the input; the number of waves does. A task returns a spanning forest of its links, not the links.
    """
    spark = classes.sparkSession
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    tables = [sum(masks[i] for i in choice) for choice in combinations(range(blocks), blocks - radius)]
    at = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in tables)))
    dealt = split_hot(classes.select("node", "fp", at.alias("t", "value")).select("node", "fp", F.xxhash64("t", "value").alias("bucket")))
    bundles = max(1, -(-classes.count() * len(tables) // BUNDLE))
    bundle = F.pmod(F.xxhash64("shard", F.lit(3)), F.lit(bundles)).cast("long").alias("bundle")
    kept = dealt.select(F.xxhash64("bucket", "own").alias("shard"), "fp", "node").select(bundle, "shard", "fp", "node")
    later = F.explode(F.sequence(F.lit(0), "own")).alias("to")
    asks = dealt.select("bucket", later, "fp", "node").select(F.xxhash64("bucket", "to").alias("shard"), "fp", "node").select(bundle, "shard", "fp", "node")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "bundle"):
            every = rows["bundle"].to_numpy()
            starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(every)], strict=True):
                shard, fp, node = (rows[c].to_numpy()[s:e] for c in ("shard", "fp", "node"))
                tree = pickle.dumps((Trees(shard, fp.view(np.uint64)), node), protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([int(every[s])]), pa.array([len(tree)], pa.int64()), pa.array([tree], pa.binary())], ["bundle", "size", "tree"])

    trees = scratch.table(kept.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(build, "bundle long, size long, tree binary"), "trees")
    asked = scratch.table(asks.repartitionByRange("bundle"), "asked")
    out, wave, held = [], [], 0
    for b, size in [*((r["bundle"], r["size"]) for r in trees.select("bundle", "size").orderBy("bundle").collect()), (None, 0)]:  # a row a bundle
        if wave and (b is None or held + size > WAVE_MB << 20):
            out.append(_search(spark, trees, asked, wave, radius))
            wave, held = [], 0
        wave, held = [*wave, b], held + size
    none = classes.select(F.col("node").alias("u"), F.col("node").alias("v")).where(F.lit(False))
    for x in out:
        none = none.unionByName(x)
    return none


def _search(spark, trees: DataFrame, asked: DataFrame, wave: list[int], radius: int) -> DataFrame:
    """One wave: its trees are broadcast, and the questions to their shards run through them."""
    inside = F.col("bundle").between(wave[0], wave[-1])
    sent = spark.sparkContext.broadcast([bytes(r["tree"]) for r in trees.where(inside).select("tree").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pickle.loads(x) for x in sent.value]
        every, nodes, forest = Trees.joined([t for t, _ in parts]), np.concatenate([n for _, n in parts]), Forest()
        for batch in batches:
            shard, fp, node = (batch.column(c).to_numpy() for c in ("shard", "fp", "node"))
            for i, j in every.probe(shard, fp.view(np.uint64), radius):
                u, v = nodes[i], node[j]
                if (u != v).any():
                    forest.add(u[u != v], v[u != v])
        yield _pair_batch(*forest.edges())

    found = scratch.table(asked.where(inside).select("shard", "fp", "node").mapInArrow(run, "u long, v long"), "links")
    sent.destroy()
    return found


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    size: words a shingle. Texts of the same fingerprint are one node, named by its smallest doc_id, so copies cost
    a row and not pairs. component_id is the smallest doc_id that can be reached over links, the row's own included.
    Null and empty texts have fingerprint 0 and are linked like others; rows with a null doc_id get a fingerprint
    and a null component_id; an empty table gives no rows.
    blocks: by default the fewest (at most radius + 3) whose buckets hold a thousand of evenly spread fingerprints.
    """
    fps = scratch.table(fingerprints(docs, size), "fps")
    classes = scratch.table(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")).select("node", "fp"), "classes")
    if blocks is None:
        n = classes.count()
        blocks = next((b for b in range(radius + 1, radius + 3) if n >> (64 * (b - radius) // b) < 1000), radius + 3)
    roots = components(links(classes, radius, blocks))
    named = classes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("component_id"), "fp")
    return (
        fps.join(named, "fp", "left")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    )


def node_of(text: Column) -> Column:
    """A 64-bit hash of the words of a text, A-Z lowered: texts of the same words are one node."""
    upper = "".join(map(chr, range(65, 91)))
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), SPLIT, " ")))


def masks(nodes: int = 0) -> list[int]:
    """Choices of some of 64 bits, made by a rule, for so many nodes.

    A mask has as many bits as leave a bucket SHARD nodes on average, MASK_BITS at least, so that comparisons grow in
    proportion to the nodes. A pair agrees on a longer mask less often; so there are more masks, by the chance of a pair
    that differs in FLIPPED of its bits: 1.17 times as many a bit, about nodes ** 0.23 in all.
    """
    bits = min(48, max(MASK_BITS, math.ceil(math.log2(max(nodes, 1) / SHARD))))
    order = [sorted(range(64), key=lambda b: xxhash.xxh64_intdigest(f"{i}:{b}".encode())) for i in range(math.ceil(MASKS * (1 - FLIPPED) ** (MASK_BITS - bits)))]
    return [sum(1 << b for b in o[:bits]) for o in order]


def _close(every: bool):
    """Of dealt rows: a forest of the pairs within RADIUS and LEAST, the likeliest first, told as ``_chosen`` of it;

    every: of the pairs across labels that are within LEAST_WIDE too, told as the nodes that they connect, each beside the
    smallest. So a task returns a row a node that it has read at most, however large a group of near copies is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, alike = Forest(), {}
        for rows in whole_groups(batches, "key"):
            key, side, node = (rows[c].to_numpy() for c in ("key", "side", "node"))
            fp, sig = rows["fp"].to_numpy().view(np.uint64), rows["sig"].to_numpy().view(np.uint64)
            label = rows["label"].to_numpy() if every else node
            wide = _matrix(rows["wide"]) if every else None
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            guests = np.repeat(np.add.reduceat(side, starts) > 0, np.diff(np.r_[starts, len(key)]))
            own, ask = np.flatnonzero(side == 0), np.flatnonzero((side == 1) | ~guests)
            for i, j in Trees(key[own], fp[own]).probe(key[ask], fp[ask], RADIUS):
                i, j = own[i], ask[j]
                like = MINIMA - np.bitwise_count(sig[i] ^ sig[j]).astype(np.int64)
                ok = ((side[j] == 1) | (i < j)) & (label[i] != label[j]) & (2 * like >= MINIMA * (1 + LEAST))
                i, j, like = i[ok], j[ok], like[ok]
                if every:
                    ok = _could(wide[i], wide[j])
                    i, j, like = i[ok], j[ok], like[ok]
                i, j = node[i], node[j]
                for at in (20 * like >= 19 * MINIMA, 20 * like < 19 * MINIMA):
                    before = len(forest.pairs)
                    if at.any():
                        forest.add(i[at], j[at])
                    if len(forest.pairs) > before:
                        new = set(forest.pairs[before:])
                        alike.update((x, k) for x, k in zip(zip(i[at].tolist(), j[at].tolist(), strict=True), like[at].tolist(), strict=True) if x in new)
        if every:  # which nodes are together is all that is asked, and smallest nodes are the same in many tasks
            yield _pair_batch(*forest.edges())
        elif forest.pairs:
            yield _chosen(np.array(forest.pairs, np.int64).T, np.array([alike[x] for x in forest.pairs], np.int64))

    return run


def _chosen(pairs: np.ndarray, like: np.ndarray) -> pa.RecordBatch:
    """Of pairs: a row a node x, with the likeliest other node (a, the smallest of these), its likeness, and the smallest smaller one (b)."""
    x, y, like = np.concatenate(pairs), np.concatenate(pairs[::-1]), np.r_[like, like]
    order = np.lexsort((y, -like, x))
    x, y, like = x[order], y[order], like[order]
    first, none = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), np.iinfo(np.int64).max
    b = np.minimum.reduceat(np.where(y < x, y, none), first)
    columns = [pa.array(x[first]), pa.array(y[first]), pa.array(like[first]), pa.array(b, mask=b == none)]
    return pa.RecordBatch.from_arrays(columns, ["x", "a", "like", "b"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _could(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether longer min-hashes show LEAST_WIDE."""
    far = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return 2 * (WIDE - far) >= WIDE * (1 + LEAST_WIDE)


def _dealt(rows: DataFrame, *extra: str) -> DataFrame:
    """Rows of (bucket, node) and more, as groups (key) of bounded size, in which all pairs of a bucket meet.

    A bucket of more than 2 * SHARD nodes is cut; its shards meet in pairs. side: 1 in the later shard of two.
    """
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("a"), F.greatest(t, F.col("own")).alias("b"))))
    dealt = split_hot(rows).select("bucket", "node", *extra, "own", pairs.alias("p"))
    dealt = dealt.select(F.xxhash64("bucket", "p.a", "p.b").alias("key"), (F.col("own") > F.col("p.a")).cast("int").alias("side"), "node", *extra)
    return dealt.repartition("key").sortWithinPartitions("key")


def candidates(classes: DataFrame, every: bool = False) -> DataFrame:
    """Of classes (node, f0, f1 and so on, sig): pairs of which a fingerprint is within RADIUS and agrees on a mask.

    A mask's bucket is a shard with its own BK-tree; here trees are built where they are asked, since there are
    SEEDS times as many as ``masks`` a text, too many to broadcast. Of what tasks return, each node keeps its likeliest
    pair and the smallest of the smaller nodes. every: pairs of nodes of different ``label``, whose ``wide`` could be of
    0.8 or more; all that tasks return stay, the nodes that a task connects beside their smallest, so any such pair
    is joined by a chain of rows.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(classes.count())]
    extra = ["sig", *(["label", "wide"] if every else [])]
    fps = [f"f{i}" for i in range(SEEDS)]
    at = F.posexplode(F.array(*(F.col(c).bitwiseAND(F.lit(m).cast("long")) for c in fps for m in signed)))
    fp = F.element_at(F.array(*fps), (F.floor(F.col("t") / len(signed)) + 1).cast("int"))
    rows = classes.select("node", *fps, *extra, at.alias("t", "value")).select("node", fp.alias("fp"), *extra, F.xxhash64("t", "value").alias("bucket"))
    dealt = _dealt(rows, "fp", *extra)
    if every:
        return dealt.mapInArrow(_close(True), "u long, v long")
    told = dealt.mapInArrow(_close(False), "x long, a long, like long, b long")
    kept = told.groupBy("x").agg(F.max_by("a", F.struct("like", -F.col("a"))).alias("a"), F.min("b").alias("b"))
    kept = kept.select("x", F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))).alias("y"))
    return kept.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of dealt rows: a forest of each group's pairs across labels whose sets of hashes have a similarity of 0.8 or more."""
    for rows in whole_groups(batches, "key"):
        key, side, node, label = (rows[c].to_numpy() for c in ("key", "side", "node", "label"))
        starts, found = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), []
        for s, e in zip(starts, np.r_[starts[1:], len(key)], strict=True):
            of, wide, sets = label[s:e].copy(), _matrix(rows["wide"].slice(s, e - s)), [np.frombuffer(x, np.uint64) for x in rows["hashes"].slice(s, e - s).to_pylist()]
            size = np.array([len(x) for x in sets])
            begin = np.cumsum(size) - size
            flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mark, guest = np.zeros(len(flat), np.int32), side[s:e] == 1
            for j in np.flatnonzero(guest) if guest.any() else range(e - s):
                i = np.flatnonzero(~guest) if guest.any() else np.arange(j)
                i = i[(of[i] != of[j]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j]))]
                i = i[_could(wide[i], wide[j])]
                if not len(i):
                    continue
                own, n = flat[begin[j] : begin[j] + size[j]], size[i]
                mark[own] = 1
                at = np.cumsum(n) - n
                both = np.add.reduceat(mark[flat[np.repeat(begin[i] - at, n) + np.arange(n.sum())]], at)
                mark[own] = 0
                for x in i[9 * both >= 4 * (n + size[j])]:
                    if of[x] != of[j]:  # not joined by an earlier pair
                        found.append((node[s + x], node[s + j]))
                        of[of == of[x]] = of[j]
        if found:
            yield _pair_batch(*np.array(found, np.int64).T)


def _alike(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(u, v, alike) of pairs of nodes: whether the Jaccard similarity of their texts' shingles is 0.8 or more, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set[bytes]] = {}
        for batch in batches:
            u, v, same = batch.column("u").to_pylist(), batch.column("v").to_pylist(), []
            for p, q, a, b in zip(u, v, batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if len(known) > 1000:
                    known.clear()
                a = known.get(p) or known.setdefault(p, set(shingles(a, SHINGLE)))
                b = known.get(q) or known.setdefault(q, set(shingles(b, SHINGLE)))
                same.append(9 * len(a & b) >= 4 * (len(a) + len(b)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(same, pa.bool_())], ["u", "v", "alike"])

    both = pairs.join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, alike boolean")


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [_hashes(list(set(shingles(text, SHINGLE)))) for text in batch.column("text").to_pylist()]
        made = [[wide_minima(h) for h in hashes], [h.tobytes() for h in hashes]]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(x, pa.binary()) for x in made)], ["node", "wide", "hashes"])


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, node, root) of every row with a doc_id: node as of ``node_of``; rows of one root are a group of near copies.

    Links join nodes whose sets of SHINGLE-word shingles have a Jaccard similarity of 0.8 or more; each is checked on
    the texts themselves. Each node's likeliest and smallest candidates are checked first, and make groups. Where a
    check failed, another candidate may hold in its stead: so all nodes with candidates are asked again for those in
    other groups. Such candidates are not written as pairs: nodes that they connect are one cluster, whose sets of
    shingle hashes meet in blocks of bounded size, where all of a cluster's pairs between groups are told and a forest
    of the links is returned. So tasks return a pair or so a node, not the pairs of a group of copies, and no candidate
    between groups stays unchecked; sets of a cluster of n nodes, if over 2 * SHARD, travel n / SHARD times. Null and empty texts are one node; an empty table gives no
    rows; other columns take no part.
    """
    names = [*(f"f{i}" for i in range(SEEDS)), "sig"]
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((len(batch), len(names)), np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                of = [_hashes(list(set(shingles(text, size)))) for size in (1, SHINGLE)]
                made[i, :-1] = np.array(seeded(*of), np.uint64).view(np.int64)
                made[i, -1] = minima(of[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), *map(pa.array, made.T.copy())], ["doc_id", "node", *names])

    rows = scratch.table(own.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "node", *names))), "fps")
    classes = scratch.table(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in names)), "classes")
    found = scratch.table(candidates(classes), "candidates")
    ends = found.select(F.col("u").alias("node")).union(found.select("v")).distinct()
    asked = scratch.table(own.join(ends, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "asked")
    checked = scratch.table(_alike(found, asked), "checked")
    linked = checked.where("alike").select("u", "v")
    roots = components(linked)
    if not checked.where("NOT alike").isEmpty():
        some = asked.mapInArrow(_widen, "node long, wide binary, hashes binary").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        some = scratch.table(some, "some")
        clusters = components(candidates(classes.join(some.drop("hashes"), "node"), every=True))
        meet = clusters.join(some, "node").withColumnRenamed("root", "bucket")
        more = _dealt(meet, "label", "wide", "hashes").mapInArrow(_similar, "u long, v long").distinct()
        more = scratch.table(_alike(more, asked), "more")
        if not (joined := more.where("alike").select("u", "v")).isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(joined))
    return rows.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
