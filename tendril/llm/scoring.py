"""LM scoring: a weighted backoff automaton over words, trained on all words, pairs and triples of the training texts.

Texts are cut into chunks of whole documents, written once as word numbers and the chunk's vocabulary. Each chunk asks
for the counts of the n-grams that occur in it, and brings its own training counts: both are one packed, sorted list,
dealt to shards by ranges of a hash. A shard adds up what all chunks bring and answers each. Shards grow in number with
the corpus, not in size; no count is dropped, and neither the driver nor any task holds the model.

With the answers a chunk has the part of the automaton that its texts can reach. States are contexts of two words, one
word or none that training texts hold; an arc carries the smoothed log-probability of its word; where a state has no
arc for a word, its failure arc, with its own weight, leads to the state of the shorter context. One left-to-right pass
carries the state and adds up what the arcs weigh. Smoothing is Dirichlet: p(w | c) = (n(c, w) + K p(w | shorter c)) /
(n(c) + K), down to the base, which sums to one over the known words and one unknown.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scratch
from .toxicity import held_out
from .words import texts, whole_groups, words

#: Words of an n-gram at most; how many words' worth the shorter context is, by the length of the longer.
ORDER, PRIOR = 3, {1: 1000.0, 2: 5.0}
#: Bits of a hash of two or three words (a single word's has all 64); bytes of text a chunk, tokens of the corpus a shard.
BITS, CHUNK, SHARD = 46, 5_000_000, 1_000_000
#: Lanes of a chunk that the traversal moves in step.
LANES = 8192
END, START = b"\n", np.uint64(xxhash.xxh64_intdigest(b"start of a text", 1))
_ODD = np.uint64(xxhash.xxh64_intdigest(b"pairs", 1) | 1)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit values, plane by plane of their bytes, compressed; of ascending ones the differences, which take few bytes."""
    wide = values.astype(np.uint64, copy=False)
    planes = (np.diff(wide, prepend=np.uint64(0)) if ascending else wide).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + (pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * _ODD + b
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Whole texts as numbers of the chunk's words, which are numbered by their ascending hashes."""

    def __init__(self, ids: list, held: list, parts: list[np.ndarray], place: dict[bytes, int]):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, place), np.uint64, len(place))
        self.vocab, rank = np.unique(hashes, return_inverse=True)
        self.ids, self.held = ids, np.array(held, bool)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.tokens = rank[np.concatenate(parts)].astype(np.int32)

    def dump(self) -> bytes:
        """Numbers as planes of bytes, compressed."""
        planes = np.ascontiguousarray(self.tokens.view(np.uint8).reshape(-1, 4).T).tobytes()
        return pickle.dumps((self.ids, self.held, self.lengths, pack(self.vocab, True), pa.compress(planes, codec="zstd", asbytes=True)), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Chunk:
        made = cls.__new__(cls)
        made.ids, made.held, made.lengths, vocab, tokens = pickle.loads(data)
        n = int(made.lengths.sum())
        planes = np.frombuffer(pa.decompress(tokens, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
        made.tokens = np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()
        made.vocab = unpack(vocab, True)
        return made

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def before(self) -> np.ndarray:
        """For each token, the number of the one before it; as many as there are words at the start of a text."""
        out = np.r_[np.int32(0), self.tokens[:-1]]
        out[self.starts] = len(self.vocab)
        return out

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, hashes ascending, for each where it ends first, for each token the place of the n-gram that it ends, -1 for none)."""
        yield 1, self.vocab, np.empty(0, np.int64), self.tokens
        hashed = np.r_[self.vocab, START]
        two = _mix(hashed[self.before()], hashed[self.tokens])
        keys, first, at = np.unique(two >> np.uint64(64 - BITS), return_index=True, return_inverse=True)
        yield 2, keys, first, at.astype(np.int32)
        ends = np.setdiff1d(np.arange(len(self.tokens)), self.starts, assume_unique=True)
        keys, first, at = np.unique(_mix(two[ends - 1], hashed[self.tokens[ends]]) >> np.uint64(64 - BITS), return_index=True, return_inverse=True)
        every = np.full(len(self.tokens), -1, np.int32)
        every[ends] = at
        yield 3, keys, ends[first], every


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a chunk: CHUNK bytes of text, or a single longer text."""
    context, made = TaskContext.get(), 0
    ids, held, parts, place, size = [], [], [], {END: 0}, 0

    def row() -> pa.RecordBatch:
        c = Chunk(ids, held, parts, place)
        return pa.RecordBatch.from_arrays([pa.array([(context.partitionId() << 32) | made], pa.int64()), pa.array([len(c.tokens)], pa.int64()), pa.array([c.dump()], pa.binary())], ["chunk", "tokens", "data"])

    for batch in batches:
        for i, (d, h, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), pc.binary_length(batch.column("text")).to_pylist(), strict=True)):
            if ids and size + n > CHUNK:
                yield row()
                made, ids, held, parts, place, size = made + 1, [], [], [], {END: 0}, 0
            ids.append(d)
            held.append(h)
            w = words(batch.column("text")[i].as_py(), lower=True)
            parts.append(np.fromiter((place.setdefault(x, len(place)) for x in (*w, END)), np.int32, len(w) + 1))
            size += n
    if ids:
        yield row()


def _requests(shards: int):
    """Of chunks: their n-grams' hashes and training counts, a row for each n and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                c = Chunk.load(data.as_py())
                learn = ~np.repeat(c.held, c.lengths)
                for n, keys, _, at in c.grams():
                    counts = np.bincount(at[learn & (at >= 0)], minlength=len(keys))
                    top = keys >> np.uint64(32) if n == 1 else keys >> np.uint64(BITS - 32)
                    shard = (top.astype(np.int64) * shards) >> 32
                    cuts = np.searchsorted(shard, np.arange(shards + 1))
                    full = np.flatnonzero(np.diff(cuts))
                    rows = [(pack(keys[cuts[s] : cuts[s + 1]], True), pack(counts[cuts[s] : cuts[s + 1]])) for s in full.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(full * (ORDER + 1) + n, pa.int64()), pa.array(np.full(len(full), chunk), pa.int64()), pa.array([k for k, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())],
                        ["shard", "chunk", "keys", "counts"],
                    )

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of requests, shard by shard: each chunk's sums over all chunks, in the order asked; and once a shard its sum and how many are known."""
    for rows in whole_groups(batches, "shard"):
        every = rows["shard"].to_numpy()
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(every)], strict=True):
            part = rows.slice(s, e - s)
            keys = [unpack(x.as_py(), True) for x in part["keys"]]
            counts = np.concatenate([unpack(x.as_py()) for x in part["counts"]])
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, counts, len(found)).astype(np.int64)
            ends = np.cumsum([len(k) for k in keys])
            told = [pack(sums[at[b - len(k) : b]]) for k, b in zip(keys, ends.tolist(), strict=True)]
            once = np.arange(e - s) == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["chunk"].to_numpy()), pa.array(every[s:e]), pa.array(told, pa.binary()), pa.array(once * int(sums.sum()), pa.int64()), pa.array(once * int((sums > 0).sum()), pa.int64())],
                ["chunk", "shard", "data", "total", "known"],
            )


class Automaton:
    """The states and arcs that a chunk's texts can reach.

    State 0 has no context, 1 + w has word w (one more: the start of a text), and then comes one for each pair. States
    of contexts that no training text holds are never entered: what leads there leads to the shorter context.
    """

    def __init__(self, chunk: Chunk, sums: dict[int, np.ndarray], total: int, known: int):
        v, before, tokens = len(chunk.vocab), chunk.before(), chunk.tokens
        grams = {n: (first.astype(np.int32), at) for n, _, first, at in chunk.grams()}
        self.words, self.end = v, int(np.searchsorted(chunk.vocab, np.uint64(xxhash.xxh64_intdigest(END))))
        one, two, three = (sums[n].astype(np.float64) for n in (1, 2, 3))
        root = (one + 1) / (total + known + 1)
        context = np.r_[one, one[self.end]]
        first, place = grams[2]
        u, w = before[first], tokens[first]
        k = PRIOR[1]
        pair = (two + k * root[w]) / (context[u] + k)
        ends, _ = grams.pop(3)
        low = place[ends]
        k = PRIOR[2]
        triple = (three + k * pair[low]) / (two[place[ends - 1]] + k)
        self.root, self.pair_state = np.log10(root), 2 + v
        self.fall = np.r_[0.0, np.log10(PRIOR[1] / (context + PRIOR[1])), np.log10(PRIOR[2] / (two + PRIOR[2]))]
        self.fail = np.r_[np.zeros(2 + v, np.int32), 1 + w]
        self.alone = np.where(one > 0, 1 + np.arange(v), 0)
        self.alone[self.end] = 1 + v
        seen, full = two > 0, three > 0
        source = np.r_[1 + u[seen], self.pair_state + place[ends - 1][full]]
        symbol = np.r_[w[seen], tokens[ends[full]]]
        target = np.r_[np.flatnonzero(seen).astype(np.int32), low[full]] + self.pair_state
        arcs = source * np.int64(v) + symbol
        order = np.argsort(arcs).astype(np.int32)
        self.arcs = np.r_[arcs[order], np.iinfo(np.int64).max]
        self.weight = np.r_[np.log10(np.r_[pair[seen], triple[full]])[order], 0.0]
        self.to = np.r_[np.where(symbol == self.end, np.int32(1 + v), target)[order], np.int32(0)]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol each, and what the arcs weigh."""
        weight, after = np.zeros(len(state)), np.empty(len(state), np.int64)
        left, s = np.arange(len(state)), state
        while len(left):
            wanted = s * np.int64(self.words) + symbol[left]
            at = np.searchsorted(self.arcs, wanted)
            hit = (self.arcs[at] == wanted) & (s > 0)
            weight[left[hit]] += self.weight[at[hit]]
            after[left[hit]] = self.to[at[hit]]
            bottom = left[s == 0]
            weight[bottom] += self.root[symbol[bottom]]
            after[bottom] = self.alone[symbol[bottom]]
            more = ~hit & (s > 0)
            left, s = left[more], s[more]
            weight[left] += self.fall[s]
            s = self.fail[s]
        return after, weight

    def weigh(self, tokens: np.ndarray) -> np.ndarray:
        """Each token's log-probability. Lanes move in step; each but the first reads the words before it, which are its state."""
        size = max(64, -(-len(tokens) // LANES))
        lanes, warm = -(-len(tokens) // size), ORDER - 1
        padded = np.r_[np.full(warm, self.end), tokens, np.full(lanes * size - len(tokens), self.end)]
        at, out = np.arange(lanes) * size, np.empty((size, lanes))
        state = np.zeros(lanes, np.int64)
        for i in range(size + warm):
            state, weight = self.step(state, padded[at + i])
            if i >= warm:
                out[i - warm] = weight
        return out.T.ravel()[: len(tokens)]


def _scores(total: int, known: int):
    """Of chunks (shard -1) and their answers, sorted: a row a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "chunk"):
            every, shard = rows["chunk"].to_numpy(), rows["shard"].to_numpy()
            starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(every)], strict=True):
                c, told = Chunk.load(rows["data"][s].as_py()), {n: [np.empty(0, np.uint64)] for n in range(1, ORDER + 1)}
                for i in range(s + 1, e):
                    told[int(shard[i]) % (ORDER + 1)].append(unpack(rows["data"][i].as_py()))
                sums = {n: np.concatenate(x) for n, x in told.items()}
                begin, counts = c.starts, sums[1][c.tokens]
                base = np.log10((counts + 1.0) / (total + known + 1))
                weights = Automaton(c, sums, total, known).weigh(c.tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(c.lengths), pa.array(np.add.reduceat((counts > 0).astype(np.int64), begin)), pa.array(np.full(len(begin), total)),
                     pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(weights, begin))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del c, told, sums, counts, base, weights
                pa.default_memory_pool().release_unused()

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null and empty texts have one token, the end. Rows with a null doc_id count as training rows; rows that repeat
    are counted and scored each. Without training texts nothing is known and all tokens are equally likely. An empty
    table gives no rows. Words are told apart by 64-bit hashes, pairs and triples by BITS.
    """
    own = texts(docs).withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    chunks = scratch.table(own.mapInArrow(_chunks, "chunk long, tokens long, data binary"), "chunks")
    shards = max(1, -(-(chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) // SHARD))
    asked = chunks.select("chunk", "data").mapInArrow(_requests(shards), "shard long, chunk long, keys binary, counts binary")
    dealt = asked.repartition(min(shards * ORDER, 100_000), "shard").sortWithinPartitions("shard")
    answers = scratch.table(dealt.mapInArrow(_answers, "chunk long, shard long, data binary, total long, known long"), "answers")
    words_only = answers.where(F.pmod("shard", F.lit(ORDER + 1)) == 1)
    total, known = words_only.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    both = chunks.select("chunk", F.lit(-1).cast("long").alias("shard"), "data").unionByName(answers.select("chunk", "shard", "data"))
    parts = min(max(1, chunks.count()), 100_000)
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition(parts, "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(_scores(int(total), int(known)), shape)
