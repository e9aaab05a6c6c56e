"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁".encode()
#: Distinct pieces of text whose encoding a task keeps.
CACHE = 400_000
_CHUNK = re.compile(rb" *[^ ]+| +")


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    """The public vocabulary that the environment offers; any other file may be named instead."""
    found = importlib.util.find_spec("public_tokenizers")
    return str((Path(found.origin).parent if found and found.origin else Path("/opt/tokenizers")) / name)


@dataclass(frozen=True)
class Vocabulary:
    """pieces: bytes of each id, None for controls; scores: log scores; bytes_at: ids of the 256 byte pieces, or None."""

    pieces: tuple[bytes | None, ...]
    scores: tuple[float, ...]
    bytes_at: tuple[int, ...] | None
    unknown: int
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value: the child of state s by byte b is base[s] + b + 1 if check of that is s; value: an id or -1."""
    tree: dict = {}
    for key, ident in keys.items():
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = ident
    size = 1024
    base, check, value = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
    free = np.ones(size, bool)
    free[0], check[0] = False, 0
    low = 1
    todo = [(0, tree)]
    while todo:
        state, node = todo.pop()
        value[state] = node.pop(-1, -1)
        if not node:
            continue
        offsets = np.sort(np.fromiter(node, np.int64, len(node))) + 1
        while low < size and not free[low]:
            low += 1
        start, at, tried = low, None, 0
        while at is None:
            tried += 1
            if start + 600 > size:
                base, check, value = (np.r_[a, np.full(size, fill)] for a, fill in ((base, 0), (check, -1), (value, -1)))
                free = np.r_[free, np.ones(size, bool)]
                size *= 2
            first = start + np.flatnonzero(free[start : start + 256])
            fits = first[free[(first - offsets[0])[:, None] + offsets].all(axis=1) & (first >= offsets[0])]
            at = int(fits[0] - offsets[0]) if len(fits) else None
            start += 256
        if tried > 3:  # the slots before are too sparse to be worth another look
            low = start - 256
        base[state] = at
        check[at + offsets] = state
        free[at + offsets] = False
        todo += [(at + b + 1, child) for b, child in node.items()]
    return base, check, value


def load(path: str | None = None) -> Vocabulary:
    """Reads a vocabulary. Scores of a merge list (whole negative ranks) become log p of rank r, p in proportion to 1 / (r + 10)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_file())
    n = sp.get_piece_size()
    own = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) else sp.id_to_piece(i).encode() for i in range(n)]
    raw = [sp.get_score(i) for i in range(n)]
    if all(float(s).is_integer() for s, p in zip(raw, own, strict=True) if p):
        total = sum(1 / (10 - s) for s, p in zip(raw, own, strict=True) if p)
        raw = [float(-np.log((10 - s) * total)) if p else 0.0 for s, p in zip(raw, own, strict=True)]
    at = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
    if any(re.search("[^▁]▁", p.decode()) for p in own if p):
        raise ValueError("a piece holds a marker after other text; chunks would cut it")
    return build(own, raw, tuple(at[b] for b in range(256)) if len(at) == 256 else None, sp.unk_id())


def build(pieces: list[bytes | None], scores: list[float], bytes_at: tuple[int, ...] | None, unknown: int) -> Vocabulary:
    return Vocabulary(tuple(pieces), tuple(scores), bytes_at, unknown, *double_array({p: i for i, p in enumerate(pieces) if p}))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.scores = np.array(vocabulary.scores)
        self.lost = float(min(s for s, p in zip(vocabulary.scores, vocabulary.pieces, strict=True) if p)) - 10
        self.ids: dict[bytes, np.ndarray] = {}
        out = [b"" if p is None else p.replace(MARK, b" ") for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.bytes_at or ()):
            out[i] = bytes([b])
        self.out = out

    def segment(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Viterbi over many chunks in step. Where no piece is a character alone, its bytes (or unknown) may be taken at a loss."""
        if not chunks:
            return []
        lengths = np.array([len(c) for c in chunks])
        offset = np.r_[0, np.cumsum(lengths + 1)]
        flat = np.frombuffer(b"\xff".join([*chunks, b""]), np.uint8).astype(np.int64)
        best, back, by = np.full(offset[-1], -np.inf), np.full(offset[-1], -1), np.full(offset[-1], -1)
        best[offset[:-1]] = 0.0
        order = np.argsort(-lengths, kind="stable")
        start, ends, by_length = offset[:-1][order], (offset[:-1] + lengths)[order], -lengths[order]
        base, check, value = self.v.base, self.v.check, self.v.value
        for s in range(int(lengths.max(initial=0))):
            k = int(np.searchsorted(by_length, -s))
            at, end = start[:k] + s, ends[:k]
            live = best[at] > -np.inf
            at, end = at[live], end[live]
            lead = flat[at]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            char = np.minimum(char, end - at)
            alone = np.zeros(len(at), bool)
            which, state, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
            while len(which):
                ok = at[which] + depth < end[which]
                which, state = which[ok], state[ok]
                goto = base[state] + flat[at[which] + depth] + 1
                ok = goto < len(check)
                ok[ok] = (check[goto[ok]] == state[ok]) & (goto[ok] > 0)
                which, state = which[ok], goto[ok]
                depth += 1
                hit = value[state] >= 0
                if hit.any():
                    w, ident = which[hit], value[state[hit]]
                    alone[w[char[w] == depth]] = True
                    self._relax(best, back, by, at[w], at[w] + depth, self.scores[ident], ident)
            w = ~alone
            self._relax(best, back, by, at[w], at[w] + char[w], np.full(int(w.sum()), self.lost), np.full(int(w.sum()), -2))
        out = []
        for c, a, n in zip(chunks, offset.tolist(), lengths.tolist(), strict=False):
            ids, p = [], a + n
            while p > a:
                q, ident = int(back[p]), int(by[p])
                if ident >= 0:
                    ids.append(ident)
                elif self.v.bytes_at:
                    ids += [self.v.bytes_at[x] for x in reversed(c[q - a : p - a])]
                else:
                    ids.append(self.v.unknown)
                p = q
            out.append(np.array(ids[::-1], np.int32))
        return out

    @staticmethod
    def _relax(best: np.ndarray, back: np.ndarray, by: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        new = best[a] + score
        up = new > best[b]
        best[b[up]], back[b[up]], by[b[up]] = new[up], a[up], ident[up]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Each space, and the start, is a marker; a marker that the text itself holds goes by its bytes."""
        split = [_CHUNK.findall(b" " + t) if t else [] for t in texts]
        if len(self.ids) > CACHE:
            self.ids.clear()
        if fresh := [c for c in dict.fromkeys(x for s in split for x in s) if c not in self.ids]:
            plain = [c for c in fresh if MARK not in c]
            self.ids.update(zip(plain, self.segment([c.replace(b" ", MARK) for c in plain]), strict=True))
            for c in fresh:
                if MARK in c:
                    parts = [np.array([self.v.bytes_at[x] for x in p] if self.v.bytes_at else [self.v.unknown], np.int32) if p == MARK else self.segment([p.replace(b" ", MARK)])[0] for p in re.split(b"(%b)" % MARK, c) if p]
                    self.ids[c] = np.concatenate(parts)
        none = np.empty(0, np.int32)
        return [np.concatenate([self.ids[c] for c in s]) if s else none for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of these ids: markers are spaces, the first of which is dropped; byte pieces are their bytes."""
        text = b"".join(map(self.out.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == b" " else text


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every row; round_trip: decoding the ids gives the text back.

    Null and empty texts have no pieces; repeated rows are encoded each; an empty table gives no rows. The vocabulary
    travels with the task: a fixed file's size bounds it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for batch in batches:
            docs_in, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for i in range(0, len(texts), 1000):
                part = texts[i : i + 1000]
                got = coder.encode(part)
                offsets = np.r_[0, np.cumsum([len(g) for g in got])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))
                same = [coder.decode(g) == t for g, t in zip(got, part, strict=True)]
                yield pa.RecordBatch.from_arrays([docs_in.slice(i, len(part)), pa.array(np.diff(offsets).astype(np.int64)), ids, pa.array(same)], ["doc_id", "n_pieces", "ids", "round_trip"])

    return own.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int32)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
