"""Cross-tokenizer alignment: byte spans of two tokenizers' tokens, groups between common ends, and links of overlaps.

Spans come from the libraries: character offsets of a byte-level BPE (A), spans of a SentencePiece proto (B). They are
coarse cuts: where tokens share a character, or a fallback byte has no span of its own, the tokens' decoded bytes give
the ends, from the last sure end on.

Texts are cut before single spaces between other than white space. There both tokenizers always end a token, so what
stands between two cuts (a unit) is encoded, grouped and linked alike wherever it occurs: each different unit of a
chunk of texts is encoded once, and documents are sums over their units.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.util
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scratch
from .words import texts

#: Bytes of text of which a unit is encoded once.
CHUNK = 32 << 20
#: The encoding of spaces in pieces.
MARK = "▁"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def vocabulary_file(name: str) -> str:
    """A public vocabulary that the environment offers; any other path may be named instead."""
    found = importlib.util.find_spec("public_tokenizers")
    return str((Path(found.origin).parent if found and found.origin else Path("/opt/tokenizers")) / name)


@functools.cache
def _load(path_a: str, path_b: str):
    """Both tokenizers, the bytes of their ids, and whether texts may be cut into units. Once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # of byte-level BPE: these bytes are shown as they are, the others from 256 on
    hidden = [x for x in range(256) if x not in set(shown)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    names = {i: s for s, i in a.get_vocab(with_added_tokens=True).items()}
    of_a = [bytes(byte[c] for c in names[i]) if i in names and all(c in byte for c in names[i]) else b"" for i in range(max(names) + 1)]
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    inner = any(re.search(f"[^{MARK}]{MARK}", p) for i, p in enumerate(pieces) if not b.is_control(i) and not b.is_unknown(i))
    level = a.pre_tokenizer is not None and "use_regex=True" in repr(a.pre_tokenizer) and a.normalizer is None
    return a, b, of_a, of_b, level and not inner


def units(text: str, cut: bool = True) -> list[str]:
    """The text between single spaces that stand between other than white space; those spaces are left out."""
    if not cut:
        return [text]
    odd = text[:1] == " " or text[-1:] == " " or "  " in text or any(w in text and (w + " " in text or " " + w in text) for w in _SPACES)
    return _CUT.split(text) if odd or (not text.isascii() and _OTHER_SPACE.search(text)) else text.split(" ")


def _decoded(text: bytes) -> str | None:
    try:
        return text.decode()
    except UnicodeDecodeError:  # no tokenizer gives such bytes back
        return None


def refined(counts: np.ndarray, start: np.ndarray, stop: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ends of tokens, in bytes from their unit's beginning. counts: tokens a unit; start, stop: coarse spans; length: decoded bytes.

    A token whose span begins where the one before ends, is as long as its bytes and meets the next one is sure: its
    end is its span's. From the last sure end, or the unit's beginning, the lengths are added up.
    """
    last = np.cumsum(counts)
    first = np.repeat(last - counts, counts)
    edge = np.arange(len(start)) == first
    before = np.where(edge, 0, np.r_[0, stop[:-1]])
    after = np.where(np.r_[edge[1:], True], stop, np.r_[start[1:], 0])
    sure = (start == before) & (stop - start == length) & (after == stop)
    total = np.cumsum(length)
    anchor = np.maximum.accumulate(np.where(sure, np.arange(len(start)), -1)) if len(start) else start
    base = total[first] - length[first] if len(start) else total
    return total - np.where(anchor >= first, (total - stop)[anchor], base)


def _spans_a(encoded: list, starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, tokens a unit and coarse byte spans of A's encodings. starts: first byte of each character; bounds: first character of each unit."""
    counts = np.fromiter((len(e.ids) for e in encoded), np.int64, len(encoded))
    ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int64, int(counts.sum()))
    spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in encoded)), np.int64, 2 * len(ids)).reshape(-1, 2)
    at = starts[np.repeat(bounds[:-1], counts)[:, None] + spans] - np.repeat(starts[bounds[:-1]], counts)[:, None]
    return ids, counts, at[:, 0], at[:, 1]


def _spans_b(encoded: list) -> tuple[np.ndarray, ...]:
    """The same of B's protos; the space that B adds is the first byte."""
    counts = np.fromiter((len(e.pieces) for e in encoded), np.int64, len(encoded))
    flat = np.fromiter((x for e in encoded for p in e.pieces for x in (p.id, p.begin, p.end)), np.int64, 3 * int(counts.sum())).reshape(-1, 3)
    head = np.cumsum(counts) - counts
    start, stop = flat[:, 1] + 1, flat[:, 2] + 1
    start[head[counts > 0]] = 0
    return flat[:, 0], counts, start, stop


def encode_units(found: list[str], path_a: str, path_b: str) -> dict[str, list]:
    """Of each unit, with a space before it: whether both tokenizers give its bytes back, and its tokens, groups and links."""
    a, b, of_a, of_b, _ = _load(path_a, path_b)
    spaced = [" " + u for u in found]
    whole = [u.encode() for u in spaced]
    text = np.frombuffer(b"".join(whole), np.uint8)
    starts = np.r_[np.flatnonzero((text & 0xC0) != 0x80), len(text)]
    bounds = np.r_[0, np.cumsum([len(u) for u in spaced])]
    sides = []
    for (ids, counts, start, stop), known in ((_spans_a(a.encode_batch(spaced, add_special_tokens=False), starts, bounds), of_a), (_spans_b(b.encode(found, return_type="proto", num_threads=1)), of_b)):
        parts = [known[i] for i in ids.tolist()]
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        last = np.cumsum(counts)
        same = [b"".join(parts[k - n : k]) == w for k, n, w in zip(last.tolist(), counts.tolist(), whole, strict=True)]
        sides.append((ids, counts, refined(counts, start, stop, length), length, np.array(same, bool)))
    ok = sides[0][4] & sides[1][4]
    size = np.where(ok, [len(w) for w in whole], 0)
    base = np.cumsum(size) - size
    flat = []
    for ids, counts, end, length, _ in sides:  # only of units that both give back, on one line of bytes
        own = np.repeat(ok, counts)
        flat.append((ids[own], np.where(ok, counts, 0), (np.repeat(base, counts) + end)[own], length[own]))
    (ids_a, n_a, end_a, len_a), (ids_b, n_b, end_b, _) = flat
    common = np.intersect1d(end_a, end_b)
    groups = np.searchsorted(common, base + size, "right") - np.searchsorted(common, base, "right")
    low, high = np.searchsorted(end_b, end_a - len_a, "right"), np.searchsorted(end_b, end_a, "left")
    many = high - low + 1
    link_a = np.repeat(ids_a, many)
    link_b = ids_b[np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
    links = np.bincount(np.repeat(np.arange(len(found)), n_a), many, len(found)).astype(np.int64)
    cut_a, cut_b = np.searchsorted(end_a, common, "right").tolist(), np.searchsorted(end_b, common, "right").tolist()
    names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
    each = [",".join(names_a[p:q]) + "|" + ",".join(names_b[r:s]) for p, q, r, s in zip([0, *cut_a[:-1]], cut_a, [0, *cut_b[:-1]], cut_b, strict=False)]
    stop = np.cumsum(groups).tolist()
    shown = [";".join(each[k - n : k]) for k, n in zip(stop, groups.tolist(), strict=True)]
    return {"ok": ok, "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links, "groups": shown, "a": link_a, "b": link_b}


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between successive edges."""
    total = np.r_[0, np.cumsum(values.astype(np.int64))]
    return total[edges[1:]] - total[edges[:-1]]


def _packed(chunk: int, ids: list, raws: list[bytes], paths: tuple[str, str], cut: bool) -> pa.RecordBatch:
    """A row: the chunk's documents as lists of its units, the units as lists of its pairs of ids, and these with how many links hold them."""
    numbers: dict[str, int] = {}
    own = []
    for raw in raws:
        text = _decoded(raw) if raw else None
        own.append(np.fromiter((numbers.setdefault(u, len(numbers)) for u in (units(text, cut) if text is not None else ())), np.int32))
    found = list(numbers)
    parts = [encode_units(found[k : k + 5000], *paths) for k in range(0, len(found), 5000)]
    joined = {c: np.concatenate([p[c] for p in parts] or [np.zeros(0, np.int64)]) for c in ("ok", *_SUMS[:4], "a", "b")}
    shown = [g for p in parts for g in p["groups"]]
    ok = joined["ok"].astype(bool)
    own = [x if len(x) and ok[x].all() else x[:0] for x in own]
    edges, flat = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int32), np.concatenate([*own, np.zeros(0, np.int32)])
    sums = [pa.array(_sums(joined[c][flat], edges)) for c in _SUMS[:4]]
    digests = [hashlib.sha256(";".join([shown[i] for i in x.tolist()]).encode()).hexdigest() if len(x) else "" for x in own]
    docs = pa.table([pa.array(ids, pa.int64()), *sums, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["doc_id", *_SUMS[:4], "groups_sha256", "units"])
    pairs, at = np.unique(joined["a"].astype(np.int64) << 32 | joined["b"].astype(np.int64), return_inverse=True)
    times = np.bincount(at, np.repeat(np.bincount(flat, minlength=len(found)), joined["n_links"].astype(np.int64)), len(pairs)).astype(np.int64)
    links = pa.table([pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(joined["n_links"])].astype(np.int32)), pa.array(at.astype(np.int32)))], ["links"])
    lists = [pa.array([x], pa.list_(t)) for x, t in (((pairs >> 32).astype(np.int32), pa.int32()), ((pairs & 0xFFFFFFFF).astype(np.int32), pa.int32()), (times, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_ipc(docs)], pa.binary()), pa.array([_ipc(links)], pa.binary()), *lists], ["chunk", "docs", "units", "a", "b", "n"])


def _pack(size: int, paths: tuple[str, str], cut: bool):
    """A row for about ``size`` bytes of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, raws, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held and held + len(raw) > size:
                    yield _packed(chunk, ids, raws, paths, cut)
                    chunk, ids, raws, held = chunk + 1, [], [], 0
                ids.append(doc_id)
                raws.append(raw)
                held += len(raw)
        if ids:
            yield _packed(chunk, ids, raws, paths, cut)

    return run


def _total(packs: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a chunk: their units' sums of what is known of each pair of ids by now."""
    out = []
    at = answers["pos"].to_numpy()
    known = np.zeros((2, int(at.max()) + 1 if len(at) else 0), np.int64)
    known[:, at] = answers["best"].to_numpy(), answers["count"].to_numpy()
    for docs, links in zip(packs["docs"].to_pylist(), packs["units"].to_pylist(), strict=True):
        docs, links = (pa.ipc.open_stream(x).read_all() for x in (docs, links))
        own, links = docs["units"].combine_chunks(), links["links"].combine_chunks()
        for name, each in zip(_SUMS[4:], known, strict=True):
            of_unit = _sums(each[links.values.to_numpy()], links.offsets.to_numpy())
            docs = docs.append_column(name, pa.array(_sums(of_unit[own.values.to_numpy()], own.offsets.to_numpy())))
        out.append(docs.select(["doc_id", *_SUMS, "groups_sha256"]))
    return pa.concat_tables(out)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A (``path_a``, a tokenizers file of byte-level BPE) encodes a space and the text, B (``path_b``, a SentencePiece
    model that adds a space) the text, both whole and without special tokens. Tokens are linked if their bytes overlap;
    a pair of ids counts how many links of the corpus hold it. n_best: the links whose pair is the commonest of its B
    id; count_sum: the sum of their counts. groups_sha256: of the ids between common ends.

    Null and empty texts, and those that either tokenizer doesn't give back byte by byte (U+2581 in a text, say, or
    bytes that aren't UTF-8), are zeros with '' and count nowhere. Rows that repeat, ids included, stay and count each.
    Other columns don't matter. An empty table gives no rows. Long texts are cut like others; a text without spaces is
    one unit. Sums are 64-bit.

    A task turns its texts, CHUNK bytes at a time, into one row, written once: documents are lists of the chunk's
    units, units lists of the chunk's pairs. The pairs are counted over the corpus, and each chunk is told the counts
    of its own: a join with a row for each chunk and different pair in it. Nothing is broadcast, no text is shuffled,
    and no pair, however common, has more rows than there are chunks. If a tokenizer might join units, whole texts
    are taken.
    """
    paths = path_a or vocabulary_file("byte_bpe_50k.json"), path_b or vocabulary_file("piece_bpe_32k.model")
    packs = texts(docs).mapInArrow(_pack(chunk, paths, _load(*paths)[4]), "chunk long, docs binary, units binary, a array<int>, b array<int>, n array<long>")
    packs = scratch.table(packs, "packs")
    asked = packs.select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("pos", "x")).select("of", "pos", "x.a", "x.b", "x.n")
    pairs = scratch.table(asked.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    judged = pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    answers = asked.select("of", "pos", "a", "b").join(judged, ["a", "b"]).select("of", "pos", "count", "best")
    shape = "doc_id long, " + ", ".join(f"{c} long" for c in _SUMS) + ", groups_sha256 string"
    return packs.select("chunk", "docs", "units").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_total, shape)
