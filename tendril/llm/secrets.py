"""Secret scans: known forms, and random-looking strings by character Markov models, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPLIT

#: Kinds in the order in which spans at the same place are listed, with their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST_VALUE = 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that the models judge. Documents (about) that they are trained on: a documented bound of labelled samples.
CANDIDATE, SAMPLE = r"[A-Za-z0-9+/_=-]{16,}", 2_000
#: Least log-likelihood ratio in all, and a pair of characters; weight of a class's single characters in the smoothing.
LEAST_RATIO, LEAST_PAIR, PRIOR = 12.0, 1.25, 40.0

#: Matches whose places are summed in one fold.
BLOCK = 256
_SPAN = "array<struct<kind:string,start:int,end:int,rank:int>>"


def _matches(text: Column, pattern: str, kind: str, rank: int, ok=None) -> Column:
    """Spans of the leftmost non-overlapping matches: the texts between them and the matches, measured in turn.

    ok: of the array of matches, an array that says which count. Places are summed in blocks of BLOCK matches, and
    over the blocks, so that no step copies more than a block's spans: the time grows with the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("hit"), (ok(found) if ok else F.transform(found, lambda _: F.lit(True))).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        own = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.lit(rank).alias("rank")))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    def placed(blocks: Column) -> Column:
        widths = F.transform(blocks, lambda k: F.aggregate(k, F.lit(0), lambda acc, x: acc + x["gap"] + x["hit"]))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(widths, none, lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        one = lambda z: F.aggregate(z["block"], F.struct(z["start"].alias("at"), F.array().cast(_SPAN).alias("spans")), step, lambda acc: acc["spans"])
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("start")), one))

    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))
    bound = F.transform(F.array(steps), cut)  # evaluated once
    return F.when(text.rlike(pattern), F.transform(bound, placed)[0]).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    long_enough = lambda _: F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE)
    return F.concat(_matches(text, ASSIGN, "assign", 0, long_enough), _matches(text, ACCESS, "access", 1), _matches(text, HEX, "hex", 2))


def _code(c: Column) -> Column:
    return F.call_function("instr", F.lit(ALPHABET), c)


def _known(text: Column) -> Column:
    """The strings of the known forms, of 16 characters or more."""
    own = F.concat(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    return F.filter(own, lambda v: F.length(v) >= 16)


def samples(docs: DataFrame) -> DataFrame:
    """(token, random): labelled samples of random strings and of ordinary identifiers, from about SAMPLE documents.

    Random: strings of the known forms, and digests of texts' hashes in the alphabets that keys are written in (base
    64, 62, 36, 32 and 16). Ordinary: the words outside known forms, but for those with a digit before a letter, which
    may be unmarked secrets; and identifiers made of such words: joined by a sign, by capitals, or with a number.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    n = max(docs.count(), 1)
    d = docs.select(text.alias("text"), F.xxhash64(text, F.lit(23)).alias("h")).where(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * min(1.0, SAMPLE / n))
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = F.filter(F.split(masked, SPLIT), lambda w: (F.length(w) >= 3) & ~w.rlike("[0-9][A-Za-z]"))
    bare = F.filter(F.transform(plain, lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", "")), lambda w: F.length(w) >= 3)
    number = lambda w: F.pmod(F.xxhash64(w), F.lit(3000)).cast("string")
    after = lambda i: F.get(F.col("bare"), i + 1)
    made = F.transform(
        F.filter(F.transform(F.col("bare"), lambda w, i: F.struct(w.alias("a"), F.coalesce(after(i), w).alias("b"), F.pmod(F.xxhash64(w, i), F.lit(64)).alias("k"))), lambda x: x["k"] < 5),
        lambda x: F.when(x["k"] == 0, F.concat_ws("_", x["a"], x["b"])).when(x["k"] == 1, F.concat_ws("-", x["a"], x["b"])).when(x["k"] == 2, F.concat(F.lower(x["a"]), F.initcap(x["b"])))
        .when(x["k"] == 3, F.concat_ws("/", x["a"], x["b"])).otherwise(F.concat(x["a"], number(x["a"]))),
    )
    ordinary = d.withColumn("plain", plain).withColumn("bare", bare).select(F.explode(F.concat("plain", made)).alias("token"), F.lit(False).alias("random"))
    key = lambda i: F.sha2(F.concat_ws(":", F.col("h").cast("string"), F.lit(str(i))), 256)
    b64 = lambda i: F.regexp_replace(F.base64(F.unhex(key(i))), "=", "")
    b62 = lambda i: F.regexp_replace(b64(i), "[+/]", "")
    digests = F.array(b64(0), F.translate(b64(1), "+/", "-_"), b62(2), b62(3), b62(4), F.lower(b62(5)), F.upper(b62(6)), F.substring(key(7), 1, 40), F.upper(F.substring(key(8), 1, 32)))
    random = d.select(F.explode(F.concat(digests, _known(F.col("text")))).alias("token"), F.lit(True).alias("random"))
    return ordinary.unionByName(random)


def fit(tokens: DataFrame) -> list[float]:
    """Of (token, random): log-likelihood ratios of character pairs, cell by cell, random against ordinary.

    A class's chance of a character after another is counted, smoothed by the class's chance of the character at all,
    so that a small sample of words still finds digits and capitals rare. (alphabet + 1)^2 cells whatever the input.
    """
    size = len(ALPHABET) + 1
    pair = F.transform(F.sequence(F.lit(2), F.length("token")), lambda i: _code(F.substring(F.col("token"), i - 1, F.lit(1))) * size + _code(F.substring(F.col("token"), i, F.lit(1))))
    cells = tokens.where(F.length("token") > 1).select("random", F.explode(pair).alias("cell")).groupBy("random", "cell").count()
    counts = {True: [0.0] * (size * size), False: [0.0] * (size * size)}
    for r in cells.collect():  # at most 2 * size * size rows
        counts[r["random"]][r["cell"]] = float(r["count"])
    tables = []
    for label in (True, False):
        c = counts[label]
        rows = [sum(c[i * size : (i + 1) * size]) for i in range(size)]
        single = [sum(c[j::size]) + 0.5 for j in range(size)]
        total = sum(single)
        tables.append([math.log((c[i * size + j] + PRIOR * single[j] / total) / (rows[i] + PRIOR)) for i in range(size) for j in range(size)])
    return [a - b for a, b in zip(*tables, strict=True)]


def train(docs: DataFrame) -> list[float]:
    """The pair of models, as the ratios of ``fit`` on the ``samples`` of docs; an empty table gives ratios of 0."""
    return fit(samples(docs))


def ratio(token: Column, model: list[float]) -> Column:
    """Sum over a string's character pairs of the log-likelihood ratio."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), _code)
    size = len(ALPHABET) + 1
    at = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(c, i - 1) * size + F.get(c, i)))
    return F.when(F.length(token) > 1, F.transform(F.array(codes), at)[0]).otherwise(0.0)


def likely(token: Column, model: list[float]) -> Column:
    """Is a string rather random: by its ratio in all and a pair."""
    return F.transform(F.array(ratio(token, model)), lambda r: (r >= LEAST_RATIO) & (r >= LEAST_PAIR * (F.length(token) - 1)))[0]


def _spans(docs: DataFrame, model: list[float]) -> DataFrame:
    """(row, text, spans) of every row: the row as it is, its text or "", and (start, rank, end, kind) sorted by start, then rank.

    Spans count code points, end exclusive. The model adds strings of kind "markov" that overlap no known form and
    are ``likely``. Null and empty texts have none. Columns of docs stay inside ``row``, so their names can't clash.
    """
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    d = d.withColumn("base", base_spans(F.col("text"))).withColumn("more", _matches(F.col("text"), CANDIDATE, "markov", 3, lambda found: F.transform(found, lambda hit: likely(hit, model))))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    d = d.withColumn("more", F.filter("more", free))
    order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return d.select("row", "text", order(F.concat("base", "more")).alias("spans"))


def _listed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of every row.

    Null texts are empty; rows that repeat get a row each; other columns take no part; an empty table gives no rows.
    """
    d = _spans(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), model)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = _listed(F.filter("spans", lambda s: s["kind"] != "markov"))
    return d.select("row.doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), n("markov").alias("n_markov"))


def redact(docs: DataFrame, model: list[float], by: str = "[SECRET]") -> DataFrame:
    """docs, all columns whatever their names, with each run of overlapping spans in the text replaced.

    Texts without spans, null and empty ones among them, stay as they are; so do all other columns. Rows that repeat
    are treated alike; an empty table gives no rows.
    """
    d = _spans(docs, model)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(by))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when((s["start"] >= acc["at"]) & ((s["start"] > 0) | (acc["at"] == 0)), fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, done).otherwise(F.col("row").getField("text"))
    return d.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))
