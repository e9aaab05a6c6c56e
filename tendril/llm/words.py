"""Words of texts, as all operators of this package take them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The same words in a regular expression of Java or RE2.
SPLIT, WORD = r"[ \t-\r]+", r"[^ \t-\r]+"


def words(text: bytes, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8; lower turns A-Z only. bytes.split() and .lower() mean just that."""
    return (text.lower() if lower else text).split()


def texts(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text as UTF-8 bytes, null as empty: other columns, however they are named, stay out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Of batches sorted by a long key: tables that end where a key ends."""
    rest = None
    for batch in batches:
        got = pa.Table.from_batches([batch])
        got = pa.concat_tables([rest, got]) if rest is not None else got
        if not len(got):
            continue
        keys = got[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        rest = got.slice(cut)
        if cut:
            yield got.slice(0, cut)
    if rest is not None and len(rest):
        yield rest
