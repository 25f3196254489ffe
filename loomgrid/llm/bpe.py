"""Byte-level BPE: text to ids by a rank file, ids back to raw bytes.

The tiktoken library does the merges.  A long text is first cut where the pattern always starts a new match, so that
the pieces' ids, joined, are those of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common

#: Texts of more characters are cut at safe boundaries.
PIECE_CHARS = 1 << 16
_LOADED: dict[tuple[str, str], object] = {}


def encoding(ranks_file: str | None = None, pattern: str | None = None):
    """The encoder of a local rank file; a worker loads it once.  None: the installed multilingual vocabulary."""
    import public_tokenizers
    import tiktoken

    ranks_file = ranks_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    if (ranks_file, pattern) not in _LOADED:
        with open(ranks_file, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        _LOADED[ranks_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[ranks_file, pattern]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text cut into pieces of about ``size`` characters, only between a visible character and white space after it.

    No match of the pattern runs from a visible character into white space and nothing in it looks back, so a match always
    begins there.  Where no such place is near, the piece gets longer.
    """
    if len(text) <= size:
        return [text]
    found, start = [], 0
    while len(text) - start > size:
        cut = start + size
        while cut > start + 1 and not (text[cut] in " \n\t\r" and not text[cut - 1].isspace()):
            cut -= 1
        if cut == start + 1:
            cut = start + size
            while cut < len(text) and not (text[cut] in " \n\t\r" and not text[cut - 1].isspace()):
                cut += 1
        found.append(text[start:cut])
        start = cut
    if start < len(text):
        found.append(text[start:])
    return found


def ids_of(encoder, text: str | None) -> list[int]:
    """The ids of a text, special tokens' strings as ordinary text; null gives none."""
    if not text:
        return []
    pieces = safe_pieces(text)
    ids = encoder.encode_ordinary(pieces[0])
    for piece in pieces[1:]:
        ids += encoder.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with the column ``ids``, an array of ints; a null or empty text gives an empty array.

    A column of that name is replaced; other columns pass unchanged.
    """
    kept = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks_file, pattern)
        for batch in common.slices(batches, text):
            out = pa.array([ids_of(encoder, x) for x in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, ids])

    schema = df.select(kept).withColumn(ids, F.array().cast("array<int>")).schema
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", data: str = "data", ranks_file: str | None = None) -> DataFrame:
    """``df`` with the column ``data``: the ids' raw bytes, which need not be whole UTF-8; null ids give null.

    An id outside the vocabulary fails the query.
    """
    kept = [c for c in df.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks_file)
        for batch in batches:
            out = pa.array([None if x is None else encoder.decode_bytes(x) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, data])

    schema = df.select(kept).withColumn(data, F.lit(None).cast("binary")).schema
    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_file: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes that they decode to.

    Encoding and decoding run in one pass, so that the ids do not travel.  Null and empty texts have no ids; both digests are
    then those of nothing.  A row for each row, repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks_file)
        for batch in common.slices(batches, text):
            counts, first, second = [], [], []
            for x in batch.column(text).to_pylist():
                ids = ids_of(encoder, x)
                counts.append(len(ids))
                first.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(encoder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.array(counts, np.int64)), pa.array(first, pa.string()), pa.array(second, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(key, text)
    schema = rows.select(key, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return rows.mapInArrow(run, schema)
