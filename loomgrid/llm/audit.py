"""How five filters on documents interact in every order.

Texts are scanned in their Arrow buffers: byte classes become masks, prefix sums over the texts' offsets give words, capitals and
symbols, and each text's words are hashed, sorted and compared byte by byte where hashes are equal, so counts of distinct words are
exact.  What a document fails becomes five bits.  Copies of a text are found by SHA-256; rows are counted before they meet, so a text
that a third of all documents share costs a row a document in the shuffle and never meets in one task.  What remains is one row for
each part and set of failed filters, at most 32 a part, from which all 120 orders are read.

What becomes of odd input:

- a null text is empty and equal to an empty one; it fails A alone, and E where a smaller id has it too;
- a null id is smaller or greater than none: such a row never fails E, nor makes another fail it;
- repeated rows each count; rows with one id and text are not copies of each other, since no id is smaller;
- a null source is the part of the empty source; ``labels`` may hold an id several times, one row with the mark is enough;
- a table without rows gives none; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
#: Bytes that begin a code point.
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends), without a copy; a null is empty."""
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


def counted(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many are set between each two edges."""
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[edges[1:]] - sums[edges[:-1]]


def word_spans(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; none reaches from one text into the next."""
    inside = ~common._SPACE[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = edges[:-1][edges[:-1] < len(raw)]
    begins[firsts] = inside[firsts]  # the first byte of a text, whatever the text before ends with
    starts = np.flatnonzero(begins)
    # a word ends at the next byte that is white space, or where the next text begins
    stops = ~inside
    stops[firsts] = True
    after = np.append(np.flatnonzero(stops), len(raw))
    return starts, after[np.searchsorted(after, starts, side="right")]


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The distinct words of each text: hashes sorted within texts, and equal neighbours verified byte by byte."""
    if not len(starts):
        return np.zeros(texts, np.int64)
    sizes = ends - starts
    hashes = common.mixed(common.Rolling(common.BYTE_VALUES[raw]).of(starts, ends) + sizes.astype(np.uint64))
    order = np.lexsort((hashes, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    at = np.flatnonzero(same)
    one, two = order[at], order[at + 1]
    alike = sizes[one] == sizes[two]
    for a in range(0, len(at), 1 << 16):  # the bytes of both words side by side
        i, j = one[a : a + (1 << 16)], two[a : a + (1 << 16)]
        n = np.where(alike[a : a + (1 << 16)], sizes[i], 0)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = raw[np.repeat(starts[i], n) + inner] != raw[np.repeat(starts[j], n) + inner]
        wrong = np.concatenate(([0], np.cumsum(differ)))
        ends_ = np.cumsum(n)
        alike[a : a + (1 << 16)] &= wrong[ends_] == wrong[ends_ - n]
    counts = np.bincount(owner, minlength=texts) - np.bincount(owner[one], minlength=texts)
    for text in np.unique(owner[one[~alike]]).tolist():  # two words of one hash: this text is counted as a set
        mine = np.flatnonzero(owner == text)
        counts[text] = len({raw[starts[k] : ends[k]].tobytes() for k in mine.tolist()})
    return counts


#: A text of more bytes is scanned in blocks of as many, cut at white space.
LONG_TEXT = 4 << 20


def _long(data: bytes) -> dict[str, int]:
    """The measures of one long text: blocks add up, but for distinct words, which are gathered in a set."""
    total, seen, at = dict.fromkeys(("n_words", "n_capitals", "n_chars", "n_symbols"), 0), set(), 0
    while at < len(data):
        end = min(at + LONG_TEXT, len(data))
        while end < len(data) and not common._SPACE[data[end]]:
            end += 1
        block = measures(pa.array([data[at:end]], pa.binary()), distinct=False)
        for c in total:
            total[c] += int(block[c][0])
        seen.update(data[at:end].split())  # splits at the same six bytes
        at = end
    return total | {"n_distinct": len(seen)}


def measures(column: pa.Array, distinct: bool = True) -> dict[str, np.ndarray]:
    """n_words, n_distinct, n_capitals, n_chars and n_symbols of each text."""
    raw, edges = buffers(column)
    texts = len(column)
    if distinct and texts == 1 and len(raw) > LONG_TEXT:
        return {c: np.array([v], np.int64) for c, v in _long(raw.tobytes()).items()}
    starts, ends = word_spans(raw, edges)
    owner = np.searchsorted(edges, starts, side="right") - 1
    return {
        "n_words": np.bincount(owner, minlength=texts).astype(np.int64),
        "n_distinct": distinct_words(raw, starts, ends, owner, texts).astype(np.int64) if distinct else np.zeros(texts, np.int64),
        "n_capitals": counted(_CAPITAL[raw], edges),
        "n_chars": counted(_LEAD[raw], edges),
        "n_symbols": counted(_SYMBOL[raw], edges),
    }


def failing(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bits 0 to 3 for what fails A to D."""
    a = m["n_words"] < MIN_WORDS
    b = 100 * m["n_distinct"] < 50 * m["n_words"]
    c = 100 * m["n_capitals"] > 2 * m["n_chars"]
    d = m["n_symbols"] > 0
    return (a + 2 * b + 4 * c + 8 * d).astype(np.int32)


def scanned(df: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """The ``kept`` columns of each row with ``mask`` (what fails of A to D) and ``digest`` (SHA-256 of the text)."""
    rows = df.select(*kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text, common.HASHED_BYTES):
            column = batch.column(text)
            mask = failing(measures(column))
            digests = [hashlib.sha256(x).digest() for x in common.encoded(column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(mask), pa.array(digests, pa.binary())], names=[*kept, "mask", "digest"])

    return rows.mapInArrow(run, rows.select(*kept, F.lit(0).alias("mask"), F.lit(b"").alias("digest")).schema)


def outcomes(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail, bit i for the i-th letter."""
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = common.scratch(scanned(named, "text", ["id", "part"]).groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")))
    # one row a text, met by id too, so that the copies of one text are spread over many tasks
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # rows without an id never join: the digest keeps them apart
    told = rows.join(firsts, ["digest", "id"], "left").withColumn("spread", F.when(F.col("id").isNull(), F.hex("digest")).otherwise(""))
    told = told.join(marks.withColumn("spread", F.lit("")), ["id", "spread"], "left")
    mask = F.col("mask") + F.when(F.col("id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    mark = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return told.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), mark("good"), mark("toxic"))


def _tables(order: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each step of an order its filter, and which masks arrive there and fail it."""
    masks, left, out = np.arange(32), np.ones(32, bool), []
    for letter in order:
        i = FILTERS.index(letter)
        fails = (masks >> i & 1).astype(bool)
        out.append((i, left.copy(), fails))
        left &= ~fails
    return out


def orders_of(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, list]:
    """The rows of one part from its counts by mask."""
    masks = np.arange(32)
    found: dict[str, list] = {c: [] for c in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
    shares, which = [0] * len(FILTERS), []
    for order in ORDERS:
        for step, (i, left, fails) in enumerate(_tables(order), 1):
            here = left & fails
            removed = int(n[here].sum())
            shares[i] += removed
            which.append(i)
            row = (order, step, int(n[left & ~fails].sum()), removed, int(n[fails & ~left].sum()), int(n[masks == 1 << i].sum()), int(good[here].sum()), int(toxic[here].sum()))
            for held, x in zip(found.values(), row, strict=True):
                held.append(x)
    return found | {"shapley": [shares[i] for i in which]}


def interactions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: what is kept, removed, redundant, failed by this filter alone, lost."""
    held = outcomes(docs, labels, key, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))  # at most 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(batch.column("part").to_pylist(), batch.column("held").to_pylist(), strict=True):
                n, good, toxic = np.zeros((3, 32), np.int64)
                for r in rows:
                    n[r["mask"]], good[r["mask"]], toxic[r["mask"]] = r["n"], r["good"], r["toxic"]
                found = orders_of(n, good, toxic)
                size = len(found["step"])
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([name] * size), *(pa.array(v, k) for v, k in zip(found.values(), kinds, strict=True))], names=["part", *found])

    return held.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
