"""Substring deduplication by difference-cover anchors.

A window is 20 consecutive words.  Anchors are 8 words long and hashed only where a word's number modulo 13 lies in the cover
{0, 1, 3, 9}: for any two places some shift below 13 brings both onto the cover, so any two equal windows share an anchor at
the same place within them.  Anchors that occur once in all texts leave; around the others, windows are hashed whole (96
bits, of words hashed to 128) and the first place of each hash is found.

Hashes travel packed: a row holds all hashes of one bucket from one chunk of rows, each hash once with the least key and place that
the chunk has it at, so a passage that many documents share costs a row's part for each chunk and never gathers its places in
one task.  Long texts are worked on in overlapping pieces, each window in one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Anchors that a task gathers before it sends them on.
GATHERED = 2_000_000


class _Words:
    """The words of some pieces, their hashes and where they stand; and the anchors."""

    def __init__(self, pieces: list[bytes], begins: list[int]) -> None:
        self.one, self.two, self.owner, self.within, self.counts = common.Texts(pieces).words()
        self.place = self.within + np.array(begins, np.int64)[self.owner]
        left = self.counts[self.owner] - self.within
        on_cover = np.isin(self.place % PERIOD, COVER) & (left >= ANCHOR) & (self.counts[self.owner] >= WINDOW)
        self.at = np.flatnonzero(on_cover)
        self.anchors = common.Rolling(self.one).of(self.at, self.at + ANCHOR)
        self.left = left


def _send_anchors(buckets: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, hashes, twice in held:
                rows = [(b, chunk, *x) for b, x in common.packed((hashes % np.uint64(buckets)).astype(np.int64), buckets, hashes, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "chunk", "hashes", "twice"])
            held.clear()

        for batch in batches:
            for chunk, docs in zip(batch.column("chunk").to_pylist(), batch.column("docs"), strict=True):
                parts = [_Words(x, begins).anchors for x, _, begins in common.pieces(common.encoded(common.unbundled(docs.as_py())[text]), WINDOW, True)]
                hashes, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
                if len(hashes):
                    held.append((chunk, hashes, counts > 1))
                    size += len(hashes)
                if size >= GATHERED:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket, each chunk's anchors that occur elsewhere or twice in the chunk."""
    hashes, twice = common.joined(table["hashes"], np.uint64), common.joined(table["twice"], bool)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    weight = np.bincount(group, weights=1 + twice[order])
    shared = np.empty(len(hashes), bool)
    shared[order] = weight[group] > 1
    ends = np.cumsum(common.lengths(table["hashes"], 8))
    rows = [(c, hashes[a:b][shared[a:b]].tobytes()) for c, a, b in zip(table["chunk"].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True) if shared[a:b].any()]
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary())})


_SHARED = "chunk long, hashes binary"
_ANSWERS = "chunk long, bucket int, bits binary"


class _Chunk:
    """The rows of one chunk and those of their windows that may be repeated (96 bits, row, key and place).

    ``first`` numbers, of the equal windows of the chunk, that of the least key and place; ``of`` has its number for each window.
    """

    def __init__(self, left: pa.Table, right: pa.Table, key: str, text: str) -> None:
        docs = common.unbundled(left["docs"][0].as_py())
        self.keys, self.datas = docs[key], common.encoded(docs[text])
        order = common.keys_of(docs[key])
        shared = np.unique(common.joined(right["hashes"], np.uint64))
        h1s, h2s, rows_of, place_of = [], [], [], []
        self.counts = np.zeros(len(self.datas), np.int64)
        for parts, rows, begins in common.pieces(self.datas, WINDOW, True):
            x = _Words(parts, begins)
            rows = np.array(rows, np.int64)
            np.maximum.at(self.counts, rows[x.owner], x.place + 1)
            at = x.at[common.member(x.anchors, shared)]
            if not len(at):
                continue
            # windows that begin at most PERIOD - 1 words ahead of the anchor, in the same piece
            w = np.flatnonzero(common.spread(at, PERIOD - 1, 1, len(x.one)) & (x.left >= WINDOW))
            one, two = common.both(x.one, x.two)
            h1s.append(one.of(w, w + WINDOW))
            h2s.append(two.of(w, w + WINDOW) & np.uint64(0xFFFFFFFF))
            rows_of.append(rows[x.owner[w]])
            place_of.append(x.place[w])
        self.h1, self.h2 = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (h1s, h2s))
        self.row, self.place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows_of, place_of))
        self.key = order[self.row]
        by, new = common.groups_of(self.h1, self.h2, then=(self.key, self.place))
        self.first, self.of = by[new], np.empty(len(by), np.int64)
        self.of[by] = np.cumsum(new) - 1
        # in the order of rows, so that neighbours' keys lie together
        ranked = np.argsort(self.first)
        back = np.empty(len(ranked), np.int64)
        back[ranked] = np.arange(len(ranked))
        self.first, self.of = self.first[ranked], back[self.of]


def _ask(buckets: int, key: str, text: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left, right, key, text)
        f = chunk.first
        return common.questions(left["chunk"][0].as_py(), chunk.h1[f], chunk.h2[f], buckets, key=chunk.key[f], place=chunk.place[f].astype(np.uint32))

    return run


def _later(table: pa.Table) -> pa.Table:
    """Of one bucket, which of each chunk's windows also start at a lesser key and place in another."""

    def judge(h1: np.ndarray, h2: np.ndarray, table: pa.Table) -> np.ndarray:
        key, place = common.joined(table["key"], np.int64), common.joined(table["place"], np.uint32)
        order, new = common.groups_of(h1, h2, then=(key, place))
        first = order[new][np.cumsum(new) - 1]
        late = np.zeros(len(order), bool)
        late[order] = (key[order] != key[first]) | (place[order] != place[first])
        return late

    return common.answered(table, judge)


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window that begins at one of the starts."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + window, n), -1)
    return np.cumsum(edges[:-1]) > 0


_RESULT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())]


def _removed(buckets: int, key: str, text: str, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left, right, key, text)
        late = common.answers(right, chunk.h1[chunk.first], buckets)
        first = chunk.first[chunk.of]
        again = late[chunk.of] | (chunk.key != chunk.key[first]) | (chunk.place != chunk.place[first])
        row, place = chunk.row[again], chunk.place[again]
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order]
        cuts = np.searchsorted(row, np.arange(len(chunk.datas) + 1))
        rows = []
        for i, (data, n) in enumerate(zip(chunk.datas, chunk.counts.tolist(), strict=True)):
            words, removed = data.split(), 0
            if cuts[i] < cuts[i + 1]:
                gone = covered(place[cuts[i] : cuts[i + 1]], WINDOW, n)
                words, removed = [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())
            kept = b" ".join(words)
            rows.append((n, removed, kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest()))
        return pa.table({key: chunk.keys, **{n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(_RESULT)}})

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_text, kept_sha256) of each row; kept_text is null unless asked for.

    A word goes if it is covered by a window whose words also start earlier: at a smaller key, or at the same key and an
    earlier word.  So rows with the same key count as the same document, and equal ones get equal results; null keys count as one key
    after all others.  Keys are integers.  A null text has no words.  Texts pass through one shuffle, compressed, which both their
    users read.
    """
    spark = df.sparkSession
    rows = df.select(key, text)
    docs, size = common.chunked(rows, text)
    docs = docs.select("chunk", "docs")
    buckets = common.buckets_for(spark, size // 2)
    sent = docs.mapInArrow(_send_anchors(buckets, text), "bucket int, chunk long, hashes binary, twice binary")
    shared = common.scratch(sent.groupBy("bucket").applyInArrow(_shared_anchors, _SHARED))
    asked = common.buckets_for(spark, size * 2, 16 << 20)
    late = docs.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_ask(asked, key, text), f"{common.QUESTION}, key binary, place binary").groupBy("bucket").applyInArrow(_later, _ANSWERS)
    told = shared.select("chunk", "hashes", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("bits")).unionByName(late.withColumn("hashes", F.lit(None).cast("binary")))
    schema = rows.select(key, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"), F.lit("").alias("kept_sha256")).schema
    return docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_removed(asked, key, text, with_text), schema)
