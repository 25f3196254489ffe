"""Suffix-array deduplication by a depth-limited radix sort of suffixes.

Suffixes begin at bytes or at words and are told apart only through a depth (400 bytes, 50 words), most significant digit first;
groups of one leave after each pass, and what is equal after the last is a repeated window.  Digits are long, and each is
represented by a fingerprint, so a pass groups suffixes by prefix but in the order of fingerprints.  A window's key begins
at its lead, so that few suffixes decide many windows:

1. Of a window's first places (128 bytes, 16 words) the one with the least hashed gram is its lead; equal windows lead from the
   same place.  Neighbouring windows mostly share a lead, so one suffix stands for all windows of a stretch (65 bytes on
   average).  First digit: what follows the lead and every window that it leads contains (273 bytes, 35 words).  A lead alone
   with its digit ends here.
2. Second digit: the rest, as the bytes of all windows of the stretch together.  Where these occur twice, all windows of the
   stretch are repeated.  Where a lead's group also has stretches that occur once (a repeat begins or ends there), ...
3. ... the windows of these and of one stretch of each kind are sorted one by one, by 96 bits.

Fingerprints travel packed, each once from a chunk of rows, so a passage that many documents share never gathers its places in
one task.  Long texts are worked on in overlapping pieces, each window in one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common


class Unit(NamedTuple):
    """What suffixes are made of: windows of ``depth``, led from the first ``leads`` places by grams of ``gram``."""

    words: bool
    depth: int
    leads: int
    gram: int

    @property
    def digit(self) -> int:
        return self.depth - self.leads + 1


def unit(depth: int, words: bool = False) -> Unit:
    """The unit of that depth; leads take up to a third of it."""
    leads = 1 << max(0, (depth // 3).bit_length() - 1)
    return Unit(words, depth, leads, max(1, min(3 if words else 16, depth - leads + 1)))


BYTES = unit(400)
WORDS = unit(50, words=True)
#: Stretches that a task gathers before it sends them on.
GATHERED = 1_000_000
REPEATED, ALONE, SPEAKER, FIRST = 1, 2, 3, 4


_LOW = np.uint64((1 << 20) - 1)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


def _leads(grams: np.ndarray, leads: int) -> np.ndarray:
    """For each place the last of those with the least gram (its upper 44 bits) among the ``leads`` places from it on.

    A place's number stands in the lower bits, so places must stay below 2**20: pieces see to that.
    """
    if len(grams) > int(_LOW):
        raise ValueError("too many places")
    least, step = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64)), 1
    while step < leads:
        np.minimum(least[:-step], least[step:], out=least[:-step])
        step *= 2
    return (_LOW - (least & _LOW)).astype(np.int64)


class Stretches:
    """The windows of some pieces in stretches of one lead: their pieces, first and last windows, and both digits."""

    def __init__(self, pieces: list[bytes], of: Unit) -> None:
        texts = common.Texts(pieces)
        if of.words:
            one, two, _, _, sizes = texts.words()
            starts = np.cumsum(sizes) - sizes
        else:
            raw = np.frombuffer(texts.data, np.uint8)
            one, two = common.BYTE_VALUES[raw], common.OTHER_VALUES[raw]
            sizes, starts = texts.sizes, texts.starts
        self.starts, n = starts, len(one)
        self.first = self.last = self.owner = np.zeros(0, np.int64)
        self.digit = self.rest = np.zeros(0, np.uint64)
        edges = np.zeros(n + 1, np.int32)
        long = sizes >= of.depth
        edges[starts[long]] += 1
        edges[starts[long] + sizes[long] - of.depth + 1] -= 1
        w = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        if not len(w):
            return
        self.one, self.two = common.both(one, two)
        lead = _leads(self.one.unmixed(of.gram) * _SPREAD, of.leads)[w]
        new = np.ones(len(w), bool)
        new[1:] = (np.diff(lead) != 0) | (np.diff(w) != 1)
        at = np.flatnonzero(new)
        self.first, self.last = w[at], w[np.append(at[1:], len(w)) - 1]
        lead = lead[at]
        self.owner = np.searchsorted(starts, self.first, side="right") - 1
        self.digit = self.one.of(lead, lead + of.digit)
        shape = ((lead - self.first) * of.leads + (self.last - self.first)).astype(np.uint64)
        self.rest = common.mixed(self.two.of(self.first, self.last + of.depth) + shape)


def _send(buckets: int, text: str, units: list[Unit]):
    """(bucket, chunks, digit, rest, twice): a row for each bucket from all that a task gathers, whatever chunks its rows are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                (chunks, digit, rest), weight = _distinct(np.concatenate(held, axis=1))
                held.clear()
                rows = [(b, *x) for b, x in common.packed((digit % np.uint64(buckets)).astype(np.int64), buckets, chunks, digit, rest, weight > 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "chunks", "digit", "rest", "twice"])

        for batch in batches:
            for chunk, docs in zip(batch.column("chunk").to_pylist(), batch.column("docs"), strict=True):
                datas = common.encoded(common.unbundled(docs.as_py())[text])
                for of in units:
                    for parts, _, _ in common.pieces(datas, of.depth, of.words):
                        s = Stretches(parts, of)
                        if len(s.first):
                            held.append(np.stack([np.full(len(s.first), chunk, np.uint64), s.digit, s.rest]))
                            size += len(s.first)
                        if size >= GATHERED:
                            yield from flush()
                            size = 0
        yield from flush()

    return run


def _distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of an array of rows, ordered by the rows, and how often each occurs."""
    order, new = common.groups_of(*columns)
    at = np.flatnonzero(new)
    return columns[:, order[at]], np.diff(np.append(at, len(order)))


def _sorted_out(table: pa.Table, keep_first: bool = False) -> pa.Table:
    """The first two passes over one bucket: what each chunk's stretches are, where it is anything but unique.

    Where first places are kept, a lead's only kind of stretch has its first one told so, and a speaker is its kind's first; windows of
    a lead with several kinds may be shared between them, so all these are sorted one by one.
    """
    chunks, digit, rest = (common.joined(table[c], np.uint64) for c in ("chunks", "digit", "rest"))
    weight = 1 + common.joined(table["twice"], bool).astype(np.int64)
    order, new_r = common.groups_of(digit, rest, then=(chunks,))
    d, w = digit[order], weight[order]
    new_d = np.zeros(len(d), bool)
    new_d[:1] = True
    new_d[1:] = d[1:] != d[:-1]
    of_d, of_r = np.cumsum(new_d) - 1, np.cumsum(new_r) - 1
    in_d, in_r = np.bincount(of_d, weights=w), np.bincount(of_r, weights=w)
    alone = in_r[of_r] == 1
    mixed_group = np.bincount(of_d, weights=alone) > 0
    if keep_first:
        several = np.bincount(of_d, weights=new_r) > 1
        equal = np.where(new_r, np.where(several[of_d], SPEAKER, FIRST), REPEATED)
    else:
        equal = np.where(mixed_group[of_d] & new_r, SPEAKER, REPEATED)
    status = np.where(in_d[of_d] < 2, 0, np.where(alone, ALONE, equal)).astype(np.uint8)
    told = np.flatnonzero(status)
    # a chunk that several tasks have rows of asks as often; it is told once, and a speaker is told so
    by_chunk, first = common.groups_of(chunks[order[told]], digit[order[told]], rest[order[told]], FIRST - status[told])
    first[1:] = (np.diff(np.stack([x[order[told]][by_chunk].view(np.int64) for x in (chunks, digit, rest)])) != 0).any(axis=0)
    told = told[by_chunk[first]]
    of, status = order[told], status[told]
    cuts = [0, *(np.flatnonzero(np.diff(chunks[of])) + 1).tolist(), len(of)]
    rows = [(int(chunks[of[a]].astype(np.int64)), digit[of[a:b]].tobytes(), rest[of[a:b]].tobytes(), status[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("chunk", "digit", "rest", "status"), kinds, strict=True))})


_TOLD = "chunk long, digit binary, rest binary, status binary"
_ANSWERS = "chunk long, bucket int, bits binary"


class _Told:
    """What is told of a chunk's stretches, looked up by both digits at once."""

    def __init__(self, right: pa.Table) -> None:
        digit, rest = (common.joined(right[c], np.uint64) for c in ("digit", "rest"))
        key = self._key(digit, rest)
        order = np.argsort(key, kind="stable")
        self.key, self.digit, self.rest = key[order], digit[order], rest[order]
        self.status = common.joined(right["status"], np.uint8)[order]

    @staticmethod
    def _key(digit: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return common.mixed(digit) ^ rest

    def of(self, digit: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Each stretch's status, 0 where nothing is told."""
        if not len(self.key) or not len(digit):
            return np.zeros(len(digit), np.uint8)
        key = self._key(digit, rest)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where((self.key[at] == key) & (self.digit[at] == digit) & (self.rest[at] == rest), self.status[at], 0).astype(np.uint8)


class _Chunk:
    """The rows of one chunk, the windows known to be repeated, and those to sort one by one (96 bits, unit, row and place)."""

    def __init__(self, left: pa.Table, right: pa.Table, text: str, units: list[Unit], keep_first: bool = False) -> None:
        self.docs = common.unbundled(left["docs"][0].as_py())
        self.datas = common.encoded(self.docs[text])
        told = _Told(right)
        #: (unit, row, first window, last window) of stretches that are repeated, and (unit, row, window, hashes) of those to sort
        known, asked = [[np.zeros(0, np.int64)] * 4], [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2]
        spoken: set[tuple[int, int]] = set()
        for u, of in enumerate(units):
            for parts, rows, begins in common.pieces(self.datas, of.depth, of.words):
                s = Stretches(parts, of)
                found = told.of(s.digit, s.rest)
                at = np.flatnonzero(found)
                if not len(at):
                    continue
                row, first, last = np.array(rows, np.int64)[s.owner[at]], s.first[at], s.last[at]
                shift = np.array(begins, np.int64)[s.owner[at]] - s.starts[s.owner[at]]
                sure = found[at] != ALONE
                ask = ~sure
                for i in np.flatnonzero(found[at] >= SPEAKER).tolist():
                    pair = (int(s.digit[at[i]]), int(s.rest[at[i]]))
                    if pair not in spoken:
                        ask[i] = found[at[i]] == SPEAKER
                        sure[i] = not keep_first
                    spoken.add(pair)
                known.append([np.full(int(sure.sum()), u), row[sure], (first + shift)[sure], (last + shift)[sure]])
                if ask.any():
                    first, size = first[ask], (last - first + 1)[ask]
                    w = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                    h1, h2 = s.one.of(w, w + of.depth), s.two.of(w, w + of.depth) & np.uint64(0xFFFFFFFF)
                    asked.append([np.full(len(w), u), np.repeat(row[ask], size), w + np.repeat(shift[ask], size), h1, h2])
        self.known = np.stack([np.concatenate(x) for x in zip(*known, strict=True)])
        self.unit, self.row, self.place, self.h1, self.h2 = (np.concatenate(x) for x in zip(*asked, strict=True))


def _ask(buckets: int, text: str, units: list[Unit], keep_first: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return common.questions(0, np.zeros(0, np.uint64), np.zeros(0, np.uint64), buckets)
        chunk = _Chunk(left, right, text, units, keep_first)
        return common.questions(left["chunk"][0].as_py(), chunk.h1, chunk.h2, buckets)

    return run


def _equal(table: pa.Table, keep_first: bool = False) -> pa.Table:
    """The last pass over one bucket: which of each chunk's windows equal another, or an earlier one where first places are kept."""

    def judge(h1: np.ndarray, h2: np.ndarray, asked: pa.Table) -> np.ndarray:
        # a chunk's questions come in the order of its rows and places
        order, new = common.groups_of(h1, h2, then=(np.repeat(asked["chunk"].to_numpy(), common.lengths(asked["a"], 8)),))
        group = np.cumsum(new) - 1
        again = np.empty(len(order), bool)
        again[order] = ~new if keep_first else np.bincount(group)[group] > 1
        return again

    return common.answered(table, judge)


def _spans(chunk: _Chunk, again: np.ndarray, u: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row to (first windows, last windows) of what is repeated in one unit."""
    known = chunk.known[1:, chunk.known[0] == u]
    mine = again & (chunk.unit == u)
    rows = np.concatenate([known[0], chunk.row[mine]])
    order = np.argsort(rows, kind="stable")
    first, last = (np.concatenate([x, chunk.place[mine]])[order] for x in known[1:])
    found, at = np.unique(rows[order], return_index=True)
    cuts = np.append(at, len(rows))
    return {row: (first[a:b], last[a:b]) for row, a, b in zip(found.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False)}


def _gone(spans: tuple[np.ndarray, np.ndarray], depth: int, n: int) -> np.ndarray:
    """Which of ``n`` bytes or words a repeated window covers."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, spans[0], 1)
    np.add.at(edges, spans[1] + depth, -1)
    return np.cumsum(edges[:-1]) > 0


def without_words(data: bytes, gone: np.ndarray) -> bytes:
    """``data`` without the words that are gone and the white space behind each."""
    starts, _ = common.word_bounds(data)
    edges = np.append(starts, len(data))
    dropped = np.zeros(len(data) + 1, np.int64)
    np.add.at(dropped, edges[:-1][gone], 1)
    np.add.at(dropped, edges[1:][gone], -1)
    return np.frombuffer(data, np.uint8)[np.cumsum(dropped[:-1]) == 0].tobytes()


_COUNTS = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_repeated_words", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())]


def _removed(buckets: int, key: str, text: str, units: list[Unit], with_kept: bool):
    """The counts of each row; the first unit is that of bytes, a second one of words is only counted."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left, right, text, units)
        again = common.answers(right, chunk.h1, buckets)
        spans = [_spans(chunk, again, u) for u in range(len(units))]
        rows = []
        for i, data in enumerate(chunk.datas):
            kept, removed, runs, words = data, 0, 0, 0
            if i in spans[0]:
                gone = _gone(spans[0][i], units[0].depth, len(data))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            if len(units) > 1 and i in spans[1]:
                words = int(_gone(spans[1][i], units[1].depth, int(spans[1][i][1].max()) + units[1].depth).sum())
            rows.append((len(data), removed, runs, words, kept if with_kept else None, hashlib.sha256(kept).hexdigest()))
        return pa.table({key: chunk.docs[key], **{n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(_COUNTS)}})

    return run


def _left(buckets: int, text: str, n_chars: str, of: Unit, kinds: dict[str, pa.DataType], keep_first: bool):
    """The rows with what is left of their texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left, right, text, [of], keep_first)
        spans = _spans(chunk, common.answers(right, chunk.h1, buckets), 0)
        texts = []
        for i, data in enumerate(chunk.datas):
            if i in spans:
                if of.words:
                    data = without_words(data, _gone(spans[i], of.depth, len(common.word_bounds(data)[0])))
                else:
                    data = np.frombuffer(data, np.uint8)[~_gone(spans[i], of.depth, len(data))].tobytes()
            texts.append(data.decode("utf-8", "ignore"))
        new = {text: pa.array(texts, pa.string()), n_chars: pa.array([len(x) for x in texts], pa.int64()).cast(kinds.get(n_chars, pa.int64()))}
        return pa.table({c: new[c] if c in new else chunk.docs[c] for c in chunk.docs.column_names})

    return run


def _repeats(df: DataFrame, text: str, units: list[Unit], finish, schema, keep_first: bool = False) -> DataFrame:
    """``finish(buckets)`` over each chunk and what is told of it."""
    docs, size = common.chunked(df, text)
    spark = df.sparkSession
    buckets = common.buckets_for(spark, size // 2)
    sent = docs.select("chunk", "docs").mapInArrow(_send(buckets, text, units), "bucket int, chunks binary, digit binary, rest binary, twice binary")
    told = common.scratch(sent.groupBy("bucket").applyInArrow(lambda table: _sorted_out(table, keep_first), _TOLD))
    asked = common.buckets_for(spark, size, 16 << 20)
    docs = docs.select("chunk", "docs")
    again = docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_ask(asked, text, units, keep_first), common.QUESTION).groupBy("bucket").applyInArrow(lambda table: _equal(table, keep_first), _ANSWERS)
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = told.select("*", null("int", "bucket"), null("binary", "bits")).unionByName(again.select("*", *(null("binary", c) for c in ("digit", "rest", "status"))))
    return docs.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish(asked), schema)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = True, depth: int = BYTES.depth, word_depth: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, n_repeated_words, kept, kept_sha256) of each row; the kept bytes are null unless asked for.

    A byte goes if it is covered by a string of ``depth`` bytes that also starts at another place, in this row or another: of copies
    none stays.  Each of repeated rows is a text of its own, and so a copy.  A null text is empty; keys may be null.  What is kept
    need not be whole UTF-8.  With a ``word_depth``, words covered by as many consecutive words that also stand elsewhere are
    counted (white space between them does not matter); they stay.
    """
    units = [unit(depth), *([unit(word_depth, words=True)] if word_depth else [])]
    rows = df.select(key, text)
    schema = rows.select(key, *(F.lit(0).cast("long").alias(c) for c, _ in _COUNTS[:4]), F.lit(None).cast("binary").alias("kept"), F.lit("").alias("kept_sha256")).schema
    return _repeats(rows, text, units, lambda asked: _removed(asked, key, text, units, with_kept), schema)


def remove_from(df: DataFrame, text: str = "text", n_chars: str = "n_chars", depth: int = BYTES.depth, words: bool = False, keep_first: bool = False) -> DataFrame:
    """``df`` with what is kept as its text and the text's length.

    With ``keep_first`` a window goes only if it also starts earlier: in a chunk of rows before, or in this one in a row before or at
    an earlier place.  Chunks are numbered by the tasks that read the rows, so for a table the first place is that in its files.

    Bytes of characters cut in two go too.  With ``words``, windows are of as many consecutive words, and with a word goes the white
    space behind it.  A null text becomes an empty one; other columns pass unchanged.
    """
    of = unit(depth, words)
    kinds = {n_chars: pa.int32()} if n_chars in df.columns and df.schema[n_chars].dataType.simpleString() == "int" else {}
    return _repeats(df, text, [of], lambda asked: _left(asked, text, n_chars, of, kinds, keep_first), df.schema, keep_first)
