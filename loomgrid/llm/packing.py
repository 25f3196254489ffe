"""Best-fit packing by large-item matching, decided on the counts of each length.

Texts become token ids; a document longer than a sequence is cut, its first piece taking the remainder.  Only the number of
pieces of each length (at most one count for each possible length) reaches the driver.  There pieces above a third of the
capacity are matched, longest first with the longest partner that fits, at most two to a sequence; shorter ones then go, by
length, where they leave the least gap.  The plan is a list of runs: so many pieces of one length go to so many sequences at
one offset.  Each piece finds its place from its rank among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm import bpe, common

CAPACITY = 1024
END_ID = 2
#: Rows of one length are ranked in so many parts at least, so that a length with most of the rows isn't one task's.
SALTS = 64
#: How a byte-level pre-tokenizer with its own expression splits.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str | None, tuple] = {}


def tokenizer(path: str | None = None):
    """The tokenizer of a local file, special tokens' strings taken as ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible bytes stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked_vocabulary(found) -> dict[bytes, int] | None:
    """Byte strings by id of a byte-level tokenizer that splits by ``BYTE_LEVEL`` and whose ids follow its merges; None for any other.

    Merging by lowest id then gives what merging by the list gives, which a faster library does.
    """
    import json

    model = json.loads(found.to_str())
    split, kind = model.get("pre_tokenizer") or {}, model["model"]
    if kind["type"] != "BPE" or kind.get("ignore_merges") or kind.get("dropout") or kind.get("continuing_subword_prefix") or kind.get("end_of_word_suffix"):
        return None
    if model.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    special = {t["content"] for t in model.get("added_tokens", [])}
    vocabulary, stand = model["model"]["vocab"], _byte_characters()
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["model"]["merges"]]
    if None in merged or merged != sorted(merged) or len(set(merged)) != len(merged):
        return None
    return {bytes(stand[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, as the tokenizer of a local file gives them without special tokens.

    A byte-level tokenizer whose ids follow its merges is run by the rank library on its own vocabulary, which gives the same ids
    in a third of the time; any other by itself.
    """

    def __init__(self, path: str | None = None) -> None:
        import tiktoken

        if path not in _LOADED:  # a worker loads each file once and keeps one of the two
            found = tokenizer(path)
            ranks = ranked_vocabulary(found)
            _LOADED[path] = (None, found) if ranks is None else (tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}), None)
        self.ranked, self.tokenizer = _LOADED[path]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.ranked is not None:
            return [np.array(bpe.ids_of(self.ranked, t), "<u4").tobytes() for t in texts]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each row's ids and the end id, and the ids themselves if asked for.

    A null text is empty: its one piece is the end id.  Each of repeated rows has pieces of its own.
    """
    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in common.slices(batches, text, 2 << 20):
            rows, at = [], []
            for i, ids in enumerate(encode([x or "" for x in batch.column(text).to_pylist()])):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                start = 0
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    part = ids[4 * start : 4 * stop]
                    rows.append((k, start, stop - start, zlib.crc32(part), part))
                    at.append(i)
                    start = stop
            columns = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3))]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[4], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *columns], names=names)

    rows = df.select(key, text)
    long = F.lit(0).cast("long")
    schema = rows.select(key, F.lit(0).alias("piece"), long.alias("start"), long.alias("length"), long.alias("ids_crc32"), *([F.array().cast("array<int>").alias("ids")] if with_ids else [])).schema
    return rows.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(runs, sequences).  A run is (length, first rank, pieces, first sequence, pieces a sequence, offset of its first)."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    #: gap to the runs of sequences that have it, as (first sequence, sequences)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def put(length: int, number: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], number, first, each, offset))
        used[length] += number
        left[length] -= number

    def opened(gap: int, first: int, number: int) -> None:
        if gap > 0 and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, number))

    third = capacity // 3
    for length in sorted((n for n in left if n > third), reverse=True):
        while left[length]:
            partner = next((n for n in range(min(length, capacity - length), third, -1) if left.get(n, 0) and (n != length or left[n] > 1)), None)
            number = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, number, sequences, 1, 0)
            if partner is not None:
                put(partner, number, sequences, 1, length)
            opened(capacity - length - (partner or 0), sequences, number)
            sequences += number
    for length in sorted((n for n in left if n <= third), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                number = -(-left[length] // each)
                opened(capacity, sequences, number)
                sequences += number
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // length
            full = min(number, left[length] // each)
            if full:
                put(length, full * each, first, each, capacity - gap)
                opened(gap - each * length, first, full)
            first, number, rest = first + full, number - full, left[length]
            if number and rest < each:
                if rest:
                    put(length, rest, first, rest, capacity - gap)
                    opened(gap - rest * length, first, 1)
                    first, number = first + 1, number - 1
                opened(gap, first, number)
    return runs, sequences


def ranked(df: DataFrame, by: str, order: list[str], salts: int = SALTS) -> DataFrame:
    """``df`` with ``rank``, from 0 without gaps within each value of ``by``.

    Rows are numbered within ``salts`` parts of each value; the parts' counts, at most values times ``salts`` rows, give each its start.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inner = Window.partitionBy(by, "_salt").orderBy(*order)
    numbered = salted.withColumn("_nth", F.row_number().over(inner) - 1)
    parts = salted.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return numbered.join(starts, [by, "_salt"]).withColumn("rank", F.col("_start") + F.col("_nth")).drop("_salt", "_nth", "_start")


def pack(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (as ``pieces`` gives it, written or checkpointed) with sequence_id and offset.

    Sequences are filled from 0 without gaps and never over the capacity.  No pieces give no rows.
    """
    spark = cut.sparkSession
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each possible length at most
    runs, _ = plan(counts, capacity)
    by_length: dict[int, list] = {}
    for length, rank, number, first, each, offset in runs:
        by_length.setdefault(length, []).append((rank, number, first, each, offset))
    table = spark.createDataFrame([(n, sorted(r)) for n, r in by_length.items()], "length long, runs array<struct<rank:long,number:long,first:long,each:long,offset:long>>")
    placed = ranked(cut, "length", [key, "piece"], salts).join(F.broadcast(table), "length")  # one row for each possible length at most
    run = F.expr("filter(runs, r -> r.rank <= rank and rank < r.rank + r.number)[0]")
    placed = placed.withColumn("_run", run).withColumn("_at", F.col("rank") - F.col("_run.rank"))
    return placed.withColumns({
        "sequence_id": F.col("_run.first") + F.floor(F.col("_at") / F.col("_run.each")).cast("long"),
        "offset": F.col("_run.offset") + F.pmod(F.col("_at"), F.col("_run.each")) * F.col("length"),
    }).drop("runs", "rank", "_run", "_at")


def best_fit(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows with their places.  They are written to the shared folder first, so texts are encoded once."""
    return pack(common.scratch(pieces(df, key, text, capacity, end_id, path, with_ids)), key, capacity)
