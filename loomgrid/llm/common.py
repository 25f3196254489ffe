"""What the text operators share: scratch tables, word and byte hashing, packed key exchange."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20
#: Bytes of text whose bytes or words are hashed at once; the arrays take some hundred times as much.
HASHED_BYTES = 512 << 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not folder:
        known = context.getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loomgrid-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage is cut and a lost executor costs no recomputation.

    The table goes when the application ends, or earlier by ``release``.
    """
    return placed(df, compression)[0]


def placed(df: DataFrame, compression: str = "zstd") -> tuple[DataFrame, str]:
    """The same and its path, for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgrid-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    drop_on_exit(spark, path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Drop a scratch table that nothing reads any more."""
    _WRITTEN[spark.sparkContext.applicationId].remove(path)
    drop(spark, path)


_WRITTEN: dict[str, list[str]] = {}


def _place(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jpath


def drop_on_exit(spark: SparkSession, path: str) -> None:
    fs, jpath = _place(spark, path)
    fs.deleteOnExit(jpath)


def drop(spark: SparkSession, path: str) -> None:
    fs, jpath = _place(spark, path)
    fs.delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Drop all scratch tables; only for a caller whose results are all written."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        drop(spark, path)


#: The most keys that are looked up in a table sent to every task.
FREQUENT = 10_000


def look_up(rows: DataFrame, table: DataFrame, counts: DataFrame, key: str, least: int = 4096) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key of theirs.

    ``counts`` (key, n) tells how many rows have a key.  A key counts as frequent if it has over a ``FREQUENT``-th of all rows, so there are
    fewer than ``FREQUENT`` of them whatever the input; those are sent to every task, and no other key can fill one.
    """
    total = rows.count()
    frequent = counts.where(F.col("n") > max(least, total // FREQUENT)).select(key)
    frequent = scratch(table.join(frequent, key, "left_semi").withColumn("frequent", F.lit(True)))
    new = [c for c in table.columns if c != key]
    both = rows.join(F.broadcast(frequent), key, "left")
    told = both.where("frequent").select(*rows.columns, *new)
    rest = both.where("frequent is null").select(rows.columns).join(table, key).select(*rows.columns, *new)
    return told.union(rest)


# ---------------------------------------------------------------- Arrow slices


def trim() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column holds about ``limit`` bytes at most; a longer value stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, sizes
        trim()


#: Rows of an Arrow batch whose rows are whole sets of shingles, some 4 KB each and 160 KB for a text of 20,000 words.
SHORT_BATCH = 256


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = SHORT_BATCH) -> Iterator[None]:
    """What is written inside goes to Python in batches of few rows: both sides hold a batch whole, whatever its rows weigh."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def encoded(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- hashing

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte value, by a fixed rule.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
#: Others, for a second hash.
OTHER_VALUES = mixed(BYTE_VALUES + _ODD2)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for later calls."""
    key = int(base)
    have = _POWERS.get(key)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        inverse = np.uint64(pow(key, -1, 1 << 64))
        up, down = np.full(m, base, np.uint64), np.full(m, inverse, np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if m <= 1 << 21:
            _POWERS[key] = have
    return have[0][:n], have[1][:n]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, by differences of prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray, base: np.uint64 = _ODD) -> None:
        n = len(values)
        self.up, self.down = _powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, length: int) -> np.ndarray:
        return mixed(self.unmixed(length))

    def unmixed(self, length: int) -> np.ndarray:
        """The same, equal for equal windows but with less random bits, the upper ones most."""
        n = len(self.sums) - 1 - length + 1
        return (self.sums[length:] - self.sums[:-length]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def both(values: np.ndarray, others: np.ndarray | None = None) -> tuple[Rolling, Rolling]:
    """Two independent rolling hashes, 128 bits together; the second of ``others`` where each item has two values."""
    return Rolling(values), Rolling(mixed(values + _ODD2) if others is None else others, _ODD2)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


# ---------------------------------------------------------------- packed exchange


def packed(bucket: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, each column's values as bytes) for the buckets that have rows; order within a bucket is kept."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=parts))
    start = 0
    columns = [x[order] for x in columns]
    for b, end in enumerate(ends.tolist()):
        if end > start:
            yield b, [x[start:end].tobytes() for x in columns]
        start = end


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """All values of the column's byte strings as one array."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def lengths(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.array([len(x) // width if x else 0 for x in column.to_pylist()], np.int64)


def buckets_for(spark: SparkSession, total_bytes: int, bytes_per_bucket: int = 8 << 20) -> int:
    """As many buckets as keep one within a task's memory, and at least one for each shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // bytes_per_bucket), 1)


# ---------------------------------------------------------------- chunks of rows

CHUNK_BYTES = 4 << 20


def chunked(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """((chunk, docs, size) in the shared folder, bytes of all texts).

    A task puts its rows, whatever their keys, into chunks of about ``CHUNK_BYTES`` of text (a longer text is a chunk), each a compressed
    Arrow stream of whole rows with a number of its own.  So no chunk grows with a key's or a null's share of the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for x in held:
                    writer.write_batch(x)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([size], pa.int64())], names=["chunk", "docs", "size"])

        for batch in slices(batches, text, CHUNK_BYTES // 4):
            n = pc.sum(pc.fill_null(pc.binary_length(batch.column(text)), 0)).as_py() or 0
            if held and size + n > CHUNK_BYTES:
                yield full()
                held.clear()
                size = 0
            held.append(batch)
            size += n
        if held:
            yield full()

    docs = scratch(df.mapInArrow(run, "chunk long, docs binary, size long"), "none")
    return docs, int(docs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])


def unbundled(docs: bytes) -> pa.Table:
    """The rows of a chunk."""
    trim()
    return pa.ipc.open_stream(docs).read_all()


def keys_of(column: pa.ChunkedArray) -> np.ndarray:
    """The keys as 64-bit integers; null as the largest."""
    return np.array([_LAST_KEY if x is None else int(x) for x in column.to_pylist()], np.int64)


_LAST_KEY = (1 << 63) - 1

#: A word of more bytes is hashed by XXH3 of 128 bits: powers modulo 2**64 tell some long words badly apart.
LONG_WORD = 64


class Texts:
    """Several byte strings side by side: which one each byte or word is of, and where in it."""

    def __init__(self, datas: list[bytes]) -> None:
        self.data = b"\n".join(datas)
        sizes = np.fromiter(map(len, datas), np.int64, len(datas))
        self.sizes = sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(datas)].astype(np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(64 bits of each word, 64 others, the text it is of, its place there, words of each text)."""
        if not self.data:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.sizes), np.int64)
        raw = np.frombuffer(self.data, np.uint8)
        starts, ends = _edges(raw)
        sizes = (ends - starts).astype(np.uint64)
        one, two = (mixed(x.of(starts, ends) + sizes) for x in both(BYTE_VALUES[raw], OTHER_VALUES[raw]))
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            one[i], two[i] = np.frombuffer(_xxh128(self.data[starts[i] : ends[i]]), np.uint64)
        owner = np.searchsorted(self.starts, starts, side="right") - 1
        counts = np.bincount(owner, minlength=len(self.sizes)).astype(np.int64)
        return one, two, owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner], counts


def _xxh128(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(data)


def _edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_bounds(data: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends, found block by block."""
    starts, ends, raw, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.frombuffer(data, np.uint8), 0
    while at < len(raw):
        a, b = _edges(raw[at : at + block])
        if len(b) and at and b[0] and a[0] == 0 and not _SPACE[raw[at - 1]]:  # a word that goes on from the block before
            ends[-1] = ends[-1][:-1]
            a = a[1:]
        starts.append(a + at)
        ends.append(b + at)
        at += block
    return np.concatenate(starts), np.concatenate(ends)


def pieces(datas: list[bytes], window: int, by_words: bool, limit: int = HASHED_BYTES) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """(pieces, the text of each, the place where each begins) in groups of about ``limit`` bytes.

    A text is one piece; one beyond the limit is several, which overlap so that each window of ``window`` bytes or words lies whole in
    the one where it starts, and in no other.
    """
    group: tuple[list[bytes], list[int], list[int]] = ([], [], [])
    size = 0
    for i, data in enumerate(datas):
        if len(data) <= limit:
            cut = [(data, 0)]
        elif by_words:
            starts, ends = word_bounds(data)
            step = max(1, limit * len(starts) // len(data))
            cut = ((data[starts[a] : ends[min(len(ends), a + step + window - 1) - 1]], a) for a in range(0, max(1, len(starts) - window + 1), step)) if len(starts) else [(b"", 0)]
        else:
            cut = ((data[a : a + limit + window - 1], a) for a in range(0, max(1, len(data) - window + 1), limit))
        for part, at in cut:
            if size and size + len(part) > limit:
                yield group
                group, size = ([], [], []), 0
            for held, x in zip(group, (part, i, at), strict=True):
                held.append(x)
            size += len(part)
    if group[0]:
        yield group


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values


def spread(marks: np.ndarray, before: int, after: int, size: int) -> np.ndarray:
    """Positions within ``before`` ahead of a mark to ``after`` behind it, as booleans."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, np.maximum(marks - before, 0), 1)
    np.add.at(edges, np.minimum(marks + after, size), -1)
    return np.cumsum(edges[:-1]) > 0


# ---------------------------------------------------------------- questions by chunk

#: A window's 96 bits: 64 of one hash and 32 of another.  Among 10**13 windows two different ones meet with a chance below one in a hundred.
QUESTION = "bucket int, chunk long, a binary, b binary"


def questions(chunk: int, h1: np.ndarray, h2: np.ndarray, buckets: int, **more: np.ndarray) -> pa.Table:
    """A row for each bucket; ``more`` are further columns of the questions."""
    columns = {"a": h1, "b": h2.astype(np.uint32), **more}
    rows = [(b, chunk, *x) for b, x in packed((h1 % np.uint64(buckets)).astype(np.int64), buckets, *columns.values())]
    kinds = (pa.int32(), pa.int64(), *(pa.binary() for _ in columns))
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("bucket", "chunk", *columns), kinds, strict=True))})


def answered(table: pa.Table, judge) -> pa.Table:
    """(chunk, bucket, bits) of one bucket's questions: ``judge`` gets (h1, h2, the table) of all and returns booleans."""
    h1, h2 = joined(table["a"], np.uint64), joined(table["b"], np.uint32)
    sizes = lengths(table["a"], 8)
    chunks = table["chunk"].to_numpy()
    yes = judge(h1, h2, table)
    ends = np.cumsum(sizes)
    rows = [(c, table["bucket"][0].as_py(), np.packbits(yes[a:b]).tobytes()) for c, a, b in zip(chunks.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True) if yes[a:b].any()]
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "bits": pa.array([r[2] for r in rows], pa.binary())})


def answers(right: pa.Table, h1: np.ndarray, buckets: int) -> np.ndarray:
    """The booleans for a chunk's questions, in their order."""
    yes = np.zeros(len(h1), bool)
    told = {b: x for b, x in zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), strict=True) if b is not None}
    if told and len(h1):
        for b, (at,) in packed((h1 % np.uint64(buckets)).astype(np.int64), buckets, np.arange(len(h1))):
            if b in told:
                where = np.frombuffer(at, np.int64)
                yes[where] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=len(where)).astype(bool)
    return yes


def groups_of(*keys: np.ndarray, then: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts by the keys, the first most significant, then by ``then``; whether each in that order differs from the one before by a key)."""
    order = np.lexsort((*then[::-1], *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def asked_in_parts(datas: list, limit: int = HASHED_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the texts with about ``limit`` characters each."""
    start, size = 0, 0
    for i, x in enumerate(datas):
        if size and size + len(x or "") > limit:
            yield start, i
            start, size = i, 0
        size += len(x or "")
    if start < len(datas):
        yield start, len(datas)
