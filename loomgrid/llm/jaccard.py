"""Near duplicates by the Jaccard similarity of their sets of word shingles.

Candidates are texts that share one of ``BANDS`` keys, each a hash of ``ROWS`` minima of the set under fixed random orders: two
sets of similarity s share one with the chance 1 - (1 - s**5)**20, 0.9996 at 0.8.  Whatever shares a key is compared where the
key's sets meet, on the whole sets, unless links found there connect it already.

A key with more sets than one task should hold is worked on in parts.  All its sets are compared with its first one; what is near
that is connected.  The rest meet every part of the key's sets, block by block, and distances to the first set discard pairs by
the triangle inequality; so no link is lost whatever a key holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common

BANDS, ROWS = 20, 5
_FLIPS = common.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_TIMES = common.mixed(_FLIPS) | np.uint64(1)
_PLACES = common.mixed(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
_NUMBERS = common.mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(datas: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's set of ``width``-word shingles as sorted hashes; a shorter text is one shingle, one without words has none."""
    one, two, _, _, counts = common.Texts([x.translate(_LOWER) for x in datas]).words()
    rolling = common.Rolling(one ^ common.mixed(two))
    ends = np.cumsum(counts)
    starts = ends - counts
    windows = rolling.windows(width)
    return [
        np.unique(windows[a : b - width + 1]) if b - a >= width else common.mixed(rolling.of(np.array([a]), np.array([b])) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
    ]


#: What stands for the empty set.
EMPTY = bytes(16)


def digest(held: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    import xxhash

    return xxhash.xxh3_128_digest(held) if len(held) else EMPTY


def minima(held: np.ndarray) -> np.ndarray:
    """The set's least element under each of ``BANDS * ROWS`` orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 4096):
        least = np.minimum(least, ((held[at : at + 4096, None] ^ _FLIPS) * _TIMES).min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The keys of a set with those minima."""
    return common.mixed((common.mixed(least).reshape(BANDS, ROWS) * _PLACES).sum(axis=1, dtype=np.uint64) ^ _NUMBERS)


def _sets(batch: pa.RecordBatch, text: str, width: int) -> Iterator[np.ndarray]:
    """The set of each row, in the batch's order."""
    datas = common.encoded(batch.column(text))
    for a, b in common.asked_in_parts(datas):
        yield from shingles(datas[a:b], width)


def fingerprints(rows: DataFrame, text: str, width: int, with_bands: bool = False, with_set: bool = False, sketch: Callable[[np.ndarray], bytes] | None = None, number: Callable[[bytes], int] | None = None) -> DataFrame:
    """``rows`` without the text, with the digest ``fp`` of each row's set, and its keys, size and sketch or the set itself where asked.

    ``number`` gives an unsigned 64-bit number of each text, ``sim``: one pass over the texts, and one worker, for both.
    """
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            fps, keys, sizes, sketches, whole = [], [], [], [], []
            for held in _sets(batch, text, width):
                fps.append(digest(held))
                if with_bands:
                    least = minima(held)
                    keys.append(bands(least).view(np.int64) if len(held) else None)
                    sizes.append(len(held))
                    sketches.append(sketch(least) if sketch else b"")
                if with_set:
                    whole.append(held.tobytes())
            more = [pa.array(fps, pa.binary())]
            more += [pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())] if with_bands else []
            more += [pa.array(whole, pa.binary())] if with_set else []
            more += [pa.array(np.array([number(x) for x in common.encoded(batch.column(text))], np.uint64).view(np.int64))] if number else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=names)

    added = [F.lit(b"").alias("fp")]
    added += [F.lit(None).cast("array<long>").alias("bands"), F.lit(0).cast("long").alias("size"), F.lit(b"").alias("sketch")] if with_bands else []
    added += [F.lit(b"").alias("held")] if with_set else []
    added += [F.lit(0).cast("long").alias("sim")] if number else []
    out = rows.select(*kept, *added)
    names = out.columns
    return rows.mapInArrow(run, out.schema)


class _Roots:
    """Which of n things are connected."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def of(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.of(a), self.of(b)
        self.parent[b] = a
        return a != b


def similar(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the others, none of them empty, have at least that Jaccard similarity with one set."""
    sizes = np.array([len(x) for x in others])
    found = np.zeros(len(others), bool)
    for at in range(0, len(others), 512):
        part = sizes[at : at + 512]
        same = np.add.reduceat(common.member(np.concatenate(others[at : at + 512]), one).astype(np.int64), np.cumsum(part) - part)
        found[at : at + 512] = same >= similarity * (part + len(one) - same) - 1e-9
    return found


def _like(sizes: np.ndarray, size: int, similarity: float) -> np.ndarray:
    """Sets of which sizes can be that similar to one of ``size``."""
    return np.minimum(sizes, size) >= similarity * np.maximum(sizes, size) - 1e-9


def apart(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many bits each sketch differs from one; rows of 64-bit words, none where there are no sketches."""
    return np.bitwise_count(sketches ^ one).sum(axis=1, dtype=np.int64)


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1) if sketches else np.zeros((0, 0), np.uint64)


def links(sets: list[np.ndarray], similarity: float, sketches: np.ndarray | None = None, most: int = 0) -> list[tuple[int, int]]:
    """Places of sets whose links connect all that pairs of at least that similarity connect: one fewer than sets at most.

    Pairs whose sketches differ in over ``most`` bits are not compared.
    """
    n, roots, found = len(sets), _Roots(len(sets)), []
    sizes = np.array([len(x) for x in sets])
    group = np.arange(n)  # each set's root
    for i in range(n - 1):
        left = np.flatnonzero((group[i + 1 :] != group[i]) & _like(sizes[i + 1 :], sizes[i], similarity)) + i + 1
        if sketches is not None and len(left):
            left = left[apart(sketches[left], sketches[i]) <= most]
        if not len(left):
            continue
        for j in left[similar(sets[i], [sets[j] for j in left], similarity)].tolist():
            if roots.join(i, j):
                group[group == group[j]] = roots.of(i)
                group[i] = roots.of(i)
                found.append((i, j))
    return found


#: The most sets, and bytes of them, of one key that one task holds.
CAP_SETS, CAP_BYTES = 1024, 16 << 20
#: Parts of a large key's rows where each meets the key's first set.
SALTS = 64


def _linked(keyed: DataFrame, similarity: float, cap_bytes: int, most: int | None) -> DataFrame:
    """(a, b, hot) of each key's links, from (band, fp, sketch, held); (null, null, key) for a key with larger sets than one task should hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fps, sets, sketches, size = None, [], [], [], 0

        def out(a: list[bytes | None], b: list[bytes | None], hot: list[int | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(hot, pa.int64())], names=["a", "b", "hot"])

        def finished() -> Iterator[pa.RecordBatch]:
            if size < 0:
                yield out([None], [None], [at])
                return
            told = None if most is None else unpacked(sketches)
            pairs = links(sets, similarity, told, most or 0) if len(sets) > 1 else []
            if pairs:
                yield out([fps[i] for i, _ in pairs], [fps[j] for _, j in pairs], [None] * len(pairs))

        for batch in batches:
            common.trim()
            for band, fp, sketch, held in zip(batch.column("band").to_pylist(), batch.column("fp").to_pylist(), batch.column("sketch").to_pylist(), batch.column("held"), strict=True):
                if band != at:
                    yield from finished()
                    at, fps, sets, sketches, size = band, [], [], [], 0
                if size < 0:
                    continue
                held = np.frombuffer(held.as_py(), np.uint64)
                fps.append(fp)
                sets.append(held)
                sketches.append(sketch)
                size += held.nbytes
                if size > cap_bytes and len(sets) > 1:
                    fps, sets, sketches, size = [], [], [], -1
        yield from finished()

    return keyed.repartition("band").sortWithinPartitions("band", "fp").mapInArrow(run, "a binary, b binary, hot long")


def _large(keyed: DataFrame, similarity: float, cap_bytes: int, most: int | None) -> DataFrame:
    """(a, b): links that connect what the links within each of some large keys (band, fp, sketch, held) connect."""
    first = keyed.groupBy("band").agg(F.min("fp").alias("fp"))
    lead = keyed.join(first, ["band", "fp"]).select("band", F.col("fp").alias("lead"), F.col("held").alias("lead_held"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = keyed.withColumn("salt", F.expr(f"cast(pmod(xxhash64(fp), {SALTS}) as int)")).join(lead, ["band", "salt"])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = []
            for x, y in zip(batch.column("held"), batch.column("lead_held"), strict=True):
                one, two = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                same = int(common.member(one, two).sum())
                far.append(1 - same / (len(one) + len(two) - same))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("band", "fp", "sketch", "held", "lead")), pa.array(far, pa.float64())], names=["band", "fp", "sketch", "held", "lead", "far"])

    with common.short_batches(keyed.sparkSession):
        rows = common.scratch(met.select("band", "fp", "sketch", "held", "lead", "lead_held").mapInArrow(distances, "band long, fp binary, sketch binary, held binary, lead binary, far double"))
    bar = 1 - similarity + 1e-9
    aside = F.col("far") > bar
    size = F.octet_length("held")
    parts = rows.groupBy("band").agg(F.sum(size).alias("all"), F.sum(F.when(aside, size)).alias("rest")).where("rest is not null")
    parts = common.scratch(parts.select("band", *(F.ceil(F.col(c) / cap_bytes).cast("int").alias(c) for c in ("all", "rest"))))
    number = lambda c: F.expr(f"cast(pmod(xxhash64(fp, '{c}'), `{c}`) as int)")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    whole = rows.join(parts, "band").select("band", "fp", "sketch", "held", "far", number("all").alias("part"), every("rest").alias("block"))
    rest = rows.where(aside).join(parts, "band").select("band", "fp", "sketch", "held", "far", number("rest").alias("block"), every("all").alias("part"))
    rest = rest.select(*(F.col(c).alias(f"rest_{c}") for c in rest.columns))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        fps, far, sets, sketches = [], [], [], []
        for table, prefix in ((right, "rest_"), (left, "")):
            fps += table[f"{prefix}fp"].to_pylist()
            far += table[f"{prefix}far"].to_pylist()
            sets += [np.frombuffer(x, np.uint64) for x in table[f"{prefix}held"].to_pylist()]
            sketches += table[f"{prefix}sketch"].to_pylist()
        n, roots, found = right.num_rows, _Roots(len(fps)), []
        far, sizes, names = np.array(far), np.array([len(x) for x in sets]), np.array(fps, object)
        told = unpacked(sketches)
        near = np.flatnonzero((far <= bar) & (np.arange(len(far)) >= n)).tolist()
        for a, b in zip(near, near[1:], strict=False):
            roots.join(a, b)  # all are linked with the key's first
        for i in range(n):
            left_over = np.flatnonzero((np.abs(far - far[i]) <= bar) & _like(sizes, sizes[i], similarity) & (names != names[i]))
            if most is not None:
                left_over = left_over[apart(told[left_over], told[i]) <= most]
            mine = roots.of(i)
            left_over = np.array([j for j in left_over.tolist() if roots.of(j) != mine], np.int64)
            if len(left_over):
                for j in left_over[similar(sets[i], [sets[j] for j in left_over], similarity)].tolist():
                    if roots.join(i, j):
                        found.append((fps[i], fps[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    keys = ["band", "part", "block"]
    more = whole.groupBy(*keys).cogroup(rest.groupBy(*(f"rest_{k}" for k in keys))).applyInArrow(meet, "a binary, b binary")
    return rows.where(~aside & (F.col("fp") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("fp").alias("b")).union(more)


def _met(keyed: DataFrame) -> DataFrame:
    """The rows (band, fp) of keys that more than one set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, False  # the row before, and whether it is known to share its key
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch.cast(last.schema)]).combine_chunks().to_batches()[0]
            keys = batch.column("band").to_numpy()
            same = keys[1:] == keys[:-1]
            told = np.zeros(len(keys), bool)
            told[1:] |= same
            told[:-1] |= same
            told[0] |= held
            last, held = batch.slice(len(keys) - 1), bool(told[-1])
            yield batch.slice(0, len(keys) - 1).filter(pa.array(told[:-1]))
        if last is not None and held:
            yield last

    return keyed.repartition("band").sortWithinPartitions("band").mapInArrow(run, keyed.schema)


def _near(met: DataFrame, similarity: float, most: int) -> DataFrame:
    """Of the rows (band, fp, size, sketch) of keys that several sets have, those with another of their key whose sketch and size are near theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sketches, sizes = unpacked(rows.column("sketch").to_pylist()), rows.column("size").to_numpy()
            near = np.zeros(len(sizes), bool)
            for i in range(len(sizes) - 1):
                at = np.flatnonzero(_like(sizes[i + 1 :], sizes[i], similarity)) + i + 1
                at = at[~(near[at] & near[i])]
                at = at[apart(sketches[at], sketches[i]) <= most]
                near[at] = True
                near[i] |= len(at) > 0
            yield rows.filter(pa.array(near))

        last = None
        for batch in batches:
            keys = batch.column("band").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != last:
                    yield from told()
                    held, last = [], keys[a]
                held.append(batch.slice(a, b - a))
        yield from told()

    return met.repartition("band").sortWithinPartitions("band", "fp").mapInArrow(run, met.schema)


def edges(df: DataFrame, distinct: DataFrame, key: str, text: str, width: int, similarity: float, cap_sets: int = CAP_SETS, cap_bytes: int = CAP_BYTES, most: int | None = None) -> DataFrame:
    """(a, b): links between the digests of ``distinct`` (fp, first, bands, size, sketch), whose texts are those of ``df``.

    Where ``most`` is given, a pair is compared only if its sketches differ in at most as many bits, and sets without such a partner
    under a key are not sent there.
    """
    banded = common.scratch(distinct.select(F.explode("bands").alias("band"), "fp", "size", "sketch"))
    # counted before any key's rows meet: those of a key with many sets never go to one task
    many = common.scratch(banded.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > cap_sets).select("band"))
    crowded = not many.isEmpty()
    met = _met(banded.join(many, "band", "left_anti") if crowded else banded)
    met = common.scratch(met if most is None else _near(met, similarity, most))
    both = met.union(banded.join(many, "band", "left_semi")) if crowded else met
    wanted = common.scratch(distinct.select("fp", "first").join(both.select("fp").distinct(), "fp", "left_semi"))
    rows = df.select(F.col(key).alias("first"), F.col(text).alias("text"))
    rows = rows.where("first is not null").join(wanted.select("first").distinct(), "first", "left_semi").union(rows.where("first is null"))
    sets = fingerprints(rows.select("text"), "text", width, with_set=True).join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])
    if crowded:  # read twice
        sets = common.scratch(sets)
    keyed = met.join(sets, "fp").select("band", "fp", "sketch", "held")
    with common.short_batches(df.sparkSession):
        found = common.scratch(_linked(keyed, similarity, cap_bytes, most))
    edges = found.where("hot is null").select("a", "b")
    large = found.where("hot is not null").select(F.col("hot").alias("band"))
    groups = [] if large.isEmpty() else [met.join(large, "band", "left_semi")]
    groups += [banded.join(many, "band", "left_semi")] if crowded else []
    for rows in groups:
        edges = edges.union(_large(common.scratch(rows.join(sets, "fp").select("band", "fp", "sketch", "held")), similarity, cap_bytes, most))
    return edges
