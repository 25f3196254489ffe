"""SimHash near-duplicates within three bits, by pivot distance tables.

Fingerprints become distinct first, so exact copies cost one row.  Two that differ in at most three bits agree on three whole
blocks of six, which gives each fingerprint twenty keys; those that share a key meet.  There a table of Hamming distances to
reference fingerprints, computed once, discards pairs whose coordinates differ by more than three anywhere (the triangle
inequality), and only survivors are compared bit by bit.  A key with more than ``CAP`` fingerprints is dealt again by finer
keys: all but three of sixteen blocks, whose groups cannot exceed 4096.  Links become components by repeated star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm import common, jaccard

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: The most fingerprints of one key that are compared in one place; a group of the finer keys cannot have more.
CAP = 4096
#: Reference fingerprints, by a fixed rule.
PIVOTS = common.mixed(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(data: bytes) -> int:
    """The fingerprint of one text's UTF-8 bytes: a bit is set if it is in over half of the shingles' XXH64."""
    import xxhash

    words = data.translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = np.array([digest(b" ".join(words), SEED)], np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of each row, the 64 bits as a signed long; a text without words, or null, has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            fps = np.array([fingerprint(x) for x in common.encoded(batch.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fps)], names=[key, "fp"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, rows.select(key, F.lit(0).cast("long").alias("fp")).schema)


def _masks(blocks: int, kept: int) -> np.ndarray:
    """A mask for each choice of ``kept`` of ``blocks`` nearly equal blocks of the 64 bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return np.array([sum(parts[i] for i in choice) for choice in combinations(range(blocks), kept)], np.uint64)


COARSE, FINE = _masks(6, 3), _masks(16, 13)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what distinct fingerprints' links within ``distance`` connect: at most one fewer than fingerprints.

    Row by row against the later ones: the pivot table discards by the largest coordinate difference, coordinate after coordinate on
    what is left; survivors are verified.
    """
    n = len(fps)
    if n < 2:
        return []
    table = pivot_table(fps)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i in range(n - 1):
        left = np.arange(i + 1, n)
        for k in range(table.shape[1]):
            left = left[np.abs(table[left, k] - table[i, k]) <= distance]
            if len(left) < 16:
                break
        left = left[np.abs(table[left] - table[i]).max(axis=1) <= distance] if len(left) else left
        for j in left[np.bitwise_count(fps[left] ^ fps[i]) <= distance].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                found.append((int(fps[i]), int(fps[j])))
    return found


def _keyed(distinct: DataFrame, masks: np.ndarray) -> DataFrame:
    """(mask number, masked bits, fp): a row for each fingerprint and mask."""
    table = F.array(*(F.lit(int(m)) for m in masks.view(np.int64)))
    rows = distinct.select("fp", F.posexplode(table).alias("m", "mask"))
    return rows.select("m", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")


def _linked(keyed: DataFrame, cap: int) -> DataFrame:
    """(a, b, hot) from the rows of each key: links between fingerprints, or (fp, null, true) for those of a key with more than ``cap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        at, over = None, False

        def out(a: list[int], b: list[int] | None) -> pa.RecordBatch:
            first = np.array(a, np.uint64).view(np.int64)
            second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.array(b, np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(first), second, pa.array([b is None] * len(a))], names=["a", "b", "hot"])

        def finished() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and not over:
                pairs = links(np.array(held, np.uint64))
                if pairs:
                    yield out([p[0] for p in pairs], [p[1] for p in pairs])

        for batch in batches:
            m, bits = (batch.column(c).to_numpy() for c in ("m", "bits"))
            fps = batch.column("fp").to_numpy().view(np.uint64)
            edges = np.flatnonzero((np.diff(m) != 0) | (np.diff(bits) != 0)) + 1
            single: list[tuple[int, int]] = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(fps)], strict=True):
                if hi == lo:
                    continue
                key = (int(m[lo]), int(bits[lo]))
                if key != at:
                    yield from finished()
                    held, at, over = [], key, False
                    if hi - lo == 1 and hi < len(fps):
                        continue
                    if hi - lo == 2 and hi < len(fps):
                        single.append((lo, lo + 1))
                        continue
                part = fps[lo:hi].tolist()
                if over:
                    yield out(part, None)
                elif len(held) + len(part) > cap:
                    yield out(held + part, None)
                    held, over = [], True
                else:
                    held += part
            if single:
                i, j = np.array(single).T
                near = np.abs(pivot_table(fps[i]) - pivot_table(fps[j])).max(axis=1) <= DISTANCE
                i, j = i[near], j[near]
                near = np.bitwise_count(fps[i] ^ fps[j]) <= DISTANCE
                if near.any():
                    yield out(fps[i[near]].tolist(), fps[j[near]].tolist())
        yield from finished()

    return keyed.repartition("m", "bits").sortWithinPartitions("m", "bits", "fp").mapInArrow(run, "a long, b long, hot boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the least node that it reaches.

    Large-star and small-star steps in turn until nothing changes: each links a node's neighbours to the least of them, so
    the edges of a component become a star around its least node in a number of rounds that grows with the logarithm of
    its size.  Each round is written to the shared folder and the one before dropped; the driver sees two numbers.
    """

    def smaller(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now, path = common.placed(smaller(edges))
    seen = state(now)
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = smaller(large)
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        before, (now, path) = path, common.placed(smaller(small))
        common.discard(edges.sparkSession, before)
        after = state(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _edges(distinct: DataFrame, cap: int) -> DataFrame:
    """(a, b): links that connect what links within three bits connect among ``distinct`` fingerprints (fp)."""
    first = common.scratch(_linked(_keyed(distinct, COARSE), cap))
    hot = first.where("hot").select(F.col("a").alias("fp")).distinct()
    return first.where("not hot").select("a", "b").union(_linked(_keyed(hot, FINE), CAP).select("a", "b"))


def _groups(df: DataFrame, key: str, text: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """((key, fp) of each row, (fp, root, component_id) of each fingerprint), written to the shared folder as far as they are read again."""
    rows = common.scratch(fingerprints(df, key, text))
    distinct = common.scratch(rows.groupBy("fp").agg(F.min(key).alias("first")))
    edges = _edges(distinct, cap)
    return rows, _named(distinct, edges)


def _named(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each of ``distinct`` (fp, first) by its links."""
    roots = components(edges)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(distinct["fp"], "first", F.coalesce("root", distinct["fp"]).alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def _with_fingerprint(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sim``, each text's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            fps = np.array([fingerprint(x) for x in common.encoded(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "sim"])

    return rows.mapInArrow(run, rows.select("*", F.lit(0).cast("long").alias("sim")).schema)


def _confirmed(rows: DataFrame, distinct: DataFrame, similarity: float, shingle: int, cap: int = CAP) -> DataFrame:
    """(a, b): digests of ``distinct`` (fp, first, bands, sim) by fingerprints within three bits, confirmed on the whole sets.

    ``rows`` has the texts (key, text).  Of the sets of one fingerprint each is held against one of them, which also stands for them in
    links to other fingerprints.  Pairs with a min-hash key in common are compared under that key and left out here.
    """
    sims = distinct.where("bands is not null").select("fp", "sim", "bands")
    one = common.scratch(sims.groupBy("sim").agg(F.min(F.struct("fp", "bands")).alias("one")))
    ends = lambda c: one.select(F.col("sim").alias(c), F.col("one").alias(f"{c}_one"))
    same = sims.join(one, "sim").select(F.col("one").alias("a_one"), F.struct("fp", "bands").alias("b_one"))
    near = _edges(one.select(F.col("sim").alias("fp")), cap).distinct().join(ends("a"), "a").join(ends("b"), "b").select("a_one", "b_one")
    new = same.where("a_one.fp <> b_one.fp").union(near).where(~F.arrays_overlap("a_one.bands", "b_one.bands"))
    pairs = common.scratch(new.select(F.col("a_one.fp").alias("a"), F.col("b_one.fp").alias("b")).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    firsts = distinct.join(wanted, "fp", "left_semi").select(F.col("first").alias("key")).distinct()
    texts = rows.where("key is not null").join(firsts, "key", "left_semi").union(rows.where("key is null"))
    sets = common.scratch(jaccard.fingerprints(texts.select("text"), "text", shingle, with_set=True).join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))
    held = lambda c: sets.select(F.col("fp").alias(c), F.col("held").alias(f"{c}_held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common.trim()
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("a_held", "b_held"))
            good = pa.array([bool(jaccard.similar(x, [y], similarity)[0]) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    with common.short_batches(rows.sparkSession):
        return common.scratch(pairs.join(held("a"), "a").join(held("b"), "b").select("a", "b", "a_held", "b_held").mapInArrow(run, pairs.schema))


def _similar(df: DataFrame, key: str, text: str, similarity: float, shingle: int, **caps: int) -> DataFrame:
    """The groups by the similarity of whole texts; ``fp`` is the digest of a text's set of shingles.

    Candidates are texts with fingerprints within three bits, and those that share a min-hash key; either are confirmed on whole sets.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    told = jaccard.fingerprints(rows, "text", shingle, with_bands=True, number=fingerprint)
    distinct = common.scratch(told.groupBy("fp").agg(F.min("key").alias("first"), F.min("sim").alias("sim"), *(F.first(c).alias(c) for c in ("bands", "size", "sketch"))))
    links = jaccard.edges(df, distinct, key, text, shingle, similarity, **caps).select("a", "b").union(_confirmed(rows, distinct, similarity, shingle))
    return _named(distinct.select("fp", "first"), links)


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", cap: int = CAP) -> DataFrame:
    """(key, fp, component_id) of each row; component_id is the least key that it reaches by links of at most three bits.

    Texts with the same fingerprint are linked; so null, empty and wordless texts form one group (fingerprint 0) with what lies within
    three bits of it.  Rows whose key is null get the least other key of their component, or null.  Repeated rows stay.
    """
    rows, groups = _groups(df, key, text, cap)
    return rows.join(groups, "fp").select(key, "fp", "component_id")


def hex_of(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", cap: int = CAP, similarity: float | None = None, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``df`` for each group: of those with the group's least key the first by all columns.

    Links are fingerprints within three bits or, where a ``similarity`` is given, sets of ``shingle``-word shingles whose Jaccard
    similarity is that or more, among texts with fingerprints within three bits or a min-hash key in common.  A row with a null key stays only where no row of its group has one.
    Other columns pass unchanged, whatever their names; two columns of one name raise, as they do in Spark.
    """
    if similarity is None and shingle != SHINGLE:
        raise ValueError("fingerprints within three bits are of three-word shingles")
    groups = _groups(df, key, text, cap)[1] if similarity is None else _similar(df, key, text, similarity, shingle)
    # rows travel as one struct, so that no column of theirs meets a name of ours
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    order = [F.col("row").getField(f.name) for f in df.schema if not f.dataType.simpleString().startswith(("map", "variant"))]

    def first_of(rows: DataFrame, by: str) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("nth = 1").select("row")

    least = groups.where("component_id is not null").select(F.col("component_id").alias("key")).distinct()
    named = first_of(whole.where("key is not null").join(least, "key", "left_semi").select("row", "key"), "key")
    nameless = whole.where("key is null").select("row", "text")

    if similarity is None:
        nameless = _with_fingerprint(nameless).select("row", F.col("sim").alias("fp"))
    else:
        nameless = jaccard.fingerprints(nameless, "text", shingle)
    nameless = first_of(nameless.join(groups.where("component_id is null").select("fp", "root"), "fp").select("row", "root"), "root")
    return named.union(nameless).select(*(F.col("row").getField(c).alias(c) for c in df.columns))
