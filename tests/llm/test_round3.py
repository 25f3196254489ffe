"""Whitening, odd sketches and the filter audit against plain versions; names that clash in the pipeline."""

import math
import os
import random
import sys
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("loomgrid.llm")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from loomgrid.llm import audit, common, jaccard, oddsketch, queries, whitening  # noqa: E402
from loomgrid.llm.common import read  # noqa: E402

# ---------------------------------------------------------------- whitening


def plain_whitening(vectors: np.ndarray, k: int):
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_of_the_table_by_numpy(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows], np.float64)
    n, deviation, white, explained = plain_whitening(vectors, 32)
    got = queries.op11_tiled_whitening(spark, sf_dir).collect()
    assert len(got) == 32 * len(rows) and {r.n for r in got} == {n}
    place = {r.vec_id: i for i, r in enumerate(rows)}
    found = np.zeros((len(rows), 32))
    for r in got:
        found[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    signs = np.sign((found * white).sum(axis=0))
    assert found == pytest.approx(white * signs, abs=1e-6)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() == pytest.approx(np.abs(found.T @ found / n - np.eye(32)).max(), abs=1e-9)


@pytest.mark.parametrize("dims", [1, 31, 33, 70])
def test_tiles_of_any_width_and_small_blocks(spark, dims, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * dims * 7)
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(200, dims)) @ rng.normal(size=(dims, dims))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    whole = lambda c: whitening.entries(c, dims, 64.0, 0)[1].astype(float)
    x = np.floor(64 * vectors)
    assert whitening.tiled_products(df, "embedding", whole, dims) == pytest.approx(x.T @ x, rel=1e-12)
    got = whitening.whitened(df, components=5).collect()
    assert len(got) == 200 * min(5, dims) and max(r.identity_error for r in got) < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], 7), (2, [1.5, 1.0], 7), (None, [0.5, 1.0], 7), (1, [0.5, 1.0], 7), (3, None, 7), (4, [1.0, None], 7), (5, [nan, 1.0], 7), (6, [inf, 1.0], 7), (7, [], 7), (8, [1.0], 7), (9, [1e300, 0.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int").withColumn("n", F.lit("x")).withColumn("whitened", F.lit(3))
    got = sorted(whitening.whitened(df).collect(), key=repr)
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(k), c) for k in (1, 1, 2, None) for c in (1, 2))
    assert {r.n for r in got} == {4}
    # 4 * x - S: 32, 96, 32, 32 of S = 192; the second dimension never varies
    assert sorted({r.deviation for r in got}) == [(4 * 32 - 192) ** 2, (4 * 96 - 192) ** 2]
    assert [r.whitened for r in got if r.component == 2] == [None] * 4
    assert [r.explained for r in got if r.component == 1] == [1.0] * 4
    assert max(r.identity_error for r in got) < 1e-12
    for few in (df.limit(0), df.where("vec_id = 3")):
        assert whitening.whitened(few).count() == 0
    flat = whitening.whitened(df.where("vec_id = 1")).collect()
    assert len(flat) == 4 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in flat} == {(None, None, None, 0)}


def test_sums_and_deviations_beyond_a_long():
    x = np.array([[(1 << 56) + 1, -5], [(1 << 56) + 3, 7]] * 3, np.int64)
    assert whitening.exact_sums(x).tolist() == [3 * ((1 << 57) + 4), 6]
    model = whitening.Whitening(6, [int(s) for s in whitening.exact_sums(x)], np.ones(2), np.eye(2), 2.0, 64.0, 0)
    assert whitening.deviations(model, x[:2]).to_pylist() == [6**2 + 36**2] * 2
    far = np.array([[1 << 57, 0]], np.int64)
    assert whitening.deviations(model, far).to_pylist() == [None]


# ---------------------------------------------------------------- odd sketches


def test_odd_sketch_groups_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    want = brute.op12(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op12_odd_sketches(spark, sf_dir).collect()}
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("caps", [{}, {"cap_sets": 5, "cap_bytes": 3000}])
def test_odd_sketch_groups_lose_no_link(spark, caps):
    """Chains at the very bound, copies that differ in one word, many copies of one text, and texts that share a boilerplate half."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(6000)]
    texts: list[str | None] = [None, "", " \n", "one", "one", "ONE two", "one two", "a b c", "A b C"]
    for size in (20, 102, 300):
        base = [rng.choice(words) for _ in range(size)]
        texts += [" ".join(base)] * 12
        for _ in range(15):
            copy = list(base)
            for at in rng.sample(range(size), rng.randrange(1, max(2, size // 30))):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
        texts += [" ".join(base[: size - cut]) for cut in range(0, size // 5)]  # some hold exactly 85 of 100
        texts += [" ".join(base[: size // 2] + [rng.choice(words) for _ in range(size // 2)]) for _ in range(25)]
    rows = list(enumerate(texts))
    want = brute.op12(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in oddsketch.near_sets(table, **caps).collect()}
    assert got == want


def test_odd_sketch_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long, 1), (None, long, 2), (3, long, 3), (3, long, 3), (None, None, 4), (8, None, 5), (None, "only here once", 6), (9, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").withColumn("fp", F.lit("x")).withColumn("bands", F.lit(0)).withColumn("frequent", F.lit(True))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in oddsketch.near_sets(df).collect()), key=repr)
    assert got == sorted([(5, 38, 3, False), (None, 38, 3, False), (3, 38, 3, True), (3, 38, 3, True), (None, 0, None, False), (8, 0, 8, True), (None, 1, None, False), (9, 0, 9, True)], key=repr)
    assert oddsketch.near_sets(df.limit(0)).count() == 0
    assert oddsketch.near_sets(df.where("text is null")).count() == 2


def test_bits_that_a_pair_may_differ_in():
    """The bound holds for drawn pairs, and the estimate finds the similarity of like sets."""
    rng = np.random.default_rng(4)
    most = oddsketch.most_bits(0.85)
    assert oddsketch.most_bits(0.85, 0.5) < most < oddsketch.BITS // 2 and oddsketch.most_bits(1.0) == 0
    seen = []
    for size in (200, 1000):
        for _ in range(150):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            gone = round(size * 0.15 / 1.85)  # as many of each set are its own
            other = base.copy()
            other[:gone] = rng.integers(0, 1 << 63, gone, dtype=np.uint64)
            a, b = (jaccard.unpacked([oddsketch.sketch(jaccard.minima(np.unique(x)))])[0] for x in (base, other))
            seen.append(int(jaccard.apart(a[None], b)[0]))
    assert max(seen) <= most
    assert np.mean([oddsketch.estimate(b) for b in seen]) == pytest.approx(0.85, abs=0.02)
    twenty = np.mean(seen)
    assert 10 < twenty < most


def test_keys_that_many_rows_have_are_looked_up_apart(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"))
    table = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = common.look_up(rows, table, rows.groupBy("k").agg(F.count("*").alias("n")), "k", least=100)
    assert out.count() == 6000 and out.where("v = 2 * k").count() == 6000


# ---------------------------------------------------------------- the filter audit


def rows_of(df):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in df.select(columns).collect())


def test_audit_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in read(spark, sf_dir, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in read(spark, sf_dir, "labels").collect()]
    assert rows_of(queries.op13_filter_audit(spark, sf_dir)) == sorted(brute.op13(docs, labels))


def test_audit_of_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(250))
    docs = [(1, many, "s"), (2, many, None), (2, many, ""), (None, many, "s"), (7, many, "t"), (3, None, "s"), (4, "", "t"), (5, "é É \u00c0" * 90, "s"), (6, "A" * 3 + " b" * 300, "s"), (8, many + " #", "s"), (9, "ABC" + many, "t"), (1, many, "s"), (10, "x\u2003y " * 220, "t")]
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (7, 1, None), (8, None, 1), (99, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("m")).withColumn("n", F.lit(1)).withColumn("part", F.lit("p"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(5))
    got = rows_of(audit.interactions(df.repartition(4), marks))
    assert got == sorted(brute.op13(docs, [x for x in labels if x[0] is not None])) and len(got) == 3 * 600
    assert audit.interactions(df.limit(0), marks).count() == 0
    assert {r[7] for r in rows_of(audit.interactions(df, marks.limit(0)))} == {0}


def test_scanning_of_buffers():
    rng = random.Random(1)
    alphabet = ["a", "B", " ", "\t", "\n", "é", "Z", "#", "|", "\u2003", "😀", "\x0b", "\x1c", "\x85"]
    texts = [None, "", " ", *("".join(rng.choices(alphabet, k=rng.randrange(0, 60))) for _ in range(300))]
    for column in (pa.array(texts), pa.array(["zz", *texts, None])[1:-1], pa.array(texts, pa.large_string())):
        m = audit.measures(column)
        for i, t in enumerate(texts):
            ws = brute.words(t)
            want = (len(ws), len(set(ws)), sum("A" <= c <= "Z" for c in t or ""), len(t or ""), sum(c in "#$%&*|" for c in t or ""))
            assert tuple(int(m[c][i]) for c in ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")) == want


def test_long_texts_and_words_of_one_hash(monkeypatch):
    text = " ".join(f"w{i % 5000}É" for i in range(40_000))
    whole = audit.measures(pa.array([text]))
    monkeypatch.setattr(audit, "LONG_TEXT", 10_000)
    assert {c: v.tolist() for c, v in audit.measures(pa.array([text])).items()} == {c: v.tolist() for c, v in whole.items()}
    assert whole["n_distinct"].tolist() == [5000]
    monkeypatch.setattr(common, "mixed", lambda x: x * np.uint64(0))  # every word has the same hash: bytes decide
    assert audit.measures(pa.array(["a b a c", "aa bb aa", "x"]))["n_distinct"].tolist() == [3, 2, 1]


# ---------------------------------------------------------------- the pipeline


def test_names_that_clash_pass_through_the_pipeline(spark, sf_dir):
    """Columns called as the stages call their own come out as they went in."""
    odd = ["_nth", "_root", "_lang_pred", "_score", "row", "fp", "bands", "nth", "key", "root", "lang_pred", "score", "kept", "base_failed", "n_words", "size", "sketch", "first"]
    docs = read(spark, sf_dir, "documents")
    table = docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in odd))
    now, bare = table, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), table.schema)
        bare = spark.createDataFrame(stage(spark, bare, sf_dir).collect(), docs.schema)
        rows = now.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in bare.collect()}, name
        assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in odd), name


def test_language_stage_where_nothing_is_labelled(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("lang", F.lit(None).cast("string"))
    out = {r.doc_id for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    assert out == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


def test_share_of_links_that_bands_may_lose():
    chance = (1 - 0.85**jaccard.ROWS) ** jaccard.BANDS
    assert chance < 1e-5 and math.isclose(float(oddsketch.SIMILARITY), Fraction(85, 100))
