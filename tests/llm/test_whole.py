"""Jobs done whole: what earlier versions left out."""

import os
import random
import sys

import pytest

pytest.importorskip("loomgrid.llm")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from loomgrid.llm import html_density, langid, simhash  # noqa: E402
from loomgrid.llm.common import read  # noqa: E402


def sets_of(text: str, width: int = 5) -> frozenset:
    ws = text.lower().split()
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)) or frozenset([tuple(ws)])


def test_stage_drops_near_copies_of_similarity_0_8(spark, sf_dir):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 400))]
        texts.append(base)
        for share in (0.01, 0.03, 0.08):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[at] = rng.choice(words)
            texts.append(copy)
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    sets = [sets_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if same >= 0.8 * (len(a) + len(sets[j]) - same):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    want = {i for i in range(len(rows)) if root(i) == i}
    assert 60 <= len(want) < len(rows) - 40
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, sf_dir).collect()} == want
    nulls = table.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one(nulls, similarity=0.8, shingle=5).count() == len(want)
    assert simhash.keep_one(table.limit(0), similarity=0.8, shingle=5).count() == 0


def test_page_text_takes_sibling_articles_and_keeps_named_subtrees_that_hold_the_page():
    one, two = (["".join(f"{w}{i} part{j} " for j in range(25)).strip() for i in range(5)] for w in ("alpha", "gamma"))
    parts = ["<article>" + "".join(f"<p>{x}</p>" for x in part) + "</article>" for part in (one, two)]
    menu = "<div class='menu'><a href='/'>Home</a> short words</div>"
    assert html_density.main_text(f"<html><body>{menu}{''.join(parts)}</body></html>") == "\n".join(one + two)
    bare = "".join(f"<p>{x}</p>" for x in one)
    assert html_density.main_text(f"<html><body><div class='menu'><a href='/'>Home</a></div><div class='page header'>{bare}</div></body></html>") == "\n".join(one)
    assert html_density.main_text(f"<html><body><div class='widget'>{parts[0]}</div></body></html>") == "\n".join(one)
    comments = "<section class='comments'><article><p>reader says this</p></article></section>"
    assert html_density.main_text(f"<html><body>{parts[0]}{comments}</body></html>") == "\n".join(one)


def test_language_learns_distinct_texts_and_no_short_language_cuts_the_others(spark):
    rng = random.Random(5)
    rows = [(" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(80)), lang) for lang, letters in (("aa", "abcde"), ("bb", "fghij")) for _ in range(130)]
    plain = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    copied = langid.train(spark.createDataFrame(rows + rows[:130] * 20, "text string, lang string"))
    short = langid.train(spark.createDataFrame([*rows, ("kkk", "zz")], "text string, lang string"))
    assert min(plain.learned) > 120 * 395
    assert copied.learned == plain.learned
    assert [e.tolist() for e in copied.edges] == [e.tolist() for e in plain.edges]
    assert short.learned[:2] == plain.learned
    assert langid.predict_texts(short, [rows[0][0], rows[-1][0], "xyz qxw", "kkk"])[0][:2] == ["aa", "bb"]


def test_large_keys_are_worked_on_in_parts_and_lose_no_link(spark):
    """A cluster of near copies, chains that leave it and sets apart, with so small bounds that nearly every key is large."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for size in (400, 60, 200):
        base = [rng.choice(words) for _ in range(size)]
        chain = list(base)
        for i in range(40):
            copy = list(base)
            copy[rng.randrange(size)] = rng.choice(words)
            texts.append(copy)
            if i < 12:  # each step further from the cluster
                chain = list(chain)
                for at in rng.sample(range(size), max(1, size // 60)):
                    chain[at] = rng.choice(words)
                texts.append(chain)
    texts += [[rng.choice(words) for _ in range(100)] for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    groups = brute.near(rows)
    want = {k for k, c in groups.items() if k == c}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for caps in ({}, {"cap_sets": 5, "cap_bytes": 6000}):
        found = simhash._similar(table, "doc_id", "text", 0.8, 5, **caps)
        assert {r.component_id for r in found.collect()} == want


def test_recall_of_near_copies_against_brute_force(spark, sf_dir):
    """Of the links that all pairs of texts have, those whose ends the operator puts into one group: 0.9 at least, here all."""
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8, shingle=5).collect()}
    assert kept == {k for k, c in brute.near(rows).items() if k == c}
