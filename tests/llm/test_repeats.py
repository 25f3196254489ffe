"""Repeated passages: long texts, words as units, chunks that no key can fill."""

import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("loomgrid.llm")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from loomgrid.llm import common, radix, substring  # noqa: E402
from loomgrid.llm.common import read  # noqa: E402


def test_radix_counts_repeated_words_on_tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.collect()
    want = {r.doc_id: len(x) for r, x in zip(rows, brute.repeated_words([r.text for r in rows]), strict=True)}
    assert sum(x > 0 for x in want.values()) > 10
    found = radix.remove_repeats(docs, with_kept=False, word_depth=50).collect()
    assert {r.doc_id: r.n_repeated_words for r in found} == want
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(found, key=lambda r: r.doc_id)] == brute.op10([r.text for r in sorted(rows, key=lambda r: r.doc_id)])


def test_stage_takes_out_passages_of_fifty_words(spark, sf_dir):
    rng = random.Random(11)
    words = ["a", "of", "né", "the", "longer", "wörd"] + [f"w{i}" for i in range(300)]
    passage = [rng.choice(words[:6]) for _ in range(51)]
    texts: list[str | None] = [None, "", "  \n"]
    for i in range(30):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 200))]
        if i % 3 == 0:
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage if i % 2 else passage[:50]
        texts.append(rng.choice([" ", "  ", "\n"]).join(text))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, table, sf_dir).collect()}
    gone = brute.later_words(texts)
    assert sum(bool(x) for x in gone) == 9  # the first of ten stays
    for i, text, lang, _, n in rows:
        assert (out[i].lang, out[i].n_chars) == (lang, len(out[i].text))
        assert brute.words(out[i].text) == [w for j, w in enumerate(brute.words(text)) if j not in gone[i]]
        assert gone[i] or out[i].text == (text or "")


def test_long_texts_are_worked_on_in_pieces(spark):
    """Texts over 1 MiB; a repeat at 2**20 - 50 and repeats across the borders of pieces."""
    rng = np.random.default_rng(5)
    raw = bytearray(rng.integers(97, 123, 3 << 20, dtype=np.uint8).tobytes())
    for at in range(7, len(raw), 11):
        raw[at] = 32
    limit = common.HASHED_BYTES
    gram = b"zq" * 8
    raw[(1 << 20) - 40 : (1 << 20) - 24] = gram
    raw[(1 << 20) + 10 : (1 << 20) + 26] = gram
    long = raw.decode()
    parts = [long[(1 << 20) - 50 : (1 << 20) + 350], long[limit - 200 : limit + 200], long[4 * limit - 1 : 4 * limit + 399], long[5_000:5_399]]
    texts = [long, *parts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in radix.remove_repeats(df, with_kept=False).collect()}
    assert got == {0: 1200, 1: 400, 2: 400, 3: 400, 4: 0}
    ws = long.split()
    for cut in (limit // 11 - 30, 40_000, len(ws) - 60):
        spans = [(2, " ".join(ws[cut : cut + 60])), (3, " ".join(ws[cut + 41 : cut + 60]))]
        got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame([(1, long), *spans], "doc_id long, text string"), with_text=False).collect()}
        assert got == {1: (len(ws), 0), 2: (60, 60), 3: (19, 0)}
        got = {r.doc_id: r.n_repeated_words for r in radix.remove_repeats(spark.createDataFrame([(1, long), *spans], "doc_id long, text string"), with_kept=False, word_depth=50).collect()}
        assert got == {1: 60, 2: 60, 3: 0}


def test_pieces_hold_each_window_once():
    rng = random.Random(2)
    data = b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(400))
    words = data.split()
    for limit in (100, 257, 1000):
        for window in (3, 20):
            seen = Counter()
            for parts, _, begins in common.pieces([data], window, True, limit):
                for part, at in zip(parts, begins, strict=True):
                    ws = part.split()
                    assert ws == words[at : at + len(ws)]
                    seen.update(range(at, at + max(0, len(ws) - window + 1)))
            assert seen == Counter(range(len(words) - window + 1))
            seen = Counter(at + i for parts, _, begins in common.pieces([data], window, False, limit) for part, at in zip(parts, begins, strict=True) for i in range(len(part) - window + 1))
            assert seen == Counter(range(len(data) - window + 1))
    starts, ends = common.word_bounds(data, 16)
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == words


@pytest.mark.parametrize("kind", ["outlier", "null", "one"])
def test_no_key_fills_a_chunk(spark, kind, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 64 << 10)
    keys = {"outlier": F.when(F.col("id") == 0, F.lit(10**12)).otherwise(F.col("id")), "null": F.lit(None).cast("long"), "one": F.lit(7).cast("long")}
    table = spark.range(4000).select(keys[kind].alias("doc_id"), F.concat_ws(" ", *(F.sha2(F.concat("id", F.lit(f"x{i}")), 256) for i in range(8))).alias("text"))
    docs, size = common.chunked(table, "text")
    sizes = [r["size"] for r in docs.collect()]
    assert sum(sizes) == size == 4000 * (8 * 65 - 1)
    assert max(sizes) <= 2 * (64 << 10)
    assert docs.select("chunk").distinct().count() == len(sizes) > 20
    assert substring.remove_repeats(table, with_text=False).agg(F.sum("n_removed")).first()[0] == 0


def test_words_that_powers_tell_badly_apart(spark):
    """A Thue-Morse word and its complement, whose hashes modulo 2**64 agree for any base."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    assert hashlib.sha256(word.encode()).digest() != hashlib.sha256(other.encode()).digest()


def test_first_places_stay_whatever_overlaps(spark):
    """Passages that overlap, end inside each other and stand several times in one text, cut out as by hand."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(400)]
    texts: list[str | None] = [None]
    for i in range(60):
        text: list[str] = []
        for _ in range(rng.randrange(1, 5)):
            text += [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40))]
            at = rng.randrange(0, 300)
            text += base[at : at + rng.randrange(20, 130)]
        texts.append(" ".join(text))
    rows = list(enumerate(texts))
    gone = brute.later_words(texts)
    assert sum(map(len, gone)) > 3000
    for parts in (1, 5):
        table = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        out = {r.doc_id: r.text for r in radix.remove_from(table, depth=50, words=True, keep_first=True).collect()}
        assert {k: brute.words(t) for k, t in out.items()} == {k: [w for j, w in enumerate(brute.words(t)) if j not in gone[k]] for k, t in rows}


def test_words_that_share_half_their_bits_stay_apart(spark, monkeypatch):
    """Two words whose first 64 bits agree are two words: windows are told apart by 128 bits of each."""
    whole = common.Texts.words

    def halved(self):
        one, *rest = whole(self)
        return (np.zeros_like(one), *rest)

    monkeypatch.setattr(common.Texts, "words", halved)
    pieces = substring._Words([" ".join(f"a{i}" for i in range(30)).encode(), " ".join(f"b{i}" for i in range(30)).encode()], [0, 0])
    one, two = common.both(pieces.one, pieces.two)
    assert one.of(np.array([0]), np.array([20])) == one.of(np.array([30]), np.array([50]))
    assert two.of(np.array([0]), np.array([20])) != two.of(np.array([30]), np.array([50]))
