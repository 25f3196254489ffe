"""The text operators against plain versions, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import public_tokenizers as tokenizers_dir  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from loomgrid.llm import bpe, html_density, langid, ogg, packing, quality, queries, radix, simhash, substring, urlrep  # noqa: E402
from loomgrid.llm.common import read  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("ba", "ké", "lo", "mi", "nu", "ß") for b in ("ta", "ri", "so", "vé", "x1")]
    passage = " ".join(rng.choice(vocabulary) for _ in range(120))
    texts: list[str | None] = [None, "", " \n\t ", "word", "!!! ### 123", "ééé " * 300, "a" * 5000]
    for i in range(40):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 300)))
        if i % 4 == 0:
            at = rng.randrange(len(text))
            text = text[:at] + " " + passage + "\n" + text[at:]
        texts += [text] * (3 if i % 7 == 0 else 1)
    long = " ".join(rng.choice(vocabulary) for _ in range(40_000))
    texts += [long, long[:100_000] + " changed " + long[100_000:], texts[20] + " end", texts[20].replace(" ", "  ", 5)]
    langs = ["xx", "yy", None]
    return [(i, t, langs[i % 3], "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(df):
    """The same rows with columns that share names with what operators use inside."""
    names = ["bucket", "chunk", "key", "fp", "hashes", "length", "rank", "piece", "host", "kept", "data", "extra"]
    return df.select("*", *(F.lit("clash").alias(c) for c in names))


def test_substring_matches_brute_force(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(with_clashes(docs)).collect()}
    assert got == brute.op6([r[:2] for r in rows])
    kept = {r.doc_id: r.kept_text for r in substring.remove_repeats(docs).collect()}
    assert all(hashlib.sha256(kept[k].encode()).hexdigest() == v[2] for k, v in got.items())


def test_substring_repeated_rows_ties_and_null_keys(spark, empty):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (-5, None), (-(1 << 40), "x")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(df).collect()))
    assert got == [(False, -(1 << 40), 0), (False, -5, 0), (False, 1, 0), (False, 1, 0), (False, 2, 30), (True, 0, 30)]
    assert substring.remove_repeats(empty).count() == 0


def test_radix_matches_brute_force(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in radix.remove_repeats(with_clashes(docs)).collect()}
    assert got == dict(zip([r[0] for r in rows], brute.op10([r[1] for r in rows]), strict=True))


def test_radix_repeats_near_their_ends_and_repeated_rows(spark, empty):
    rng = random.Random(3)
    letters = "abcdefgh"
    base = "".join(rng.choice(letters) for _ in range(3000))
    texts = [base, base[500:1500] + "Q" + base[1500:1950], "Z" * 700, "Z" * 399, base[100:500], base[2000:2399], "y" + base[2599:], base[700:1100] + base[700:1100]]
    df = spark.createDataFrame([(9, t) for t in texts] + [(None, texts[4])], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in radix.remove_repeats(df).collect())
    assert got == sorted(brute.op10([*texts, texts[4]]))
    assert radix.remove_repeats(empty).count() == 0


def test_radix_keeps_columns_in_the_pipeline_form(docs, rows, empty):
    out = radix.remove_from(with_clashes(docs))
    assert out.columns == with_clashes(docs).columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, text, lang, source, _ in rows:
        assert (got[i].lang, got[i].source, got[i].n_chars, got[i].extra) == (lang, source, len(got[i].text), "clash")
        assert len(got[i].text) <= len(text or "")
    assert radix.remove_from(empty).count() == 0


def test_simhash_matches_brute_force(docs, rows, sf_dir, spark):
    want = brute.op7([r[:2] for r in rows])
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(with_clashes(docs)).collect()}
    assert got == want
    table = read(spark, sf_dir, "documents")
    want = brute.op7([(r.doc_id, r.text) for r in table.collect()])
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op7_simhash_pivots(spark, sf_dir).collect()}
    assert got == want


def chain(n: int, seed: int) -> list[int]:
    rng = np.random.default_rng(seed)
    found = [int(rng.integers(0, 1 << 63))]
    while len(found) < n:
        x = found[int(rng.integers(0, len(found)))] if rng.random() < 0.8 else int(rng.integers(0, 1 << 63))
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            x ^= 1 << int(b)
        found.append(x)
    return found


def test_links_through_the_finer_keys_join_the_same_groups(spark):
    fps = sorted(set(chain(600, 5)))
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = np.array(fps, np.uint64)
    for x in fps:
        for y in at[np.bitwise_count(at ^ np.uint64(x)) <= 3].tolist():
            a, b = root(x), root(y)
            parent[max(a, b)] = min(a, b)
    want = sorted(sorted(y for y in fps if root(y) == r) for r in {root(x) for x in fps})
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for cap in (4096, 2):
        first = simhash._linked(simhash._keyed(distinct, simhash.COARSE), cap).cache()
        hot = first.where("hot").select(F.col("a").alias("fp")).distinct()
        edges = first.where("not hot").select("a", "b").union(simhash._linked(simhash._keyed(hot, simhash.FINE), 4096).select("a", "b"))
        groups: dict[int, list[int]] = {x: [x] for x in fps}
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        by: dict[int, list[int]] = {}
        for x in fps:
            signed = x - (1 << 64) if x >> 63 else x
            by.setdefault(roots.get(signed, signed), []).append(x)
        assert sorted(sorted(v) for v in by.values()) == want
        assert (first.where("hot").count() > 0) == (cap == 2)
        assert groups


def test_simhash_keeps_one_and_takes_null_keys(spark, empty):
    df = spark.createDataFrame([(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (7, None), (8, "")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.keep_one(df).collect()))
    assert got == [(False, 3, "a b c d"), (False, 7, None), (True, 0, "q r s t u")]
    assert simhash.keep_one(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0


def test_bpe_matches_the_library_and_round_trips(docs, rows, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers_dir.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=tokenizers_dir.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(with_clashes(docs)).collect()}
    for i, text, *_ in rows:
        ids = plain.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    again = bpe.decode(bpe.encode(docs)).select("text", "data").collect()
    assert all(bytes(r.data) == (r.text or "").encode() for r in again)
    assert bpe.round_trip(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bpe_pieces_never_change_ids(seed):
    rng = random.Random(seed)
    encoder = bpe.encoding()
    alphabet = ["a", "b", "é", "1", "2", " ", "  ", "\n", "\t", "'s", "'", "\u00a0", "\x1c", "\u3000", "漢", ".", "!", "🙂"]
    text = "".join(rng.choice(alphabet) for _ in range(3000))
    for size in (1, 7, 100):
        pieces = bpe.safe_pieces(text, size)
        assert "".join(pieces) == text
        assert [x for p in pieces for x in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)
    assert bpe.safe_pieces("x" * 500, 10) == ["x" * 500]


def test_quality_features_match_brute_force(docs, rows, empty):
    got = {r.doc_id: r for r in quality.features(with_clashes(docs)).withColumn("failed", quality.base_failed()).collect()}
    for i, text, *_ in rows:
        assert (*(got[i][c] for c in quality.FEATURES), got[i].failed) == brute.op3(text)
    assert quality.features(empty).count() == 0


def test_quality_cutoffs_hold_their_promise(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        words = [rng.choice("abcdefgh") * rng.randrange(2, 7) + str(rng.randrange(10**6)) for _ in range(30)]
        rows.append((i, " ".join(w + ("###" if bad else "") for w in words), "en" if i % 3 else None, "s", 0))
        labels.append((i, 0 if bad else 1))
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1), (5, None), (1, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.quality_rules(df, marks).collect()}
    assert len(out) == 3000
    assert all(out[i].kept == (i % 10 != 0) for i in out)
    assert quality.tail(0, 10, 0.5) == pytest.approx(0.5**10)
    assert quality.tail(10, 10, 0.5) == 1.0
    none = {r.doc_id: r for r in quality.quality_rules(df, marks.limit(0)).collect()}
    assert all(r.kept for r in none.values())
    kept = quality.keep_good(with_clashes(df), marks)
    assert kept.columns == with_clashes(df).columns and kept.count() == 2700


def test_language_on_held_out_rows(spark, sf_dir):
    found = queries.op1_language_id(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark, docs, empty):
    model = langid.train(docs)
    assert model.langs == ["xx", "yy"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(with_clashes(docs), model).collect()}
    assert got[0] == got[1] == got[2] == got[4] == (langid.UNKNOWN, 0.0)
    assert got[3][0] in model.langs
    nothing = langid.train(empty)
    assert nothing.langs == []
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {langid.UNKNOWN}
    assert langid.predict(empty, model).count() == 0


def test_phrases_match_a_plain_parse(docs):
    texts = {"xx": "abcabcabd xyz", "yy": "zzyx abd"}
    letters = np.unique(np.frombuffer("abcdxyz".encode("utf-32-le"), np.uint32))
    classes = langid._classes(letters)
    built = [langid.automaton(classes[np.frombuffer(t.encode("utf-32-le"), np.uint32)].tolist()) for t in texts.values()]
    model = langid.Model(list(texts), [letters, letters], [np.arange(2, len(letters) + 2)] * 2, [e for e, _ in built], [n for _, n in built], [len(t) for t in texts.values()])

    def plain(text: str, learned: str) -> int:
        count, at = 0, 0
        while at < len(text):
            size = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in learned), 1)
            count, at = count + 1, at + size
        return count

    cases = ["abcabd", "zzyx  abd!", "q", "ABC-abd", "", "...", "xyz abq abd cab"]
    found, sizes = langid.phrases(model, cases)
    for i, case in enumerate(cases):
        clean = langid.normal(case)
        assert sizes[i] == len(clean)
        assert found[i].tolist() == [plain(clean, t) for t in texts.values()]


def test_ogg_round_trip_and_damage(docs, rows, empty):
    got = {r.doc_id: r for r in ogg.media_digest(with_clashes(docs)).collect()}
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = ogg.payload_of(data)
        assert len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == data.rstrip(b"\0")
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(data), len(payload))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[0].media_sha256 == got[1].media_sha256
    packets = ogg.packets(ogg.add_media(docs).select("doc_id", "media")).where("doc_id = 6 and packet > 0").orderBy("serial", "packet").collect()
    assert b"".join(sorted((bytes(p.data) for p in packets), key=len, reverse=True)) == ogg.payload_of(b"a" * 5000)
    assert ogg.media_digest(empty).count() == 0
    media = ogg.store(ogg.payload_of(b"x" * 100_000))
    assert ogg.load(media)[0] == ogg.payload_of(b"x" * 100_000)
    for at in (5, 30, 1000, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.demux(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        ogg.demux(media[:-10])


@pytest.mark.parametrize("sizes", [[0], [254, 255, 256], [255 * 255], [255 * 255 - 1, 3, 0], [200_000, 0, 510]])
def test_ogg_packets_of_any_size(sizes):
    packets = [(random.Random(i).randbytes(n), i) for i, n in enumerate([8, *sizes])]
    found = ogg.demux(ogg.mux([(1, packets), (2, packets[:1])]))
    assert [p for p, _ in found[1]] == [p for p, _ in packets]
    assert found[1][-1][1] == packets[-1][1]
    assert len(found[2]) == 1


def test_packing_is_whole_and_tight(docs, rows, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizers_dir.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    out = packing.best_fit(with_clashes(docs), with_ids=True).collect()
    by, places = {}, {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [x for r in mine for x in r.ids] == ids
        assert [r.start for r in mine] == [sum(len(p.ids) for p in mine[:k]) for k in range(len(mine))]
        assert all(r.length == len(r.ids) == 1024 for r in mine[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(places) == list(range(len(places)))
    assert packing.best_fit(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_fills_by_large_item_matching(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 1025): rng.randrange(1, 50) for _ in range(rng.randrange(1, 200))}
    runs, sequences = packing.plan(counts)
    fill: dict[int, list[tuple[int, int]]] = {}
    placed: dict[int, int] = {}
    for length, rank, number, first, each, offset in runs:
        assert rank == placed.get(length, 0)
        placed[length] = rank + number
        for k in range(number):
            fill.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert placed == counts
    assert sorted(fill) == list(range(sequences))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        assert sum(n > 341 for _, n in parts) <= 2
    assert sequences <= 1.25 * -(-sum(n * c for n, c in counts.items()) // 1024) + sum(c for n, c in counts.items() if n > 512) * 0.5 + 1


def test_packing_ranks_are_gapless(spark):
    df = spark.createDataFrame([(i, 0, 7 if i % 3 else i % 5) for i in range(1000)] * 2, "doc_id long, piece int, length long")
    got = packing.ranked(df, "length", ["doc_id", "piece"]).groupBy("length").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(list(r.r) == list(range(len(r.r))) for r in got)


PAGES = {
    "<html><head><title>t</title><style>x</style></head><body><nav><a href=1>m</a></nav><article><h1>Title&nbsp;one</h1><p>First <b>bold</b> text &amp; more, long enough to count.<p>Second\n  paragraph with <a href=q>a link</a> in it.</article><footer>f</footer></body></html>": "Title one\nFirst bold text & more, long enough to count.\nSecond paragraph with a link in it.",
    "<body><div class=sidebar><p>Some long sidebar text that should never be kept at all.</p></div><div id=content><p>Paragraph one has quite some text in it, you see.</p><p>Paragraph two has more text in it, as you can see.</p></div><div class='comments'><p>I like this very much, said a reader at length.</p></div></body>": "Paragraph one has quite some text in it, you see.\nParagraph two has more text in it, as you can see.",
    "<body><script>var a='<p>no</p>'</script><!-- <p>no</p> --><p>Only &lt;this&gt; &#x41;&#66;.</p><form><p>no</p></form></body>": "Only <this> AB.",
    "<body><div class='layout with-sidebar no-header'><div class='postBody'><p>Text of a page that names its parts in its classes.</p></div><ul class='relatedPosts'><li>Other text</li></ul></div></body>": "Text of a page that names its parts in its classes.",
    "": "",
    "<p>": "",
    "plain text": "plain text",
    "<body><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><table><tr><td>Cell one of a table with text in it.<td>Cell two</table>": "Cell one of a table with text in it.\nCell two",
}


def test_page_text(spark):
    rows = [(i, "u", h) for i, h in enumerate([*PAGES, None])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_density.extract(df.withColumn("text", F.lit("clash"))).collect()}
    for i, want in enumerate([*PAGES.values(), ""]):
        assert got[i].text == want, i
        assert got[i].n_chars == len(want)
    assert html_density.extract(df.limit(0)).count() == 0


def test_page_text_never_fails():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div", ">", "<", "&", "&amp", "<!--", "-->", "<script>", "</script", "<a href='", "'", '"', "text ", "<li>", "</body>", "<head>", "<body>", "<td>", "<table>", "</div>", "<br/>", "é", "\x00"]
    for _ in range(500):
        html_density.main_text("".join(rng.choice(bits) for _ in range(rng.randrange(80))))
    assert html_density.main_text("<div>" * 5000 + "deep " * 20) == " ".join(["deep"] * 20)


def test_url_rules_and_reputation(spark):
    urls = [None, "no scheme", "http://EXAMPLE.com", "https://www.example.com/en/1?q", "http://a.example.com/en/2#x", "ftp://bad.org/x", "http://good.org/x", "http://sub.deep.net/fr/", "x://net/es/1", "http://other.net", "http://new.org/", "a://b://c/d", "http://com/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(5, urls[5])], "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([("bad.org", 1)] * 40 + [("good.org", 0)] * 60 + [(None, 1), ("", 1), ("x.org", None)], "host string, bad int")
    got = {}
    for r in urlrep.filter_urls(pages, outcomes).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert got[0] == got[1] == [("", "", None, "allow")]
    assert got[2] == [("example.com", "", None, "allow")]
    assert got[3] == [("www.example.com", "/en/1", "www.example.com/en/", "allow")]
    assert got[4] == [("a.example.com", "/en/2", "example.com/en/", "block")]
    assert got[5] == [("bad.org", "/x", None, "block")] * 2
    assert got[6] == [("good.org", "/x", None, "allow")]
    assert got[7] == [("sub.deep.net", "/fr/", "net/fr/", "block")]
    assert got[8] == [("net", "/es/1", "net/es/", "block")]
    assert got[11] == [("b:", "//c/d", None, "allow")]
    assert got[12] == [("com", "/", "com/", "allow")]
    assert urlrep.filter_urls(pages, outcomes.limit(0)).where("verdict = 'block'").count() == 3
    assert urlrep.filter_urls(pages.limit(0), outcomes).count() == 0


def test_pipeline_stages_agree_with_plain_versions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, tables[-1], sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        tables.append(spark.createDataFrame(rows, docs.schema))
    first, kept, ruled, single, cut = ([(r.doc_id, r.text) for r in t.collect()] for t in tables)
    assert {k for k, _ in kept} == {k for k, t in first if any(c.isalpha() for c in t or "")}
    failed = {k for k, t in kept if brute.op3(t)[-1]}
    assert not failed & {k for k, _ in ruled}
    groups = brute.near(ruled)
    assert {k for k, _ in single} == {k for k, c in groups.items() if k == c}
    left = dict(cut)
    assert set(left) == {k for k, _ in single}
    gone = brute.later_words([t for _, t in single])
    for (k, t), places in zip(single, gone, strict=True):
        assert brute.words(left[k]) == [w for i, w in enumerate(brute.words(t)) if i not in places]
        assert places or left[k] == (t or "")
    packed = corpus_pipeline.STAGES[-1][1](spark, tables[-1], sf_dir).collect()
    assert {r.doc_id for r in packed} == set(left)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_pipeline_takes_nulls_and_empty_tables(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "some words here " * 5, None, None, None)], DOCS)
    for table in (with_clashes(docs.union(nulls)), empty):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), table.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= (0 if table is empty else 10)
