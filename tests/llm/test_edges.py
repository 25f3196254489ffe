"""Cases at the edges: odd characters, many strata, damaged and deep pages, other tokenizer files, blocked hosts."""

import json
import math
import random
import time

import duckdb
import pytest

pytest.importorskip("loomgrid.llm")

import public_tokenizers as tokenizers_dir  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loomgrid.llm import bpe, html_density, langid, ogg, packing, quality, queries, urlrep  # noqa: E402


def test_language_takes_any_character_and_any_script(spark):
    rng = random.Random(4)
    letters = {"aa": "abcdefgh", "el": "αβγδεζηθ", "ru": "абвгдежз", "zh": "".join(chr(0x4E00 + i) for i in range(400)), "ja": "".join(chr(0x3041 + i) for i in range(80))}
    rows = [(" ".join("".join(rng.choice(x) for _ in range(4)) for _ in range(60)), lang) for lang, x in letters.items() for _ in range(6)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == sorted(letters)
    odd = ["\0", "abc\0def", "\0\0абв\0", "", "😀", "ab" * 3000 + "\0"]
    langs, scores = langid.predict_texts(model, [*odd, *(t for t, _ in rows)])
    assert langs[: len(odd)] == ["und", "aa", "ru", "und", "und", "aa"]
    assert langs[len(odd) :] == [x for _, x in rows]
    assert ((scores >= 0) & (scores <= 1)).all()
    one = [langid.predict_texts(model, [t])[0][0] for t in odd]
    assert one == langs[: len(odd)]


def test_tail_is_the_sum_of_the_binomial():
    for k, n, rate in ((0, 5, 0.1), (3, 40, 0.0125), (7, 300, 0.05), (0, 3000, 0.0125), (90, 3000, 0.0125), (150, 3000, 0.05)):
        want = math.fsum(math.comb(n, j) * rate**j * (1 - rate) ** (n - j) for j in range(k + 1))
        assert quality.tail(k, n, rate) == pytest.approx(want, rel=1e-9)
    began = time.time()
    assert 0.49 < quality.tail(500_000, 10_000_000, 0.05) < 0.51
    assert time.time() - began < 1


def test_strata_beyond_the_most_are_decided_as_one(spark):
    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        words = " ".join(f"w{i}x{j}" + ("###" if bad else "") for j in range(20))
        # two large strata and many of a few rows, too small to decide anything alone
        stratum = "a" if i < 2000 else "b" if i < 4000 else f"s{i % 400}"
        rows.append((i, words, stratum))
        labels.append((i, 0 if bad else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    measured = quality.features(docs).drop("text").cache()
    chosen = quality.cutoffs(measured, marks, max_strata=2)
    assert chosen.apart == ["a", "b"]
    assert {s for s, _ in chosen.cutoffs} == {"a", "b", quality.REST}
    kept = {r.doc_id: r.kept for r in quality.judge(measured, chosen).collect()}
    assert all(kept[i] == (i % 10 != 0) for i in kept)
    few = quality.cutoffs(measured, marks, max_strata=1000)
    assert len(few.apart) == 402 and quality.REST not in {s for s, _ in few.cutoffs}


def test_quality_verdicts_on_tables_by_a_plain_version(spark, sf_dir):
    """The cutoffs of the whole query, found again by counting rows one by one."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    worst: dict[int, int] = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        worst[r.doc_id] = min(r.quality, worst.get(r.doc_id, 1))
    measured = {k: dict(zip(quality.FEATURES, quality.measures((d.text or "").encode()), strict=True)) for k, d in docs.items()}
    failed = {k: m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] for k, m in measured.items()}
    top = {"symbols": "n_symbols", "repeats": "n_repeat_words", "dup_lines": "n_dup_lines", "word_length": "word_chars"}
    value = lambda k, s: measured[k][top[s]] / max(1, measured[k]["n_words"])
    used = [k for k in docs if not failed[k] and k in worst]
    strata = {docs[k].lang or "" for k in used}
    cut = {}
    for s in strata:
        for signal, candidates in quality.CUTOFFS.items():
            good = [value(k, signal) for k in used if (docs[k].lang or "") == s and worst[k] == 1]
            bad = [value(k, signal) for k in used if (docs[k].lang or "") == s and worst[k] == 0]
            best = 0
            for c in sorted(candidates, reverse=True):
                lost = sum(v > c for v in good)
                p = math.fsum(math.comb(len(good), j) * (quality.RISK / 4) ** j * (1 - quality.RISK / 4) ** (len(good) - j) for j in range(lost + 1)) if lost < len(good) else 1
                if not good or p > quality.LEVEL / (len(strata) * 4):
                    break
                if sum(v > c for v in bad) - quality.WORTH * lost > best:
                    best, cut[s, signal] = sum(v > c for v in bad) - quality.WORTH * lost, c
    want = {k: not failed[k] and not any(value(k, g) > c for (s, g), c in cut.items() if s == (docs[k].lang or "")) for k in docs}
    assert {r.doc_id: r.kept for r in queries.op3_quality_rules(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("page", ["<a " * 16000, '<a "' * 16000, "<div>" * 100_000 + "x", "<nav>" + "<div>" * 50_000 + "</span>" * 50_000, "<b><td>" + "<span>" * 50_000 + "</b>" * 50_000, "<div class='menu'>x</div>" * 30_000, "<!--" * 50_000, "<li>x" * 40_000], ids=range(8))
def test_bad_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_density.main_text(page)
    assert time.process_time() - began < 6


def test_damaged_tags():
    text = html_density.main_text
    assert text("<p>one <b title=\"a>b\">two</b> three < four <p>five<a href='x") == "one two three < four\nfive"
    assert text('<p>one <i title="x>two</i> three</p><p>four') == "one two three\nfour"
    assert text("<p>a<!-- <p>b") == "a"
    assert text("<nav>menu <article><p>x</article> more</nav><p>body text") == "body text"


def plain_density(tree) -> list[tuple[str, float, float]]:
    """(tag, density, sum of the children's) in page order of nested (tag, items), by the formulas word for word."""

    def sums(node):
        chars = tags = link_chars = link_tags = 0
        for x in node[1]:
            if isinstance(x, str):
                chars += len(x.replace(" ", "").replace("\n", ""))
            else:
                c, t, lc, lt = sums(x)
                chars, tags = chars + c, tags + t + 1
                link_chars += c if x[0] == "a" else lc
                link_tags += lt + (x[0] == "a")
        return chars, tags, link_chars, link_tags

    whole = sums(tree)
    share = whole[2] / max(1, whole[0])

    def density(node):
        c, t, lc, lt = sums(node)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        value = c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)))
        return max(0.0, value / max(1e-9, math.log(base) if base > math.e else 1.0))

    found = []

    def walk(node):
        children = [x for x in node[1] if not isinstance(x, str)]
        found.append((node[0], density(node), sum(density(x) for x in children)))
        for x in children:
            walk(x)

    walk(tree)
    return found


@pytest.mark.parametrize("seed", range(20))
def test_densities_match_a_plain_version_on_small_trees(seed):
    rng = random.Random(seed)

    def tree(depth: int):
        items = []
        for _ in range(rng.randrange(1, 4)):
            items.append(" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))) if depth == 0 or rng.random() < 0.5 else tree(depth - 1))
        return rng.choice(["div", "div", "section", "a", "span"]), items

    def render(node):
        return f"<{node[0]}>" + "".join(x if isinstance(x, str) else render(x) for x in node[1]) + f"</{node[0]}>"

    body = ("body", [tree(3) for _ in range(3)])
    nodes = html_density.measure(html_density.parse(render(body)))
    want = plain_density(("#root", [body]))
    assert [x.tag for x in nodes] == [x[0] for x in want]
    for x, (_, density, sums) in zip(nodes, want, strict=True):
        assert x.density == pytest.approx(density) and x.sums == pytest.approx(sums)


def test_other_tokenizer_files_are_run_by_themselves(tmp_path):
    path = tokenizers_dir.path("byte_bpe_50k.json")
    assert packing.ranked_vocabulary(packing.tokenizer(path)) is not None
    with open(path) as file:
        model = json.load(file)
    for change in ({"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\d"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}, {**model["pre_tokenizer"], "use_regex": False}, {**model["pre_tokenizer"], "add_prefix_space": True}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(model | {"pre_tokenizer": change}))
        found = packing.tokenizer(str(other))
        assert packing.ranked_vocabulary(found) is None
    encode = packing.Encoder(str(other))
    assert encode.ranked is None
    assert encode(["ab 12"])[0] == b"".join(i.to_bytes(4, "little") for i in found.encode("ab 12").ids)


def test_null_keys_of_maps(spark):
    rows = [(None, "some text"), (None, None), (1, "some text"), (1, "some text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (bpe.round_trip(df), ogg.media_digest(df)):
        assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None", "None"]
        assert out.drop("doc_id").distinct().count() == 2
    packed = packing.best_fit(df).collect()
    assert sorted(str(r.doc_id) for r in packed) == ["1", "1", "None", "None"]


def test_a_bad_host_is_blocked_through_the_query(spark, tmp_path):
    pages, labels = [], []
    for i in range(400):
        host = ["good.example.org", "bad.spam.info", "Mixed.Example.co.uk", "worse.spam.info"][i % 4]
        pages.append((i, f"http://{host}/en/{i}", ""))
        labels.append((i, 0 if host.endswith("spam.info") or i % 12 == 2 else 1, 0))
    pages += [(1000, "http://bad.spam.info/other", ""), (1001, "http://new.spam.info/x", ""), (1002, None, ""), (1003, "no host", ""), (1004, "http://bad.spam.info/en/5", ""), (None, "http://www.example.com/en/1", ""), (1005, "ftp://a.net/es/1?x", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([*labels, (5, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op9_host_reputation(spark, str(tmp_path)).collect()
    verdicts = {r.page_id: (r.rule, r.verdict) for r in got}
    assert verdicts[1000] == (None, "block") and verdicts[1] == (None, "block")
    assert verdicts[0] == verdicts[2] == verdicts[1001] == verdicts[1002] == verdicts[1003] == (None, "allow")
    assert verdicts[None] == ("www.example.com/en/", "allow") and verdicts[1005] == ("net/es/", "block")
    base = duckdb.connect()
    for name in ("pages", "labels"):
        base.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = base.execute("select page_id, host, path, rule, verdict from (" + queries.oracle_sql()["op9_host_reputation"] + ")").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_page_outcomes_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/7"), (2, "http://a.b/en/8"), (3, None), (4, "http://a.b/7"), (5, "http://c.d/fr/7?x#y"), (6, "http://a.b/en/" + "9" * 30)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in urlrep.page_outcomes(pages, labels).collect()) == [("a.b", 0), ("a.b", 1), ("c.d", 1)]
    assert urlrep.page_outcomes(pages.limit(0), labels).count() == 0
    assert urlrep.filter_urls(pages, urlrep.page_outcomes(pages, labels.limit(0))).where(F.col("verdict") == "allow").count() == 6
