"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton.  A text is parsed against each automaton into longest matches: a
phrase goes on while it occurs in that language's text, and where it ends the next begins.  Phrases times the logarithm of
the learned length, a character, estimate the cross entropy; the language with the least wins.

The automata are learned on a bounded sample (``docs_per_lang`` pieces of ``piece_chars`` characters for each of at most
``max_langs`` languages); predictions cover whole texts.  Each language has an alphabet of its own, so one script does not
crowd out another.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm import common

UNKNOWN = "und"
#: A text is parsed in blocks of so many characters, each from the automaton's root.
BLOCK = 1024


class Model(NamedTuple):
    """Per language its letters, their classes, its automaton's edges (from, character class, to), states and learned characters."""

    langs: list[str]
    letters: list[np.ndarray]
    classes: list[np.ndarray]
    edges: list[np.ndarray]
    states: list[int]
    learned: list[int]


def normal(text: str) -> str:
    """Lower case with each run of anything but letters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(codes: list[int]) -> tuple[np.ndarray, int]:
    """The suffix automaton of a sequence: its edges as (from, code, to) and how many states it has."""
    nexts: list[dict[int, int]] = [{}]
    links, depths, last = [-1], [0], 0
    for c in codes:
        new = len(nexts)
        nexts.append({})
        depths.append(depths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if depths[q] == depths[p] + 1:
                links[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                depths.append(depths[p] + 1)
                links.append(links[q])
                links[q] = links[new] = copy
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = links[p]
        last = new
    return np.array([(s, c, t) for s, m in enumerate(nexts) for c, t in m.items()], np.int32).reshape(-1, 3), len(nexts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = 120, piece_chars: int = 400, max_langs: int = 64, alphabet: int = 254) -> Model:
    """Learn from rows with a text and a language: per language the pieces of least hash, each from a place that its hash names.

    Languages beyond the ``max_langs`` with the most rows are left out; a language's letters beyond its ``alphabet`` most frequent count
    as one, and one that its pieces lack matches nothing.  Copies of a text count once.  A language with less than ``piece_chars`` characters is normalised as if it had so many.
    No labelled row gives a model without languages.
    """
    labelled = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null and t <> ''")
    h = F.xxhash64("t")
    top = labelled.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct(h).alias("texts")).orderBy(F.desc("n"), "l").limit(max_langs).collect()
    if not top:
        return Model([], [], [], [], [], [])
    pieces = labelled.select("l", h.alias("h"), F.substring("t", F.expr(f"cast(1 + pmod(xxhash64(t), greatest(1, length(t) - {piece_chars - 1})) as int)"), F.lit(piece_chars)).alias("t"))
    # the share of all hashes below which a language's pieces lie: some four times as many as are taken, and more where that is too few
    share = {r.l: 4 * docs_per_lang / max(1, r.texts) for r in top}
    while True:
        bounds = F.create_map(*(F.lit(x) for l, q in share.items() for x in (l, (1 << 63) - 1 if q >= 1 else int(q * (1 << 64)) - (1 << 63))))
        few = pieces.where(F.col("h") <= F.element_at(bounds, F.col("l")))
        least = few.select("l", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= docs_per_lang)
        taken = {r.l: r.n for r in least.groupBy("l").agg(F.count("*").alias("n")).collect()}
        short = [l for l, q in share.items() if q < 1 and taken.get(l, 0) < docs_per_lang]
        if not short:
            break
        share |= {l: 8 * share[l] for l in short}
    best = few.join(F.broadcast(least.select("l", "h")), ["l", "h"]).dropDuplicates(["l", "h"])  # docs_per_lang rows a language
    rows = best.select("l", "h", "t").collect()
    texts = {x: " ".join(normal(r.t) for r in sorted((r for r in rows if r.l == x), key=lambda r: (r.h, r.t))) for x in sorted(share)}
    letters, classes, built = [], [], []
    for t in texts.values():
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        seen, counts = np.unique(points[points != 32], return_counts=True)
        letters.append(seen)
        classes.append(np.empty(len(seen), np.int64))
        classes[-1][np.argsort(-counts, kind="stable")] = np.minimum(np.arange(len(seen)), alphabet) + 2
        built.append(automaton(_classes(seen, classes[-1])[points].tolist()))
    return Model(list(texts), letters, classes, [e for e, _ in built], [n for _, n in built], [max(2, piece_chars, len(t)) for t in texts.values()])


_ALPHA: list[np.ndarray] = []


def _classes(letters: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """Code point to class: 0 for anything but a letter, 1 for a letter that is not among these, and from 2 on these, each its own or as given."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    table = _ALPHA[0].astype(np.uint16 if len(letters) < 65_000 else np.int32)
    table[letters] = np.arange(2, len(letters) + 2) if classes is None else classes
    return table


_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, own, steps, roots) over all languages.

    A code point's class is 0 for anything but a letter, 1 for a letter that no language has, or its place among all letters;
    ``own[language, class]`` is its class there.  A state is where its row begins in ``steps``, which has at row + class the next
    state times four plus the phrases that end there.
    """
    key = zlib.crc32(b"".join(e.tobytes() for e in model.edges), zlib.crc32(repr((model.langs, [(x.tolist(), c.tolist()) for x, c in zip(model.letters, model.classes, strict=True)])).encode()))
    if key not in _TABLES:
        every = np.unique(np.concatenate([np.zeros(0, np.uint32), *model.letters]))
        own = np.ones((len(model.langs), len(every) + 2), np.int64)
        own[:, 0] = 0
        widths = [max(2, *c.tolist(), 2) + 1 for c in model.classes]
        roots = np.concatenate(([0], np.cumsum([n * w for n, w in zip(model.states, widths, strict=True)]))).astype(np.int64)
        steps = np.empty(int(roots[-1]), np.int64 if roots[-1] >= 1 << 29 else np.int32)
        for i, (base, n, width, edges) in enumerate(zip(roots.tolist(), model.states, widths, model.edges, strict=False)):
            own[i, 2 + np.searchsorted(every, model.letters[i])] = model.classes[i]
            to = np.full((n, width), -1, np.int64)
            to[edges[:, 0], edges[:, 1]] = edges[:, 2]
            there = (base + to * width) * 4
            fresh = np.where(to[0] >= 0, there[0] + 1, base * 4 + 2)  # the phrase ends; the character begins one, or is one
            part = steps[base : base + n * width].reshape(n, width)
            part[:] = np.where(to >= 0, there, fresh)
            part[0] = np.where(to[0] >= 0, there[0], base * 4 + 1)
        _TABLES.clear()
        _TABLES[key] = (_classes(every), own, steps, roots[:-1])
    return _TABLES[key]


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of each text against each language, characters of each text after normalisation; 0: no letter)."""
    classes, own, steps, roots = tables(model)
    langs = len(roots)
    lower = [t.lower() for t in texts]
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lower), np.int64, len(lower)))
    codes = classes[np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)]
    # one space for a run of other characters, none at a text's start or end
    gap = codes == 0
    starts = np.ones(len(codes), bool)
    starts[1:] = owner[1:] != owner[:-1]
    gap[1:] &= (codes[:-1] == 0) | starts[1:]
    codes, owner = codes[~gap], owner[~gap]
    last = np.ones(len(codes), bool)
    last[:-1] = owner[1:] != owner[:-1]
    keep = ~(last & (codes == 0))
    codes, owner = codes[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    blocks = -(-sizes // BLOCK)
    text_of = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = starts[text_of] + nth * BLOCK
    size = np.minimum(sizes[text_of] - nth * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")
    first, size, text_of = first[order], size[order], text_of[order]
    n = len(order)
    state = np.repeat(roots[:, None], n, axis=1).astype(np.int64)
    ended = np.zeros((langs, n), np.int64)
    active = n - np.searchsorted(size[::-1], np.arange(int(size[0]) if n else 0), side="right")
    for t, m in enumerate(active.tolist()):
        moved = steps[state[:, :m] + own[:, codes[first[:m] + t]]]
        ended[:, :m] += moved & 3
        state[:, :m] = moved >> 2
    ended += state != roots[:, None]
    found = np.stack([np.bincount(text_of, weights=row, minlength=len(texts)) for row in ended], axis=1) if langs else np.zeros((len(texts), 0))
    return found.reshape(len(texts), langs), sizes


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Per text the language of least normalised phrases (the first by name among equals) and a score.

    The score is how far the best estimate lies below the second, 0 to 1; 1 if only one language was learned.
    """
    found, sizes = phrases(model, [t or "" for t in texts]) if texts and model.langs else (np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64))
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    rates = found * np.log2(np.array(model.learned, np.float64)) / np.maximum(sizes, 1)[:, None]
    best = rates.argmin(axis=1)
    ordered = np.sort(rates, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.clip(1 - ordered[:, 0] / ordered[:, 1], 0, 1) if len(model.langs) > 1 else np.ones(len(texts))
    score = np.where(sizes > 0, np.nan_to_num(score), 0.0)
    return [model.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist(), strict=True)], score


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language of each whole text and its score.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned.  Columns of those names are replaced;
    others pass unchanged; equal texts get equal values.
    """
    kept = [c for c in df.columns if c not in (lang_pred, score)]
    shared = df.sparkSession.sparkContext.broadcast(model._replace(edges=[e.copy() for e in model.edges]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text, 1 << 20):
            langs, scores = predict_texts(shared.value, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores)], names=[*kept, lang_pred, score])

    return df.mapInArrow(run, df.select(*kept, F.lit("").alias(lang_pred), F.lit(0.0).alias(score)).schema)


def held_out(key: str = "doc_id"):
    """The fold rule: crc32 of the id's text modulo 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def entropy_bits(model: Model, text: str) -> dict[str, float]:
    """The estimated bits a character of one text against each language."""
    found, sizes = phrases(model, [text])
    return {x: float(found[0, i]) * math.log2(model.learned[i]) / max(1, int(sizes[0])) for i, x in enumerate(model.langs)}
