"""Quality rules with risk-controlled thresholds.

Signals of a whole text (symbols a word, share of words in repeated windows, share of duplicate lines, letters a word) reject
above a cutoff.  The cutoffs are chosen on labelled documents: a candidate is admissible in a stratum if the chance of
seeing so few rejected good documents, were the true rate above the allowed one, is at most the level divided by all tests
made (an exact binomial tail).  Candidates of one signal are tested from the highest down until one fails, which needs no correction
among them; strata times signals are corrected for (Bonferroni).  Of the admissible ones the cutoff rules that catches most bad
documents, a good one lost counting as ten; a signal without gain never rejects.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Signal to the SQL of its value, larger is worse; all are bounded sums or ratios of the features.
SIGNALS = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}
#: The candidate cutoffs of each signal.
CUTOFFS = {
    "symbols": [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5],
    "repeats": [0.02, 0.05, 0.1, 0.15, 0.2],
    "dup_lines": [0.01, 0.02, 0.05, 0.1, 0.2],
    "word_length": [6.0, 8.0, 10.0, 12.0, 16.0, 24.0, 48.0],
}
#: The most that all rules together may reject of a stratum's good documents, and the chance of a wrong promise.
RISK = 0.05
LEVEL = 0.05
#: Bad documents that one good document is worth where an admissible cutoff is chosen.
WORTH = 10


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that the text has twice or more, the first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == n:
        return 0
    counts = Counter(grams)
    found, covered = 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            found += i + window - max(i, covered)
            covered = i + window
    return found


def measures(data: bytes) -> tuple[int, int, int, int, int]:
    """The features of one text's UTF-8 bytes; a word is a run of anything but the six ASCII white space bytes."""
    words = data.split()
    continued = len(data) - len(data.decode("utf-8", "replace")) if not data.isascii() else 0
    chars = sum(map(len, words)) - continued
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(words), chars, sum(data.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five features (long) of each whole text; a null text has none of anything.

    Columns of those names are replaced; others pass unchanged.
    """
    kept = [c for c in df.columns if c not in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            rows = np.array([measures(x) for x in common.encoded(batch.column(text))], np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], names=[*kept, *FEATURES])

    return df.mapInArrow(run, df.select(*kept, *(F.lit(0).cast("long").alias(c) for c in FEATURES)).schema)


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def tail(k: int, n: int, rate: float) -> float:
    """P(Binomial(n, rate) <= k): the p-value of ``the false rejection rate is above rate``.

    The regularised incomplete beta function at (n - k, k + 1), by its continued fraction: some hundred steps for any n.
    """
    if k >= n:
        return 1.0
    return _beta(n - k, k + 1, 1 - rate)


def _beta(a: float, b: float, x: float) -> float:
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15 or m > 100_000:
            return min(1.0, front * value)


class Chosen(NamedTuple):
    """(stratum, signal) to the cutoff.  ``apart`` names the strata decided each by itself; all others have the stratum ``REST``."""

    cutoffs: dict[tuple[str | None, str], float]
    apart: list[str]


#: The stratum of all that are decided as one.
REST = None


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", risk: float = RISK, level: float = LEVEL, max_strata: int = 256) -> Chosen:
    """The chosen cutoffs.

    ``labels`` has the key and ``quality`` (1 good, 0 bad; null or absent: not used).  Good and bad documents that pass the base
    rule are counted beyond each candidate in one aggregation; the driver gets the counts of at most ``max_strata`` strata and of the
    rest together.  A null stratum is one of its own; those beyond the ``max_strata`` with the most labels (the first by name among
    equals) are decided as one.  A key that is labelled more than once takes its worst label.
    """
    marks = labels.where("quality is not null").groupBy(key).agg(F.min("quality").alias("quality"))
    rows = measured.where(~base_failed()).select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *FEATURES).join(marks, key)
    named = [(s, c) for s, cs in CUTOFFS.items() for c in cs]
    beyond = [F.sum(F.when(F.expr(f"({SIGNALS[s]}) > {c!r}") & (F.col("quality") == q), 1).otherwise(0)).alias(f"{'bg'[q]}{i}") for i, (s, c) in enumerate(named) for q in (0, 1)]
    counted = common.scratch(rows.groupBy("stratum").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.count("*").alias("all"), *beyond))
    found = counted.orderBy(F.desc("all"), "stratum").limit(max_strata + 1).collect()
    apart = [r.stratum for r in found[:max_strata]]
    groups = [(r.stratum, r.asDict()) for r in found[:max_strata]]
    if len(found) > max_strata:
        rest = counted.join(F.broadcast(counted.sparkSession.createDataFrame([(x,) for x in apart], "stratum string")), "stratum", "left_anti")  # max_strata rows
        groups.append((REST, rest.agg(*(F.sum(c).alias(c) for c in counted.columns if c != "stratum")).first().asDict()))
    tests = max(1, len(groups)) * len(SIGNALS)
    chosen: dict[tuple[str | None, str], float] = {}
    for name, row in groups:
        for signal in SIGNALS:
            best = 0
            for i, (_, cutoff) in sorted(((i, x) for i, x in enumerate(named) if x[0] == signal), key=lambda x: -x[1][1]):
                if not row["good"] or tail(row[f"g{i}"], row["good"], risk / len(SIGNALS)) > level / tests:
                    break
                gain = row[f"b{i}"] - WORTH * row[f"g{i}"]
                if gain > best:
                    best, chosen[name, signal] = gain, cutoff
    return Chosen(chosen, apart)


def judge(measured: DataFrame, chosen: Chosen, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``.  A stratum without cutoffs is judged by the base rule alone.

    Strata that were not decided apart take the rest's cutoffs, if there was a rest.
    """
    value = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    rejected = F.lit(False)
    for signal, rule in SIGNALS.items():
        own = {s: cutoff for (s, by), cutoff in sorted(chosen.cutoffs.items(), key=repr) if by == signal}
        for cutoff in sorted(set(own.values())):
            fits = value.isin([s for s, c in own.items() if c == cutoff and s is not REST])
            if own.get(REST) == cutoff:
                fits = fits | ~value.isin(chosen.apart)
            rejected = rejected | (fits & F.expr(f"({rule}) > {cutoff!r}"))
    return measured.withColumns({"base_failed": base_failed(), "kept": ~(base_failed() | rejected)})


def quality_rules(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``df`` without its text, with the features, ``base_failed`` and ``kept`` of each row.

    The features are measured once and written to the shared folder; cutoffs and verdicts both read them there.
    """
    measured = common.scratch(features(df, text).drop(text))
    return judge(measured, cutoffs(measured, labels, key, stratum), stratum)


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps, with their own columns.

    Texts are measured twice, for the cutoffs and for the verdicts, so that they need not be stored or shuffled in between.
    """
    measured = common.scratch(features(df.select(key, text, stratum), text).drop(text))
    chosen = cutoffs(measured, labels, key, stratum)
    named = df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text"), F.col(stratum).alias("stratum"))
    return judge(features(named, "text"), chosen, "stratum").where("kept").select("row.*")
