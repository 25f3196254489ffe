"""What can be added to: overlays, stages, kinds of layers, and declared settings.  To add one, add a line to its table."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import grid, kernels, palette, planes, vision

# ---------------------------------------------------------------- overlays

#: Name to the lines that are laid over each of some pictures' light, (lines, 4) of x1, y1, x2, y2; they run in this order.
OVERLAYS: dict[str, Callable[[list[np.ndarray]], list[np.ndarray]]] = {
    "traced-lines": lambda lights: [np.array(t, float).reshape(-1, 4) for t in vision.traces(lights, 1.5, 2.0)],
    "strokes": lambda lights: [np.stack([s[c] for c in ENDS], axis=1) for s in vision.strokes_of(lights)],
}
ENDS = ("x1", "y1", "x2", "y2")


def overlays(light: DataFrame, names: list[str] | None = None, key: str = "image_id") -> DataFrame:
    """(key, overlay, x1, y1, x2, y2): the lines of the chosen overlays over each picture (y, x, light)."""
    chosen = [n for n in OVERLAYS if names is None or n in names]
    if names is not None and set(names) - set(OVERLAYS):
        raise ValueError(f"no overlay of the names {sorted(set(names) - set(OVERLAYS))}")

    def run(charts: list[planes.Chart]) -> list[dict[str, np.ndarray]]:
        lights = [c.grid(0.0)[..., 0] for c in charts]
        laid = [np.concatenate([np.zeros((0, 5))] + [np.insert(lines, 0, n, axis=1) for n, lines in enumerate(of)]) for of in zip(*(OVERLAYS[n](lights) for n in chosen), strict=True)] if chosen else [np.zeros((0, 5))] * len(charts)
        return [{"nth": of[:, 0].astype(np.int32)} | {c: of[:, i] for i, c in enumerate(ENDS, 1)} for of in laid]

    found = planes.by_chart(light, key, ["light"], run, "nth int, " + ", ".join(f"{c} double" for c in ENDS))
    name = F.element_at(F.array(*(F.lit(n) for n in chosen)) if chosen else F.array().cast("array<string>"), F.col("nth") + 1)
    return found.select(key, name.alias("overlay"), *ENDS)


# ---------------------------------------------------------------- kinds of layers

#: Kind to how two rows of a place become one: the upper's value where it has one, or the value of either.
LAYER_KINDS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "stitches": lambda lower, upper: palette.merged_layers(lower, upper, []),
    "mask": lambda lower, upper: grid.combine(lower, upper, "add", ["y", "x"]),
}


def merged(kind: str, lower: DataFrame, upper: DataFrame) -> DataFrame:
    if kind not in LAYER_KINDS:
        raise ValueError(f"no layer of the kind {kind}")
    return LAYER_KINDS[kind](lower, upper)


# ---------------------------------------------------------------- settings


class Setting(NamedTuple):
    """A declared setting: a whole number within bounds, a share from 0 to 1, a switch, or one of some words."""

    kind: str
    default: object
    low: float | None = None
    high: float | None = None
    words: tuple[str, ...] = ()


SETTINGS = {
    "longerSideStitches": Setting("whole", 200, 10, 1500),
    "colorCount": Setting("whole", 30, 2, 100),
    "quantizer": Setting("word", "latest", words=("original", "latest")),
    "edgeMode": Setting("word", "standard", words=("standard", "crisp", "crisp-plus")),
    "optimize": Setting("switch", True),
    "textureDensity": Setting("share", 0.5, 0, 1),
}


def _problem(text: Column, setting: Setting) -> Column:
    """Whether a given text breaks the setting's rule; a null is the default and breaks none."""
    if setting.kind == "word":
        bad = ~text.isin(*setting.words)
    elif setting.kind == "switch":
        bad = ~text.isin("true", "false")
    else:
        shape = r"^-?\d{1,9}$" if setting.kind == "whole" else r"^-?\d{1,9}(\.\d+)?$"
        value = F.when(text.rlike(shape), text).cast("double")
        bad = value.isNull() | (value < setting.low) | (value > setting.high)
    return text.isNotNull() & bad


def settings_problems(given: DataFrame, column: str = "settings") -> DataFrame:
    """``given`` with ``problems``: of a map of texts, the settings that break a rule, in the order of their declaration, then unknown ones by name."""
    asked = F.col(column)
    broken = F.array_compact(F.array(*(F.when(_problem(F.element_at(asked, n), s), F.lit(n)) for n, s in SETTINGS.items())))
    unknown = F.array_sort(F.array_except(F.map_keys(asked), F.array(*(F.lit(n) for n in SETTINGS))))
    return given.withColumn("problems", F.concat(broken, F.transform(unknown, lambda n: F.concat(F.lit("unknown "), n))))


def with_defaults(given: DataFrame, column: str = "settings") -> DataFrame:
    """``given`` with each declared setting's text, the default where none is given."""
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    full = F.create_map(*(x for n, s in SETTINGS.items() for x in (F.lit(n), F.coalesce(F.element_at(F.col(column), n), F.lit(text(s.default))))))
    return given.withColumn(column, full)


# ---------------------------------------------------------------- stages


def stages() -> dict[str, Callable[[kernels.Run], None]]:
    """The steps that make a chart, in order."""
    return dict(kernels.STAGES)
