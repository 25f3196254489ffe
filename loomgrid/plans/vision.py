"""Queries with picture kernels; without SQL twins, their kernels are tested against plain versions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions import colour
from loomgrid.operators import kernels as K
from loomgrid.operators import planes
from loomgrid.operators import vision as V
from loomgrid.plans.grid import _LIGHT, _P, _oklab_sql, pixels
from loomgrid.plans.registry import query


def mapped(rows: DataFrame, function, of: list[str], names: list[str]) -> DataFrame:
    """``rows`` with columns that a function of an (n, columns) array gives, over Arrow batches."""

    def run(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(function(np.stack([c.to_numpy(float) for c in columns], axis=1)), columns=names)

    udf = F.pandas_udf(run, ", ".join(f"{n} double" for n in names))
    return rows.withColumn("_m", udf(*of)).select(*rows.columns, *(F.col(f"_m.{n}").alias(n) for n in names))


@query()
def p5_gamut_map(spark, sf_dir):
    """Each distinct colour at twice its chroma, mapped back into sRGB."""
    lab = colour.with_oklab(pixels(spark, sf_dir).select("r", "g", "b").distinct())
    wide = lab.select("r", "g", "b", "ok_l", *((F.col(c) * 2).alias(c) for c in ("ok_a", "ok_b")))
    return mapped(wide, V.gamut_map, ["ok_l", "ok_a", "ok_b"], ["red", "green", "blue"])


@query()
def p8_okhsl(spark, sf_dir):
    return mapped(pixels(spark, sf_dir).select("r", "g", "b").distinct(), V.okhsl, ["r", "g", "b"], ["hue", "saturation", "lightness"])


def _lab(spark, sf_dir):
    return colour.with_oklab(pixels(spark, sf_dir)).select("image_id", "y", "x", "ok_l", "ok_a", "ok_b")


def _light(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "y", "x", colour.luminance(F.col("r"), F.col("g"), F.col("b")).cast("double").alias("light"))


def _cells(values: np.ndarray, names: list[str]) -> pd.DataFrame:
    y, x = np.indices(values.shape[:2])
    return pd.DataFrame({"cy": y.ravel(), "cx": x.ravel()} | {n: values[..., i].ravel() for i, n in enumerate(names)})


@query()
def w8_edge_evidence(spark, sf_dir):
    names = ["right", "down", "down_right", "down_left"]
    return V.per_picture(_lab(spark, sf_dir), lambda lab: _cells(V.edge_evidence(lab, 12, 9), names), ["ok_l", "ok_a", "ok_b"], "cy long, cx long, " + ", ".join(f"{n} double" for n in names))


def _derivatives_sql() -> str:
    """The same taps, applied along x and then along y, the edges' values repeated."""
    taps = V.gaussian_taps(1.5)
    r = len(taps[0]) // 2
    rows = ", ".join(f"({i - r}, {', '.join(f'{float(taps[k][2 * r - i])!r}::double' for k in range(3))})" for i in range(2 * r + 1))
    along = f"select p.image_id, p.y, p.x, {', '.join(f'sum(k{i} * q.v) v{i}' for i in range(3))} from (select l.*, k.*, least(greatest(x + d, 0), 47) nx from l, k) p join l q on q.image_id = p.image_id and q.y = p.y and q.x = nx group by all"
    down = {"dx": "k0 * q.v1", "dy": "k1 * q.v0", "dxx": "k0 * q.v2", "dxy": "k1 * q.v1", "dyy": "k2 * q.v0"}
    sums = ", ".join(f"round(sum({e}), 7) + 0.0 {n}" for n, e in down.items())
    return f"""with l as (select image_id, y, x, {_LIGHT}::double v from {_P} p), k(d, k0, k1, k2) as (values {rows}), h as ({along})
    select p.image_id, p.y cy, p.x cx, {sums} from (select h.*, k.*, least(greatest(y + d, 0), 35) ny from h, k) p join h q on q.image_id = p.image_id and q.x = p.x and q.y = ny group by all"""


@query(_derivatives_sql())
def w9_gaussian_derivatives(spark, sf_dir):
    def run(a: np.ndarray) -> pd.DataFrame:
        d = V.gaussian_derivatives(a[..., 0], 1.5)
        return _cells(np.round(np.stack(list(d.values()), axis=2), 7) + 0.0, [f"d{k}" for k in d])

    return V.per_picture(_light(spark, sf_dir), run, ["light"], "cy long, cx long, dx double, dy double, dxx double, dxy double, dyy double")


@query(f"""with p as (select image_id, y, x, ok_l, ok_a, ok_b from {_oklab_sql(_P)}), o as materialized (select p.*, (dy + 1) * 3 + dx + 1 - (case when dy * 3 + dx < 0 then 0 else 1 end) * (case when dy = 0 and dx = 0 then 5 else 0 end) k, y + dy ny, x + dx nx from p, (select a.v dy, b.v dx from range(-1, 2) a(v), range(-1, 2) b(v))),
    s as materialized (select o.image_id, o.y, o.x, o.k, q.ok_l, q.ok_a, q.ok_b from o join p q on q.image_id = o.image_id and q.y = ny and q.x = nx),
    d as (select a.image_id, a.y, a.x, a.k, any_value(a.ok_l) ok_l, any_value(a.ok_a) ok_a, any_value(a.ok_b) ok_b, sum(sqrt(pow(a.ok_l - b.ok_l, 2) + pow(a.ok_a - b.ok_a, 2) + pow(a.ok_b - b.ok_b, 2))) total from s a join s b on a.image_id = b.image_id and a.y = b.y and a.x = b.x group by all)
    select image_id, y cy, x cx, round(ok_l, 7) + 0.0 ok_l, round(ok_a, 7) + 0.0 ok_a, round(ok_b, 7) + 0.0 ok_b from d qualify row_number() over (partition by image_id, y, x order by round(total, 12), k) = 1""")
def w10_medoid_filter(spark, sf_dir):
    return V.per_picture(_lab(spark, sf_dir), lambda lab: _cells(np.round(K.medoid_filter(lab), 7) + 0.0, ["ok_l", "ok_a", "ok_b"]), ["ok_l", "ok_a", "ok_b"], "cy long, cx long, ok_l double, ok_a double, ok_b double")


@query()
def i23_ridges(spark, sf_dir):
    return V.per_picture(_light(spark, sf_dir), lambda a: V.ridges(a[..., 0], 1.5, 2.0), ["light"], "y long, x long, strength double, ny double, nx double")


@query()
def i24_i26_traced_lines(spark, sf_dir):
    def run(charts: list[planes.Chart]) -> list[dict[str, np.ndarray]]:
        found = V.traces([c.grid(0.0)[..., 0] for c in charts], 1.5, 2.0)
        return [dict(zip(("x1", "y1", "x2", "y2"), np.array(t, np.int64).reshape(-1, 4).T, strict=True)) for t in found]

    return planes.by_chart(_light(spark, sf_dir), "image_id", ["light"], run, "x1 long, y1 long, x2 long, y2 long")


@query()
def i25_w13_strokes(spark, sf_dir):
    return V.per_picture(_light(spark, sf_dir), lambda a: V.strokes(a[..., 0]), ["light"], "x1 double, y1 double, x2 double, y2 double, strength double")


@query()
def i18_hand_drawn(spark, sf_dir):
    """The toned picture against the thresholds of scattered marks, each picture with a seed of its own."""

    def run(a: np.ndarray) -> pd.DataFrame:
        light = a[..., 0] / 255
        return _cells((light > V.hand_drawn(light.shape[1], light.shape[0], seed=int(light.sum())))[..., None].astype(int), ["label"])

    return V.per_picture(_light(spark, sf_dir), run, ["light"], "cy long, cx long, label int")


@query()
def i19_two_modes(spark, sf_dir):
    """Each 6 × 6 block's two colours, how many of its pixels take the second, and how clearly they part."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(cy=rows["y"] // 6, cx=rows["x"] // 6).sort_values(["cy", "cx", "y", "x"], ignore_index=True)
        size = rows.groupby(["cy", "cx"])["y"].transform("size")
        found = []
        for n, same in rows.groupby(size):  # blocks of as many pixels, all of a picture at once
            values = lambda *c, n=n, same=same: same[list(c)].to_numpy(float).reshape(-1, n, len(c))
            _, labels, sure = V.modes_of_cells(values("ok_l", "ok_a", "ok_b"), np.ones((len(same) // n, n)), values("x", "y") % 6 / 6)
            found.append(same.iloc[::n][["image_id", "cy", "cx"]].assign(second=labels.sum(axis=1), confidence=sure))
        return pd.concat(found)

    return _lab(spark, sf_dir).groupBy("image_id").applyInPandas(run, "image_id long, cy long, cx long, second long, confidence double")


@query()
def i13_a23_reserved_hues(spark, sf_dir):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lab = rows[["ok_l", "ok_a", "ok_b"]].to_numpy()
        labels, palette = K.quantize(lab, 8)
        kept = K.reserve_hues(lab, labels, palette)
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "idx": range(len(kept)), "ok_l": kept[:, 0], "ok_a": kept[:, 1], "ok_b": kept[:, 2]})

    return _lab(spark, sf_dir).groupBy("image_id").applyInPandas(run, "image_id long, idx int, ok_l double, ok_a double, ok_b double")


@query()
def i10_weighted_kmeans(spark, sf_dir):
    """Colours of each picture clustered once each, weighted by how often they occur."""
    counted = _lab(spark, sf_dir).groupBy("image_id", "ok_l", "ok_a", "ok_b").agg(F.count("*").alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ok_l", "ok_a", "ok_b"])
        labels, _ = K.kmeans(rows[["ok_l", "ok_a", "ok_b"]].to_numpy(), 6, rows["n"].to_numpy(float))
        mass = np.bincount(labels, weights=rows["n"])
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "idx": range(len(mass)), "cells": mass.astype(int)})

    return counted.groupBy("image_id").applyInPandas(run, "image_id long, idx int, cells long")
