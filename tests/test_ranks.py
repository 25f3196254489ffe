import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import ranks


def plain(values, at):
    found = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return found[at(len(found))] if found else None


GROUPS = {
    "one": [4.0],
    "ties": [2.0] * 50 + [1.0] * 49,
    "nulls": [None, None],
    "some": [None, 3.0, None, 1.0, 2.0],
    "spread": [math.ldexp(1.0, int(e)) * s for e in range(-1070, 1020, 7) for s in (1, -1)],
    "ends": [float("inf"), float("-inf"), float("nan"), 0.0, 1.5, -2.5, float("nan")] * 3,
    "nan": [float("nan")] * 5,
    "widest": [-1.7e308, 1.7e308, 0.0, 1e308],
    "close": (1.0 + np.arange(300) * 2.3e-16).tolist(),
    "normal": np.random.default_rng(5).normal(size=5000).round(3).tolist(),
}


@pytest.mark.parametrize("few", [1, 40, 100_000])
@pytest.mark.parametrize("share", [0.5, 0.999])
def test_kth_of_groups_of_any_size(spark, few, share):
    at = lambda n: math.floor((n - 1) * share)
    rows = spark.createDataFrame([(k, v) for k, vs in GROUPS.items() for v in vs], "g string, v double")
    got = {r.g: r.v for r in ranks.kth(rows, ["g"], "v", lambda n: F.floor((n - 1) * share), few).collect()}
    want = {k: plain(vs, at) for k, vs in GROUPS.items() if k != "nulls"}
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or math.isnan(got[k]) and math.isnan(want[k]) for k in want), {k: (got[k], want[k]) for k in want if got[k] != want[k]}


def test_kth_keeps_types_names_and_long_values(spark):
    big = [2**62 + i for i in range(500)]  # equal as doubles, and still told apart
    rows = spark.createDataFrame([(None, v) for v in big] + [(1, v) for v in (5, 7, 9, 11)], "_x int, _k long")
    found = ranks.upper_median(rows, ["_x"], "_k")
    assert dict(found.dtypes) == {"_x": "int", "_k": "bigint"}
    assert ranks.kth(rows.where("_x = 1"), ["_x"], "_k", lambda n: n - 1, 1).first()[1] == 11
    got = {r[0]: r[1] for r in ranks.kth(rows.fillna(0, ["_x"]), ["_x"], "_k", lambda n: F.floor(n / 2), 100).collect()}
    assert got == {0: big[250], 1: 9}
    assert ranks.upper_median(rows.limit(0), ["_x"], "_k").count() == 0


def test_kth_spreads_a_large_group(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 200_003).alias("v"))
    assert ranks.kth(rows, ["g"], "v", lambda n: F.floor(n * 0.3), 1000).first().v == sorted(i * 7919 % 200_003 for i in range(200_000))[60_000]


def test_budgets(spark):
    lists = {"a": [3.0, 5.0, 2.0, 1.0], "b": [7.0, None, 6.0], "c": [], "d": [0.0] * 40, None: [1.0, 6.0]}
    rows = spark.createDataFrame([(k, i, v) for k, vs in lists.items() for i, v in enumerate(vs)], "k string, o int, v double")
    want = set()
    for k, vs in lists.items():
        used = 0.0
        for i, v in enumerate(vs):
            if v is not None and used + v <= 6:
                used += v
                want.add((k, i, v))
    got = [tuple(r) for r in ranks.budgeted(rows, ["k"], ["o"], "v", 6.0).collect()]
    assert set(got) == want and len(got) == len(want)
    assert ranks.budgeted(rows.where("false"), ["k"], ["o"], "v", 6.0).count() == 0
