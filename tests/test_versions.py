"""Runs and XOR deltas of planes against plain dictionaries."""

import random

from pyspark.sql import functions as F

from loomgrid.operators import versions as V


def test_any_version_comes_back_from_its_deltas(spark):
    rng = random.Random(6)
    planes: dict = {}
    for chart in (1, 2):
        now: dict = {}
        for version in range(6):
            now = dict(now)
            for _ in range(30):  # strokes, some of them wiping
                y, x, n, v = rng.randrange(4), rng.randrange(-3, 30), rng.randrange(1, 9), rng.choice([None, 0, 1, 2, 7])
                for i in range(n):
                    now[y, x + i] = v
            if version == 3:
                now = {p: v for p, v in now.items() if p[0] != 2}  # a line without rows
            planes[chart, version] = now
    rows = [(c, n, y, x, v) for (c, n), cells in planes.items() for (y, x), v in cells.items()]
    table = spark.createDataFrame(rows, "chart long, version int, y int, x int, label int")
    history = V.deltas(V.changes(table, ["chart", "version"], "label"), ["chart"], "version").cache()

    def held(df):
        return {(r.chart, r.y, r.x): r.value for r in V.cells(df, ["chart"]).collect()}

    def want(version):
        return {(c, y, x): v for (c, n), cells in planes.items() if n == version for (y, x), v in cells.items() if v is not None}

    for version in range(6):
        assert held(V.at_version(history, ["chart"], "version", version)) == want(version)
    short = V.compacted(history, ["chart"], "version", 3)
    assert {r.version for r in short.select("version").distinct().collect()} == {3, 4, 5}
    assert [held(V.at_version(short, ["chart"], "version", n)) for n in (3, 4, 5)] == [want(n) for n in (3, 4, 5)]
    # a step back applies the last delta once more
    last = V.at_version(history, ["chart"], "version", 5).union(history.where("version = 5").drop("version"))
    assert held(V.folded(last, ["chart"])) == want(4)
    for r in V.runs(history.where("version = 2").drop("version"), ["chart"]).collect():
        a, b = planes[r.chart, 2], planes[r.chart, 1]
        coded = lambda cells, x, r=r: 0 if cells.get((r.y, x)) is None else cells[r.y, x] + 1
        assert all(coded(a, x) ^ coded(b, x) == r.value for x in range(r.x, r.x + r.n))
    assert V.changes(table.where(F.lit(False)), ["chart", "version"], "label").count() == 0
