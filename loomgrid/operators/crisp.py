"""Labels for cells on an edge: two colours seen in a cell, the palette colours that they admit, repair, and the palette's last rounds.

Evidence is a row for each cell and mode: (chart_id, y, x, mode, ok_l, ok_a, ok_b, coverage).  Palettes have at most 100 colours, so
each chart's goes along as one array and a mode finds its nearest colour without a join of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions import colour
from loomgrid.operators import grid

LAB = ("ok_l", "ok_a", "ok_b")
CELL = ["chart_id", "y", "x"]
#: What an uncovered part of a cell costs beside a squared colour distance, and the most rounds of the palette.
BETA, ROUNDS = 0.15, 3


def _nearest(entries: Column) -> Column:
    """The nearest entry of an array of (idx, ok_l, ok_a, ok_b) to the row's colour as (d, idx); the first among equals."""
    return F.array_min(F.transform(entries, lambda p: F.struct(colour.distance_sq(tuple(p[c] for c in LAB), tuple(F.col(c) for c in LAB)).alias("d"), p["idx"].alias("idx"))))


def admissible(evidence: DataFrame, palette: DataFrame, alpha: float = 1.0, beta: float = BETA) -> DataFrame:
    """(cell, label, cost, mode): the colours nearest to a cell's covered modes, each at its cheapest mode.

    A cost is alpha times the squared distance and beta times the share that the mode leaves uncovered.
    """
    entries = palette.groupBy("chart_id").agg(F.collect_list(F.struct("idx", *LAB)).alias("entries"))
    near = evidence.where("coverage > 0").join(entries, "chart_id").withColumn("n", _nearest(F.col("entries")))
    costs = near.select(*CELL, "mode", F.col("n.idx").alias("label"), (alpha * F.col("n.d") + beta * (1 - F.col("coverage"))).alias("cost"))
    return costs.groupBy(*CELL, "label").agg(F.min(F.struct("cost", "mode")).alias("m")).select(*CELL, "label", "m.cost", "m.mode")


def best(sets: DataFrame) -> DataFrame:
    """(cell, label) of the cheapest admissible colour, the first mode's among equals."""
    return sets.groupBy(*CELL).agg(F.min(F.struct("cost", "mode", "label")).alias("m")).select(*CELL, "m.label")


def repaired(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """``cells`` with the label replaced by the cheapest admissible one where it is none; cells without evidence keep theirs."""
    allowed = sets.groupBy(*CELL).agg(F.min(F.struct("cost", "mode", "label")).alias("_m"), F.collect_set("label").alias("_in"))
    joined = cells.join(allowed, CELL, "left")
    stays = F.col("_in").isNull() | F.col("label").isNull() | F.array_contains("_in", F.col("label"))
    return joined.withColumn("label", F.when(stays, F.col("label")).otherwise(F.col("_m.label"))).select(cells.columns)


def _recoloured(cells: DataFrame, palette: DataFrame, sets: DataFrame, evidence: DataFrame) -> DataFrame:
    """The palette with each colour the mean of its cells, a cell on an edge counted at the mode that supports its label."""
    modes = sets.join(evidence, [*CELL, "mode"]).select(*CELL, "label", *(F.col(c).alias(f"m_{c}") for c in LAB))
    seen = cells.where("label is not null").join(modes, [*CELL, "label"], "left")
    mean = seen.groupBy("chart_id", F.col("label").alias("idx")).agg(*(F.avg(F.coalesce(f"m_{c}", c)).alias(c) for c in LAB))
    new = colour.with_rgb(mean, tuple(F.col(c) for c in LAB), ("n_r", "n_g", "n_b")).drop(*LAB)
    return palette.join(new, ["chart_id", "idx"], "left").select("chart_id", "idx", *(F.coalesce(f"n_{c}", c).alias(c) for c in "rgb"))


def finalised(cells: DataFrame, palette: DataFrame, evidence: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(cells, palette) after at most ``rounds`` rounds of repair and recolouring; a chart stops after a round that repairs nothing.

    ``cells`` has the cell, its own colour and label (null: empty), ``palette`` chart_id, idx, r, g, b.  Each round is checkpointed, so
    a lost executor costs one.
    """
    evidence = grid.kept(evidence.select(*CELL, "mode", *LAB, "coverage"))
    cells, palette = grid.kept(cells), grid.kept(palette.select("chart_id", "idx", *"rgb"))
    going = palette.select("chart_id").distinct()
    for _ in range(rounds):
        mine, theirs = (x.join(going, "chart_id", "left_semi") for x in (cells, palette))
        sets = grid.kept(admissible(evidence, colour.with_oklab(theirs)))
        mended = grid.kept(repaired(mine, sets))
        before = mine.select(*CELL, F.col("label").alias("_was"))
        after = going.join(mended.join(before, CELL).where("label <> _was").select("chart_id").distinct(), "chart_id", "left_semi")
        coloured = _recoloured(mended, theirs, sets, evidence)
        cells = grid.kept(mended.unionByName(cells.join(going, "chart_id", "left_anti")))
        palette, going = grid.kept(coloured.unionByName(palette.join(going, "chart_id", "left_anti"))), grid.kept(after)
    return cells, palette
