"""Small regions recoloured on the graph of regions: nodes are regions, edges shared borders; cells take no part in the rounds.

Regions are decided in the order of their first cells, and each reads what its neighbours have become.  Only a small region can change, so
one waits for no more than the small neighbours that begin before it: a round decides all that wait for none, of all charts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.grid import CROSS, kept, neighbours, regions


def _table(rows: DataFrame) -> DataFrame:
    """``rows`` kept, and never broadcast: places and regions take a few bits a row in a file, by which Spark would take millions for short."""
    return kept(rows).hint("merge")


def graph(cells: DataFrame, key: list[str], parts: list[str], find=regions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((key, y, x, label, region), nodes (key, region, label, area, parts: the cells' means), edges (key, region, other), both ways)."""
    found = _table(find(cells, key).select(*key, "y", "x", "label", "region"))
    with_parts = found.join(cells.select(*key, "y", "x", *parts), [*key, "y", "x"])
    nodes = with_parts.groupBy(*key, "region", "label").agg(F.count("*").alias("area"), *(F.avg(p).alias(p) for p in parts))
    edges = neighbours(found, key, CROSS, ["region"]).where("n_region <> region").select(*key, "region", F.col("n_region").alias("other")).distinct()
    return found, nodes, edges


def recoloured(cells: DataFrame, palettes: DataFrame, key: list[str], parts: list[str], small: int, find=regions) -> DataFrame:
    """(key, y, x, label): regions of at most ``small`` cells take the neighbouring label nearest to their mean colour, lower label on a tie.

    ``cells`` has (key, y, x, label, parts), ``palettes`` (key, idx, parts).  A region without neighbours stays; so do empty cells.
    """
    found, nodes, edges = graph(cells, key, parts, find)
    nodes = _table(nodes)
    little = nodes.where(F.col("area") <= small)
    edges = _table(edges.join(little.select(*key, "region"), [*key, "region"], "left_semi"))
    waits = _table(edges.where("other < region").join(little.select(*key, F.col("region").alias("other")), [*key, "other"], "left_semi"))
    left = _table(little.join(edges.select(*key, "region").distinct(), [*key, "region"], "left_semi").select(*key, "region", *parts))
    now = _table(nodes.select(*key, F.col("region").alias("other"), F.col("label").alias("held")))
    colours = palettes.select(*key, F.col("idx").alias("held"), *(F.col(p).alias(f"_{p}") for p in parts))
    gap = sum(((F.col(p) - F.col(f"_{p}")) * (F.col(p) - F.col(f"_{p}")) for p in parts[1:]), (F.col(parts[0]) - F.col(f"_{parts[0]}")) * (F.col(parts[0]) - F.col(f"_{parts[0]}")))
    while not left.isEmpty():
        undone = left.select(*key, F.col("region").alias("other"))
        held_up = waits.join(undone, [*key, "other"], "left_semi").select(*key, "region").distinct()
        ready = left.join(held_up, [*key, "region"], "left_anti")
        around = ready.join(edges, [*key, "region"]).join(now, [*key, "other"]).join(colours, [*key, "held"])
        told = _table(around.groupBy(*key, "region").agg(F.min(F.struct(gap.alias("d"), "held")).alias("n")).select(*key, F.col("region").alias("other"), F.col("n.held").alias("new")))
        now = _table(now.join(told, [*key, "other"], "left").select(*key, "other", F.coalesce("new", "held").alias("held")))
        left = _table(left.join(told.withColumnRenamed("other", "region"), [*key, "region"], "left_anti"))
    filled = found.join(now.withColumnRenamed("other", "region"), [*key, "region"]).select(*key, "y", "x", F.col("held").cast("int").alias("label"))
    return filled.union(cells.where("label is null").select(*key, "y", "x", F.lit(None).cast("int").alias("label")))
