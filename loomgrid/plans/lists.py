"""Queries on lists of any length: line items as colours of charts, one chart for each supplier, and all embeddings as a thread list."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import grid as G
from loomgrid.operators import nearest as N
from loomgrid.operators import palette as P
from loomgrid.plans.registry import query, read

PARTS = ["p0", "p1", "p2"]
#: Entries on a lattice, so that many lie equally far from a point.
_T = "(select vec_id, round(embedding[1]::double * 8) / 8 p0, round(embedding[2]::double * 8) / 8 p1, round(embedding[3]::double * 8) / 8 p2 from embeddings)"
_I = """(select l_suppkey chart_id, l_orderkey * 10 + l_linenumber idx, l_quantity::bigint as count, round((l_quantity / 25 - 1) * 8) / 8 p0, round((l_discount * 20 - 1) * 8) / 8 p1, round((l_tax * 25 - 1) * 8) / 8 p2 from lineitem)"""
_U = f"(select chart_id, p0, p1, p2, ((p0 * 8 + 64) * 16384 + (p1 * 8 + 64) * 128 + p2 * 8 + 64)::bigint idx, sum(count)::bigint as count from {_I} i group by all)"
_E = "(select l_suppkey chart_id, l_orderkey * 10 + l_linenumber idx, min(l_quantity / 50) p0, min(l_discount * 10) p1, min(l_extendedprice / 100000) p2 from lineitem group by all)"


def d2_sql(a: str, b: str) -> str:
    return " + ".join(f"({a}.{p} - {b}.{p}) * ({a}.{p} - {b}.{p})" for p in PARTS)


def threads(spark, sf_dir):
    """(vec_id, p0, p1, p2): every embedding's first three components on a lattice."""
    return read(spark, sf_dir, "embeddings").select("vec_id", *(F.expr(f"rint(cast(embedding[{i}] as double) * 8) / 8").alias(p) for i, p in enumerate(PARTS)))


def colours(spark, sf_dir):
    """(chart_id, idx, count, p0, p1, p2) of line items on the same lattice."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey chart_id", "l_orderkey * 10 + l_linenumber idx", "cast(l_quantity as bigint) count", "rint((l_quantity / 25 - 1) * 8) / 8 p0", "rint((l_discount * 20 - 1) * 8) / 8 p1", "rint((l_tax * 25 - 1) * 8) / 8 p2"
    )


def palettes(spark, sf_dir):
    """(chart_id, idx, count, p0, p1, p2): the distinct colours of each chart, numbered by their places on the lattice."""
    number = F.expr("cast((p0 * 8 + 64) * 16384 + (p1 * 8 + 64) * 128 + p2 * 8 + 64 as long)")
    return colours(spark, sf_dir).groupBy("chart_id", *PARTS).agg(F.sum("count").alias("count")).withColumn("idx", number)


def prices(spark, sf_dir):
    """(chart_id, idx, p0, p1, p2) of line items by quantity, discount and price."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey chart_id", "l_orderkey * 10 + l_linenumber idx", "l_quantity / 50 p0", "l_discount * 10 p1", "l_extendedprice / 100000 p2").repartition("chart_id")  # one shuffle for lines and charts
    return rows.groupBy("chart_id", "idx").agg(*(F.min(p).alias(p) for p in PARTS))  # a line's number may stand twice


_NEAR = f"""with q as (select distinct p0, p1, p2 from {_I}), t as (select *, min(vec_id) over (partition by p0, p1, p2) = vec_id lone from {_T}),
    n as (select q.*, t.vec_id, {d2_sql("q", "t")} d from q, t where lone qualify row_number() over (partition by q.p0, q.p1, q.p2 order by d, vec_id) = 1)"""


@query(f"{_NEAR} select idx, vec_id as nearest, d as distance_sq from {_I} i join n using (p0, p1, p2)")
def j6_long_list(spark, sf_dir):
    """The nearest of all embeddings for each line item, among equals the first of the list."""
    return G.nearest(colours(spark, sf_dir), threads(spark, sf_dir), PARTS, "vec_id").select("idx", "nearest", "distance_sq")


@query(f"""with q as (select distinct p0, p1, p2 from {_I}), n as (select q.*, t.vec_id, row_number() over (partition by q.p0, q.p1, q.p2 order by {d2_sql("q", "t")}, vec_id) nth from q, {_T} t qualify nth <= 2)
    select i.idx, a.vec_id as first, b.vec_id as second from {_I} i join n a using (p0, p1, p2) join n b using (p0, p1, p2) where a.nth = 1 and b.nth = 2""")
def j8_long_list(spark, sf_dir):
    return G.two_nearest(colours(spark, sf_dir), threads(spark, sf_dir), PARTS, "vec_id").select("idx", "first", "second")


@query(f"""{_NEAR} select chart_id, row_number() over (partition by chart_id order by min(idx)) - 1 as new_idx, vec_id as ord, sum(count)::bigint as count from {_U} i join n using (p0, p1, p2) group by chart_id, vec_id""")
def a30_j7_thread_list(spark, sf_dir):
    """The colours of every chart on a list of as many threads as there are embeddings."""
    return P.onto_threads(palettes(spark, sf_dir), threads(spark, sf_dir).withColumnRenamed("vec_id", "ord"), "chart_id", PARTS)[1]


@query(f"""select a.chart_id, arg_min({{'a': a.idx, 'b': b.idx}}, {{'d': {d2_sql("a", "b")}, 'a': a.idx, 'b': b.idx}}).a as a, arg_min({{'a': a.idx, 'b': b.idx}}, {{'d': {d2_sql("a", "b")}, 'a': a.idx, 'b': b.idx}}).b as b,
    min({d2_sql("a", "b")}) as d2 from {_E} a join {_E} b on a.chart_id = b.chart_id and a.idx < b.idx group by 1""")
def j16_closest_of_charts(spark, sf_dir):
    """The closest pair of every chart at once."""
    return N.closest_pairs(prices(spark, sf_dir), PARTS, ["chart_id"])


@query()
def i11_merged(spark, sf_dir):
    """The palettes of all charts, after near colours merged: what each colour has become, and the cells of that."""
    return N.merged(palettes(spark, sf_dir), PARTS, ["chart_id"], 0.02).select("chart_id", "idx", "into", F.col("total").cast("long").alias("total"))
