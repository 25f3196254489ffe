"""Queries on data sources: every supplier's chart and every brand's threads written as files to the shared folder and read from there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import grid as G
from loomgrid.plans.files import _THREADS, COLOURS, _palette, _plain, _threads
from loomgrid.plans.grid import _C, H, W
from loomgrid.plans.registry import query
from loomgrid.sources import formats

PER_PAGE, OVERLAP = (20, 20), 3
#: Pages across and down of a chart of 48 x 36 cells, 20 x 20 a page, 3 shown twice.
_PAGES = f"""(select s_suppkey chart_id, chr((65 + v.n)::int) || (h.n + 1) || '.png' as name, h.n * 17 page_left, v.n * 17 page_top, least({W} - h.n * 17, 20) width, least({H} - v.n * 17, 20) height
    from supplier, range(3) h(n), range(2) v(n))"""


def _numbered(rows: DataFrame, key: str = "chart_id") -> DataFrame:
    """The name of a file is the number of its chart; places are longs, as everywhere in these tables."""
    named = rows.withColumn(key, F.col("file").cast("long")).drop("file")
    return named.withColumns({c: F.col(c).cast("long") for c in ("y", "x") if c in named.columns})


def _charts(spark, sf_dir, kind: str) -> str:
    return formats.saved(formats.lines(_plain(spark, sf_dir), _palette(spark, sf_dir)), G.new_folder(spark, kind), kind)


def _paged(spark, sf_dir) -> str:
    rows = formats.page_lines(_plain(spark, sf_dir), _palette(spark, sf_dir), (W, H), PER_PAGE, OVERLAP)
    return formats.saved(rows, G.new_folder(spark, "chart_pages"), "chart_pages")


@query(f"select chart_id, y, x, label from {_C} c")
def k2_s6_json_files(spark, sf_dir):
    """Charts as JSON files and their cells."""
    return _numbered(formats.loaded(spark, _charts(spark, sf_dir, "chart_json"), "chart_json"))


@query(f"select chart_id, y, x, label + 1 as label from {_C} c where label is not null")
def k3_s7_oxs_files(spark, sf_dir):
    """Charts in the exchange format and their stitches, streamed tag by tag; index 0 is the cloth."""
    return _numbered(formats.loaded(spark, _charts(spark, sf_dir, "chart_oxs"), "chart_oxs"))


@query(f"select s_suppkey chart_id, (i.n)::int idx, case when i.n = 0 then 'cloth' else '<grey ' || (i.n - 1) || ' & \"so\">' end as name, i.n = 0 as cloth from supplier, range({COLOURS + 1}) i(n)")
def k3_s7_oxs_palettes(spark, sf_dir):
    """The palettes of such files, names with marks that XML must escape."""
    return _numbered(formats.loaded(spark, _charts(spark, sf_dir, "chart_oxs"), "chart_oxs", "palette")).select("chart_id", "idx", "name", "cloth")


@query(f"select chart_id, row_number() over (partition by chart_id order by y, x) - 1 as nth, x::varchar as x, y::varchar as y, (label + 1)::varchar as palindex from {_C} c where label is not null")
def s8_xml_tags(spark, sf_dir):
    """Every stitch of every file as a row of XML with its attributes, numbered as it stands."""
    tags = formats.loaded(spark, _charts(spark, sf_dir, "chart_oxs"), "xml_tags", rowTag="stitch", ending=".oxs")
    return tags.select(F.col("file").cast("long").alias("chart_id"), "nth", *(F.col("attributes")[a].alias(a) for a in ("x", "y", "palindex")))


@query(f"select chart_id, y, x, coalesce(label * 40 + 20, 0)::int as r, case when label is null then 0 else 255 end::int as a from {_C} c")
def k4_k6_png_files(spark, sf_dir):
    """Charts as pictures, a pixel a cell, deflated line by line; two of the four channels."""
    path = _charts(spark, sf_dir, "chart_png")
    return _numbered(formats.register(spark).read.format("chart_png").schema("file string, y int, x int, r int, a int").load(path))


@query(f"select chart_id, name, page_left, page_top, width, height from {_PAGES} p")
def k7_page_map(spark, sf_dir):
    """The page map in each archive."""
    pages = _numbered(formats.loaded(spark, _paged(spark, sf_dir), "chart_pages", "pages"))
    return pages.select("chart_id", "name", *(F.col(c).cast("long").alias(to) for c, to in (("left", "page_left"), ("top", "page_top"), ("width", "width"), ("height", "height"))))


@query(f"select s_suppkey chart_id, i.n::int as idx, upper(repeat(lpad(to_hex(i.n * 40 + 20), 2, '0'), 3)) hex, count(c.label) stitches from supplier cross join range({COLOURS}) i(n) left join {_C} c on c.chart_id = s_suppkey and c.label = i.n group by s_suppkey, i.n")
def k7_page_threads(spark, sf_dir):
    """The table of threads in each archive: stitches shown on two pages count once."""
    return _numbered(formats.loaded(spark, _paged(spark, sf_dir), "chart_pages", "threads"))


@query(f"select p.chart_id, name, y - page_top as y, x - page_left as x, coalesce(label * 40 + 20, 0)::int as g, case when label is null then 0 else 255 end::int as a from {_PAGES} p join {_C} c on c.chart_id = p.chart_id and x >= page_left and x < page_left + width and y >= page_top and y < page_top + height")
def k7_page_pixels(spark, sf_dir):
    """Every pixel of every page in each archive."""
    return _numbered(formats.loaded(spark, _paged(spark, sf_dir), "chart_pages", "pixels")).select("chart_id", "name", "y", "x", "g", "a")


@query(_THREADS)
def k10_s9_list_files(spark, sf_dir):
    """A file of threads for each brand."""
    path = formats.saved(_threads(spark, sf_dir).withColumnRenamed("p_brand", "file"), G.new_folder(spark, "thread_list"), "thread_list")
    return formats.loaded(spark, path, "thread_list").drop("error").withColumnRenamed("file", "p_brand")
