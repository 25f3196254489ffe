"""Queries on files: charts, thread lists, palettes and pictures written as columns and read back, over the standard tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.plans.grid import _C, _P, H, W, cells, pixels
from loomgrid.plans.registry import query, read
from loomgrid.sources import charts, images, matrices

COLOURS = 5


def _palette(spark, sf_dir) -> DataFrame:
    """Five greys from dark to light for each chart, with names that need quoting."""
    i = F.col("idx")
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chart_id"), F.explode(F.sequence(F.lit(0), F.lit(COLOURS - 1))).alias("idx"))
    return rows.select("chart_id", "idx", *((i * 40 + 20).alias(c) for c in "rgb"), F.element_at(F.array(*(F.lit(s) for s in "+x#o*")), i + 1).alias("symbol"), F.concat(F.lit("<grey "), i, F.lit(' & "so">')).alias("name"))


def _plain(spark, sf_dir) -> DataFrame:
    return cells(spark, sf_dir).select("chart_id", "y", "x", "label")


# ---------------------------------------------------------------- pictures


def _bytes(value: Column, n: int, little: bool = True) -> Column:
    """Hex digits of an unsigned number of ``n`` bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(n)[::-1])) if little else digits


_KINDS = "['png', 'gif', 'bmp', 'webp', 'jpeg', 'avif', null]"


@query(f"select p_partkey, {_KINDS}[p_partkey % 7 + 1] as format, case when p_partkey % 7 < 6 then p_size + 1 end width, case when p_partkey % 7 < 6 then p_partkey % 90 + 1 end height from part")
def s3_sniffed_headers(spark, sf_dir):
    """Each part's size as the header of one of six picture formats, or of none."""
    w, h = F.col("p_size") + 1, F.col("p_partkey") % 90 + 1
    text = lambda s: F.lit(s.encode().hex())
    forms = [
        F.concat(F.lit("89504E470D0A1A0A0000000D"), text("IHDR"), _bytes(w, 4, False), _bytes(h, 4, False)),
        F.concat(text("GIF89a"), _bytes(w, 2), _bytes(h, 2)),
        F.concat(text("BM"), F.lit("00" * 12), F.lit("28000000"), _bytes(w, 4), _bytes(h, 4)),
        F.concat(text("RIFF"), F.lit("00" * 4), text("WEBPVP8X"), F.lit("00" * 8), _bytes(w - 1, 3), _bytes(h - 1, 3)),
        F.concat(F.lit("FFD8FFE000046162FFC0001108"), _bytes(h, 2, False), _bytes(w, 2, False), F.lit("00" * 10)),
        F.concat(F.lit("00000014"), text("ftypavif"), F.lit("00" * 4), text("mif1"), F.lit("00000014"), text("ispe"), F.lit("00" * 4), _bytes(w, 4, False), _bytes(h, 4, False)),
        text("no picture at all"),
    ]
    which = F.element_at(F.array(*forms), (F.col("p_partkey") % 7 + 1).cast("int"))
    return images.headers(read(spark, sf_dir, "part").select("p_partkey", F.unhex(which).alias("content"))).select("p_partkey", "format", "width", "height")


@query(f"select image_id, y, x, r, g, b, a from {_P} p")
def s3_k4_png_pixels(spark, sf_dir):
    """Pictures as PNG files and their pixels read back."""
    files = images.write_png(pixels(spark, sf_dir), "image_id")
    back = images.pixels(files.select(F.col("image_id").cast("string").alias("image_id"), F.col("png").alias("content")), "image_id")
    return back.select(F.col("image_id").cast("long").alias("image_id"), "y", "x", "r", "g", "b", "a")


@query(f"select image_id, y, x, r, g, b, a from {_P} p")
def s5_raw_pixels(spark, sf_dir):
    """Pictures as raw bytes, four a pixel, read by place."""
    digits = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgba"))
    raw = pixels(spark, sf_dir).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", digits.alias("d")))).alias("p"))
    raw = raw.select("image_id", F.lit(W).alias("w"), F.lit(H).alias("h"), F.unhex(F.array_join(F.transform("p", lambda v: v["d"]), "")).alias("data"))
    return images.from_rgba(raw, "image_id", "w", "h", "data")


@query(f"select chart_id, y, x, case when label is not null then dense_rank() over (partition by chart_id order by label nulls last) - 1 end::int as label from {_C} c")
def k6_s11_pixel_art(spark, sf_dir):
    """Charts as pictures of a pixel a cell, read back: labels by luminance, which here is their order."""
    files = charts.write_png(_plain(spark, sf_dir), _palette(spark, sf_dir)).select(F.col("chart_id").cast("string").alias("chart_id"), F.col("png").alias("content"))
    found = charts.read_pixel_art(images.pixels(files, "chart_id"), "chart_id")[0]
    return found.select(F.col("chart_id").cast("long").alias("chart_id"), "y", "x", "label")


@query(f"select chart_id, y, x, case when label = 2 then 0 when label is not null then 1 end as label from {_C} c")
def k5_two_labels(spark, sf_dir):
    return charts.two_label(_plain(spark, sf_dir), 2)


# ---------------------------------------------------------------- charts


@query(f"select chart_id, y, x, label from {_C} c")
def k2_s6_json(spark, sf_dir):
    """Charts as JSON texts, read back by the strict reader."""
    return charts.cells(charts.read_json(charts.write_json(_plain(spark, sf_dir), _palette(spark, sf_dir))))


@query("""select p_partkey, [null, 'not-a-chart', 'newer-version', 'size', 'cell-count', 'label-out-of-palette', 'colour', 'not-a-chart'][p_partkey % 8 + 1] problem from part""")
def s6_json_rules(spark, sf_dir):
    """A small chart for each part, most with one rule broken."""
    texts = [
        '{"formatVersion": 7, "width": 2, "height": 1, "cellPalette": [0, 255], "palette": [{"rgb": [1, 2, 3]}]}',
        '{"something": "else"}',
        '{"formatVersion": 8, "width": 1, "height": 1, "cellPalette": [255], "palette": []}',
        '{"width": 0, "height": 1, "cellPalette": [], "palette": []}',
        '{"width": 2, "height": 2, "cellPalette": [0], "palette": [{"rgb": [1, 2, 3]}]}',
        '{"width": 1, "height": 1, "cellPalette": [3], "palette": [{"rgb": [1, 2, 3]}]}',
        '{"width": 1, "height": 1, "cellPalette": [0], "palette": [{"rgb": [1, 2, 300]}]}',
        "not JSON",
    ]
    which = F.element_at(F.array(*(F.lit(t) for t in texts)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return charts.read_json(read(spark, sf_dir, "part").select("p_partkey", which.alias("text"))).select("p_partkey", "problem")


@query(f"select chart_id, y, x, label + 1 as label from {_C} c where label is not null")
def k3_s7_oxs(spark, sf_dir):
    """Charts in the exchange format, read back; its index 0 is the cloth."""
    return charts.read_oxs(charts.write_oxs(_plain(spark, sf_dir), _palette(spark, sf_dir)))[1]


@query("""select chart_id, kind, n from (select s_suppkey chart_id, unnest(['cloth', 'duplicate', 'out-of-grid', 'unreadable', 'part-stitches', 'completion-marks']) kind, unnest([1, 1, s_suppkey % 3, 1, s_suppkey % 2, 1]) n from supplier) where n > 0""")
def s7_oxs_report(spark, sf_dir):
    """What a reader of the exchange format leaves out, counted by kind; how much differs by chart."""
    n = F.col("s_suppkey")
    text = F.concat(
        F.lit('<chart><properties chartwidth="4" chartheight="3"/><palette><palette_item index="0" number="cloth"/><palette_item index="1" number="310" name="a &amp; b" color="000000"/></palette><fullstitches>'),
        F.lit('<stitch x="0" y="0" palindex="1"/><stitch x="0" y="0" palindex="1"/><stitch x="1" y="0" palindex="0"/><stitch x="one" y="0" palindex="1"/><stitch x="2" y="2" palindex="1" marked="true"/>'),
        F.repeat(F.lit('<stitch x="9" y="0" palindex="1"/>'), (n % 3).cast("int")), F.lit("</fullstitches><partstitches>"), F.repeat(F.lit('<partstitch x="1" y="1"/>'), (n % 2).cast("int")), F.lit("</partstitches></chart>"),
    )
    return charts.read_oxs(read(spark, sf_dir, "supplier").select(n.alias("chart_id"), text.alias("text")))[2]


@query("select s_suppkey chart_id, unnest(['A1.png', 'A2.png', 'A3.png', 'B1.png', 'B2.png', 'B3.png']) as name from supplier")
def k7_pages(spark, sf_dir):
    """Charts cut into overlapping pages, a picture each, in one archive a chart; here the names in it."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, n) for k, data in zip(batch["chart_id"], batch["zip"], strict=True) for n in zipfile.ZipFile(io.BytesIO(data)).namelist()]
            yield pd.DataFrame(found, columns=["chart_id", "name"])

    packed = charts.write_pages(_plain(spark, sf_dir), _palette(spark, sf_dir), (W, H), (20, 20), 3)
    return packed.mapInPandas(names, "chart_id long, name string")


@query("select kind, count(*) files from supplier, (values ('editable'), ('oxs'), ('png-color'), ('png-bw'), ('pages')) t(kind) group by 1")
def k1_exports(spark, sf_dir):
    """Every kind of export of every chart: how many files came out."""
    plain, palette = _plain(spark, sf_dir), _palette(spark, sf_dir)
    options = {"pages": {"size": (W, H), "per_page": (20, 20), "overlap": 3}}
    files = [charts.export(kind, plain, palette, **options.get(kind, {})) for kind in ("editable", "oxs", "png-color", "png-bw", "pages")]
    counted = [f.select(F.lit(kind).alias("kind"), F.octet_length(f.columns[1]).alias("n")) for kind, f in zip(("editable", "oxs", "png-color", "png-bw", "pages"), files, strict=True)]
    every = counted[0]
    for more in counted[1:]:
        every = every.union(more)
    return every.groupBy("kind").agg(F.count_if(F.col("n") > 20).alias("files"))


# ---------------------------------------------------------------- lists


def _threads(spark, sf_dir) -> DataFrame:
    """A list for each brand; names hold commas and quotes."""
    order = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return read(spark, sf_dir, "part").select("p_brand", order.alias("ord"), F.concat(F.lit("N"), "p_partkey").alias("code"), F.concat("p_name", F.lit(', "'), "p_size", F.lit('"')).alias("name"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")).alias("hex"))


_THREADS = """select p_brand, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as int) ord, 'N' || p_partkey code, p_name || ', "' || p_size || '"' as name,
    lower(lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0')) hex from part"""


@query(_THREADS)
def k10_s9_thread_csv(spark, sf_dir):
    """Thread lists as CSV with a header, read back."""
    return charts.thread_lists(charts.write_thread_list(_threads(spark, sf_dir), "p_brand"), "p_brand").drop("error")


@query(_THREADS)
def k10_s10_thread_json(spark, sf_dir):
    """Thread lists as JSON objects, read back."""
    listed = _threads(spark, sf_dir).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("ord", "code", "name", "hex"))).alias("t"))
    text = F.to_json(F.struct(F.transform("t", lambda v: F.struct(v["code"].alias("code"), v["name"].alias("name"), F.concat(F.lit("#"), v["hex"]).alias("hex"))).alias("threads")))
    return charts.thread_lists(listed.select("p_brand", text.alias("text")), "p_brand").drop("error")


@query("select p_brand, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as int) idx, lower(lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0')) hex, p_name || ', \"' || p_size || '\"' as name from part")
def s12_palette_files(spark, sf_dir):
    listed = _threads(spark, sf_dir).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("ord", "hex", "name"))).alias("t"))
    text = F.to_json(F.struct(F.transform("t", lambda v: F.struct(F.concat(F.lit("#"), F.upper(v["hex"])).alias("hex"), v["name"].alias("name"))).alias("colors")))
    return charts.read_palettes(listed.select("p_brand", text.alias("text")), "p_brand")


@query("with t(name, n) as (values ('bayer-4', 16), ('bayer-8', 64), ('lines-horizontal', 64), ('lines-vertical', 64), ('blue-noise-16', 256), ('clustered-8', 64), ('ring-8', 64), ('lines-diagonal', 64), ('lines-anti-diagonal', 64)) select name, n.v as rank from t, range(256) n(v) where n.v < t.n")
def s13_matrices(spark, sf_dir):
    """The patterns as lines of a table, read: each has every rank once."""
    lines = [("\t".join((name, str(len(m)), ",".join(str(v) for row in m for v in row))),) for name, m in ((name, make()) for name, make in matrices.NAMES.items())]
    return matrices.parsed(spark.createDataFrame(lines, "line string"), "line").select("name", F.col("rank").cast("long").alias("rank"))


@query("select p_name || ' ' || p_partkey as name, cast(p_partkey % 256 as int) r, cast(p_size as int) g, 7 as b from part where p_partkey % 5 < 3")
def s14_colour_names(spark, sf_dir):
    """A colour-name dictionary as lines of text, with comments, blank and broken ones between, read."""
    n = F.col("p_partkey") % 5
    hexed = F.concat(F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), F.lpad(F.hex(F.col("p_size").cast("long")), 2, "0"), F.lit("07"))
    line = F.when(n == 3, F.concat(F.lit("# "), "p_name")).when(n == 4, F.concat("p_name", F.lit("\tnothex"))).otherwise(F.concat("p_name", F.lit(" "), "p_partkey", F.lit("\t"), F.when(n == 0, "#").otherwise(""), hexed))
    return charts.read_names(read(spark, sf_dir, "part").select(line.alias("line")), "line").select("name", "r", "g", "b")
