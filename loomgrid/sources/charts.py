"""Chart files: editable JSON, the OXS exchange format, thread lists and palettes, read and written as columns."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import scalars
from loomgrid.operators import grid
from loomgrid.sources import images

EMPTY = 255
VERSION = 7
LONGEST_SIDE = 1500
CHART = "formatVersion int, width int, height int, isLandscape boolean, cellPalette array<int>, palette array<struct<rgb:array<int>,symbol:string,name:string,source:struct<brand:string,code:string>>>, name string"


def read_json(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``chart`` and ``problem``: a chart that breaks a rule is null, and the first rule that it breaks is named.

    Older versions are read as the newest: a missing version counts as 1 and missing fields are null.
    """
    side = lambda v: v.isNull() | (v < 1) | (v > LONGEST_SIDE)

    def judged(c: Column) -> Column:
        colours = F.coalesce(F.size(c["palette"]), F.lit(0))
        rules = [
            (c.isNull() | (c["cellPalette"].isNull() & c["width"].isNull()), "not-a-chart"),
            (F.coalesce(c["formatVersion"], F.lit(1)) > VERSION, "newer-version"),
            (side(c["width"]) | side(c["height"]), "size"),
            (F.coalesce(F.size(c["cellPalette"]), F.lit(-1)) != c["width"] * c["height"], "cell-count"),
            (colours > 100, "too-many-colours"),
            (F.array_contains(F.transform(c["cellPalette"], lambda v: v.isNull()), True), "label-out-of-palette"),
            (F.array_min(c["cellPalette"]) < 0, "label-out-of-palette"),
            (F.array_max(F.filter(c["cellPalette"], lambda v: v != EMPTY)) >= colours, "label-out-of-palette"),
            (F.exists(c["palette"], lambda p: p["rgb"].isNull() | (F.size(p["rgb"]) != 3) | F.exists(p["rgb"], lambda v: v.isNull() | (v < 0) | (v > 255))), "colour"),
        ]
        return F.struct(c.alias("chart"), F.coalesce(*(F.when(condition, F.lit(name)) for condition, name in rules)).alias("problem"))

    # the text is parsed once: the rules read it as the variable of a function, not as an expression that each of them repeats
    told = F.get(F.transform(F.array(F.from_json(text, CHART)), judged), F.lit(0))
    return rows.withColumn("_c", told).select(*rows.columns, F.when(F.col("_c.problem").isNull(), F.col("_c.chart")).alias("chart"), F.col("_c.problem").alias("problem"))


def cells(charts: DataFrame, key: str = "chart_id", chart: str = "chart") -> DataFrame:
    """(key, y, x, label), null for an empty cell."""
    rows = charts.where(F.col(chart).isNotNull()).select(key, F.col(f"{chart}.width").alias("w"), F.posexplode(f"{chart}.cellPalette").alias("at", "label"))
    return rows.select(key, F.floor(F.col("at") / F.col("w")).alias("y"), (F.col("at") % F.col("w")).cast("long").alias("x"), F.when(F.col("label") != EMPTY, F.col("label")).alias("label"))


def palette(charts: DataFrame, key: str = "chart_id", chart: str = "chart") -> DataFrame:
    rows = charts.where(F.col(chart).isNotNull()).select(key, F.posexplode(f"{chart}.palette").alias("idx", "p"))
    return rows.select(key, "idx", *(F.col("p.rgb")[i].alias(c) for i, c in enumerate("rgb")), "p.symbol", "p.name", "p.source")


def write_json(cell_rows: DataFrame, palette_rows: DataFrame, key: str = "chart_id") -> DataFrame:
    """(key, text): each chart as one JSON text, its cells in reading order; every place of the grid needs a row."""
    grid = cell_rows.groupBy(key).agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.sort_array(F.collect_list(F.struct("y", "x", F.coalesce("label", F.lit(EMPTY)).alias("l")))).alias("c"))
    colours = palette_rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b", "symbol", "name"))).alias("p"))
    rgb = lambda p: F.array(p["r"], p["g"], p["b"]).alias("rgb")
    entry = F.transform("p", lambda p: F.struct(rgb(p), p["symbol"].alias("symbol"), p["name"].alias("name")))
    chart = F.struct(F.lit(VERSION).alias("formatVersion"), "width", "height", (F.col("width") >= F.col("height")).alias("isLandscape"), F.transform("c", lambda v: v["l"]).alias("cellPalette"), entry.alias("palette"))
    return grid.join(colours, key).select(key, F.to_json(chart).alias("text"))


# ---------------------------------------------------------------- OXS


def _attribute(tag: Column, name: str) -> Column:
    return scalars.xml_unescape(F.regexp_extract(tag, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1))


def _whole(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*\d{1,6}\s*$"), F.trim(text).cast("int"))


def read_oxs(rows: DataFrame, key: str = "chart_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(palette, cells, report) of OXS texts by tag patterns in the JVM.

    Palette: (key, idx, number, name, hex, cloth).  Cells: (key, y, x, label) with label the palette's index, the first stitch of a
    place ruling; cloth stitches and those outside the grid are left out.  Report: (key, kind, n) counts what was not taken.
    """
    tags = lambda name: F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"<{name}\b[^>]*>"), 0)).alias("tag")
    number = F.trim(_attribute(F.col("tag"), "number"))
    items = rows.select(key, tags("palette_item")).select(key, _whole(_attribute(F.col("tag"), "index")).alias("idx"), number.alias("number"), F.trim(_attribute(F.col("tag"), "name")).alias("name"), F.upper(_attribute(F.col("tag"), "color")).alias("hex"))
    items = items.withColumn("cloth", (F.col("idx") == 0) | (F.lower("number") == "cloth"))
    prop = F.regexp_extract(F.col(text), r"<properties\b[^>]*>", 0)
    size = rows.select(key, _whole(_attribute(prop, "chartwidth")).alias("w"), _whole(_attribute(prop, "chartheight")).alias("h"))
    stitches = rows.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"<stitch\s[^>]*>"), 0)).alias("nth", "tag"))
    stitches = stitches.select(key, "nth", *(_whole(_attribute(F.col("tag"), a)).alias(b) for a, b in (("x", "x"), ("y", "y"), ("palindex", "label"))))
    cloth = items.where("cloth").select(key, F.col("idx").alias("label"), F.lit(True).alias("_cloth"))
    told = stitches.join(size, key).join(cloth, [key, "label"], "left")
    nth = F.row_number().over(Window.partitionBy(key, "y", "x").orderBy("nth"))
    kind = (
        F.when(F.col("x").isNull() | F.col("y").isNull() | F.col("label").isNull(), "unreadable")
        .when((F.col("x") >= F.col("w")) | (F.col("y") >= F.col("h")), "out-of-grid")
        .when(F.coalesce("_cloth", F.lit(False)), "cloth")
    )
    judged = told.withColumn("kind", kind)
    taken = judged.where("kind is null").withColumn("_nth", nth)
    parts = F.regexp_count(F.col(text), F.lit(r"<partstitch\s"))
    marks = F.regexp_count(F.col(text), F.lit(r"<stitch\s[^>]*marked\s*=\s*[\"']true"))
    counts = rows.select(key, F.explode(F.map_from_arrays(F.array(F.lit("part-stitches"), F.lit("completion-marks")), F.array(parts, marks))).alias("kind", "n")).where("n > 0")
    report = judged.where("kind is not null").groupBy(key, "kind").agg(F.count("*").alias("n")).union(taken.where("_nth > 1").groupBy(key, F.lit("duplicate")).agg(F.count("*"))).union(counts.select(key, "kind", F.col("n").cast("long")))
    return items, taken.where("_nth = 1").select(key, "y", "x", "label"), report


def write_oxs(cell_rows: DataFrame, palette_rows: DataFrame, key: str = "chart_id", software: str = "loomgrid") -> DataFrame:
    """(key, text): each chart as OXS.  Rows become lines before a chart is put together, so only a chart's lines meet in one place."""
    filled = F.when(F.col("label").isNotNull(), F.concat(F.lit('<stitch x="'), "x", F.lit('" y="'), "y", F.lit('" palindex="'), F.col("label") + 1, F.lit('"/>')))
    lines = cell_rows.groupBy(key, "y").agg(F.max("x").alias("x"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", filled.alias("s")))), lambda v: v["s"]), "\n").alias("line"))
    grid = lines.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda v: F.nullif(v["line"], F.lit(""))), "\n").alias("stitches"))
    hexed = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb"))
    item = F.concat(F.lit('<palette_item index="'), F.col("idx") + 1, F.lit('" number="" name="'), scalars.xml_escape(F.coalesce("name", F.lit(""))), F.lit('" color="'), hexed, F.lit('" printcolor="'), hexed, F.lit('" blendcolor="nil" strands="2" symbol="'), scalars.xml_escape(F.coalesce("symbol", F.lit(""))), F.lit('"/>'))
    items = palette_rows.select(key, "idx", item.alias("item")).groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda v: v["item"]), "\n").alias("items"))
    text = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<chart>\n<properties oxs="1.0" oxsversion="1.0" software="'), F.lit(software), F.lit('" chartwidth="'), "w", F.lit('" chartheight="'), "h", F.lit('" palettecount="'), "n",
        F.lit('"/>\n<palette>\n<palette_item index="0" number="cloth" name="cloth" color="FFFFFF" printcolor="FFFFFF" blendcolor="nil" strands="2"/>\n'), "items", F.lit("\n</palette>\n<fullstitches>\n"), "stitches",
        F.lit("\n</fullstitches>\n<partstitches/>\n<backstitches/>\n<ornaments_inc_knots_and_beads/>\n<commentboxes/>\n</chart>\n"),
    )
    return grid.join(items, key).select(key, text.alias("text"))


# ---------------------------------------------------------------- thread lists


def read_thread_list(text: str) -> tuple[list[tuple[str, str, str]], str | None]:
    """(threads, error) of a list in CSV (comma, semicolon or tab; the first line may be a header) or JSON (pairs or objects)."""
    if text.lstrip()[:1] in "[{" and text.strip():
        try:
            data = json.loads(text)
        except ValueError as problem:
            return [], f"not JSON: {problem}"
        rows = data.get("threads", []) if isinstance(data, dict) else data
        found = []
        for i, row in enumerate(rows):
            code, name, colour = ((row.get("code") or row.get("number"), row.get("name"), row.get("hex") or row.get("rgb")) if isinstance(row, dict) else (*row, None, None, None)[:3])
            if isinstance(colour, list):
                colour = "".join(f"{v:02x}" for v in colour)
            if not code or not re.fullmatch(r"#?[0-9a-fA-F]{6}", str(colour or "")):
                return [], f"entry {i + 1} is no thread"
            found.append((str(code), str(name or ""), str(colour).lstrip("#").lower()))
        return found, None
    lines = re.split(r"\r\n|\r|\n", text)
    first = next((x for x in lines if x.strip()), "")
    separator = max(",;\t", key=lambda s: first.count(s))
    found, seen = [], False
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        row = [c.strip() for c in next(iter(csv.reader([line.strip()], delimiter=separator, skipinitialspace=True)))]
        header, seen = not seen, True
        if header and len(row) >= 3 and not re.fullmatch(r"#?[0-9a-fA-F]{6}", row[2]) and re.search(r"hex|colou?r|rgb", row[2], re.I):
            continue
        if len(row) != 3:
            return [], f"line {i + 1} has {len(row)} cells"
        if not row[0]:
            return [], f"line {i + 1} has no number"
        if not re.fullmatch(r"#?[0-9a-fA-F]{6}", row[2]):
            return [], f"line {i + 1}: no colour"
        found.append((row[0], row[1], row[2].lstrip("#").lower()))
    return found, None


def thread_lists(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, code, name, hex, error): a row for each thread, or one with what is wrong with the list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text], strict=True):
                found, error = read_thread_list(t or "")
                out += [(k, None, None, None, None, error)] if error else [(k, i, *x, None) for i, x in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "ord", "code", "name", "hex", "error"]).astype({"ord": "Int32"})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, ord int, code string, name string, hex string, error string")


def write_thread_list(threads: DataFrame, key: str) -> DataFrame:
    """(key, text): a CSV with a header and a thread a line, in their order."""
    line = F.concat_ws(",", scalars.csv_cell(F.col("code")), scalars.csv_cell(F.col("name")), F.concat(F.lit("#"), "hex"))
    listed = threads.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda v: v["line"]), "\n").alias("t"))
    return listed.select(key, F.concat(F.lit("number,name,hex\n"), "t", F.lit("\n")).alias("text"))


def read_palettes(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, hex, name) of palette files: JSON with ``colors`` as ``#rrggbb`` texts or objects with hex and name."""
    objects = F.from_json(text, "colors array<struct<hex:string,name:string>>")["colors"]
    plain = F.transform(F.from_json(text, "colors array<string>")["colors"], lambda v: F.struct(v.alias("hex"), F.lit(None).cast("string").alias("name")))
    each = rows.select(key, F.posexplode(F.when(F.exists(plain, lambda v: v["hex"].startswith("{")), objects).otherwise(plain)).alias("idx", "c"))
    return each.select(key, "idx", F.lower(F.regexp_extract("c.hex", "#?([0-9a-fA-F]{6})", 1)).alias("hex"), "c.name")


def read_names(lines: DataFrame, line: str = "value") -> DataFrame:
    """(name, hex, r, g, b) of a colour-name dictionary: a name, a tab and ``#rrggbb`` a line; comments, blank and broken lines are left out."""
    cell = F.split(line, "\t")
    rows = lines.where(~F.col(line).startswith("#") & (F.trim(line) != "")).select(F.trim(cell[0]).alias("name"), F.get(cell, F.lit(1)).alias("hex"))
    told = rows.withColumn("c", scalars.rgb_of_hex(F.trim("hex"))).where("c is not null and name <> ''")
    return told.select("name", F.lower(F.regexp_replace(F.trim("hex"), "^#", "")).alias("hex"), "c.r", "c.g", "c.b")


# ---------------------------------------------------------------- rasters of charts


def _drawn(cell_rows: DataFrame, palette_rows: DataFrame, key: str, page: list[str], size: int) -> DataFrame:
    """(key, page, png): a picture for each key and page, a square of ``size`` pixels a cell; cells without a label or a colour are clear.

    A chart's palette and then its cells come as lines to one task, and pictures are put together from lines that follow each other: a
    task holds one picture, and no row of a cell carries a colour.
    """
    of = [key, *page]
    cells = cell_rows.select(*of, F.col("y").cast("int").alias("y"), F.struct(F.col("x").cast("int").alias("x"), F.coalesce(F.col("label"), F.lit(-1)).cast("int").alias("l")).alias("v"))
    colours = palette_rows.groupBy(key).agg(F.collect_list(F.struct("idx", "r", "g", "b")).alias("p"))
    entry = F.transform("p", lambda p: F.struct(*(p[c].cast("int").alias(c) for c in ("idx", "r", "g", "b"))))
    line = cells.groupBy(*of, "y").agg(F.collect_list("v").alias("v")).withColumn("p", F.lit(None).cast("array<struct<idx:int,r:int,g:int,b:int>>"))
    kinds = dict(line.dtypes)
    first = colours.select(*(F.col(c) if c == key else F.lit(None).cast(kinds[c]).alias(c) for c in of), F.lit(None).cast("int").alias("y"), F.lit(None).cast(kinds["v"]).alias("v"), entry.alias("p"))
    # A number of parts of its own: lines are short for the work that they make, and parts of a usual size would be few.  By the key's
    # hash, not the key: Spark 4.1.2 takes a union of sides that are dealt by the key for dealt, and then lets each side merge its parts.
    tasks = max(cell_rows.sparkSession.sparkContext.defaultParallelism, int(cell_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = line.union(first).repartition(tasks, F.xxhash64(key)).sortWithinPartitions(key, F.col("y").isNotNull(), *page)

    def picture(rows: list[tuple[int, np.ndarray, np.ndarray]], palette: list[dict]) -> bytes:
        top = min(y for y, _, _ in rows) if page else 0
        left = min(int(x.min()) for _, x, _ in rows) if page else 0
        labels = np.full((max(y for y, _, _ in rows) + 1 - top, max(int(x.max()) for _, x, _ in rows) + 1 - left), -1)
        for y, x, v in rows:
            labels[y - top, x - left] = v
        table = np.zeros((max((p["idx"] for p in palette), default=-1) + 2, 4), np.uint8)  # the last is clear
        for p in palette:
            table[p["idx"]] = (p["r"], p["g"], p["b"], 255)
        labels[labels >= len(table)] = -1
        return images.encode_png(np.repeat(np.repeat(table[labels], size, axis=0), size, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, palette, mine, known, rows, done, kinds = None, [], None, [], [], [], []

        def told() -> pa.RecordBatch:
            out = [pa.array([n[i] for n, _ in done], k) for i, k in enumerate(kinds)] + [pa.array([d for _, d in done], pa.binary())]
            done.clear()
            return pa.RecordBatch.from_arrays(out, names=[*of, "png"])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in of]
            names = list(zip(*(batch.column(c).to_pylist() for c in of), strict=True))
            v = batch.column("v")
            ends, x, label = v.offsets.to_numpy(), v.values.field("x").to_numpy(), v.values.field("l").to_numpy()
            for i, (name, y) in enumerate(zip(names, batch.column("y").to_pylist(), strict=True)):
                if y is None:
                    mine, known = name[0], batch.column("p")[i].as_py()
                    continue
                if not rows or name != now:
                    if rows:
                        done.append((now, picture(rows, palette)))
                    now, rows, palette = name, [], known if mine == name[0] else []
                # copies: the batch is gone when the picture goes on in the next
                rows.append((y, x[ends[i] : ends[i + 1]].copy(), label[ends[i] : ends[i + 1]].copy()))
            if done:
                yield told()
        if rows:
            done.append((now, picture(rows, palette)))
            yield told()

    schema = ", ".join(f"{c} {dict(cell_rows.dtypes)[c]}" for c in of)
    return dealt.mapInArrow(run, f"{schema}, png binary")


def write_png(cell_rows: DataFrame, palette_rows: DataFrame, key: str = "chart_id", size: int = 1) -> DataFrame:
    """(key, png): a square of ``size`` pixels a cell, empty cells clear."""
    return _drawn(cell_rows, palette_rows, key, [], size)


def read_pixel_art(pixel_rows: DataFrame, key: str = "photo_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, palette, refused): a pixel a cell; labels by luminance, then by first place.  A picture with a half-clear pixel or over 100 colours is refused."""
    # what made the pixels, a decoder perhaps, runs once, not for each of their three uses
    pixel_rows = grid.kept(pixel_rows)
    spoiled = pixel_rows.groupBy(key).agg(F.max((~F.col("a").isin(0, 255)).cast("int")).alias("half"), F.countDistinct(F.when(F.col("a") == 255, F.struct("r", "g", "b"))).alias("colours"))
    refused = spoiled.select(key, F.when(F.col("half") == 1, "half-clear").when(F.col("colours") > 100, "too-many-colours").alias("why")).where("why is not null")
    good = pixel_rows.join(refused, key, "left_anti")
    first = good.where("a = 255").groupBy(key, "r", "g", "b").agg(F.min(F.struct("y", "x")).alias("at"))
    light = F.floor(0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b") + 0.5)
    colours = first.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy(light, "at")) - 1).cast("int")).drop("at")
    labelled = good.join(colours, [key, "r", "g", "b"], "left")
    return labelled.select(key, "y", "x", F.when(F.col("a") == 255, F.col("idx")).alias("label")), colours.select(key, "idx", "r", "g", "b"), refused


def write_zip(pages: DataFrame, key: str, name: str, data: str) -> DataFrame:
    """(key, zip): the named files of each key, in the order of their names, with fixed times so that equal input gives equal bytes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
            for n, d in sorted(zip(rows[name], rows[data], strict=True)):
                archive.writestr(zipfile.ZipInfo(n), bytes(d))
        return pd.DataFrame({key: [rows[key].iloc[0]], "zip": [sink.getvalue()]})

    return pages.groupBy(key).applyInPandas(run, f"{key} {dict(pages.dtypes)[key]}, zip binary")


def write_pages(cell_rows: DataFrame, palette_rows: DataFrame, size: tuple[int, int], per_page: tuple[int, int], overlap: int = 0, key: str = "chart_id") -> DataFrame:
    """(key, zip): each chart cut into overlapping pages, a PNG a page named by its letter and number."""
    shown = grid.onto_pages(cell_rows, cell_rows.sparkSession, size, per_page, overlap)
    named = shown.withColumn("name", F.concat(scalars.page_letter(F.col("page_y")), F.col("page_x") + 1, F.lit(".png")))
    return write_zip(_drawn(named, palette_rows, key, ["name"], 4), key, "name", "png")


def two_label(cell_rows: DataFrame, first: int) -> DataFrame:
    """Cells with two labels only: 0 for one label, 1 for any other, none for an empty cell."""
    return cell_rows.withColumn("label", F.when(F.col("label") == first, 0).when(F.col("label").isNotNull(), 1))


def export(kind: str, cell_rows: DataFrame, palette_rows: DataFrame, key: str = "chart_id", **options) -> DataFrame:
    """(key, the file): ``editable``, ``oxs``, ``png-color``, ``png-bw`` or ``pages``; any other kind is refused by name."""
    grey = F.floor(0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b") + 0.5).cast("int")
    writers = {
        "editable": lambda: write_json(cell_rows, palette_rows, key),
        "oxs": lambda: write_oxs(cell_rows, palette_rows, key),
        "png-color": lambda: write_png(cell_rows, palette_rows, key, **options),
        "png-bw": lambda: write_png(cell_rows, palette_rows.withColumns({c: grey for c in "rgb"}), key, **options),
        "pages": lambda: write_pages(cell_rows, palette_rows, key=key, **options),
    }
    if kind not in writers:
        raise ValueError(f"no export of the kind {kind}")
    return writers[kind]()
