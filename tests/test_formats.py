import os
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgrid.sources import charts, formats

REFUSED = {
    "x": "not-a-chart", "{}": "not-a-chart", "[1]": "not-a-chart", '{"formatVersion":8,"width":1,"height":1,"cellPalette":[255],"palette":[]}': "newer-version",
    '{"width":0,"height":1,"cellPalette":[],"palette":[]}': "size", '{"width":1501,"height":1,"cellPalette":[],"palette":[]}': "size", '{"width":2,"height":1,"cellPalette":[255],"palette":[]}': "cell-count",
    '{"width":1,"height":1,"cellPalette":[0],"palette":[]}': "label-out-of-palette", '{"width":1,"height":1,"cellPalette":[null],"palette":[]}': "label-out-of-palette", '{"width":1,"height":1,"cellPalette":[-1],"palette":[]}': "label-out-of-palette",
    '{"width":1,"height":1,"cellPalette":[0],"palette":[{"rgb":[1,2,300]}]}': "colour", '{"width":1,"height":1,"cellPalette":[0],"palette":[{"rgb":null}]}': "colour", '{"width":1,"height":1,"cellPalette":[0],"palette":[{"rgb":[1,2,3]}]}': None,
}
BROKEN = '<chart><properties chartwidth="2" chartheight="2"/><palette><palette_item index="0" number="cloth"/><palette_item index="1" color="ff0000"/></palette><!-- <stitch x="1" y="0" palindex="1"/> --><fullstitches><stitch x="0" y="0" palindex="1" marked="true"/><stitch x="0" y="0" palindex="1"/><stitch x="5" y="0" palindex="1"/><stitch x="1" y="1" palindex="0"/><stitch x="z" y="1" palindex="0"/></fullstitches><partstitches><partstitch x="1" y="1"/></partstitches></chart>'


@pytest.fixture
def made(spark):
    """Charts of three sizes, one of a single cell and one without a stitch; names of colours need quoting."""
    sizes = {1: (7, 5), 2: (1, 1), 3: (3, 9)}
    cells = [(k, y, x, None if k == 2 or (x + y) % 4 == 3 else (x * y + k) % 3) for k, (w, h) in sizes.items() for y in range(h) for x in range(w)]
    palette = [(k, i, 10 * k, 20 * i, 255, "+", f'<n{i}> & "q"\tü') for k in sizes for i in range(3)]
    return spark.createDataFrame(cells, "chart_id long, y int, x int, label int"), spark.createDataFrame(palette, "chart_id long, idx int, r int, g int, b int, symbol string, name string"), cells


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def put(folder, **texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_charts_go_out_and_come_back(spark, made, tmp_path):
    cells, palette, plain = made
    want = sorted(((str(k), y, x, label) for k, y, x, label in plain), key=repr)
    lines = formats.lines(cells, palette)
    path = formats.saved(lines, f"file://{tmp_path}/json", "chart_json")
    assert sorted(os.listdir(tmp_path / "json")) == ["1.json", "2.json", "3.json"]
    assert rows(formats.loaded(spark, path, "chart_json"), "file", "y", "x", "label") == want
    assert rows(formats.loaded(spark, path, "chart_json", "palette"), "file", "idx", "r", "g", "b", "symbol", "name") == rows(palette.withColumn("file", F.col("chart_id").cast("string")), "file", "idx", "r", "g", "b", "symbol", "name")
    texts = spark.read.text(path, wholetext=True)  # the columns' reader takes the same files
    assert charts.read_json(texts.withColumnRenamed("value", "text")).where("problem is not null").count() == 0

    path = formats.saved(lines, str(tmp_path / "oxs"), "chart_oxs")
    assert rows(formats.loaded(spark, path, "chart_oxs"), "file", "y", "x", F.col("label") - 1) == [r for r in want if r[3] is not None]
    assert rows(formats.loaded(spark, path, "chart_oxs", "palette").where("not cloth"), "file", F.col("idx") - 1, "name") == rows(palette, F.col("chart_id").cast("string"), "idx", "name")
    assert formats.loaded(spark, path, "chart_oxs", "report").count() == 0

    path = formats.saved(lines, str(tmp_path / "png"), "chart_png")
    assert rows(formats.loaded(spark, path, "chart_png", "size"), "file", "width", "height") == [("1", 7, 5), ("2", 1, 1), ("3", 3, 9)]
    colours = {("clear", None): (0, 0, 0, 0)} | {(k, i): (10 * k, 20 * i, 255, 255) for k in (1, 2, 3) for i in range(3)}
    drawn = sorted((str(k), y, x, *colours["clear" if label is None else k, label]) for k, y, x, label in plain)
    assert rows(formats.loaded(spark, path, "chart_png"), "file", "y", "x", "r", "g", "b", "a") == sorted(drawn, key=repr)


def test_pages_and_their_tables(spark, made, tmp_path):
    cells, palette, plain = made
    one = formats.page_lines(cells.where("chart_id = 1"), palette.where("chart_id = 1"), (7, 5), (4, 3), 1)
    path = formats.saved(one, str(tmp_path / "zip"), "chart_pages")
    assert rows(formats.loaded(spark, path, "chart_pages", "pages"), "name", "left", "top", "width", "height") == [("A1.png", 0, 0, 4, 3), ("A2.png", 3, 0, 4, 3), ("B1.png", 0, 2, 4, 3), ("B2.png", 3, 2, 4, 3)]
    counts = [(i, sum(k == 1 and label == i for k, _, _, label in plain)) for i in range(3)]
    assert rows(formats.loaded(spark, path, "chart_pages", "threads"), "idx", "stitches") == counts  # overlaps counted once
    seen = formats.loaded(spark, path, "chart_pages", "pixels").where("name = 'B2.png'")
    want = sorted((y - 2, x - 3, 0 if label is None else 20 * label, 0 if label is None else 255) for k, y, x, label in plain if k == 1 and y >= 2 and x >= 3)
    assert sorted(rows(seen, "y", "x", "g", "a")) == want
    with zipfile.ZipFile(tmp_path / "zip" / "1.zip") as archive:
        assert archive.testzip() is None and archive.namelist() == ["A1.png", "A2.png", "B1.png", "B2.png", "pages.tsv", "threads.tsv"]


def test_names_choose_files_and_columns_choose_work(spark, made, tmp_path):
    cells, palette, plain = made
    path = formats.saved(formats.lines(cells, palette), str(tmp_path / "json"), "chart_json")
    put(path, **{"4.json": "broken"})
    read = formats.loaded(spark, path, "chart_json", partitionBytes="1")
    assert read.rdd.getNumPartitions() == 4
    assert formats.loaded(spark, path, "chart_json", partitionBytes="1", files="1|3").rdd.getNumPartitions() == 2
    assert rows(formats.loaded(spark, path, "chart_json", files="[12]"), "file", "y", "x", "label") == sorted(((str(k), y, x, label) for k, y, x, label in plain if k < 3), key=repr)
    assert formats.loaded(spark, path, "chart_json", files="9*").count() == 0
    # a query with filters leaves nothing behind for the next one on the same DataFrame
    assert read.where("file = '2'").count() == 1 and read.count() == len(plain)
    assert read.where("file = '2'").union(read).count() == len(plain) + 1
    narrow = formats.register(spark).read.format("chart_json").schema("label int").load(path)
    assert narrow.columns == ["label"] and narrow.count() == len(plain)
    drawn = formats.saved(formats.lines(cells, palette), str(tmp_path / "png"), "chart_png")
    assert rows(spark.read.format("chart_png").schema("b int").load(drawn).where("b > 0"), "b") == [(255,)] * sum(label is not None for *_, label in plain)
    with pytest.raises(Exception, match="no column colour"):
        spark.read.format("chart_json").schema("colour int").load(path).count()
    with pytest.raises(Exception, match="has no part"):
        formats.loaded(spark, path, "chart_json", "rows").count()


def test_problems_are_rows(spark, tmp_path):
    put(tmp_path / "json", **{f"{i}.json": t for i, t in enumerate(REFUSED)}, **{"empty.json": "", "notes.txt": "no chart"})
    got = dict(rows(formats.loaded(spark, str(tmp_path / "json"), "chart_json", "problem"), "file", "problem"))
    assert got == {str(i): p for i, p in enumerate(REFUSED.values())} | {"empty": "not-a-chart"}
    texts = spark.createDataFrame([(t,) for t in REFUSED], "text string")
    assert {r.text: r.problem for r in charts.read_json(texts).collect()} == REFUSED
    assert formats.loaded(spark, str(tmp_path / "json"), "chart_json").count() == 1

    put(tmp_path / "oxs", **{"a.oxs": BROKEN, "b.oxs": BROKEN[:-20], "c.oxs": '<!DOCTYPE x [<!ENTITY e "e">]><chart>&e;</chart>', "d.oxs": ""})
    path = str(tmp_path / "oxs")
    assert rows(formats.loaded(spark, path, "chart_oxs"), "file", "y", "x", "label") == [("a", 0, 0, 1)]
    told = formats.loaded(spark, path, "chart_oxs", "report")
    assert dict(rows(told.where("file = 'a'"), "kind", "n")) == {"duplicate": 1, "out-of-grid": 1, "cloth": 1, "unreadable": 1, "part-stitches": 1, "completion-marks": 1}
    assert rows(told.where("file <> 'a'"), "file", "kind") == [(f, "not-well-formed") for f in "bcd"]
    # the comment's stitch is none; what stands before a break is read, and the break is told
    stitches = formats.loaded(spark, path, "xml_tags", rowTag="stitch", ending=".oxs")
    assert rows(stitches.where("file = 'a'"), "nth", F.col("attributes")["x"]) == [(0, "0"), (1, "0"), (2, "5"), (3, "1"), (4, "z")]
    assert stitches.where("problem is not null and nth is null").count() == 3

    put(tmp_path / "png", **{"a.png": b"no picture", "b.png": b""})
    assert formats.loaded(spark, str(tmp_path / "png"), "chart_png").count() == 0
    assert rows(formats.loaded(spark, str(tmp_path / "png"), "chart_png", "size"), "file", "width") == [("a", None), ("b", None)]
    os.makedirs(tmp_path / "none")
    assert formats.loaded(spark, str(tmp_path / "none"), "chart_oxs").count() == 0


def test_large_xml_streams(spark, tmp_path):
    put(tmp_path, **{"big.xml": "<l>" + '<row n="1"/>' * 200_000 + "</l>"})
    read = formats.loaded(spark, str(tmp_path), "xml_tags", rowTag="row", ending=".xml")
    assert read.agg(F.count("*"), F.max("nth"), F.sum(F.col("attributes")["n"].cast("int"))).first()[:] == (200_000, 199_999, 200_000)


def test_lists_of_threads(spark, tmp_path):
    threads = spark.createDataFrame([("a", 0, "310", 'Black, "deep"', "000000"), ("a", 1, "B5200", "Snow", "ffffff"), ("b", 0, "1", None, "010203")], "file string, ord int, code string, name string, hex string")
    path = formats.saved(threads, str(tmp_path / "t"), "thread_list")
    assert rows(formats.loaded(spark, path, "thread_list"), "file", "ord", "code", "name", "hex", "error") == [("a", 0, "310", 'Black, "deep"', "000000", None), ("a", 1, "B5200", "Snow", "ffffff", None), ("b", 0, "1", "", "010203", None)]
    put(path, **{"c.csv": "310,Black", "d.csv": ""})
    assert rows(formats.loaded(spark, path, "thread_list").where("error is not null"), "file", "error") == [("c", "line 1 has 2 cells")]


def test_all_files_or_none(spark, made, tmp_path):
    cells, palette, plain = made
    lines = formats.lines(cells, palette)
    path = str(tmp_path / "out")
    formats.saved(lines.where("file = '1'"), path, "chart_oxs")
    first = (tmp_path / "out" / "1.oxs").read_bytes()
    with pytest.raises(Exception, match="there already"):
        formats.saved(lines, path, "chart_oxs")
    with pytest.raises(Exception, match="line 2 is missing"):
        formats.saved(lines.where("not (file = '3' and y = 2)"), path, "chart_oxs")
    with pytest.raises(Exception, match="missing, doubled"):
        formats.saved(lines.union(lines.where("file = '2'")), path, "chart_oxs")
    with pytest.raises(Exception, match="8 of its 9 lines"):
        formats.saved(lines.where("not (file = '3' and y = 8)").withColumn("height", F.when(F.col("file") == "3", 9).otherwise(F.col("height"))), path, "chart_oxs")
    with pytest.raises(Exception, match="no name of a file"):
        formats.saved(lines.withColumn("file", F.concat(F.lit("../"), "file")), path, "chart_oxs")
    assert os.listdir(path) == ["1.oxs"] and (tmp_path / "out" / "1.oxs").read_bytes() == first  # nothing else, no temporary folder
    formats.saved(lines.where("file > '1'"), path, "chart_oxs", overwrite=True)
    assert sorted(os.listdir(path)) == ["2.oxs", "3.oxs"]
    with pytest.raises(Exception, match="read only"):
        formats.saved(lines, path, "xml_tags")


def test_a_file_in_two_tasks_fails(spark, made, tmp_path):
    cells, palette, plain = made
    threads = spark.createDataFrame([("a", 0, "1", "x", "000000")], "file string, ord int, code string, name string, hex string")
    twice = threads.union(threads)  # two partitions that both hold the file's only thread
    with pytest.raises(Exception, match="more than one task"):
        formats.register(spark)
        twice.write.format("thread_list").mode("append").save(str(tmp_path / "t"))
    assert os.listdir(tmp_path / "t") == []


def test_lines_of_charts_that_lie_together_are_dealt_once(spark, sf_dir):
    """Cells of a chart that are in one task already are not dealt again, only the lines made of them are."""
    from loomgrid.plans import files

    rows = formats.page_lines(files._plain(spark, sf_dir), files._palette(spark, sf_dir), (48, 36), (20, 20), 3)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "name" in rows.columns and "file" in rows.columns
    physical = rows._jdf.queryExecution().executedPlan().toString()
    # suppliers by key, palettes by key; the two short tables of pages are broadcast
    assert physical.count("Exchange hashpartitioning") == 2
