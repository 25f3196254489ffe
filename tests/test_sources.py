import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomgrid.plans import grid as plans
from loomgrid.sources import charts, images

SF = os.environ.get("LOOMGRID_TEST_SF", "/root/testdata/sf0.001")


def test_png_round_trip_and_pixels(spark):
    rng = np.random.default_rng(1)
    pictures = [rng.integers(0, 256, (h, w, 4), dtype=np.uint8) for h, w in ((1, 1), (7, 5), (30, 41))]
    for p in pictures:
        assert np.array_equal(images.decode_png(images.encode_png(p)), p)
    rows = [(str(i), bytearray(images.encode_png(p))) for i, p in enumerate(pictures)]
    df = spark.createDataFrame(rows, "photo_id string, content binary")
    got = images.headers(df).select("photo_id", "format", "width", "height").collect()
    assert {(r.photo_id, r.format, r.width, r.height) for r in got} == {(str(i), "png", p.shape[1], p.shape[0]) for i, p in enumerate(pictures)}
    assert images.pixels(df).count() == sum(p.shape[0] * p.shape[1] for p in pictures)
    raw = spark.createDataFrame([("k", 5, 7, bytearray(pictures[1].tobytes()))], "k string, w int, h int, data binary")
    found = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in images.from_rgba(raw, "k", "w", "h", "data").collect()}
    assert found == {(y, x): tuple(int(v) for v in pictures[1][y, x]) for y in range(7) for x in range(5)}


def test_png_filters():
    def unfiltered(mode, line, above):
        out = []
        for i, v in enumerate(line):
            a, b, c = (out[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda q: abs(p - q))][mode]
            out.append((v + guess) & 255)
        return out

    rng = np.random.default_rng(2)
    rows, want, above = b"", [], [0] * 9
    for mode in range(5):
        line = rng.integers(0, 256, 9).tolist()
        rows += bytes([mode, *line])
        above = unfiltered(mode, line, above)
        want.append(above)
    data = images.PNG_MAGIC + images._chunk(b"IHDR", b"\0\0\0\x09\0\0\0\x05\x08\0\0\0\0") + images._chunk(b"IDAT", zlib.compress(rows)) + images._chunk(b"IEND", b"")
    assert images.decode_png(data)[..., 0].tolist() == want


def test_other_headers(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x20\x00\x30" + bytes(10)
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (200).to_bytes(2, "little") + bytes(4)
    bmp = b"BM" + bytes(12) + (40).to_bytes(4, "little") + (64).to_bytes(4, "little") + (-48).to_bytes(4, "little", signed=True)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    avif = b"\0\0\0\x14ftypavif\0\0\0\0mif1" + b"\0\0\0\x14ispe\0\0\0\0" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    df = spark.createDataFrame([(bytearray(x),) for x in (jpeg, gif, bmp, webp, avif, b"none", b"")] + [(None,)], "content binary")
    got = [(r.format, r.width, r.height) for r in images.headers(df).collect()]
    assert got == [("jpeg", 48, 32), ("gif", 300, 200), ("bmp", 64, 48), ("webp", 100, 50), ("avif", 640, 480), (None, None, None), (None, None, None), (None, None, None)]


def charts_of(spark):
    cells = plans.cells(spark, SF).where("chart_id < 4").select("chart_id", "y", "x", "label")
    palette = spark.createDataFrame([(c, i, 40 * i, 255 - i, 7, "+", f"<n{i}> & \"q\"") for c in range(4) for i in range(5)], "chart_id long, idx int, r int, g int, b int, symbol string, name string")
    return cells, palette


def test_chart_json_round_trip(spark):
    cells, palette = charts_of(spark)
    read = charts.read_json(charts.write_json(cells, palette))
    assert read.where("problem is not null").count() == 0
    key = lambda rows: sorted((r.chart_id, r.y, r.x, -1 if r.label is None else r.label) for r in rows)
    assert key(charts.cells(read).collect()) == key(cells.collect())
    assert charts.palette(read).count() == 20


def test_chart_json_refusals(spark):
    texts = {"x": "not-a-chart", "{}": "not-a-chart", '{"formatVersion":8,"width":1,"height":1,"cellPalette":[255],"palette":[]}': "newer-version", '{"width":0,"height":1,"cellPalette":[],"palette":[]}': "size",
             '{"width":2,"height":1,"cellPalette":[255],"palette":[]}': "cell-count", '{"width":1,"height":1,"cellPalette":[0],"palette":[]}': "label-out-of-palette",
             '{"width":1,"height":1,"cellPalette":[0],"palette":[{"rgb":[1,2,300]}]}': "colour", '{"width":1,"height":1,"cellPalette":[0],"palette":[{"rgb":[1,2,3]}]}': None}
    got = {r.text: r.problem for r in charts.read_json(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == texts


def test_oxs_round_trip_and_report(spark):
    cells, palette = charts_of(spark)
    items, read, report = charts.read_oxs(charts.write_oxs(cells, palette))
    key = lambda rows, shift: sorted((r.chart_id, r.y, r.x, r.label - shift) for r in rows if r.label is not None)
    assert key(read.collect(), 1) == key(cells.collect(), 0)
    assert report.count() == 0
    names = {(r.chart_id, r.idx - 1, r.name) for r in items.where("not cloth").collect()}
    assert names == {(r.chart_id, r.idx, r.name) for r in palette.collect()}
    broken = '<chart><properties chartwidth="2" chartheight="2"/><palette><palette_item index="0" number="cloth"/><palette_item index="1" color="ff0000"/></palette><fullstitches><stitch x="0" y="0" palindex="1" marked="true"/><stitch x="0" y="0" palindex="1"/><stitch x="5" y="0" palindex="1"/><stitch x="1" y="1" palindex="0"/><stitch x="z" y="1" palindex="0"/></fullstitches><partstitches><partstitch x="1" y="1"/></partstitches></chart>'
    _, read, report = charts.read_oxs(spark.createDataFrame([(1, broken)], "chart_id long, text string"))
    assert [(r.y, r.x, r.label) for r in read.collect()] == [(0, 0, 1)]
    assert {r.kind: r.n for r in report.collect()} == {"duplicate": 1, "out-of-grid": 1, "cloth": 1, "unreadable": 1, "part-stitches": 1, "completion-marks": 1}


def test_thread_lists(spark):
    texts = {1: "number;name;hex\n310;Black;#000000\n1;\"a;b\";ffFF00", 2: "310,Black", 3: "\n310,Black,nope", 4: '[["5","Five","#010203"]]', 5: '{"threads":[{"code":"6","name":"Six","rgb":[1,2,3]}]}', 6: "[", 7: ""}
    df = spark.createDataFrame(list(texts.items()), "k int, text string")
    got = {}
    for r in charts.thread_lists(df, "k").collect():
        got.setdefault(r.k, []).append((r.code, r.name, r.hex) if r.error is None else r.error)
    assert got[1] == [("310", "Black", "000000"), ("1", "a;b", "ffff00")]
    assert got[2] == ["line 1 has 2 cells"] and got[3] == ["line 2: no colour"] and got[6][0].startswith("not JSON")
    assert got[4] == [("5", "Five", "010203")] and got[5] == [("6", "Six", "010203")] and 7 not in got
    threads = charts.thread_lists(df.where("k = 1"), "k")
    text = charts.write_thread_list(threads, "k").first().text
    assert charts.read_thread_list(text)[0] == got[1]


def test_palettes_pixel_art_png_and_zip(spark):
    df = spark.createDataFrame([(1, '{"colors":["#FF0000","00ff00"]}'), (2, '{"colors":[{"hex":"#0000ff","name":"Blue"}]}')], "k int, text string")
    assert {(r.k, r.idx, r.hex, r.name) for r in charts.read_palettes(df, "k").collect()} == {(1, 0, "ff0000", None), (1, 1, "00ff00", None), (2, 0, "0000ff", "Blue")}
    cells, palette = charts_of(spark)
    drawn = charts.write_png(cells, palette, size=2)
    pictures = drawn.select(F.col("chart_id").cast("string").alias("photo_id"), F.col("png").alias("content"))
    pixels = images.pixels(pictures).where("x % 2 = 0 and y % 2 = 0").selectExpr("photo_id", "y div 2 y", "x div 2 x", "r", "g", "b", "a")
    read, colours, refused = charts.read_pixel_art(pixels)
    assert refused.count() == 0
    assert read.where("label is not null").count() == cells.where("label is not null").count()
    assert charts.read_pixel_art(pixels.withColumn("a", F.lit(7)))[2].count() == 4
    zipped = charts.write_zip(drawn.select(F.lit(1).alias("k"), F.concat("chart_id", F.lit(".png")).alias("name"), "png"), "k", "name", "png").first().zip
    assert bytes(zipped)[:2] == b"PK"


def test_pictures_come_from_lines(spark):
    """Charts of any place and size, cut by batches; labels without a colour and charts without a palette are clear."""
    import io
    import zipfile

    rng = np.random.default_rng(4)
    planes = {c: rng.integers(-1, 5, (3 + c, 9 - c)) for c in range(5)}
    cells = spark.createDataFrame([(c, y, x, int(v) if v >= 0 else None) for c, g in planes.items() for (y, x), v in np.ndenumerate(g)], "chart_id int, y long, x long, label int")
    palette = spark.createDataFrame([(c, i, 60 * i, 7, 255) for c in range(4) for i in (0, 1, 3)], "chart_id int, idx int, r long, g long, b long")
    table = np.array([(0, 7, 255, 255), (60, 7, 255, 255), (0, 0, 0, 0), (180, 7, 255, 255), (0, 0, 0, 0), (0, 0, 0, 0)], np.uint8)
    want = {c: table[g] if c < 4 else np.zeros((*g.shape, 4), np.uint8) for c, g in planes.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        drawn = charts.write_png(cells, palette, size=2)
        plan = drawn._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 1
        assert {r.chart_id: images.decode_png(bytes(r.png)).tolist() for r in drawn.collect()} == {c: p.repeat(2, 0).repeat(2, 1).tolist() for c, p in want.items()}
        packed = charts.write_pages(cells.where("chart_id = 2"), palette, (7, 5), (4, 4), 1).first().zip
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with zipfile.ZipFile(io.BytesIO(bytes(packed))) as archive:
        pages = {n: images.decode_png(archive.read(n)).tolist() for n in archive.namelist()}
    cut = {"A1": (0, 4, 0, 4), "A2": (0, 4, 3, 7), "B1": (3, 5, 0, 4), "B2": (3, 5, 3, 7)}
    assert pages == {f"{n}.png": want[2][a:b, c:d].repeat(4, 0).repeat(4, 1).tolist() for n, (a, b, c, d) in cut.items()}


def test_pixel_art_decodes_once(spark):
    runs = spark.sparkContext.accumulator(0)
    picture = images.encode_png(np.full((2, 3, 4), 255, np.uint8))

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([("a", bytearray(picture))], "photo_id string, content binary").mapInArrow(counted, "photo_id string, content binary")
    cells, _, _ = charts.read_pixel_art(images.pixels(files))
    assert cells.where("label = 0").count() == 6 and runs.value == 1


def test_exports_of_every_kind(spark):
    import io
    import zipfile

    cells, palette = charts_of(spark)
    for kind in ("editable", "oxs", "png-color", "png-bw"):
        assert charts.export(kind, cells, palette).count() == 4
    zipped = charts.export("pages", cells, palette, size=(48, 36), per_page=(20, 20), overlap=3).first().zip
    names = zipfile.ZipFile(io.BytesIO(bytes(zipped))).namelist()
    assert names == ["A1.png", "A2.png", "A3.png", "B1.png", "B2.png", "B3.png"]
    try:
        charts.export("fax", cells, palette)
        raise AssertionError
    except ValueError as refused:
        assert "fax" in str(refused)
    assert {r.label for r in charts.two_label(cells, 2).select("label").distinct().collect()} == {0, 1, None}
