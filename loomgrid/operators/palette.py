"""Palettes, threads and edits of a chart: matching, naming, merging, layers and selections; built-in operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import colour
from loomgrid.operators import grid
from loomgrid.operators import nearest as lists

LAB = ("ok_l", "ok_a", "ok_b")


def swatch_difference(current: tuple[Column, Column], candidate: tuple[Column, Column]) -> Column:
    """Lightness and saturation of a candidate against a colour, in whole points, halves away from zero."""
    points = lambda a, b: F.round((b - a) * 100).cast("int")
    return F.struct(points(current[0], candidate[0]).alias("lightness"), points(current[1], candidate[1]).alias("saturation"))


def history_text(kind: Column, before: Column, after: Column) -> Column:
    """A line of a subscription's history in words."""
    return (
        F.when(kind == "created", F.concat(F.lit("Started as "), after))
        .when(kind == "status", F.concat(F.lit("Status "), F.coalesce(before, F.lit("none")), F.lit(" → "), F.coalesce(after, F.lit("none"))))
        .when(kind == "price", F.concat(F.lit("Plan "), F.coalesce(before, F.lit("none")), F.lit(" → "), F.coalesce(after, F.lit("none"))))
        .when((kind == "cancel") & (after == "true"), "Will end with the period")
        .when(kind == "cancel", "Will renew")
        .otherwise(F.concat_ws(" ", kind, before, after))
    )


def label_means(cells: DataFrame, key: str = "chart_id") -> DataFrame:
    """(key, label, r, g, b): each label's mean in OKLab as sRGB."""
    mean = colour.with_oklab(cells.where("label is not null")).groupBy(key, "label").agg(*(F.avg(c).alias(c) for c in LAB))
    return colour.with_rgb(mean, tuple(F.col(c) for c in LAB), ("r", "g", "b")).select(key, "label", "r", "g", "b")


def vivid_label_means(cells: DataFrame, key: str = "chart_id") -> DataFrame:
    """(key, label, ok_l, ok_a, ok_b): mean lightness of all cells, colour of the quarter with most chroma, ties by place."""
    lab = colour.with_oklab(cells.where("label is not null"))
    one = Window.partitionBy(key, "label")
    ranked = lab.withColumns({"_n": F.count("*").over(one), "_nth": F.row_number().over(one.orderBy(F.desc(F.col("ok_a") * F.col("ok_a") + F.col("ok_b") * F.col("ok_b")), "y", "x"))})
    top = F.col("_nth") <= F.ceil(F.col("_n") / 4)
    return ranked.groupBy(key, "label").agg(F.avg("ok_l").alias("ok_l"), *(F.avg(F.when(top, F.col(c))).alias(c) for c in LAB[1:]))


def coverage(points: DataFrame, palette: DataFrame, parts: list[str], key: str, far: float = 0.10) -> DataFrame:
    """(key, missing): the share of points farther than ``far`` from every colour of the palette."""
    near = grid.nearest(points, palette, parts)
    return near.groupBy(key).agg(F.avg((F.sqrt("distance_sq") > far).cast("int")).alias("missing"))


def onto_threads(colours: DataFrame, threads: DataFrame, key: str, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(map, merged): each palette colour's nearest thread, the first in the list among equals, and the threads so used with their cells added up.

    ``colours`` has the key, idx, count and parts; ``threads`` ord and parts, a list of any length.  Threads keep the order of the
    first colour that took them.
    """
    mapped = grid.nearest(colours, threads, parts, "ord")
    used = mapped.groupBy(key, "nearest").agg(F.sum("count").alias("count"), F.min("idx").alias("first"))
    place = (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("int")
    merged = used.withColumn("new_idx", place)
    return mapped.join(merged.select(key, "nearest", "new_idx"), [key, "nearest"]).select(key, "idx", "new_idx"), merged.select(key, "new_idx", F.col("nearest").alias("ord"), "count")


def named(colours: DataFrame, names: DataFrame, parts: list[str], key: str = "chart_id") -> DataFrame:
    """(key, idx, name): each colour's own name of a dictionary, the closest pair first, every name once a chart.

    A colour can lose at most as many names as its chart has other colours, so as many of the nearest as there are colours hold all
    that it may get; those are found once for each distinct colour.  Equal pairs go to the lowest idx, then to the first name.
    """
    most = colours.groupBy(key).count().agg(F.max("count")).first()[0] or 1
    found = lists.nearest_lists(colours.select(*parts).distinct(), names.select("name", *parts), parts, idx="name", k=most, apart=True)
    near = found.select(*parts, F.explode("near").alias("n")).select(*parts, F.col("n.d").alias("d"), F.col("n.idx").alias("name"))
    pairs = colours.select(key, "idx", *parts).join(near, parts).select(key, "idx", "name", "d")
    return lists.matched(pairs, [key], "idx", "name", "d").select(key, "idx", "name")


def name_for(colour_row: dict[str, float], names: DataFrame, taken: DataFrame, parts: list[str]) -> DataFrame:
    """The nearest name that is not taken, one row."""
    d = sum(((F.col(p) - colour_row[p]) * (F.col(p) - colour_row[p]) for p in parts[1:]), (F.col(parts[0]) - colour_row[parts[0]]) * (F.col(parts[0]) - colour_row[parts[0]]))
    return names.join(taken, "name", "left_anti").orderBy(d, "name").limit(1).select("name")


def thread_identity(system: Column, code: Column, name: Column) -> Column:
    """What makes two palette colours one thread: system and code, spaces and case aside; null without a code."""
    return F.when(code.isNotNull() & (F.trim(code) != ""), F.concat_ws(":", F.lower(F.trim(F.coalesce(system, F.lit("")))), F.upper(F.trim(code))))


def matched(ours: DataFrame, theirs: DataFrame, key: str = "identity") -> tuple[DataFrame, DataFrame]:
    """(map, palette): their colours onto ours by identity, else by hex; those that match none are appended in their order.

    Both have idx, identity and hex.
    """
    by = lambda rows, c: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("idx").alias("to"))
    one, two = by(ours, key).withColumnRenamed("to", "t1"), by(ours.where(F.col(key).isNull()), "hex").withColumnRenamed("to", "t2")
    joined = theirs.join(one, key, "left").join(two, "hex", "left").withColumn("to", F.coalesce("t1", F.when(F.col(key).isNull(), F.col("t2"))))
    base = ours.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("base"))  # one row
    fresh = joined.where("to is null").groupBy(F.coalesce(key, "hex").alias("who")).agg(F.min("idx").alias("idx"), F.first(key).alias(key), F.first("hex").alias("hex"))
    placed = fresh.join(F.broadcast(base)).withColumn("to", (F.col("base") + F.row_number().over(Window.orderBy("idx")) - 1).cast("int"))  # a palette's rows
    mapping = joined.where("to is not null").select("idx", "to").union(joined.where("to is null").select("idx", F.coalesce(key, "hex").alias("who")).join(placed.select("who", F.col("to")), "who").select("idx", "to"))
    return mapping, ours.select("idx", key, "hex").union(placed.select(F.col("to").alias("idx"), key, "hex"))


def merged_duplicates(colours: DataFrame, key: str = "chart_id") -> DataFrame:
    """(key, idx, to): each colour's first with the same identity, renumbered without gaps."""
    who = F.coalesce(thread_identity(F.col("system"), F.col("code"), F.col("name")), F.col("hex"))
    first = colours.withColumn("first", F.min("idx").over(Window.partitionBy(key, who)))
    return first.select(key, "idx", (F.dense_rank().over(Window.partitionBy(key).orderBy("first")) - 1).cast("int").alias("to"))


def relabelled(cells: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Cells with labels replaced; labels that the map lacks stay."""
    pairs = F.create_map(*(F.lit(v) for pair in mapping.items() for v in pair)) if mapping else None
    return cells if pairs is None else cells.withColumn("label", F.coalesce(F.element_at(pairs, F.col("label")), F.col("label")).cast("int"))


def filled(cells: DataFrame, seeds: DataFrame, label: int, key: list[str], corners: bool = False) -> DataFrame:
    """Cells with the seeds' regions in another label."""
    hit = grid.flood(cells, seeds, key, corners).select(*key, "y", "x", F.lit(True).alias("_hit"))
    return cells.join(hit, [*key, "y", "x"], "left").withColumn("label", F.when(F.col("_hit"), F.lit(label)).otherwise(F.col("label"))).drop("_hit").select(cells.columns)


def lifted(cells: DataFrame, area: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(left behind, piece): the area's cells taken out, empty where they lay."""
    marked = cells.join(area.select(*key, "y", "x", F.lit(True).alias("_in")), [*key, "y", "x"], "left")
    rest = marked.withColumn("label", F.when(F.col("_in"), F.lit(None)).otherwise(F.col("label"))).select(cells.columns)
    return rest, marked.where("_in and label is not null").select(cells.columns)


def stamped(cells: DataFrame, piece: DataFrame, key: list[str]) -> DataFrame:
    """A piece laid over cells; what lies outside the grid is lost."""
    over = piece.where("label is not null").select(*key, "y", "x", F.col("label").alias("_over"))
    return cells.join(over, [*key, "y", "x"], "left").withColumn("label", F.coalesce("_over", "label")).drop("_over").select(cells.columns)


def merged_layers(lower: DataFrame, upper: DataFrame, key: list[str]) -> DataFrame:
    """Two layers as one: the upper's cell where it has one."""
    u = upper.where("label is not null").select(*key, "y", "x", F.col("label").alias("_u"))
    both = lower.select(*key, "y", "x", "label").join(u, [*key, "y", "x"], "full_outer")
    return both.select(*key, "y", "x", F.coalesce("_u", "label").alias("label"))


def tidy_kinds(cells: DataFrame) -> DataFrame:
    """An empty cell has kind 0."""
    return cells.withColumn("kind", F.when(F.col("label").isNull(), F.lit(0)).otherwise(F.coalesce("kind", F.lit(0))))


def centre_block(size: Column) -> Column:
    """The middle cell of an axis, or both of an even one."""
    return F.when(size % 2 == 1, F.array(F.floor(size / 2).cast("int"))).otherwise(F.array((size / 2 - 1).cast("int"), (size / 2).cast("int")))


def pair_value(evidence: DataFrame, key: list[str]) -> DataFrame:
    """(key, y, x, dy, dx, value): four stored slots a cell and the same read from the other side."""
    sides = [(0, 1), (1, 0), (1, 1), (1, -1)]
    both = F.array(*(s for i, (dy, dx) in enumerate(sides) for s in (
        F.struct(F.col("y").alias("y"), F.col("x").alias("x"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.col("ev")[i].alias("value")),
        F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.col("ev")[i].alias("value")),
    )))
    return evidence.select(*key, F.inline(both)).where("value is not null")


def rank_thresholds(scores: DataFrame, mark: str = "mark", score: str = "score", order: str = "cell") -> DataFrame:
    """``scores`` with ``threshold``: (rank + 0.5) / n within each mark, by score and then by cell."""
    one = Window.partitionBy(mark)
    return scores.withColumn("threshold", (F.row_number().over(one.orderBy(score, order)) - 0.5) / F.count("*").over(one))


def line_threads(lines: DataFrame, palette: DataFrame, parts: list[str], limit: float, most: int = 100) -> DataFrame:
    """(line_id, idx): each line's nearest colour if it lies within the limit, else one of its own while the palette has room, else the nearest all the same.

    New colours are one for each distinct line colour in the order of their first line.
    """
    near = grid.nearest(lines, palette, parts)
    count = palette.count()
    fresh = near.where(F.col("distance_sq") > limit * limit).groupBy(*parts).agg(F.min("line_id").alias("first"))
    few = fresh.orderBy("first").limit(max(0, most - count))  # what the palette has room for
    number = few.withColumn("new", (F.row_number().over(Window.orderBy("first")) + count - 1).cast("int"))
    joined = near.join(number.drop("first"), parts, "left")
    return joined.select("line_id", F.when((F.col("distance_sq") > limit * limit) & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("nearest")).cast("int").alias("idx"))


def edited(items: Column, what: str, *values) -> Column:
    """An ordered list with one edit: ``add`` (value), ``remove`` (place), ``move`` (from, to); places from 0."""
    at = lambda i: F.element_at(items, i + 1)
    if what == "add":
        return F.array_append(items, F.lit(values[0]))
    without = F.filter(items, lambda _, i: i != values[0])
    return without if what == "remove" else F.array_insert(without, values[1] + 1, at(values[0]))


def referenced(requests: DataFrame, nested: Column) -> DataFrame:
    """(value): the distinct keys named anywhere in a nested array."""
    return requests.select(F.explode(nested).alias("value")).where("value is not null").distinct()


def ramp(spark: SparkSession, w: int, h: int) -> DataFrame:
    """(y, x, first, second, position): a preview of a dither, from the first colour at the left to the second at the right."""
    n = F.col("id")
    return spark.range(w * h).select(F.floor(n / w).alias("y"), (n % w).alias("x"), F.lit(0).alias("first"), F.lit(1).alias("second"), ((n % w + 0.5) / w).alias("position"))


def signature(body: Column, secret: str) -> Column:
    """HMAC-SHA256 of a text as lower-case hex, in the JVM: two hashes around the padded key, which is a literal."""
    key = secret.encode()
    if len(key) > 64:
        raise ValueError("the key is longer than a block")
    pad = lambda v: F.lit(bytearray(b ^ v for b in key.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signed_text(signed: Column, body: Column) -> Column:
    """What is signed: the moment in seconds, a dot, and the body."""
    return F.concat_ws(".", signed.cast("string"), body)


def accepted(body: Column, signed: Column, given: Column, now: Column, secret: str, seconds: int = 300) -> Column:
    """Whether an event's signature is its own and not older (or newer) than ``seconds``; null parts are refused.

    Signatures are compared by their hashes, so how long it takes tells nothing about where two differ.
    """
    same = F.sha2(signature(signed_text(signed, body), secret), 256) == F.sha2(F.lower(given), 256)
    return F.coalesce(same & (F.abs(now - signed) <= seconds), F.lit(False))


def photo_store(store: DataFrame, new: DataFrame, now: str, hours: int = 24, most: int = 1000) -> DataFrame:
    """A content-addressed store after new photos: one row an id, those used within ``hours`` only, the ``most`` last used."""
    both = store.unionByName(new).groupBy("photo_id").agg(F.max("used_at").alias("used_at"), F.first("bytes").alias("bytes"))
    young = both.where(F.col("used_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))
    return young.orderBy(F.desc("used_at"), "photo_id").limit(most)
