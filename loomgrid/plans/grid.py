"""Grid queries over rasters that both engines build by the same integer arithmetic, one picture and one chart for each supplier,
over embeddings as points (first three components, the first sixteen as a palette) and over line items as lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import colour
from loomgrid.functions import scalars as S
from loomgrid.operators import clustering as C
from loomgrid.operators import grid as G
from loomgrid.operators import kernels as K
from loomgrid.operators import nearest as N
from loomgrid.operators import planes, ranks, regiongraph, tiles
from loomgrid.operators import versions as V
from loomgrid.operators.grid import kept
from loomgrid.plans.registry import query, read
from loomgrid.sources import matrices

W, H = 48, 36
#: Pictures that one task makes.
PICTURES = 256
_CHANNELS = {"r": "(x * 7 + y * 3 + image_id * 31) % 256", "g": "(x * x + y * 5 + image_id * 17) % 256", "b": "(x * y + image_id * 7) % 256", "a": "case when (x + 2 * y + image_id) % 11 < 2 then 0 else 255 end"}
_P = f"(select i.v image_id, t.v y, s.v x, {', '.join(e.replace('image_id', 'i.v').replace('x', 's.v').replace('y', 't.v') + ' ' + c for c, e in list(_CHANNELS.items())[:3])}, case when (s.v + 2 * t.v + i.v) % 11 < 2 then 0 else 255 end a from (select s_suppkey v from supplier) i, range({H}) t(v), range({W}) s(v))"
_C = "(select i.v chart_id, t.v y, s.v x, case when (s.v // 3 + t.v // 2) % 7 = 0 then null else ((s.v // 4) * 3 + (t.v // 5) * 2 + i.v) % 5 end as label, case when (s.v + t.v) % 9 = 0 then 1 else 0 end kind from (select s_suppkey v from supplier) i, range(36) t(v), range(48) s(v))"
_L = "(select l_orderkey * 10 + l_linenumber line_id, l_partkey % 20 x1, l_suppkey % 15 y1, l_orderkey % 20 x2, l_linenumber * 2 y2, l_suppkey % 4 as label from lineitem)"


def pixels(spark, sf_dir):
    """(image_id, y, x, r, g, b, a) of small pictures, one for each supplier."""
    n = F.col("n")
    owners = G.dealt(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")), "image_id", PICTURES)
    each = owners.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(H * W - 1))).alias("n"))
    at = each.select("image_id", F.floor(n / W).alias("y"), (n % W).cast("long").alias("x"))
    return at.select("*", *(F.expr(e).cast("int").alias(c) for c, e in _CHANNELS.items()))


def cells(spark, sf_dir):
    """(chart_id, y, x, label, kind) of small charts with empty cells, one for each supplier."""
    at = pixels(spark, sf_dir).select(F.col("image_id").alias("chart_id"), "y", "x")
    label = F.when((F.floor(F.col("x") / 3) + F.floor(F.col("y") / 2)) % 7 == 0, None).otherwise((F.floor(F.col("x") / 4) * 3 + F.floor(F.col("y") / 5) * 2 + F.col("chart_id")) % 5)
    return at.select("*", label.cast("int").alias("label"), F.when((F.col("x") + F.col("y")) % 9 == 0, 1).otherwise(0).alias("kind"))


def lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber line_id", "cast(l_partkey % 20 as int) x1", "cast(l_suppkey % 15 as int) y1", "cast(l_orderkey % 20 as int) x2", "l_linenumber * 2 y2", "cast(l_suppkey % 4 as int) label")


def _lab():
    return F.col("ok_l"), F.col("ok_a"), F.col("ok_b")


def points(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"p{i}") for i in range(3)))


PARTS = ["p0", "p1", "p2"]
_PT = "(select vec_id, embedding[1]::double p0, embedding[2]::double p1, embedding[3]::double p2 from embeddings)"


@query(f"""with ax as (select c.v cell, x.v pixel, least(x.v + 1.0::double, (c.v + 1) * 48 / 10.0::double) - greatest(x.v::double, c.v * 48 / 10.0::double) w from range(10) c(v), range(48) x(v)),
    ay as (select c.v cell, x.v pixel, least(x.v + 1.0::double, (c.v + 1) * 36 / 7.0::double) - greatest(x.v::double, c.v * 36 / 7.0::double) w from range(7) c(v), range(36) x(v)),
    j as (select image_id, ay.cell cy, ax.cell cx, ax.w * ay.w area, ax.w * ay.w * a / 255.0::double w, r, g, b from {_P} p join ax on x = ax.pixel and ax.w > 0 join ay on y = ay.pixel and ay.w > 0),
    l as (select *, case when r / 255.0::double <= 0.04045 then r / 255.0::double / 12.92 else pow((r / 255.0::double + 0.055) / 1.055, 2.4) end lr from j)
    select image_id, cy, cx, round(case when sum(w) > 0 then sum(lr * w) / sum(w) end, 6) red, round(sum(w) / sum(area), 6) coverage, sum(w) / sum(area) < 0.5 - 1e-9 as empty from l group by all""")
def a9_j10_downsample(spark, sf_dir):
    out = G.downsample(pixels(spark, sf_dir), (W, H), (10, 7))
    return out.select("image_id", "cy", "cx", F.round("red", 6).alias("red"), F.round("coverage", 6).alias("coverage"), (F.col("coverage") < 0.5 - 1e-9).alias("empty"))


@query(f"""with j as (select image_id, y // 6 cy, x // 6 cx, greatest(r, g, b) - least(r, g, b) bucket, a / 255.0::double w from {_P} p), t as (select image_id, cy, cx, bucket, sum(w) w from j group by all),
    k as (select *, sum(w) over (partition by image_id, cy, cx order by bucket desc) kept, sum(w) over (partition by image_id, cy, cx) total from t)
    select image_id, cy, cx, max(bucket) cutoff from k where kept >= total * 0.25 - 1e-9 group by all""")
def a10_vivid_cutoff(spark, sf_dir):
    return G.vivid_cutoffs(pixels(spark, sf_dir), (W, H), (8, 6))


_LIGHT = "cast(floor(0.2126::double * r + 0.7152::double * g + 0.0722::double * b + 0.5) as int)"
_SOBEL = f"""(with p as (select image_id, y, x, {_LIGHT} light from {_P} q),
    o as materialized (select p.*, dy.v dy, dx.v dx, least(greatest(p.y + dy.v, 0), 35) ny, least(greatest(p.x + dx.v, 0), 47) nx from p, range(-1, 2) dy(v), range(-1, 2) dx(v)),
    n as (select o.*, q.light l from o join p q on q.image_id = o.image_id and q.y = ny and q.x = nx),
    s as (select image_id, y, x, any_value(light) light, sum(l * dx * (2 - abs(dy))) gx, sum(l * dy * (2 - abs(dx))) gy from n group by all)
    select image_id, y, x, light, gx, gy, case when sqrt((gx * gx + gy * gy)::double) < 40 then 0 else sqrt((gx * gx + gy * gy)::double) end::float magnitude from s)"""


def _edges(spark, sf_dir):
    light = pixels(spark, sf_dir).withColumn("light", colour.luminance(F.col("r"), F.col("g"), F.col("b")))
    return G.sobel(light, ["image_id"], "light")


@query(f"select image_id, y, x, gx::bigint gx, gy::bigint gy, round(magnitude::double, 3) magnitude from {_SOBEL}")
def w6_sobel(spark, sf_dir):
    return _edges(spark, sf_dir).select("image_id", "y", "x", F.col("gx").cast("long"), F.col("gy").cast("long"), F.round(F.col("magnitude").cast("double"), 3).alias("magnitude"))


@query(f"select image_id, round(magnitude::double, 3) magnitude from (select *, row_number() over (partition by image_id order by magnitude) nth, count(*) over (partition by image_id) n from {_SOBEL}) where nth = floor((n - 1) * 0.999::double) + 1")
def a12_kth_smallest(spark, sf_dir):
    return ranks.kth(_edges(spark, sf_dir), ["image_id"], "magnitude", lambda n: F.floor((n - 1) * 0.999)).withColumn("magnitude", F.round(F.col("magnitude").cast("double"), 3))


@query(f"""with e as (select *, x // 6 cx, y // 6 cy from {_SOBEL}), k as (select image_id, max(magnitude) m from e group by 1)
    select image_id, cy, cx, round(least(1.0, 0.7::double * max(least(1.0, magnitude::double / m::double)) + 0.3::double * least(1.0, sqrt(greatest(0, avg((light / 255.0::double) ^ 2) - avg(light / 255.0::double) ^ 2)) / 0.5)), 6) importance from e join k using (image_id) group by all""")
def a11_j11_importance(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    most = edges.groupBy("image_id").agg(F.max("magnitude").alias("m"))
    scaled = edges.join(most, "image_id").withColumn("edge", F.least(F.lit(1.0), F.col("magnitude") / F.col("m")))
    return G.importance(scaled, (W, H), (8, 6)).withColumn("importance", F.round("importance", 6))


@query(f"select image_id, y // 5 as y, x // 5 as x, round(avg(r), 6) r, round(avg(g), 6) g from {_P} p group by all")
def a22_reduce(spark, sf_dir):
    return G.reduced(pixels(spark, sf_dir), 5, ["r", "g"]).select("image_id", "y", "x", F.round("r", 6).alias("r"), F.round("g", 6).alias("g"))


@query(f"select image_id, avg((sd < 60)::int) as share from (select image_id, stddev_pop({_LIGHT}) sd from {_P} p group by image_id, y // 8, x // 8) group by 1")
def a21_flat_share(spark, sf_dir):
    light = pixels(spark, sf_dir).withColumn("light", colour.luminance(F.col("r"), F.col("g"), F.col("b")))
    return G.flat_share(light, "light", 8, 60.0)


@query(f"select p.image_id, p.y, p.x, round(avg(q.r), 6) blurred from {_P} p, range(-2, 3) d(v), {_P} q where q.image_id = p.image_id and q.y = p.y and q.x = least(greatest(p.x + d.v, 0), 47) group by all")
def w5_box_blur(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "y", "x", F.round(G.clamped_mean("r", 2, ["image_id"], "x", "y"), 6).alias("blurred"))


@query(f"select image_id, y, x, (coalesce(lead(r) over w, r) - coalesce(lag(r) over w, r)) / (case when x in (0, 47) then 1.0 else 2.0 end)::double slope from {_P} p window w as (partition by image_id, y order by x)")
def w7_central_difference(spark, sf_dir):
    ahead, behind = G.shifted("r", 1, ["image_id"], "x", "y"), G.shifted("r", -1, ["image_id"], "x", "y")
    span = ahead.isNotNull().cast("int") + behind.isNotNull().cast("int")
    return pixels(spark, sf_dir).select("image_id", "y", "x", ((F.coalesce(ahead, "r") - F.coalesce(behind, "r")) / span).alias("slope"))


@query(f"select a.chart_id, a.y, a.x, count(*) filter (where a.label <> b.label) mismatches from {_C} a, range(-1, 2) dy(v), range(-1, 2) dx(v), {_C} b where b.chart_id = a.chart_id and b.y = a.y + dy.v and b.x = a.x + dx.v and (dy.v <> 0 or dx.v <> 0) and a.label is not null and b.label is not null group by all")
def j12_neighbour_join(spark, sf_dir):
    filled = cells(spark, sf_dir).where("label is not null")
    return G.neighbours(filled, ["chart_id"], G.AROUND, ["label"]).groupBy("chart_id", "y", "x").agg(F.count_if(F.col("label") != F.col("n_label")).alias("mismatches"))


@query(f"select distinct a.chart_id, a.y, a.x from {_C} a, range(-1, 2) dy(v), range(-1, 2) dx(v), {_C} b where b.chart_id = a.chart_id and b.y = a.y + dy.v and b.x = a.x + dx.v and (dy.v <> 0 or dx.v <> 0) and b.label = a.label and b.kind = 1")
def w12_neighbour_agreement(spark, sf_dir):
    filled = cells(spark, sf_dir).where("label is not null")
    return G.neighbours(filled, ["chart_id"], G.AROUND, ["label", "kind"]).where("n_kind = 1 and n_label = label").select("chart_id", "y", "x").distinct()


@query(f"select vec_id, idx as nearest, round(d, 9) distance_sq from (select p.vec_id, q.vec_id idx, pow(p.p0 - q.p0, 2) + pow(p.p1 - q.p1, 2) + pow(p.p2 - q.p2, 2) d from {_PT} p, {_PT} q where q.vec_id < 16) qualify row_number() over (partition by vec_id order by d, idx) = 1")
def j6_nearest(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.nearest(p, p.where("vec_id < 16").withColumnRenamed("vec_id", "idx"), PARTS).select("vec_id", "nearest", F.round("distance_sq", 9).alias("distance_sq"))


@query(f"""with d as (select p.*, q.vec_id idx, q.p0 q0, q.p1 q1, q.p2 q2, pow(p.p0 - q.p0, 2) + pow(p.p1 - q.p1, 2) + pow(p.p2 - q.p2, 2) d from {_PT} p, {_PT} q where q.vec_id < 16),
    n as (select *, row_number() over (partition by vec_id order by d, idx) nth from d where true qualify nth <= 2)
    select a.vec_id, a.idx as first, b.idx as second, round(least(1, greatest(0, ((a.p0 - a.q0) * (b.q0 - a.q0) + (a.p1 - a.q1) * (b.q1 - a.q1) + (a.p2 - a.q2) * (b.q2 - a.q2)) / (pow(b.q0 - a.q0, 2) + pow(b.q1 - a.q1, 2) + pow(b.q2 - a.q2, 2)))), 7) as position from n a join n b using (vec_id) where a.nth = 1 and b.nth = 2""")
def j8_two_nearest(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.two_nearest(p, p.where("vec_id < 16").withColumnRenamed("vec_id", "idx"), PARTS).select("vec_id", "first", "second", F.round("position", 7).alias("position"))


@query(f"""with pg as (select * from (values (0, 0, 20), (1, 17, 37), (2, 34, 48)) t(page, a, b)), ph as (select * from (values (0, 0, 20), (1, 17, 36)) t(page, a, b))
    select pg.page page_x, ph.page page_y, count(*) cells from {_C} c join pg on x >= pg.a and x < pg.b join ph on y >= ph.a and y < ph.b where label is not null group by all""")
def j9_page_join(spark, sf_dir):
    shown = G.onto_pages(cells(spark, sf_dir).where("label is not null"), spark, (W, H), (20, 20), 3)
    return shown.groupBy("page_x", "page_y").agg(F.count("*").alias("cells"))


@query("select * from (values (0, 0, 20, null::bigint, 17::bigint), (1, 17, 37, 20, 34), (2, 34, 48, 37, null)) t(page, \"start\", \"end\", before_ends, next_starts)")
def w15_page_marks(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.orderBy("page")  # the pages of one axis
    return G.pages(spark, 48, 20, 3).withColumns({"before_ends": F.lag("end").over(order), "next_starts": F.lead("start").over(order)})


@query(f"select a.vec_id a, b.vec_id b, round(pow(a.p0 - b.p0, 2) + pow(a.p1 - b.p1, 2), 9) d2 from {_PT} a join {_PT} b on a.vec_id < b.vec_id where pow(a.p0 - b.p0, 2) + pow(a.p1 - b.p1, 2) <= 0.01")
def j14_radius_join(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("p0").alias("x"), F.col("p1").alias("y"))
    return G.radius_pairs(p, 0.1, []).withColumn("d2", F.round("d2", 9))


@query(f"""select a.vec_id id, b.vec_id centre from {_PT} a join {_PT} b on b.vec_id in (select vec_id from embeddings where label = 0) and abs(floor(a.p0 / 0.5) - floor(b.p0 / 0.5)) <= 1 and abs(floor(a.p1 / 0.5) - floor(b.p1 / 0.5)) <= 1
    qualify row_number() over (partition by a.vec_id order by pow(a.p0 - b.p0, 2) + pow(a.p1 - b.p1, 2), b.vec_id) = 1""")
def j13_bucket_nearest(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("p0").alias("x"), F.col("p1").alias("y"))
    centres = read(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("id"))
    return G.bucket_nearest(p, p.join(centres, "id").withColumnRenamed("id", "centre"), 0.5).select("id", "centre")


@query(f"select a.vec_id a, b.vec_id b from {_PT} a, {_PT} b where a.vec_id < b.vec_id and b.vec_id < 16 order by pow(a.p0 - b.p0, 2) + pow(a.p1 - b.p1, 2) + pow(a.p2 - b.p2, 2), a, b limit 1")
def j16_closest_pair(spark, sf_dir):
    found = N.closest_pairs(points(spark, sf_dir).where("vec_id < 16").withColumnRenamed("vec_id", "idx"), PARTS, [])
    return found.where("a is not null").select("a", "b")


@query(f"select chart_id, label, count(*) filter (where kind = 0) whole, count(*) filter (where kind = 1) half, cast(count(*) filter (where kind = 0) + ceil(count(*) filter (where kind = 1) / 2.0) as bigint) stitches from {_C} c where label is not null group by all union all select s_suppkey, 9, 0, 0, 0 from supplier")
def a15_a17_recount(spark, sf_dir):
    all_cells = cells(spark, sf_dir)
    palette = all_cells.where("label is not null").select("chart_id", "label").union(all_cells.select("chart_id", F.lit(9))).distinct()
    return G.recounted(all_cells, palette)


@query(f"select chart_id, count(label) filled from {_C} c group by 1")
def a16_filled(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("chart_id").agg(F.count("label").alias("filled"))


@query(f"select label, round(sum(sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::double)), 4) length from {_L} l group by 1")
def a18_line_lengths(spark, sf_dir):
    return G.line_lengths(lines(spark, sf_dir), ["label"]).withColumn("length", F.round("length", 4))


@query(f"select label, min(least(x1, x2)) \"left\", min(least(y1, y2)) top, max(greatest(x1, x2)) \"right\", max(greatest(y1, y2)) bottom from {_L} l group by 1")
def a31_bounds(spark, sf_dir):
    return G.bounds(lines(spark, sf_dir), ["label"])


@query(f"select image_id, count(distinct (r, g, b)) colours from {_P} p where a = 255 group by 1")
def a32_distinct_colours(spark, sf_dir):
    return pixels(spark, sf_dir).where("a = 255").groupBy("image_id").agg(F.countDistinct("r", "g", "b").alias("colours"))


@query(f"select image_id, x, list(r order by r)[count(*) // 2 + 1] as median from {_P} p group by all")
def a29_upper_median(spark, sf_dir):
    return ranks.upper_median(pixels(spark, sf_dir), ["image_id", "x"], "r").withColumnRenamed("r", "median")


@query(f"select image_id, p_hue as bin, count(*) n from (select image_id, least(cast(floor(((atan2(b - 128, r - 128) / (2 * pi()) + 1) % 1.0) * 12) as int), 11) p_hue from {_P} p) group by all")
def a23_hue_histogram(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("image_id", colour.hue_bin(F.col("r") - 128, F.col("b") - 128).alias("bin")).agg(F.count("*").alias("n"))


@query(f"with h as (select label, count(*) n from {_C} c where label is not null group by 1) select label, n from h order by n desc, label limit 3")
def t6_heaviest_first(spark, sf_dir):
    return cells(spark, sf_dir).where("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(3)


@query("select p_partkey, row_number() over (partition by p_brand order by (p_partkey * 37) % 256, p_partkey) - 1 as place from part")
def t5_luminance_order(spark, sf_dir):
    from pyspark.sql import Window

    return read(spark, sf_dir, "part").select("p_partkey", (F.row_number().over(Window.partitionBy("p_brand").orderBy((F.col("p_partkey") * 37) % 256, "p_partkey")) - 1).cast("long").alias("place"))


@query(f"select chart_id, y, x, dense_rank() over (partition by chart_id order by label) - 1 as label from (select * from {_C} c where label is not null and label <> 1)")
def p26_compact(spark, sf_dir):
    return G.compacted(cells(spark, sf_dir).where("label is null or label <> 1")).where("label is not null").select("chart_id", "y", "x", "label")


@query(f"select chart_id, (y + 35) % 36 as y, (x + 5) % 48 as x, label from {_C} c")
def p15_wrap_shift(spark, sf_dir):
    return G.wrap_shift(cells(spark, sf_dir), W, H, 5, -1).select("chart_id", "y", "x", "label")


@query(f"select chart_id, y + 2 as y, x - 3 as x, label from {_C} c where x between 3 and 42 and y <= 27")
def p16_resize(spark, sf_dir):
    return G.resized(cells(spark, sf_dir), -3, 2, 40, 30).select("chart_id", "y", "x", "label")


@query(f"select chart_id, x as y, 35 - (47 - y) + 12 as x, label from (select chart_id, y, 47 - x as x, label from {_C} c)")
def p17_flip_rotate(spark, sf_dir):
    turned = G.rotated(G.flipped(cells(spark, sf_dir), W, H, True), W, H).select("chart_id", "y", (F.col("x")).alias("x"), "label")
    return turned.withColumn("x", H - 1 - F.col("x"))


@query(f"with k as (select * from {_C} c where x <= 23) select chart_id, y, x, label, kind from k union all select chart_id, y, 47 - x, label, case kind when 1 then 2 else kind end from k")
def p18_mirror(spark, sf_dir):
    return G.mirrored(cells(spark, sf_dir), W)


@query(f"select distinct case when x1 > x2 or (x1 = x2 and y1 > y2) then x2 else x1 end x1, case when x1 > x2 or (x1 = x2 and y1 > y2) then y2 else y1 end y1, case when x1 > x2 or (x1 = x2 and y1 > y2) then x1 else x2 end x2, case when x1 > x2 or (x1 = x2 and y1 > y2) then y1 else y2 end y2 from {_L} l")
def p19_u4_distinct_lines(spark, sf_dir):
    return G.distinct_lines(lines(spark, sf_dir), [], "line_id").select("x1", "y1", "x2", "y2")


@query(f"select line_id from {_L} l where x1 between 2 and 12 and x2 between 2 and 12 and y1 between 0 and 9 and y2 between 0 and 9")
def f10_f11_lines_inside(spark, sf_dir):
    return lines(spark, sf_dir).where("x1 between 2 and 12 and x2 between 2 and 12 and y1 between 0 and 9 and y2 between 0 and 9").select("line_id")


@query(f"select image_id, count(*) filter (where a = 0) transparent, count(*) filter (where a < 128) absent, count(*) filter (where pow(r - 120, 2) + pow(g - 120, 2) <= 900) near_colour from {_P} p group by 1")
def f7_f8_masks(spark, sf_dir):
    near = F.pow(F.col("r") - 120, 2) + F.pow(F.col("g") - 120, 2) <= 900
    return pixels(spark, sf_dir).groupBy("image_id").agg(F.count_if(F.col("a") == 0).alias("transparent"), F.count_if(F.col("a") < 128).alias("absent"), F.count_if(near).alias("near_colour"))


@query(f"select a.chart_id, a.y, a.x from {_C} a join {_C} b on b.chart_id = a.chart_id + 1 and a.x = b.x and a.y = b.y where (a.label is null) = (b.label is null) and a.label is distinct from b.label")
def f12_transparency_lock(spark, sf_dir):
    now = cells(spark, sf_dir).select("chart_id", "y", "x", "label")
    later = now.select((F.col("chart_id") - 1).alias("chart_id"), "y", "x", F.col("label").alias("after"))
    change = now.join(later, ["chart_id", "y", "x"]).where(~F.col("label").eqNullSafe(F.col("after")))
    return change.where(F.col("label").isNull() == F.col("after").isNull()).select("chart_id", "y", "x")


@query(f"select distinct y, x from {_C} c where label = 1 union select distinct y, x from {_C} c where label = 2 and chart_id = 0")
def u1_add(spark, sf_dir):
    c = cells(spark, sf_dir)
    return G.combine(c.where("label = 1"), c.where("label = 2 and chart_id = 0"), "add", ["y", "x"])


@query(f"select distinct y, x from {_C} c where label = 1 except select distinct y, x from {_C} c where label = 2 and chart_id = 0")
def u1_subtract(spark, sf_dir):
    c = cells(spark, sf_dir)
    return G.combine(c.where("label = 1"), c.where("label = 2 and chart_id = 0"), "subtract", ["y", "x"])


@query(f"select chart_id, y, x from {_C} c where label is distinct from 3")
def u2_invert(spark, sf_dir):
    c = cells(spark, sf_dir)
    return G.inverted(c.where("label = 3"), c, ["chart_id", "y", "x"])


@query(f"select y, x, arg_max(label, chart_id) as label from {_C} c where label is not null and chart_id <> 2 group by all")
def u5_flatten(spark, sf_dir):
    layers = cells(spark, sf_dir).select(F.lit(0).alias("chart_id"), F.col("chart_id").alias("layer_no"), "y", "x", "label", "kind", (F.col("chart_id") != 2).alias("visible"))
    return G.flatten(layers).select("y", "x", "label")


@query(f"select distinct label from {_C} c where label is not null")
def u6_used_colours(spark, sf_dir):
    return cells(spark, sf_dir).where("label is not null").select("label").distinct()


def _next(c):
    """Each chart's successor under its own number; the last chart has none, and its cells turn empty."""
    return c.withColumn("chart_id", F.col("chart_id") - 1).where("chart_id >= 0")


@query(f"with a as (select chart_id, y, x, label from {_C} c), b as (select chart_id - 1 as chart_id, y, x, label from {_C} c) select chart_id, y, x, a.label as before, b.label as after from a left join b using (chart_id, y, x) where a.label is distinct from b.label")
def i30_delta(spark, sf_dir):
    """What changes from each chart to the next."""
    c = cells(spark, sf_dir).select("chart_id", "y", "x", "label")
    return G.delta(c, _next(c), ["chart_id", "y", "x"], "label")


@query(f"select a.chart_id, a.y, a.x, b.label from {_C} a left join {_C} b on b.chart_id = a.chart_id + 1 and a.x = b.x and a.y = b.y")
def i30_apply(spark, sf_dir):
    """Each chart with that change made is the next."""
    c, key = cells(spark, sf_dir).select("chart_id", "y", "x", "label"), ["chart_id", "y", "x"]
    return G.apply_delta(c, G.delta(c, _next(c), key, "label"), key, "label")


_VERSIONS = _C.replace("(select i.v chart_id,", "(select i.v chart_id, z.v as version,").replace("+ i.v) % 5", "+ i.v + z.v * z.v) % 5").replace("range(36) t(v)", "range(4) z(v), range(36) t(v)")


def versions(spark, sf_dir):
    """(chart_id, version, y, x, label): four versions of every chart."""
    grown = cells(spark, sf_dir).withColumn("version", F.explode(F.array(*(F.lit(i) for i in range(4)))))
    return grown.select("chart_id", "version", "y", "x", ((F.col("label") + F.col("version") * F.col("version")) % 5).cast("int").alias("label"))


@query(f"""with d as (select a.chart_id, a.version, a.y, a.x, xor(coalesce(a.label + 1, 0), coalesce(b.label + 1, 0)) value from {_VERSIONS} a left join {_VERSIONS} b on b.chart_id = a.chart_id and b.version = a.version - 1 and b.y = a.y and b.x = a.x),
    s as (select *, x - row_number() over (partition by chart_id, version, y, value order by x) run from d where value <> 0)
    select chart_id, version, y, min(x) x, count(*) n, value::bigint as value from s group by chart_id, version, y, value, run""")
def i30_runs(spark, sf_dir):
    """The XOR runs between each version of every chart and the one before it."""
    key = ["chart_id", "version"]
    return V.runs(V.deltas(V.changes(versions(spark, sf_dir), key, "label"), ["chart_id"], "version"), key)


@query(f"select chart_id, y, x, label::bigint as label from {_VERSIONS} v where version = chart_id % 4 and label is not null")
def i30_rebuilt(spark, sf_dir):
    """A version of every chart, another for each, from its deltas; the history before version 1 folded."""
    history = V.deltas(V.changes(versions(spark, sf_dir), ["chart_id", "version"], "label"), ["chart_id"], "version")
    late = V.compacted(history.where("chart_id % 4 > 0"), ["chart_id"], "version", 1).union(history.where("chart_id % 4 = 0"))
    return V.cells(V.at_version(late, ["chart_id"], "version", F.col("chart_id") % 4), ["chart_id"]).withColumnRenamed("value", "label")


@query(f"select c.chart_id, c.y, c.x, dy, dx from {_C} c, (values (-1, 0), (0, -1), (0, 1), (1, 0)) d(dy, dx) where label = 2 and not exists (select 1 from {_C} o where o.chart_id = c.chart_id and o.label = 2 and o.y = c.y + dy and o.x = c.x + dx)")
def r5_outline(spark, sf_dir):
    return G.outline(cells(spark, sf_dir).where("label = 2"), ["chart_id"])


@query(f"select image_id, y, x, r, g, b, case when (x + y) % 3 = 0 then 0 else a end as a from {_P} p")
def r6_delete_pixels(spark, sf_dir):
    p = pixels(spark, sf_dir)
    mask = p.where("(x + y) % 3 = 0").select("image_id", "y", "x", F.lit(True).alias("hit"))
    return p.join(mask, ["image_id", "y", "x"], "left").withColumn("a", F.when(F.col("hit"), 0).otherwise(F.col("a"))).drop("hit")


@query("select distinct px as x, py as y from (select n_nationkey x, n_regionkey y from nation) n, lateral (values (x, y), (47 - x, y), (x, 35 - y), (47 - x, 35 - y)) t(px, py)")
def i5_orbit(spark, sf_dir):
    return G.orbit(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("y")), W, H, ["v", "h"])


_REGION_ROWS = f"""with recursive e as (select a.chart_id, a.y * 100 + a.x u, b.y * 100 + b.x v from {_C} a, (values (-1, 0), (0, -1), (0, 1), (1, 0)) d(dy, dx), {_C} b where a.chart_id = b.chart_id and a.label = b.label and b.y = a.y + dy and b.x = a.x + dx),
    r(chart_id, start, node) as (select chart_id, y * 100 + x, y * 100 + x from {_C} c where label is not null union select r.chart_id, r.start, e.v from r join e on e.chart_id = r.chart_id and e.u = r.node where e.v > -1)
    select chart_id, node // 100 as y, node % 100 as x, min(start) // 100 region_y, min(start) % 100 region_x from r group by chart_id, node"""


@query(_REGION_ROWS)
def i1_regions(spark, sf_dir):
    found = G.regions(cells(spark, sf_dir), ["chart_id"])
    return found.select("chart_id", "y", "x", F.shiftright("region", 32).alias("region_y"), (F.col("region") % (1 << 32)).alias("region_x"))


@query(_REGION_ROWS)
def i1_regions_by_runs(spark, sf_dir):
    """The same regions by runs of cells and connected components, for planes of any size."""
    found = G.regions_by_runs(cells(spark, sf_dir), ["chart_id"])
    return found.select("chart_id", "y", "x", F.shiftright("region", 32).alias("region_y"), (F.col("region") % (1 << 32)).alias("region_x"))


#: Regions of the charts by closure: (chart_id, node, region), places as y * 100 + x.
_REGIONS = f"""e as (select a.chart_id, a.y * 100 + a.x u, b.y * 100 + b.x v from {_C} a, (values (-1, 0), (0, -1), (0, 1), (1, 0)) d(dy, dx), {_C} b
      where a.chart_id = b.chart_id and a.label = b.label and b.y = a.y + dy and b.x = a.x + dx),
    r(chart_id, start, node) as (select chart_id, y * 100 + x, y * 100 + x from {_C} c where label is not null union select r.chart_id, r.start, e.v from r join e on e.chart_id = r.chart_id and e.u = r.node),
    g as (select chart_id, node, min(start) region from r group by all)"""


@query(f"""with recursive {_REGIONS}, i as (select g.chart_id, region, count(*) n from g join e on e.chart_id = g.chart_id and e.u = g.node group by all)
    select chart_id, (region // 100) * 4294967296 + region % 100 region, label, count(*) area, min(x) "left", min(y) top, max(x) "right", max(y) bottom, 4 * count(*) - coalesce(any_value(n), 0) perimeter
    from g join {_C} c using (chart_id) left join i using (chart_id, region) where node = y * 100 + x group by all""")
def a19_region_stats(spark, sf_dir):
    return G.region_stats(G.regions(cells(spark, sf_dir), ["chart_id"]), ["chart_id"])


@query(f"""with recursive {_REGIONS}, n as (select chart_id, region, count(*) n from g group by all)
    select chart_id, sum(case when n <= 2 then n else 0 end)::double / sum(n) ratio from n group by 1""")
def a20_confetti(spark, sf_dir):
    return G.confetti(G.regions(cells(spark, sf_dir), ["chart_id"]), ["chart_id"])


#: A place of each chart.
_SEEDS = "(select s_suppkey chart_id, s_suppkey % 36 y, s_suppkey * 7 % 48 x from supplier)"


def seeds(spark, sf_dir):
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey chart_id", "s_suppkey % 36 y", "s_suppkey * 7 % 48 x")


def _flooded(around: str, table: str, start: str) -> str:
    """What is reached from each chart's seed."""
    return f"""f(chart_id, y, x, label) as (select c.chart_id, c.y, c.x, c.label from {table} c join {start} s on s.chart_id = c.chart_id and s.y = c.y and s.x = c.x where c.label is not null
      union select c.chart_id, c.y, c.x, c.label from f, (values {around}) d(dy, dx), {table} c where c.chart_id = f.chart_id and c.label = f.label and c.y = f.y + dy and c.x = f.x + dx)"""


_CROSS, _AROUND = "(-1, 0), (0, -1), (0, 1), (1, 0)", "(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)"
_REGION = "min((y * 4294967296 + x)::bigint) over (partition by chart_id) region"


@query(f"with recursive {_flooded(_AROUND, _C, _SEEDS)} select chart_id, y, x, label, {_REGION} from f")
def i2_flood(spark, sf_dir):
    return G.flood(cells(spark, sf_dir), seeds(spark, sf_dir), ["chart_id"], corners=True)


@query(f"""with recursive p as (select * from {_P} p), t as (select p.image_id chart_id, p.y, p.x, 1 as label from p join p s on s.image_id = p.image_id and s.y = 10 and s.x = 10 where abs(p.r - s.r) + abs(p.g - s.g) <= 60),
    s as (select distinct chart_id, 10 y, 10 x from t), {_flooded(_CROSS, "t", "s")} select chart_id, y, x, label, {_REGION} from f""")
def i3_tolerance_flood(spark, sf_dir):
    """Pixels near the seed's colour (compared with the seed, not the neighbour), connected to it."""
    p = pixels(spark, sf_dir)
    seed = p.where("y = 10 and x = 10").select("image_id", F.col("r").alias("sr"), F.col("g").alias("sg"))
    near = p.join(seed, "image_id").where("abs(r - sr) + abs(g - sg) <= 60").select(F.col("image_id").alias("chart_id"), "y", "x", F.lit(1).alias("label"))
    return G.flood(near, seed.select(F.col("image_id").alias("chart_id"), F.lit(10).cast("long").alias("y"), F.lit(10).cast("long").alias("x")), ["chart_id"])


@query(f"""with recursive e as (select line_id, label * 10000 + x1 * 100 + y1 corner from {_L} t union select line_id, label * 10000 + x2 * 100 + y2 from {_L} t),
    s as (select distinct a.corner u, b.corner v from e a join e b using (line_id)), r(start, node) as (select u, u from s union select r.start, s.v from r join s on s.u = r.node),
    c as (select node, min(start) whole from r group by 1), m as (select distinct line_id, whole from e join c on node = corner)
    select line_id as node, first as root from (select line_id, min(line_id) over (partition by whole) as first, count(*) over (partition by whole) n from m) where n > 1""")
def j17_j19_i6_connected_lines(spark, sf_dir):
    return G.connected(lines(spark, sf_dir))


@query("select p_partkey, cells from (select p_partkey, case when p_size = 0 then 1 else (p_size + 1) * 4 end cells from part)")
def i28_rectangle(spark, sf_dir):
    box = G.raster_rect(F.lit(0), F.lit(0), F.col("p_size"), F.lit(3))
    return read(spark, sf_dir, "part").select("p_partkey", F.size(box).alias("cells"))


@query("""select s_suppkey, list_transform(range(0, greatest(s_suppkey % 9, s_nationkey % 7)::bigint + 1), lambda i: cast(case when greatest(s_suppkey % 9, s_nationkey % 7) = 0 then 0 else floor((s_nationkey % 7) * i / greatest(s_suppkey % 9, s_nationkey % 7)::double + 0.5) end as int))::varchar ys from supplier""")
def i28_line(spark, sf_dir):
    line = G.raster_line(F.lit(0), F.lit(0), (F.col("s_suppkey") % 9).cast("int"), F.col("s_nationkey") % 7)
    ys = F.transform(line, lambda c: c["y"].cast("string"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("["), F.array_join(ys, ", "), F.lit("]")).alias("ys"))


@query(f"select image_id, count(*) inside from {_P} p where (x - 20.0) * (x - 20.0) + 0 * y >= 0 and x >= 5 and x < 30 and y >= 5 and y < 20 group by 1")
def i28_lasso(spark, sf_dir):
    square = [(4.5, 4.5), (29.5, 4.5), (29.5, 19.5), (4.5, 19.5)]
    return pixels(spark, sf_dir).where(G.even_odd(F.col("x"), F.col("y"), square)).groupBy("image_id").agg(F.count("*").alias("inside"))


@query(f"select line_id, sum(cast(floor(sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::double) / 0.5) as bigint) + 1)::bigint as beads from {_L} l group by 1")
def r7_bead_positions(spark, sf_dir):
    return G.along(lines(spark, sf_dir), 0.5).groupBy("line_id").agg(F.count("*").alias("beads"))


@query(f"""with t as (select *, {_LIGHT} / 255.0::double t from {_P} p), m(my, mx, rank) as (values (0, 0, 0), (0, 1, 8), (0, 2, 2), (0, 3, 10), (1, 0, 12), (1, 1, 4), (1, 2, 14), (1, 3, 6), (2, 0, 3), (2, 1, 11), (2, 2, 1), (2, 3, 9), (3, 0, 15), (3, 1, 7), (3, 2, 13), (3, 3, 5))
    select image_id, y, x, case when t > (rank + 0.5) / 16.0::double then 1 else 0 end as label from t join m on y % 4 = my and x % 4 = mx""")
def p20_ordered_dither(spark, sf_dir):
    position = colour.luminance(F.col("r"), F.col("g"), F.col("b")) / 255.0
    toned = pixels(spark, sf_dir).select("image_id", "y", "x", F.lit(0).alias("first"), F.lit(1).alias("second"), position.alias("position"))
    return G.by_threshold(toned, matrices.matrix(spark, "bayer-4"), 4).select("image_id", "y", "x", "label")


@query(f"""select image_id, y, x, round(case when r / 255.0::double <= 0.04045 then r / 255.0::double / 12.92 else pow((r / 255.0::double + 0.055) / 1.055, 2.4) end, 9) linear, {_LIGHT} light from {_P} p""")
def p1_p7_linear_light(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "y", "x", F.round(colour.to_linear(F.col("r")), 9).alias("linear"), colour.luminance(F.col("r"), F.col("g"), F.col("b")).alias("light"))


def _oklab_sql(table: str) -> str:
    """``table`` with the OKLab of r, g, b as ok_l, ok_a, ok_b."""
    lin = lambda c: f"(case when {c} / 255.0::double <= 0.04045 then {c} / 255.0::double / 12.92 else pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) end)"
    lms = [f"cbrt({m[0]}::double * {lin('r')} + {m[1]}::double * {lin('g')} + {m[2]}::double * {lin('b')}) m{i}" for i, m in enumerate(colour.TO_LMS)]
    lab = [f"{m[0]}::double * m0 + {m[1]}::double * m1 + {m[2]}::double * m2 {n}" for n, m in zip(("ok_l", "ok_a", "ok_b"), colour.TO_LAB, strict=True)]
    return f"(select * exclude (m0, m1, m2), {', '.join(lab)} from (select *, {', '.join(lms)} from {table} t))"


def _rgb_sql(table: str, lab: tuple[str, str, str], names: tuple[str, str, str]) -> str:
    """``table`` with the sRGB bytes of OKLab expressions, channels clipped."""
    row = lambda m, x: " + ".join(f"{v}::double * {c}" for v, c in zip(m, x, strict=True))
    cubes = [f"pow({row(m, lab)}, 3.0) l{i}" for i, m in enumerate(colour.FROM_LAB)]
    clipped = [f"least(greatest({row(m, ('l0', 'l1', 'l2'))}, 0.0), 1.0) c{i}" for i, m in enumerate(colour.FROM_LMS)]
    bytes_ = [f"cast(floor((case when c{i} <= 0.0031308 then c{i} * 12.92::double else 1.055::double * pow(c{i}, 1 / 2.4::double) - 0.055 end) * 255 + 0.5) as int) {n}" for i, n in enumerate(names)]
    return f"(select * exclude (l0, l1, l2, c0, c1, c2), {', '.join(bytes_)} from (select *, {', '.join(clipped)} from (select *, {', '.join(cubes)} from {table} t)))"


def _lab_sql() -> str:
    lab = [f"round({c}, 7) + 0.0 as lab{i}" for i, c in enumerate(("ok_l", "ok_a", "ok_b"))]
    return f"select image_id, y, x, r r2, g g2, b b2, {', '.join(lab)} from {_oklab_sql(_P)}"


@query(_lab_sql())
def p3_p4_oklab_round_trip(spark, sf_dir):
    lab = colour.with_oklab(pixels(spark, sf_dir))
    back = colour.with_rgb(lab, _lab(), ("r2", "g2", "b2"))
    return back.select("image_id", "y", "x", "r2", "g2", "b2", *((F.round(c, 7) + 0.0).alias(f"lab{i}") for i, c in enumerate(_lab())))


@query(f"select image_id, r, g, b, count(*) n from {_P} p where a = 255 group by all")
def p10_distinct_then_map(spark, sf_dir):
    """The sliders at rest on distinct colours: each is adjusted once, then joined back and counted."""
    p = pixels(spark, sf_dir).where("a = 255")
    lab = colour.with_oklab(p.select("r", "g", "b").distinct())
    once = colour.with_rgb(lab, colour.adjust_oklab(_lab()), ("to_r", "to_g", "to_b")).drop("ok_l", "ok_a", "ok_b")
    moved = p.join(once, ["r", "g", "b"]).select("image_id", *(F.col(f"to_{c}").alias(c) for c in "rgb"))
    return moved.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def _sliders_sql() -> str:
    light = f"least(greatest({colour.MID_L}::double + ((ok_l + 0.2::double * {colour.BRIGHTNESS_REACH}::double * (1.0 - ok_l)) - {colour.MID_L}::double) * (1.0 - 0.1::double * {colour.CONTRAST_REACH}::double), 0.0), 1.0)"
    moved = f"(select image_id, y, x, a alpha, {light} n_l, ok_a * 1.3::double + 0.15::double * {colour.WARM_A}::double n_a, ok_b * 1.3::double + 0.15::double * {colour.WARM_B}::double n_b from {_oklab_sql(_P)})"
    return f"select image_id, y, x, r, g, b, alpha from {_rgb_sql(moved, ('n_l', 'n_a', 'n_b'), ('r', 'g', 'b'))}"


@query(_sliders_sql())
def p9_sliders(spark, sf_dir):
    lab = colour.with_oklab(pixels(spark, sf_dir).withColumnsRenamed({"a": "alpha"}))
    moved = colour.adjust_oklab(_lab(), brightness=20, contrast=-10, saturation=30, temperature=15)
    return colour.with_rgb(lab.select("image_id", "y", "x", "alpha", *(c.alias(n) for n, c in zip(("ok_l", "ok_a", "ok_b"), moved, strict=True))), _lab(), ("r", "g", "b")).select("image_id", "y", "x", "r", "g", "b", "alpha")


@query("select p_partkey, case when w >= h then 100 else greatest(1, cast(floor(100 * w / h::double + 0.5) as int)) end gw, case when w >= h then greatest(1, cast(floor(100 * h / w::double + 0.5) as int)) else 100 end gh from (select p_partkey, p_size + 10 w, p_partkey % 60 + 10 h from part)")
def p12_grid_size(spark, sf_dir):
    w, h = G.grid_size(F.col("p_size") + 10, F.col("p_partkey") % 60 + 10, 100)
    return read(spark, sf_dir, "part").select("p_partkey", w.alias("gw"), h.alias("gh"))


def _mulberry_sql() -> str:
    def times(a: str, b: str) -> str:
        return f"(({a})::hugeint * ({b})::hugeint % 4294967296)::bigint"

    steps = "select p_partkey, n, (p_partkey + n * 1831565813) % 4294967296 s from part, range(1, 4) t(n)"
    first = f"select *, {times('xor(s, s >> 15)', 's | 1')} t from ({steps})"
    second = f"select *, xor(t, (t + {times('xor(t, t >> 7)', 't | 61')}) % 4294967296) u from ({first})"
    return f"select p_partkey, max(d) filter (where n = 1) as first, max(d) filter (where n = 2) as second, max(d) filter (where n = 3) as third from (select *, xor(u, u >> 14) d from ({second})) group by 1"


@query(_mulberry_sql())
def fmath_mulberry(spark, sf_dir):
    """The first three draws of the generator for each part's key as a seed."""
    s1, d1 = S.mulberry_step(F.col("p_partkey"))
    s2, d2 = S.mulberry_step(s1)
    return read(spark, sf_dir, "part").select("p_partkey", d1.alias("first"), d2.alias("second"), S.mulberry_step(s2)[1].alias("third"))


_LAB = ["ok_l", "ok_a", "ok_b"]


def _lab_cells(spark, sf_dir):
    lab = colour.with_oklab(pixels(spark, sf_dir).where("a = 255"))
    return lab.select(F.col("image_id").alias("chart_id"), "y", "x", "ok_l", "ok_a", "ok_b")


@query()
def i17_floyd_steinberg(spark, sf_dir):
    return K.per_chart(_lab_cells(spark, sf_dir), K.registry()["floyd-steinberg"], ["ok_l", "ok_a", "ok_b"])


@query()
def i17_atkinson(spark, sf_dir):
    return K.per_chart(_lab_cells(spark, sf_dir), K.registry()["atkinson"], ["ok_l", "ok_a", "ok_b"])


@query()
def i8_to_i16_chart(spark, sf_dir):
    """k-means, refill, energy minimisation, small regions, diagonals and merging: a whole chart for each picture."""
    return planes.labels_by_chart(_lab_cells(spark, sf_dir), "chart_id", _LAB, lambda labs: planes.charts(labs, 8))


def _clustered(cells):
    """(cells with labels, palettes) of every picture in eight clusters."""
    # kept: a join on parts that are long expressions would work them out again for each of its filters and keys
    lab = kept(cells).hint("merge")
    blocks = C.Blocks(lab, "chart_id", _LAB)
    palettes = kept(blocks.clusters(8))
    return kept(lab.join(blocks.labels(kept(C.listed(palettes, "chart_id", _LAB))), ["chart_id", *_LAB])), palettes


def _of_clusters(spark, sf_dir, small, large):
    """Eight clusters of every picture, and of them: ``small``, of some pictures at once where they lie, ``large``, by rounds of all that one task does not hold."""
    one, others = planes.lone(_lab_cells(spark, sf_dir), "chart_id", C.BLOCK)
    found = None if one is None else planes.clustered(one, "chart_id", _LAB, 8, small)
    if others is None:
        return found
    return large(*_clustered(others)) if found is None else found.union(large(*_clustered(others)).select(found.columns))


@query()
def i15_small_regions(spark, sf_dir):
    """Eight clusters of every picture after regions of one or two cells took a neighbour's label, on the graph of regions."""
    return _of_clusters(spark, sf_dir, lambda found: planes.recoloured(found, 2), lambda cells, palettes: regiongraph.recoloured(cells, palettes, ["chart_id"], _LAB, 2))


@query()
def i14_settled(spark, sf_dir):
    """Eight clusters of every picture after energy minimisation, in tiles of 64 cells where one task does not hold it."""
    return _of_clusters(spark, sf_dir, lambda found: planes.settled(found, K.FINE), lambda cells, palettes: tiles.settled(cells, palettes, "chart_id", _LAB, K.FINE, side=64))


@query()
def i12_predict_colours(spark, sf_dir):
    """How many colours each picture needs, read from the curve of its clusters' unions; all pictures together."""
    return C.predicted(C.Blocks(_lab_cells(spark, sf_dir), "chart_id", _LAB))


@query()
def i7_i8_clusters(spark, sf_dir):
    """Eight clusters of every picture at once: joint seeds and Lloyd steps over distinct colours."""
    blocks = C.Blocks(_lab_cells(spark, sf_dir), "chart_id", _LAB)
    return blocks.clusters(8).select("chart_id", "idx", F.col("count").cast("long").alias("count"), *(F.round(c, 7).alias(c) for c in _LAB))


@query()
def i9_quantized(spark, sf_dir):
    """The palette of twelve colours of every picture after near clusters merged and freed slots went to the worst fitted colours."""
    blocks = C.Blocks(_lab_cells(spark, sf_dir), "chart_id", _LAB)
    return C.quantize(blocks, 12).select("chart_id", "idx", F.col("count").cast("long").alias("count"), *(F.round(c, 7).alias(c) for c in _LAB))
