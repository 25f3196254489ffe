"""Queries on palettes, threads, layers and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import colour
from loomgrid.operators import grid as G
from loomgrid.operators import palette as P
from loomgrid.plans.grid import _C, _CROSS, _P, _PT, _SEEDS, PARTS, _flooded, _oklab_sql, _rgb_sql, cells, pixels, points, seeds
from loomgrid.plans.registry import query, read
from loomgrid.sources import matrices


@query("select p_partkey, cast(round((p_size - 20) * 100 / 50.0::double) as int) lightness, cast(round((p_partkey % 7 - 3) * 100 / 8.0::double) as int) saturation from part")
def p11_swatch_difference(spark, sf_dir):
    told = P.swatch_difference((F.lit(20) / 50, F.lit(3) / 8), (F.col("p_size") / 50, (F.col("p_partkey") % 7) / 8))
    return read(spark, sf_dir, "part").select("p_partkey", told["lightness"].alias("lightness"), told["saturation"].alias("saturation"))


@query("select event_id, case event_type when 'click' then 'Status ' || 'none' || ' → ' || event_type else event_type || ' now' end as line from events where event_type in ('click', 'view')")
def p22_history_text(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    kind = F.when(F.col("event_type") == "click", "status").otherwise(F.col("event_type"))
    return rows.select("event_id", P.history_text(kind, F.lit(None).cast("string"), F.when(F.col("event_type") == "click", F.col("event_type")).otherwise("now")).alias("line"))


def _coloured(spark, sf_dir):
    return cells(spark, sf_dir).join(pixels(spark, sf_dir).withColumnRenamed("image_id", "chart_id").drop("a"), ["chart_id", "y", "x"])


_COLOURED = _oklab_sql(f"(select c.*, r, g, b from {_C} c join {_P} p on p.image_id = c.chart_id and p.y = c.y and p.x = c.x where label is not null)")


@query(f"select chart_id, label, r, g, b from {_rgb_sql(f'(select chart_id, label, avg(ok_l) m_l, avg(ok_a) m_a, avg(ok_b) m_b from {_COLOURED} t group by all)', ('m_l', 'm_a', 'm_b'), ('r', 'g', 'b'))}")
def a13_label_means(spark, sf_dir):
    return P.label_means(_coloured(spark, sf_dir))


@query(f"""with t as (select *, count(*) over (partition by chart_id, label) n, row_number() over (partition by chart_id, label order by round(ok_a * ok_a + ok_b * ok_b, 12) desc, y, x) nth from {_COLOURED} t)
    select chart_id, label, round(avg(ok_l), 7) ok_l, round(avg(ok_a) filter (where nth <= ceil(n / 4.0)), 7) ok_a, round(avg(ok_b) filter (where nth <= ceil(n / 4.0)), 7) ok_b from t group by all""")
def a14_vivid_label_means(spark, sf_dir):
    return P.vivid_label_means(_coloured(spark, sf_dir)).select("chart_id", "label", *(F.round(c, 7).alias(c) for c in P.LAB))


@query(f"select vec_id % 3 as part, avg((d > 0.36)::int) missing from (select p.vec_id, min(pow(p.p0 - q.p0, 2) + pow(p.p1 - q.p1, 2) + pow(p.p2 - q.p2, 2)) d from {_PT} p, {_PT} q where q.vec_id < 16 group by 1) group by 1")
def a25_coverage(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.coverage(p.withColumn("part", F.col("vec_id") % 3), p.where("vec_id < 16").withColumnRenamed("vec_id", "idx"), PARTS, "part", 0.6)


@query(f"""with m as (select p.vec_id, q.vec_id ord from {_PT} p, {_PT} q where q.vec_id < 16 and p.vec_id >= 16 qualify row_number() over (partition by p.vec_id order by pow(p.p0 - q.p0, 2) + pow(p.p1 - q.p1, 2) + pow(p.p2 - q.p2, 2), q.vec_id) = 1)
    select row_number() over (order by min(vec_id)) - 1 as new_idx, ord, sum(vec_id)::bigint as count from m group by ord""")
def a30_j7_onto_threads(spark, sf_dir):
    p = points(spark, sf_dir)
    ours = p.where("vec_id >= 16").select(F.lit(1).alias("chart_id"), F.col("vec_id").alias("idx"), F.col("vec_id").alias("count"), *PARTS)
    return P.onto_threads(ours, p.where("vec_id < 16").withColumnRenamed("vec_id", "ord"), "chart_id", PARTS)[1].drop("chart_id")


@query(f"""with recursive pairs as (select c.vec_id // 40 chart_id, (c.vec_id % 40)::int idx, 'name ' || n.vec_id as name, (c.p0 - n.p0) * (c.p0 - n.p0) + (c.p1 - n.p1) * (c.p1 - n.p1) + (c.p2 - n.p2) * (c.p2 - n.p2) d from {_PT} c, {_PT} n),
    t as (select *, false take from pairs union all
        select chart_id, idx, name, d, a = 1 and b = 1 from (
            select *, max((a = 1 and b = 1)::int) over (partition by chart_id, idx) ga, max((a = 1 and b = 1)::int) over (partition by chart_id, name) gb from (
                select *, row_number() over (partition by chart_id, idx order by d, idx, name) a, row_number() over (partition by chart_id, name order by d, idx, name) b from t where not take))
        where (a = 1 and b = 1) or (ga = 0 and gb = 0))
    select chart_id, idx, name from t where take""")
def j15_names(spark, sf_dir):
    p = points(spark, sf_dir)
    ours = p.select(F.floor(F.col("vec_id") / 40).alias("chart_id"), (F.col("vec_id") % 40).cast("int").alias("idx"), *PARTS)
    return P.named(ours, p.select(F.concat(F.lit("name "), "vec_id").alias("name"), *PARTS), PARTS)


@query(f"select 'name ' || vec_id as name from {_PT} p where vec_id % 2 = 1 order by pow(p0 - 0.1, 2) + pow(p1 - 0.2, 2) + pow(p2, 2), name limit 1")
def r4_name_for(spark, sf_dir):
    names = points(spark, sf_dir).select("vec_id", F.concat(F.lit("name "), "vec_id").alias("name"), *PARTS)
    return P.name_for({"p0": 0.1, "p1": 0.2, "p2": 0.0}, names.drop("vec_id"), names.where("vec_id % 2 = 0").select("name"), PARTS)


@query("""with o as (select n_nationkey idx, case when n_nationkey % 3 > 0 then 's:' || (n_nationkey % 10) end who, 'h' || (n_nationkey % 6) hex from nation where n_nationkey < 8),
    t as (select n_nationkey idx, case when n_nationkey % 2 > 0 then 's:' || (n_nationkey % 12) end who, 'h' || (n_nationkey % 9) hex from nation where n_nationkey >= 8),
    m as (select t.*, case when who is not null then (select min(idx) from o where o.who = t.who) else (select min(idx) from o where o.who is null and o.hex = t.hex) end as hit from t),
    f as (select coalesce(who, hex) k, 7 + row_number() over (order by min(idx)) as n from m where hit is null group by 1)
    select idx, coalesce(hit, n) as "to" from m left join f on f.k = coalesce(who, hex) and hit is null""")
def j18_matched(spark, sf_dir):
    n, nation = F.col("n_nationkey"), read(spark, sf_dir, "nation")
    ours = nation.where("n_nationkey < 8").select(n.alias("idx"), F.when(n % 3 > 0, F.concat(F.lit("s:"), n % 10)).alias("identity"), F.concat(F.lit("h"), n % 6).alias("hex"))
    theirs = nation.where("n_nationkey >= 8").select(n.alias("idx"), F.when(n % 2 > 0, F.concat(F.lit("s:"), n % 12)).alias("identity"), F.concat(F.lit("h"), n % 9).alias("hex"))
    return P.matched(ours, theirs)[0]


@query("""with c as (select p_partkey // 90 as chart_id, p_partkey idx, p_brand || ':' || (p_partkey % 9) who from part), f as (select chart_id, idx, min(idx) over (partition by chart_id, who) first from c) select chart_id, idx, dense_rank() over (partition by chart_id order by first) - 1 as "to" from f""")
def r11_r12_merged_duplicates(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 90).alias("chart_id"), F.col("p_partkey").alias("idx"), F.concat(F.lit(" "), F.upper("p_brand")).alias("system"), (F.col("p_partkey") % 9).cast("string").alias("code"), F.col("p_name").alias("name"), F.lit("ffffff").alias("hex"))
    return P.merged_duplicates(rows).select("chart_id", "idx", "to")


@query(f"select chart_id, y, x, case label when 1 then 4 when 2 then 0 else label end as label from {_C} c")
def i31_relabelled(spark, sf_dir):
    return P.relabelled(cells(spark, sf_dir), {1: 4, 2: 0}).select("chart_id", "y", "x", "label")


@query(f"with recursive {_flooded(_CROSS, _C, _SEEDS)} select c.chart_id, c.y, c.x, case when f.y is null then c.label else 9 end as label from {_C} c left join f on f.chart_id = c.chart_id and f.y = c.y and f.x = c.x")
def i4_filled(spark, sf_dir):
    return P.filled(cells(spark, sf_dir).drop("kind"), seeds(spark, sf_dir), 9, ["chart_id"])


@query(f"select chart_id, y, x, case when y between 5 and 10 and x between 5 and 10 then null when y between 20 and 25 and x between 30 and 35 and (select label from {_C} o where o.chart_id = c.chart_id and o.y = c.y - 15 and o.x = c.x - 25) is not null then (select label from {_C} o where o.chart_id = c.chart_id and o.y = c.y - 15 and o.x = c.x - 25) else label end as label from {_C} c")
def i29_lift_move_stamp(spark, sf_dir):
    chart = cells(spark, sf_dir).drop("kind")
    rest, piece = P.lifted(chart, chart.where("y between 5 and 10 and x between 5 and 10"), ["chart_id"])
    return P.stamped(rest, piece.withColumns({"y": F.col("y") + 15, "x": F.col("x") + 25}), ["chart_id"])


@query(f"select a.y, a.x, coalesce(b.label, a.label) as label from {_C} a join {_C} b on a.y = b.y and a.x = b.x and a.chart_id = 0 and b.chart_id = 3")
def r16_merged_layers(spark, sf_dir):
    c = cells(spark, sf_dir).select("chart_id", "y", "x", "label")
    return P.merged_layers(c.where("chart_id = 0").drop("chart_id"), c.where("chart_id = 3").drop("chart_id"), [])


@query(f"select chart_id, y, x, case when label is null then 0 else kind end as kind from {_C} c")
def r21_tidy_kinds(spark, sf_dir):
    return P.tidy_kinds(cells(spark, sf_dir)).select("chart_id", "y", "x", "kind")


@query("select p_partkey, case when p_size % 2 = 1 then (p_size // 2)::varchar else (p_size // 2 - 1) || ',' || (p_size // 2) end middle from part where p_size > 0")
def r10_centre_block(spark, sf_dir):
    return read(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", F.array_join(P.centre_block(F.col("p_size")).cast("array<string>"), ",").alias("middle"))


@query(f"select image_id, count(*) n, round(sum(v), 3) total from (select image_id, y, x, unnest([r, g, b, a]) / 255.0::double v from {_P} p) t, range(2) d(k) group by 1")
def r20_pair_value(spark, sf_dir):
    ev = pixels(spark, sf_dir).select("image_id", "y", "x", F.array(*(F.col(c) / 255.0 for c in "rgba")).alias("ev"))
    return P.pair_value(ev, ["image_id"]).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("select p_partkey, (row_number() over (partition by p_size order by p_retailprice, p_partkey) - 0.5::double) / count(*) over (partition by p_size) threshold from part")
def w11_rank_thresholds(spark, sf_dir):
    return P.rank_thresholds(read(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_partkey").select("p_partkey", "threshold")


@query(f"""with n as (select p.vec_id line_id, p.p0, p.p1, p.p2, q.vec_id idx, pow(p.p0 - q.p0, 2) + pow(p.p1 - q.p1, 2) + pow(p.p2 - q.p2, 2) d from {_PT} p, {_PT} q where q.vec_id < 16 and p.vec_id >= 16 qualify row_number() over (partition by p.vec_id order by d, q.vec_id) = 1),
    f as (select p0, p1, p2, 15 + row_number() over (order by min(line_id)) k from n where d > 0.81 group by all)
    select line_id, case when d > 0.81 and k < 20 then k else n.idx end as idx from n left join f using (p0, p1, p2)""")
def r3_line_threads(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.line_threads(p.where("vec_id >= 16").withColumnRenamed("vec_id", "line_id"), p.where("vec_id < 16").withColumnRenamed("vec_id", "idx"), PARTS, 0.9, 20)


@query("select p_partkey, array_to_string([p_brand, p_type, 'new'], ',') added, array_to_string([p_type], ',') removed, array_to_string([p_type, p_brand], ',') moved from part")
def r14_list_edits(spark, sf_dir):
    items = F.array("p_brand", "p_type")
    text = lambda c: F.array_join(c, ",")
    return read(spark, sf_dir, "part").select("p_partkey", text(P.edited(items, "add", "new")).alias("added"), text(P.edited(items, "remove", 0)).alias("removed"), text(P.edited(items, "move", 0, 1)).alias("moved"))


@query("select distinct unnest([p_brand, p_type]) as value from part")
def r13_referenced(spark, sf_dir):
    return P.referenced(read(spark, sf_dir, "part"), F.array("p_brand", "p_type"))


@query("with m(my, mx, rank) as (values (0, 0, 0), (0, 1, 8), (0, 2, 2), (0, 3, 10), (1, 0, 12), (1, 1, 4), (1, 2, 14), (1, 3, 6), (2, 0, 3), (2, 1, 11), (2, 2, 1), (2, 3, 9), (3, 0, 15), (3, 1, 7), (3, 2, 13), (3, 3, 5)) select y.v as y, x.v as x, ((x.v + 0.5) / 56.0::double > (rank + 0.5) / 16.0::double)::int as label from range(8) y(v), range(56) x(v), m where y.v % 4 = my and x.v % 4 = mx")
def p21_ramp_preview(spark, sf_dir):
    return G.by_threshold(P.ramp(spark, 56, 8), matrices.matrix(spark, "bayer-4"), 4).select("y", "x", "label")


def _signature_sql(body: str, secret: str) -> str:
    pad = lambda v: "'" + "".join(f"\\x{b ^ v:02X}" for b in secret.encode().ljust(64, b"\0")) + "'::blob"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({body}))))"


@query(f"""with t as (select event_id, epoch_us(ts) // 1000000 || '.' || props body, event_id % 3 = 0 forged, event_id % 7 waited from events)
    select event_id, {_signature_sql("body", "a secret")} as signature, not forged and waited <= 5 as accepted from t""")
def s15_signatures(spark, sf_dir):
    """Each event arrives some minutes after it was signed; every third with a signature that is not its own."""
    t = F.col("ts").cast("timestamp")
    rows = read(spark, sf_dir, "events").select("event_id", "props", F.unix_seconds(t).alias("signed"), (F.unix_seconds(t) + F.col("event_id") % 7 * 60).alias("now"))
    own = P.signature(P.signed_text(F.col("signed"), F.col("props")), "a secret")
    rows = rows.withColumns({"signature": own, "given": F.when(F.col("event_id") % 3 == 0, F.sha2(own, 256)).otherwise(own)})
    return rows.select("event_id", "signature", P.accepted(F.col("props"), F.col("signed"), F.col("given"), F.col("now"), "a secret").alias("accepted"))


@query("select user_id as photo_id, max(event_id) used from events where ts > timestamp '2024-01-24 12:00:00' group by 1 order by max(ts) desc, 1 limit 20")
def s4_photo_store(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("photo_id"), F.col("ts").cast("timestamp").alias("used_at"), F.col("event_id").alias("bytes"))
    kept = P.photo_store(rows.limit(0), rows, "2024-01-25 12:00:00", 24, 20)
    last = rows.groupBy("photo_id").agg(F.max("bytes").alias("used"))
    return kept.join(last, "photo_id").select("photo_id", "used")


@query(f"select image_id, y, x, r2, g2, b2 from {_rgb_sql(_oklab_sql(_P), ('ok_l', '(ok_a * 2)', '(ok_b * 2)'), ('r2', 'g2', 'b2'))}")
def p4_gamut_clip(spark, sf_dir):
    """Colours with chroma pushed out of sRGB, clipped back channel by channel."""
    lab = colour.with_oklab(pixels(spark, sf_dir))
    return colour.with_rgb(lab, (F.col("ok_l"), F.col("ok_a") * 2, F.col("ok_b") * 2), ("r2", "g2", "b2")).select("image_id", "y", "x", "r2", "g2", "b2")
