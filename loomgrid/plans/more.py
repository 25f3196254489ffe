"""Queries on edge cells, budgets, settings, overlays, mixtures and uses that are given back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import colour
from loomgrid.functions import scalars as S
from loomgrid.operators import crisp, ranks, registry
from loomgrid.operators import grid as G
from loomgrid.operators import relational as R
from loomgrid.plans.grid import _P, _PT, PARTS, _oklab_sql, lines, pixels, points
from loomgrid.plans.registry import query, read
from loomgrid.streaming import events as E

#: Evidence of 6 x 6 blocks: the mean colours of their darker and lighter pixels by red; sure where each has a fifth of the block.
_BLOCKS = f"(select image_id chart_id, y // 6 y, x // 6 x, case when r < 128 then 0 else 1 end mode, ok_l, ok_a, ok_b from {_oklab_sql(_P)})"
_EVIDENCE = f"""b as materialized (select chart_id, y, x, mode, avg(ok_l) ok_l, avg(ok_a) ok_a, avg(ok_b) ok_b, count(*) / 36.0::double coverage from {_BLOCKS} t group by all),
    ev as (select * from b where (chart_id, y, x) in (select (chart_id, y, x) from b group by chart_id, y, x having min(coverage) >= 0.2 and count(*) = 2)),
    pal as materialized (select idx, ok_l, ok_a, ok_b from {_oklab_sql("(select i.v idx, i.v * 50 + 20 r, 200 - i.v * 40 g, (i.v * 90) % 256 b from range(5) i(v))")}),
    near as (select ev.*, idx as label, pow(ev.ok_l - p.ok_l, 2) + pow(ev.ok_a - p.ok_a, 2) + pow(ev.ok_b - p.ok_b, 2) d from ev, pal p qualify row_number() over (partition by chart_id, y, x, mode order by d, idx) = 1),
    sets as (select chart_id, y, x, label, min(d + 0.15::double * (1 - coverage)) as cost from near group by all)"""


def _modes(spark, sf_dir):
    lab = colour.with_oklab(pixels(spark, sf_dir))
    block = [F.col("image_id").alias("chart_id"), F.floor(F.col("y") / 6).alias("y"), F.floor(F.col("x") / 6).alias("x")]
    modes = lab.select(*block, F.when(F.col("r") < 128, 0).otherwise(1).alias("mode"), *crisp.LAB).groupBy(*crisp.CELL, "mode").agg(*(F.avg(c).alias(c) for c in crisp.LAB), (F.count("*") / 36.0).alias("coverage"))
    sure = modes.groupBy(*crisp.CELL).agg(F.min("coverage").alias("least"), F.count("*").alias("n")).where("least >= 0.2 and n = 2")
    return modes.join(sure, crisp.CELL, "left_semi")


def _five(spark, sf_dir):
    i = F.col("idx")
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chart_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("idx"))
    return rows.select("chart_id", "idx", (i * 50 + 20).alias("r"), (200 - i * 40).alias("g"), (i * 90 % 256).alias("b"))


@query(f"with {_EVIDENCE} select chart_id, y, x, label, round(cost, 7) as cost from sets")
def i20_admissible(spark, sf_dir):
    found = crisp.admissible(_modes(spark, sf_dir), colour.with_oklab(_five(spark, sf_dir)))
    return found.select(*crisp.CELL, "label", F.round("cost", 7).alias("cost"))


@query(f"""with {_EVIDENCE}, cheap as (select chart_id, y, x, arg_min(label, cost) as best from sets group by all)
    select c.chart_id, c.y, c.x, case when best is null or exists (select 1 from sets s where s.chart_id = c.chart_id and s.y = c.y and s.x = c.x and s.label = c.label) then c.label else best end as label
    from (select distinct chart_id, y, x, (y * 7 + x * 3) % 5 as label from b) c left join cheap using (chart_id, y, x)""")
def i20_repaired(spark, sf_dir):
    sets = crisp.admissible(_modes(spark, sf_dir), colour.with_oklab(_five(spark, sf_dir)))
    return crisp.repaired(_labelled(spark, sf_dir).drop(*crisp.LAB), sets)


def _labelled(spark, sf_dir):
    """Each block's own colour and a label by its place."""
    lab = colour.with_oklab(pixels(spark, sf_dir))
    block = lab.select(F.col("image_id").alias("chart_id"), F.floor(F.col("y") / 6).alias("y"), F.floor(F.col("x") / 6).alias("x"), *crisp.LAB).groupBy(*crisp.CELL).agg(*(F.avg(c).alias(c) for c in crisp.LAB))
    return block.withColumn("label", ((F.col("y") * 7 + F.col("x") * 3) % 5).cast("int"))


@query()
def i21_finalised(spark, sf_dir):
    """Labels and palette after the rounds of repair and recolouring."""
    cells, palette = crisp.finalised(_labelled(spark, sf_dir), _five(spark, sf_dir), _modes(spark, sf_dir))
    told = palette.select("chart_id", F.col("idx").alias("label"), "r", "g", "b")
    return cells.join(told, ["chart_id", "label"]).select(*crisp.CELL, "label", "r", "g", "b")


@query("""with recursive l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) nth from lineitem),
    r(l_orderkey, nth, l_linenumber, l_partkey, used, took) as (select l_orderkey, nth, l_linenumber, l_partkey, case when l_quantity <= 60 then l_quantity else 0 end, l_quantity <= 60 from l where nth = 1
      union all select l.l_orderkey, l.nth, l.l_linenumber, l.l_partkey, case when r.used + l.l_quantity <= 60 then r.used + l.l_quantity else r.used end, r.used + l.l_quantity <= 60 from r join l on l.l_orderkey = r.l_orderkey and l.nth = r.nth + 1)
    select l_orderkey, l_linenumber, l_partkey from r where took""")
def w14_budgeted(spark, sf_dir):
    """Of each order the lines that fit into 60 pieces, taken in turn."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ranks.budgeted(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", 60.0).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""with n as (select max(ts) as moment from events), u as (select user_id, count(*) used from events, n where event_type <> 'error' and ts > moment - interval 72 hours group by 1)
    select user_id, used, greatest(0, 20 - used) as "left" from u""")
def e8_counted_with_give_back(spark, sf_dir):
    """A limit of 20 uses in 72 hours; a use whose request was refused afterwards (here: errors) is given back."""
    uses = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kept = E.without_returned(uses, uses.where("event_type = 'error'"), "event_id")
    last = uses.agg(F.max("ts")).first()[0]
    limits = spark.createDataFrame([("uses", 20, 72)], "limit_id string, value int, period_hours int")
    return R.limit_use(kept, limits, str(last)).select("user_id", "used", "left")


@query("""with s as (select p_partkey, case p_partkey % 6 when 0 then 'longerSideStitches' when 1 then 'colorCount' when 2 then 'quantizer' when 3 then 'optimize' when 4 then 'textureDensity' else 'size' end as name,
      case p_partkey % 6 when 2 then ['latest', 'newest'][p_partkey % 4 // 2 + 1] when 3 then ['true', 'yes'][p_partkey % 4 // 2 + 1] when 4 then (p_partkey % 15 / 10.0)::double::varchar else (p_size * 40)::varchar end as value from part)
    select p_partkey, case name when 'size' then 'unknown size' when 'longerSideStitches' then case when value::int not between 10 and 1500 then name end when 'colorCount' then case when value::int not between 2 and 100 then name end
      when 'quantizer' then case when value <> 'latest' then name end when 'optimize' then case when value <> 'true' then name end else case when value::double > 1 then name end end problem from s""")
def x5_settings_refusals(spark, sf_dir):
    """A setting for each part, some out of bounds, some unknown: what is refused."""
    n, six = F.col("p_partkey"), F.col("p_partkey") % 6
    name = F.element_at(F.array(*(F.lit(x) for x in ("longerSideStitches", "colorCount", "quantizer", "optimize", "textureDensity", "size"))), (six + 1).cast("int"))
    second = n % 4 >= 2
    value = F.when(six == 2, F.when(second, "newest").otherwise("latest")).when(six == 3, F.when(second, "yes").otherwise("true")).when(six == 4, (n % 15 / 10.0).cast("string")).otherwise((F.col("p_size") * 40).cast("string"))
    given = read(spark, sf_dir, "part").select("p_partkey", F.create_map(name, value).alias("settings"))
    return registry.settings_problems(given).select("p_partkey", F.get("problems", F.lit(0)).alias("problem"))


@query()
def x1_overlays(spark, sf_dir):
    """How many lines each overlay lays over each picture."""
    light = pixels(spark, sf_dir).select("image_id", "y", "x", colour.luminance(F.col("r"), F.col("g"), F.col("b")).cast("double").alias("light"))
    return registry.overlays(light).groupBy("image_id", "overlay").agg(F.count("*").alias("lines"))


@query(f"""with a as (select * from {_PT} p where vec_id = 0), b as (select * from {_PT} p where vec_id = 1),
    w as (select p.*, a.p0 a0, a.p1 a1, a.p2 a2, b.p0 - a.p0 d0, b.p1 - a.p1 d1, b.p2 - a.p2 d2, ((p.p0 - a.p0) * (b.p0 - a.p0) + (p.p1 - a.p1) * (b.p1 - a.p1) + (p.p2 - a.p2) * (b.p2 - a.p2)) / (pow(b.p0 - a.p0, 2) + pow(b.p1 - a.p1, 2) + pow(b.p2 - a.p2, 2)) t from {_PT} p, a, b)
    select vec_id, round(t, 6) + 0.0 as second, round(sqrt(pow(p0 - a0 - t * d0, 2) + pow(p1 - a1 - t * d1, 2) + pow(p2 - a2 - t * d2, 2)), 6) + 0.0 residual from w""")
def r19_mixtures(spark, sf_dir):
    """Each point as a mixture of the first two: the second's weight and what is left."""
    p = points(spark, sf_dir)
    one, two = ([r[c] for c in PARTS] for r in p.where("vec_id < 2").orderBy("vec_id").collect())
    second, residual = S.mix_of_two([F.col(c) for c in PARTS], one, two)
    return p.select("vec_id", (F.round(second, 6) + 0.0).alias("second"), (F.round(residual, 6) + 0.0).alias("residual"))


@query("select distinct y, x from (select x1 x, y1 y from (select l_partkey % 20 x1, l_suppkey % 15 y1, l_suppkey % 4 as label from lineitem) where label in (1, 2))")
def u3_combined_masks(spark, sf_dir):
    """Two masks of a photo, the starts of lines of two colours, as one."""
    starts = lines(spark, sf_dir).select("label", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return G.combine(starts.where("label = 1"), starts.where("label = 2"), "add", ["y", "x"])


@query("select l_orderkey, l_linenumber, nth from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_quantity desc, l_suppkey, l_partkey, l_linenumber) nth from lineitem) where nth <= 3")
def t7_strongest_first(spark, sf_dir):
    """Of each order the three strongest lines, ties by place."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_suppkey", "l_partkey", "l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).cast("long").alias("nth")).where("nth <= 3")


@query("""select n_nationkey, case n_nationkey % 4 when 0 then n_name when 1 then n_name || ' 2' when 2 then n_name || ' 3' else n_name || ' 2' end as name, '+x#o*%=/<>^v'[n_nationkey % 12 + 1] as symbol from nation""")
def fstr_free_names(spark, sf_dir):
    """A free name beside those that are taken, and signs in turn."""
    n, name = F.col("n_nationkey"), F.col("n_name")
    two, three = F.concat(name, F.lit(" 2")), F.concat(name, F.lit(" 3"))
    taken = F.when(n % 4 == 1, F.array(name)).when(n % 4 == 2, F.array(name, two)).when(n % 4 == 3, F.array(three, name))
    return read(spark, sf_dir, "nation").select(n, S.free_name(name, taken).alias("name"), S.symbol_for(n).alias("symbol"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then p_partkey::varchar end number, case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then p_size * 100 + 50 else p_size * 100 end::bigint minor,
    p_partkey::varchar code, p_name || ' - x' as name, p_name || '<&>"' as text, '"' || p_name || ',' || repeat('"', 3) cell from part""")
def fstr_parts(spark, sf_dir):
    """Texts taken apart and put together: thread numbers, money, labels, escapes, quoted cells."""
    n = F.col("p_partkey")
    money = F.when(n % 4 == 0, "much").when(n % 4 == 1, F.concat(F.lit("€"), "p_size", F.lit(",5"))).otherwise(F.col("p_size").cast("string"))
    label = S.label_parts(F.concat_ws(" - ", n.cast("string"), "p_name", F.lit("x")))
    number = S.thread_number(F.concat(F.when(n % 3 == 0, " dmc ").otherwise("other "), n.cast("string")))
    return read(spark, sf_dir, "part").select(
        "p_partkey", number.alias("number"), S.money_minor(money).cast("long").alias("minor"), label["code"].alias("code"), label["name"].alias("name"),
        S.xml_unescape(S.xml_escape(F.concat("p_name", F.lit('<&>"')))).alias("text"), S.csv_cell(F.concat("p_name", F.lit(',"'))).alias("cell"),
    )


@query("select event_id, strftime(date_trunc('day', ts + interval 1 hour) + interval 15 day - interval 1 hour, '%Y-%m-%d %H:%M:%S') as deadline from events")
def fdate_deadlines(spark, sf_dir):
    """The end of the 14th day after each event's day in Berlin, where all of them fall into winter time."""
    return read(spark, sf_dir, "events").select("event_id", F.date_format(S.withdrawal_deadline(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("deadline"))
