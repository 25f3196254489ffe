"""Relational queries over the standard tables: events stand for usage, customers for accounts, orders for subscriptions,
line items for payments, documents for saved charts, parts for prices and threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import scalars as S
from loomgrid.operators import relational as R
from loomgrid.plans.registry import query, read

NOW = "2024-01-25 12:00:00"
GENERATED = ["click", "view"]
_KIND = "case when event_type in ('click', 'view') then 'GENERATE' else 'EXPORT' end"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin(GENERATED), "GENERATE").otherwise("EXPORT")
    number = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", kind.alias("kind"), F.when(number % 5 > 0, F.concat(F.lit("kind"), number % 5)).alias("export_kind"))


_USAGE = f"(select event_id, ts, user_id, {_KIND} kind, case when cast(json_extract_string(props, '$.k') as int) % 5 > 0 then 'kind' || (cast(json_extract_string(props, '$.k') as int) % 5) end export_kind from events)"


@query(f"""with d as (select cast(ts as date) as day, kind from {_USAGE} where ts >= timestamp '2023-12-27' and ts < timestamp '2024-01-26'),
    s as (select cast(unnest(generate_series(date '2023-12-27', date '2024-01-25', interval 1 day)) as date) as day)
    select s.day, count(*) filter (where kind = 'GENERATE') generations, count(*) filter (where kind = 'EXPORT') exports from s left join d using (day) group by s.day""")
def a6_daily_usage(spark, sf_dir):
    return R.daily_usage(usage(spark, sf_dir), NOW)


@query(f"""with d as (select cast(ts as date) as day, kind from {_USAGE} where ts >= timestamp '2023-12-27' and ts < timestamp '2024-01-26'),
    s as (select cast(unnest(generate_series(date '2023-12-27', date '2024-01-25', interval 1 day)) as date) as day),
    c as (select s.day, count(*) filter (where kind = 'GENERATE') g, count(*) filter (where kind = 'EXPORT') e from s left join d using (day) group by s.day)
    select day, g * 100.0::double / max(g + e) over () generations_pct, e * 100.0::double / max(g + e) over () exports_pct from c""")
def a8_bar_shares(spark, sf_dir):
    return R.bar_shares(R.daily_usage(usage(spark, sf_dir), NOW))


@query(f"select cast(ts as date) as day, kind, count(*) n from {_USAGE} group by all")
def a4_daily_events(spark, sf_dir):
    return usage(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "kind").agg(F.count("*").alias("n"))


@query("select event_type, count(*) n from events group by 1")
def a3_group_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""select kind, count(*) filter (where ts <= timestamp '{NOW}' and ts >= timestamp '2024-01-25') today, count(*) filter (where ts <= timestamp '{NOW}' and ts >= timestamp '2024-01-19') seven_days,
    count(*) filter (where ts <= timestamp '{NOW}' and ts >= timestamp '2023-12-27') thirty_days, count(*) filter (where ts <= timestamp '{NOW}') all_time from {_USAGE} group by kind""")
def a1_window_counts(spark, sf_dir):
    return R.window_counts(usage(spark, sf_dir), NOW)


@query("select count(distinct user_id) accounts from events join customer on user_id = c_custkey where ts >= timestamp '2024-01-19'")
def a2_active_accounts(spark, sf_dir):
    recent = read(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-19'").select("user_id").distinct()
    return recent.join(read(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).agg(F.countDistinct("user_id").alias("accounts"))


@query("select source, coalesce(sum(n_chars) filter (where lang = 'en'), 0)::bigint bytes, count(text) filled from documents group by source")
def a5_sum_bytes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))), F.lit(0)).alias("bytes"), F.count("text").alias("filled"))


@query(f"""with c as (select coalesce(export_kind, 'not recorded') as label, count(*) filter (where ts >= timestamp '2024-01-19') recent, count(*) all_time from {_USAGE} where kind = 'EXPORT' group by 1)
    select *, row_number() over (order by label = 'not recorded', all_time desc, label) as position from c""")
def a7_exports_by_kind(spark, sf_dir):
    return R.by_label(usage(spark, sf_dir).where("kind = 'EXPORT'"), F.col("export_kind"), F.col("ts") >= F.lit("2024-01-19").cast("timestamp_ntz"))


@query("""select l_returnflag currency, sum(cast(floor(l_extendedprice) as bigint))::bigint amount from lineitem where l_quantity > 10 group by 1""")
def a27_sum_per_currency(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy(F.col("l_returnflag").alias("currency")).agg(F.sum(F.floor("l_extendedprice")).alias("amount"))


_PRICES = "select p_brand tier, case when p_size % 2 = 0 then 'MONTH' else 'YEAR' end as interval, cast(floor(p_retailprice * 100) as bigint) amount, p_partkey created, p_partkey % 3 > 0 as current from part"


@query(f"""with p as (select * from ({_PRICES}) where current qualify row_number() over (partition by tier, interval order by created desc) = 1),
    w as (select tier, max(amount) filter (where interval = 'MONTH') as month, max(amount) filter (where interval = 'YEAR') as year from p group by tier)
    select *, row_number() over (order by coalesce(month::double, year / 12.0::double), tier) as position from w""")
def a28_offered_tiers(spark, sf_dir):
    prices = read(spark, sf_dir, "part").selectExpr("p_brand tier", "case when p_size % 2 = 0 then 'MONTH' else 'YEAR' end as interval", "cast(floor(p_retailprice * 100) as bigint) amount", "p_partkey created", "p_partkey % 3 > 0 as current")
    return R.offered_tiers(prices)


@query("select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20 left join region on n_regionkey = r_regionkey")
def j2_left_chain(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").where("n_nationkey < 20")
    rows = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("select event_id, user_id from events where not exists (select 1 from customer where c_custkey = user_id and c_acctbal > 0)")
def j3_orphans(spark, sf_dir):
    owners = read(spark, sf_dir, "customer").where("c_acctbal > 0")
    return read(spark, sf_dir, "events").join(owners, F.col("user_id") == F.col("c_custkey"), "left_anti").select("event_id", "user_id")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def j4_existing(spark, sf_dir):
    large = read(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return read(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select s_suppkey, coalesce(n_name, 'Full range') as brand from supplier left join nation on s_nationkey = n_nationkey and n_regionkey in (0, 1)")
def j5_lookup_default(spark, sf_dir):
    known = read(spark, sf_dir, "nation").where("n_regionkey in (0, 1)")
    return read(spark, sf_dir, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("Full range")).alias("brand"))


_LIMITS = [("per_day", 3, 24), ("per_week", 8, 168), ("none", 0, 24), ("open", None, 24)]
_LIMIT_ROWS = "(values ('per_day', 3::bigint, 24), ('per_week', 8, 168), ('none', 0, 24), ('open', null, 24)) l(limit_id, most, period_hours)"
_USE_SQL = f"""select user_id, limit_id, most as value, count(*) used, greatest(0, most - count(*)) as "left",
    case when most > 0 and count(*) >= most then list(ts order by ts)[count(*) - most + 1] + to_hours(any_value(period_hours)) end next_at
    from events, {_LIMIT_ROWS} where most is not null and ts > timestamp '{NOW}' - to_hours(period_hours) and ts <= timestamp '{NOW}' group by user_id, limit_id, most"""


def _limit_use(spark, sf_dir):
    limits = spark.createDataFrame(_LIMITS, "limit_id string, value long, period_hours int")
    return R.limit_use(read(spark, sf_dir, "events"), limits, NOW)


@query(f"""select user_id, limit_id, value, used, "left", strftime(next_at, '%Y-%m-%d %H:%M:%S') next_at from ({_USE_SQL})""")
def w1_limit_use(spark, sf_dir):
    return _limit_use(spark, sf_dir).withColumn("next_at", F.date_format("next_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""with u as ({_USE_SQL}), s as (select *, row_number() over (partition by user_id order by next_at is null desc, next_at desc, limit_id desc) nth from u where "left" = 0)
    select user_id, s.limit_id is null as allowed, s.limit_id, strftime(s.next_at, '%Y-%m-%d %H:%M:%S') next_at from (select distinct user_id from u) left join (select * from s where nth = 1) s using (user_id)""")
def t8_longest_wait(spark, sf_dir):
    return R.decide_quota(_limit_use(spark, sf_dir)).withColumn("next_at", F.date_format("next_at", "yyyy-MM-dd HH:mm:ss"))


@query("select event_id, user_id, count(*) over (partition by user_id order by ts range between interval '86399.999999 seconds' preceding and current row) used from events")
def w1_rolling_use(spark, sf_dir):
    return R.rolling_use(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 24).drop("ts")


@query("select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def w2_latest_per_key(spark, sf_dir):
    return R.latest(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""select event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') today, strftime(date_trunc('day', ts) - interval 6 days, '%Y-%m-%d') seven_days, strftime(date_trunc('day', ts) - interval 29 days, '%Y-%m-%d') thirty_days from events""")
def w3_window_starts(spark, sf_dir):
    day = S.day_start(F.col("ts"))
    text = lambda n: F.date_format(day - F.expr(f"interval {n} days"), "yyyy-MM-dd")
    return read(spark, sf_dir, "events").select("event_id", text(0).alias("today"), text(6).alias("seven_days"), text(29).alias("thirty_days"))


@query(f"""with c as (select count(*) filter (where ts >= timestamp '2024-01-19') as current, count(*) filter (where ts < timestamp '2024-01-19') as previous from events where ts >= timestamp '2024-01-12' and ts <= timestamp '{NOW}')
    select current, previous, case when previous = 0 then null else cast(floor((current - previous) * 100.0::double / previous + 0.5) as bigint) end as change from c""")
def w4_period_over_period(spark, sf_dir):
    return R.period_over_period(read(spark, sf_dir, "events"), NOW, 7)


@query("""with s as (select 'site' as layer, 0 as r, c_custkey, 'limit' || (r_regionkey % 3) setting, r_regionkey * 10 as value from customer, region
      union all select 'audience', 1, c_custkey, 'limit0', case when c_nationkey % 4 = 0 then null else c_nationkey end from customer where c_nationkey % 2 = 0
      union all select 'tier', 2, c_custkey, 'limit1', length(c_mktsegment) from customer where c_mktsegment <> 'BUILDING'
      union all select 'person', 3, c_custkey, 'limit2', null from customer where c_acctbal < 0)
    select c_custkey, setting, arg_max_null(value, r * 1000 + coalesce(value, 0)) as value, arg_max(layer, r * 1000 + coalesce(value, 0)) as layer from s where setting <> 'limit3' group by all""")
def fmap_resolve_layers(spark, sf_dir):
    """Regions set values for the site, nations for the audience, segments for the tier, balances for the person; null is a value."""
    customers, regions = read(spark, sf_dir, "customer"), read(spark, sf_dir, "region")
    site = regions.groupBy(F.concat(F.lit("limit"), F.col("r_regionkey") % 3).alias("setting")).agg((F.max("r_regionkey") * 10).alias("value"))
    ids = customers.select("c_custkey")
    row = lambda layer, df, setting, value: df.select("c_custkey", F.lit(layer).alias("layer"), F.lit(setting).alias("setting"), value.cast("int").alias("value"))
    settings = ids.join(F.broadcast(site)).select("c_custkey", F.lit("site").alias("layer"), "setting", "value")  # one row for each of three settings
    settings = settings.union(row("audience", customers.where("c_nationkey % 2 = 0"), "limit0", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey"))))
    settings = settings.union(row("tier", customers.where("c_mktsegment <> 'BUILDING'"), "limit1", F.length("c_mktsegment"))).union(row("person", customers.where("c_acctbal < 0"), "limit2", F.lit(None)))
    return R.resolve_layers(settings.where("setting <> 'limit3'"), ["c_custkey", "setting"])


@query("select c_custkey, cast(list_sort(list(k) filter (where v <> 'on')) as varchar[]) as changed from (select c_custkey, unnest(['a', 'b', 'c']) k, unnest([case when c_nationkey % 2 = 0 then 'on' else 'locked' end, case when c_acctbal > 0 then 'on' else 'hidden' end, 'on']) v from customer) group by 1 having count(*) filter (where v <> 'on') > 0")
def fmap_drop_defaults(spark, sf_dir):
    state = F.create_map(F.lit("a"), F.when(F.col("c_nationkey") % 2 == 0, "on").otherwise("locked"), F.lit("b"), F.when(F.col("c_acctbal") > 0, "on").otherwise("hidden"), F.lit("c"), F.lit("on"))
    kept = F.sort_array(F.map_keys(R.drop_defaults(state)))
    return read(spark, sf_dir, "customer").select("c_custkey", kept.alias("changed")).where(F.size("changed") > 0)


_STATUS = "['active', 'trialing', 'past_due', 'canceled', 'incomplete', 'unpaid', 'odd']"


@query(f"""with o as (select o_orderkey, {_STATUS}[o_orderkey % 7 + 1] status, case when o_orderkey % 11 = 0 then 'grant' else 'paid' end kind, case when o_orderkey % 13 > 0 then o_orderdate + interval 30 days end fin,
      case when o_orderkey % 3 > 0 then o_orderdate + interval 20 days end failed, timestamp '1998-06-01' as now from orders),
    r as (select *, case when kind = 'grant' then case when status <> 'active' or fin is null or now >= fin then 'given-ended' end
      when status = 'incomplete' then 'first-payment-pending' when status in ('unpaid', 'canceled') then status when status = 'odd' then 'unknown-status'
      when fin is null then 'no-period-recorded' when now >= fin + interval 2 days then 'period-ended' when status = 'past_due' and failed is not null and now >= failed + interval 7 days then 'grace-ended' end reason from o)
    select o_orderkey, reason is null as tier, reason, strftime(case when reason is not null then null when kind = 'grant' then fin when status = 'past_due' and failed is not null then least(failed + interval 7 days, fin + interval 2 days) else fin + interval 2 days end, '%Y-%m-%d') as until from r""")
def p23_entitlement(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    status = F.element_at(F.array(*(F.lit(x) for x in ("active", "trialing", "past_due", "canceled", "incomplete", "unpaid", "odd"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    told = R.entitlement(
        status, F.when(F.col("o_orderkey") % 11 == 0, "grant").otherwise("paid"), F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("timestamp") + F.expr("interval 20 days")), F.lit("1998-06-01").cast("timestamp"),
    )
    return orders.select("o_orderkey", told.alias("t")).select("o_orderkey", "t.tier", "t.reason", F.date_format("t.until", "yyyy-MM-dd").alias("until"))


@query("""with p as (select l_orderkey, l_linenumber, cast(floor(l_extendedprice * 100) as bigint) amount, cast(floor(l_extendedprice * 100 * l_discount * 10) as bigint) refunded, l_shipdate s, l_shipdate + interval 30 days e, timestamp '1998-06-01' as moment
      from lineitem where l_shipdate >= timestamp '1998-04-15'),
    u as (select *, greatest(0, amount - refunded) lft, least(1.0::double, greatest(0.0::double, (epoch_us(e) - epoch_us(moment))::double / (epoch_us(e) - epoch_us(s)))) share from p)
    select l_orderkey, l_linenumber, lft as remaining, cast(least(lft, ceil(amount * share)) as bigint) refund from u where least(lft, ceil(amount * share)) > 0""")
def p24_refunds(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "cast(floor(l_extendedprice * 100) as bigint) amount", "cast(floor(l_extendedprice * 100 * l_discount * 10) as bigint) refunded",
        "l_shipdate period_start", "l_shipdate + interval 30 days period_end", "l_shipdate paid_at",
    )
    out = R.withdrawal_refunds(rows, F.lit("1998-04-15").cast("timestamp"), F.lit("1998-06-01").cast("timestamp"))
    return out.select("l_orderkey", "l_linenumber", R.refundable_left(F.col("amount"), F.col("refunded")).alias("remaining"), "refund")


@query("""with q as (select p_partkey, (p_partkey % 900)::bigint amount, (p_partkey % 700)::bigint refunded, ['all', 'unused', 'amount'][p_partkey % 3 + 1] ask, ['3.50', '0', 'x', '99999', '€2,5'][p_partkey % 5 + 1] asked from part),
    t as (select *, greatest(0, amount - refunded) lft, case asked when '3.50' then 350 when '0' then 0 when '99999' then 9999900 when '€2,5' then 250 end typed from q)
    select p_partkey, case when lft = 0 then 'nothing-left' when ask = 'all' then null when ask = 'unused' then 'no-period' when typed is null then 'not-an-amount' when typed = 0 then 'zero' when typed > lft then 'too-much' end refusal,
      case when lft = 0 then null when ask = 'all' then lft when ask = 'amount' and typed > 0 and typed <= lft then typed end::bigint amount from t""")
def p24_refund_amount(spark, sf_dir):
    pick = lambda n, *x: F.element_at(F.array(*(F.lit(v) for v in x)), (F.col("p_partkey") % n + 1).cast("int"))
    none = F.lit(None).cast("timestamp")
    told = R.refund_amount(F.col("p_partkey") % 900, F.col("p_partkey") % 700, none, none, F.current_timestamp(), pick(3, "all", "unused", "amount"), pick(5, "3.50", "0", "x", "99999", "€2,5"))
    return read(spark, sf_dir, "part").select("p_partkey", told.alias("t")).select("p_partkey", "t.refusal", "t.amount")


@query("select event_id from events where event_type in ('click', 'view') and event_type not in ('view') and props is not null and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'")
def f1_f2_predicates(spark, sf_dir):
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").where(kind.isin("click", "view") & ~kind.isin("view") & F.col("props").isNotNull() & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id")


@query("select p_partkey from part where contains(lower(p_name), 'red') or contains(lower(p_type), 'red')")
def f3_substring_search(spark, sf_dir):
    return read(spark, sf_dir, "part").where(S.all_words(F.col("p_name"), "RED") | S.all_words(F.col("p_type"), "RED")).select("p_partkey")


@query("select p_partkey from part where contains(lower(p_name), 'red') and contains(lower(p_name), 'ing')")
def f4_all_words(spark, sf_dir):
    return read(spark, sf_dir, "part").where(S.all_words(F.col("p_name"), "Ing  RED")).select("p_partkey")


@query("select o_orderkey from orders where nullif(o_orderpriority, '5-LOW') is null or o_orderstatus in ('F')")
def f5_null_or_status(spark, sf_dir):
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").where(priority.isNull() | F.col("o_orderstatus").isin("F")).select("o_orderkey")


@query("select o_orderkey from orders where o_custkey % 4 = 1")
def f13_owner_access(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(F.col("o_custkey") % 4 == 1).select("o_orderkey")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'ended' when o_totalprice < 10000 then 'too-small' when o_orderpriority = '5-LOW' then 'low' end refusal from orders")
def f14_first_refusal(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", R.first_refusal((F.col("o_orderstatus") == "F", "ended"), (F.col("o_totalprice") < 10000, "too-small"), (F.col("o_orderpriority") == "5-LOW", "low")).alias("refusal"))


@query("select o_orderkey, array_to_string(list_filter([case when o_orderstatus = 'F' then 'ended' end, case when o_totalprice < 10000 then 'too-small' end, case when o_orderpriority = '5-LOW' then 'low' end], lambda x: x is not null), ',') refusals from orders")
def f15_all_refusals(spark, sf_dir):
    found = R.all_refusals((F.col("o_orderstatus") == "F", "ended"), (F.col("o_totalprice") < 10000, "too-small"), (F.col("o_orderpriority") == "5-LOW", "low"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("refusals"))


@query("select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING' order by c_nationkey % 2 desc, c_acctbal desc, c_custkey limit 20")
def s1_t1_scan_order_limit(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return rows.orderBy((F.col("c_nationkey") % 2).desc(), F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("select o_orderkey, o_totalprice from orders where o_orderkey = 42")
def s2_point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderkey = 42").select("o_orderkey", "o_totalprice")


@query("select p_partkey, p_name from part where contains(p_name, 'e') order by p_size = 1 desc, lower(p_name), p_partkey limit 50")
def t2_pinned_first(spark, sf_dir):
    rows = read(spark, sf_dir, "part").where(F.col("p_name").contains("e"))
    return rows.orderBy((F.col("p_size") == 1).desc(), F.lower("p_name"), "p_partkey").limit(50).select("p_partkey", "p_name")


@query("select c_custkey from customer order by c_acctbal desc, c_custkey offset 40 limit 20")
def t3_pagination(spark, sf_dir):
    return R.paginate(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 3, 20).select("c_custkey")


@query("select event_id, event_type from events where event_type in ('error', 'signup') order by ts desc, event_id limit 25")
def t4_latest_changes(spark, sf_dir):
    return read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "event_type")


@query("""with t as (select user_id, event_id number, event_id % 3 = 0 as pinned, epoch_us(ts) since from events)
    select user_id, number, pinned from t qualify case when pinned then row_number() over (partition by user_id, pinned order by number) else row_number() over (partition by user_id, pinned order by since desc, number desc) end <= 5""")
def t9_keep_history(spark, sf_dir):
    tries = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("number"), (F.col("event_id") % 3 == 0).alias("pinned"), F.unix_micros(F.col("ts").cast("timestamp")).alias("since"))
    return R.keep_history(tries, "user_id").drop("since")


_OLD, _NEW = "select c_custkey, c_acctbal from customer where c_custkey % 2 = 0", "select c_custkey, c_acctbal + 1 c_acctbal from customer where c_custkey % 3 = 0"


def _old_new(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)


@query(f"with o as ({_OLD}), n as ({_NEW}) select * from o union all select * from n where c_custkey not in (select c_custkey from o)")
def k11_insert_new(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return R.insert_new(old, new.union(new), ["c_custkey"])


@query(f"with o as ({_OLD}), n as ({_NEW}) select c_custkey, coalesce(n.c_acctbal, o.c_acctbal) c_acctbal from o full join n using (c_custkey)")
def k12_upsert(spark, sf_dir):
    return R.upsert(*_old_new(spark, sf_dir), ["c_custkey"])


@query(f"with o as ({_OLD}), n as ({_NEW}) select c_custkey, case when n.c_acctbal is not null and (o.c_acctbal is null or o.c_acctbal < 1000) then n.c_acctbal else o.c_acctbal end c_acctbal from o full join n using (c_custkey)")
def k13_compare_and_set(spark, sf_dir):
    return R.upsert(*_old_new(spark, sf_dir), ["c_custkey"], F.col("o.c_acctbal") < 1000)


@query("select c_custkey from customer where not (c_acctbal < 0)")
def k14_delete_where(spark, sf_dir):
    return R.delete_where(read(spark, sf_dir, "customer"), F.col("c_acctbal") < 0).select("c_custkey")


@query("select event_id, c_custkey user_id from events left join (select c_custkey from customer where c_acctbal > 0) on c_custkey = user_id")
def k15_untie(spark, sf_dir):
    owners = read(spark, sf_dir, "customer").where("c_acctbal > 0")
    return R.untie(read(spark, sf_dir, "events").select("event_id", "user_id"), owners, "user_id", "c_custkey")


@query("select n_name, nullif(n_regionkey, 2) as value from nation where nullif(n_regionkey, 2) is null or n_regionkey > 2")
def r1_plans_with_more(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("value"))
    return rows.where(F.col("value").isNull() | (F.col("value") > 2))


@query("select source, (sum(n_chars) - 500 + 20000 > 100000) refused from documents group by source")
def r2_storage_refusal(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg((F.sum("n_chars") - 500 + 20000 > 100000).alias("refused"))


@query("select n_regionkey, min(n_nationkey) first_place from nation group by 1")
def r8_first_seen(spark, sf_dir):
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first_place"))


@query("select p_size, p_partkey, (row_number() over (partition by p_size order by p_partkey) - 1) // 18 as page from part")
def r9_rows_to_pages(spark, sf_dir):
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "part").select("p_size", "p_partkey")  # a printed table for each size
    return rows.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1) / 18).cast("long"))


@query("select * from (values ('has customers', true), ('all positive', false), ('few nations', true)) t(\"check\", ok)")
def r17_launch_checks(spark, sf_dir):
    one = read(spark, sf_dir, "customer").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("least"), F.countDistinct("c_nationkey").alias("nations"))
    return R.checks(one, {"has customers": F.col("n") > 0, "all positive": F.col("least") > 0, "few nations": F.col("nations") <= 25})


@query("select p_partkey, cast(ceil(p_size / 3.0) * 14000 as bigint) wait_ms from part")
def r18_estimated_wait(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", (F.ceil(F.col("p_size") / 3) * 14000).cast("long").alias("wait_ms"))


@query("select c_custkey, cast(floor(c_acctbal - 0.5 + 0.5) as bigint) rounded, case when c_nationkey = 0 then null else cast(floor((c_acctbal - c_nationkey) * 100.0::double / c_nationkey + 0.5) as bigint) end change from customer")
def p25_rounding(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", S.half_up(F.col("c_acctbal") - 0.5).alias("rounded"), S.percent_change(F.col("c_acctbal"), F.col("c_nationkey")).alias("change"))


@query("""select p_partkey, case when p_size - 1 <= 0 then 0 else greatest(1, cast(ceil((p_size - 1) * 1000 * ((case when 8 + p_partkey % 10 <= 11 then 3 else 2 end) * (2 * (sqrt(2.0::double) + 1) * 2.54::double * 2.0::double / (8 + p_partkey % 10))) / 4800) as bigint)) end skeins from part""")
def p13_skeins(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.skeins((F.col("p_size") - 1) * 1000, F.col("p_partkey") % 10 + 8).alias("skeins"))


@query("select p_partkey, printf('%.1f', p_size / 14.0::double * 2.54::double) size_cm from part")
def p14_finished_size(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.finished_cm(F.col("p_size"), F.lit(14.0)).alias("size_cm"))


@query("""select p_partkey, replace(replace(p_name, '&', '&amp;'), '<', '&lt;') xml, '#' || lower(printf('%02X%02X%02X', p_partkey % 256, p_size, 255)) hex, p_brand || ' - ' || p_name as label,
    case when p_size < 26 then chr(65 + p_size) else 'A' || chr(65 + p_size - 26) end letter, '€' || printf('%.2f', p_size / 100.0::double) money from part""")
def fstr_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", S.xml_escape(F.col("p_name")).alias("xml"), S.hex_colour(F.col("p_partkey") % 256, F.col("p_size"), F.lit(255)).alias("hex"),
        S.thread_label(F.col("p_brand"), F.col("p_name")).alias("label"), S.page_letter(F.col("p_size")).alias("letter"), S.money_text(F.col("p_size")).alias("money"),
    )


@query("select o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') month_from, strftime(date_trunc('month', o_orderdate) + interval 1 month, '%Y-%m-%d') month_to, strftime(o_orderdate, '%Y-%m-%d %H:%M') as \"minute\" from orders")
def fdate_ranges(spark, sf_dir):
    month = S.month_range(F.to_date("o_orderdate"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(month["from"], "yyyy-MM-dd").alias("month_from"), F.date_format(month["to"], "yyyy-MM-dd").alias("month_to"), S.iso_minute(F.col("o_orderdate")).alias("minute"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) k, sha256(props) digest from events")
def fjson_fhash(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.sha2("props", 256).alias("digest"))


@query("""with t as (select p_partkey, p_size from part) select p_partkey, case when p_size < 1 then 'Just now' end never, case when ceil(p_size * 100 / 60.0) < 60 then 'in ' || cast(greatest(1, ceil(p_size * 100 / 60.0)) as int) || ' minute' || case when greatest(1, ceil(p_size * 100 / 60.0)) = 1 then '' else 's' end
    else 'in ' || cast(ceil(ceil(p_size * 100 / 60.0) / 60.0) as int) || ' hour' || case when ceil(ceil(p_size * 100 / 60.0) / 60.0) = 1 then '' else 's' end end wait from t""")
def fdate_wait_words(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 1, "Just now").alias("never"), S.wait_words(F.col("p_size") * 100).alias("wait"))
