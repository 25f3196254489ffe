"""Batch forms of the event rules over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.plans.registry import query, read
from loomgrid.streaming import events as E


@query("select event_id, user_id from events")
def e1_once(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return E.once(events.union(events)).select("event_id", "user_id")


_S = "(select user_id, event_id, event_type status, case when value > 50 then 'gold' else 'plain' end tier from events)"


@query(f"""with p as (select *, lag(status) over w ps, lag(tier) over w pt from {_S} t window w as (partition by user_id order by event_id))
    select user_id, event_id, 'status' as field, ps as before, status as after from p where status is distinct from ps union all select user_id, event_id, 'tier', pt, tier from p where tier is distinct from pt""")
def e2_snapshot_history(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type status", "case when value > 50 then 'gold' else 'plain' end tier")
    return E.history(rows, "user_id", ["event_id"], ["status", "tier"])


@query(f"""with m as (select *, status in ('error', 'click') holds from {_S} t), r as (select *, sum(case when holds and not coalesce(lag_holds, false) then 1 else 0 end) over (partition by user_id order by event_id) run from (select *, lag(holds) over (partition by user_id order by event_id) lag_holds from m))
    select user_id, event_id, case when holds then min(case when holds then event_id end) over (partition by user_id, run order by event_id) end held from r""")
def e3_sticky_minimum(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"))
    return E.sticky_minimum(rows, "user_id", ["event_id"], F.col("status").isin("error", "click"), F.col("event_id")).drop("status")


@query("""with p as (select event_id, user_id, ts, date_trunc('day', ts) + interval 1 day as period_end, ts + to_hours(cast(event_id % 96 as int)) as arrived from events)
    select user_id, count(*) filter (where arrived <= period_end + interval 2 days) counted, count(*) filter (where arrived > period_end + interval 2 days) late from p group by 1""")
def e4_late_allowance(spark, sf_dir):
    """Each event arrives some hours after it happened; it counts for its day if it comes within the allowance for late records."""
    rows = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("interval 1 day")).alias("period_end"), (F.col("event_id") % 96).cast("int").alias("hours"))
    rows = rows.withColumn("arrived", F.col("ts") + F.make_dt_interval(hours=F.col("hours")))
    counted = E.in_time(F.col("arrived"), F.col("period_end"))
    return rows.groupBy("user_id").agg(F.count_if(counted).alias("counted"), F.count_if(~counted).alias("late"))


@query("select coalesce(a.c_custkey, b.c_custkey) c_custkey, case when a.c_custkey is null then 'missing' when b.c_custkey is null then 'gone' else 'corrected' end kind from (select * from customer where c_custkey % 5 > 0) a full join (select c_custkey, case when c_custkey % 7 = 0 then 0 else c_acctbal end c_acctbal from customer where c_custkey % 3 > 0) b using (c_custkey) where a.c_custkey is null or b.c_custkey is null or a.c_acctbal <> b.c_acctbal")
def e5_reconcile(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    now = rows.where("c_custkey % 3 > 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return E.reconcile(rows.where("c_custkey % 5 > 0"), now, "c_custkey", ["c_acctbal"])


@query("select event_id from events where event_type <> 'view' and event_id % 7 < 5 and ts > timestamp '2024-01-22'")
def e6_outbox_pending(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", F.col("ts")).alias("sent_at"), (F.col("event_id") % 7).alias("attempts"), F.col("ts").alias("created_at"))
    return E.pending(rows, "2024-01-25 00:00:00").select("event_id")


@query("""select event_id, case when event_id % 4 = 0 then case when event_id % 3 = 0 then 'recovered' end when event_id % 5 = 0 then null
    when ts + interval 6 days <= timestamp '2024-01-20' then 'last' when ts + interval 3 days <= timestamp '2024-01-20' then 'reminder' when ts <= timestamp '2024-01-20' and event_id % 3 > 0 then 'failed' end slot from events where event_type = 'error'
    and (case when event_id % 4 = 0 then case when event_id % 3 = 0 then 'recovered' end when event_id % 5 = 0 then null
    when ts + interval 6 days <= timestamp '2024-01-20' then 'last' when ts + interval 3 days <= timestamp '2024-01-20' then 'reminder' when ts <= timestamp '2024-01-20' and event_id % 3 > 0 then 'failed' end) is not null""")
def e7_notices(spark, sf_dir):
    """Errors stand for failures; every fourth recovered, every fifth account is leaving, every third got the first notice."""
    n = F.col("event_id")
    rows = read(spark, sf_dir, "events").where("event_type = 'error'").select(
        n.alias("account"), F.col("ts").cast("timestamp").alias("failed_at"), F.when(n % 4 == 0, F.lit("2024-01-02").cast("timestamp")).alias("recovered_at"),
        (n % 5 == 0).alias("cancelling"), F.when(n % 3 == 0, F.array(F.lit("failed"))).alias("sent"),
    )
    return E.notices(rows, "2024-01-20 00:00:00").select(F.col("account").alias("event_id"), "slot")
