"""Streams over the events table, run to their end with a stop and a restart from the checkpoint in between.

The events come in files that overlap by a day, so rows of one file are older than rows of files before it; a last row far ahead lets
the watermark pass everything.  The rows must be those of the batch SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.grid import kept, new_folder
from loomgrid.plans.registry import query, read
from loomgrid.streaming import stateful as S

PARTS = 4


def arriving(rows: DataFrame, at: str, ident: str, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``part``, the file they come in: by their time and up to a day more."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000
    first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
    if first is None:
        return rows.withColumn("part", F.lit(0))
    late = F.pmod(F.xxhash64(ident), F.lit(86_400))
    return rows.withColumn("part", F.floor((seconds + late - first) / (last - first + 86_400 + 1) * parts).cast("int"))


def restarted(rows: DataFrame, at: str, ident: str, key: str, build: Callable[[DataFrame], DataFrame], sink: Callable | None = None) -> str:
    """The folder in which a stream over the rows has left its output: half of the files, a stop, and a restart over the rest."""
    spark = rows.sparkSession
    folder, dealt = new_folder(spark, "stream"), kept(arriving(rows, at, ident))
    plain = dealt.drop("part")
    stream = lambda: spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    for part in range(PARTS):
        dealt.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(f"{folder}/in/{part}")
        if part == PARTS // 2 - 1:
            S.to_end(build(stream()), folder, sink)
    ahead = {at: F.lit("2100-01-01").cast("timestamp").cast(dict(plain.dtypes)[at]), key: F.lit(-1).cast(dict(plain.dtypes)[key])}
    spark.range(1).select(*(ahead.get(c, F.lit(None).cast(k)).alias(c) for c, k in plain.dtypes)).coalesce(1).write.parquet(f"{folder}/in/{PARTS}")
    S.to_end(build(stream()), folder, sink)
    return folder


def _out(folder: str, rows: DataFrame, schema: str) -> DataFrame:
    return rows.sparkSession.read.schema(schema).parquet(f"{folder}/out").where("user_id >= 0")


@query("""with p as (select user_id, event_id, event_type status, case when value > 50 then 'gold' else 'plain' end tier, lag(event_type) over w ps, lag(case when value > 50 then 'gold' else 'plain' end) over w pt
        from events window w as (partition by user_id order by ts, event_id))
    select user_id, event_id, 'status' as field, ps as before, status as after from p where status is distinct from ps union all select user_id, event_id, 'tier', pt, tier from p where tier is distinct from pt""")
def e2_history_stream(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "ts", "event_type status", "case when value > 50 then 'gold' else 'plain' end tier")
    folder = restarted(rows, "ts", "event_id", "user_id", lambda s: S.history(s, "user_id", "ts", "event_id", ["status", "tier"]))
    return _out(folder, rows, "user_id long, ident string, field string, before string, after string").select("user_id", F.col("ident").cast("long").alias("event_id"), "field", "before", "after")


@query("""with o as (select *, lag(ts) over w b from events window w as (partition by user_id, event_type order by ts)),
    s as (select *, sum(case when b is null or ts - b > interval 36 hours then 1 else 0 end) over (partition by user_id, event_type order by ts) life from o)
    select user_id, event_type as item, epoch_us(min(ts)) as first, epoch_us(max(ts)) as last, count(*) uses, 'ttl' as ended from s group by user_id, event_type, life""")
def e11_lives(spark, sf_dir):
    """Kinds of events that live for 36 hours after their last use, a state with a timer for each account."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    folder = restarted(rows, "ts", "event_id", "user_id", lambda s: S.lives(s, "user_id", "ts", "event_id", "event_type", 36, 99))
    return _out(folder, rows, "user_id long, item string, first long, last long, uses long, ended string")


def uses(spark, sf_dir):
    """(user_id, event_id, ts, back): events as uses; an error gives back the use before it."""
    rows = read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "ts", "event_type", "lag(event_id) over (partition by user_id order by ts, event_id) before")
    return rows.selectExpr("user_id", "case when event_type = 'error' then coalesce(before, event_id) else event_id end event_id", "ts", "event_type = 'error' back")


def earlier(spark, sf_dir):
    """(user_id, at, ident): a use from before the stream for every third account."""
    return read(spark, sf_dir, "events").where("user_id % 3 = 0").select("user_id", F.unix_micros(F.lit("2023-12-31 12:00:00").cast("timestamp")).alias("at"), F.lit("before").alias("ident")).distinct()


@query()
def e8_quota_stream(spark, sf_dir):
    """Two uses in 48 hours, given-back ones not counted, with uses from before the stream as its first state."""
    rows, known = uses(spark, sf_dir), kept(earlier(spark, sf_dir))
    folder = restarted(rows, "ts", "event_id", "user_id", lambda s: S.quota(s, "user_id", "ts", "event_id", 2, 48, back=F.col("back"), before=known))
    return _out(folder, rows, "user_id long, ident string, at long, allowed boolean").select("user_id", F.col("ident").cast("long").alias("event_id"), "at", "allowed")


@query("""select f.user_id, f.event_id failure, r.event_id recovery from events f left join events r on r.user_id = f.user_id and r.event_type = 'purchase' and r.ts > f.ts and r.ts <= f.ts + interval 36 hours where f.event_type = 'error'""")
def e7_recovered_stream(spark, sf_dir):
    """Failures joined with the recoveries of the 36 hours after them, two streams; those without one when none can come any more."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")

    def build(stream: DataFrame) -> DataFrame:
        side = lambda kind: stream.where((F.col("event_type") == kind) | (F.col("user_id") < 0)).select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("ident"))
        return S.recovered(side("error"), side("purchase"), "user_id", "36 hours")

    folder = restarted(rows, "ts", "event_id", "user_id", build)
    return _out(folder, rows, "user_id long, failure long, failed_at timestamp, recovery long").select("user_id", "failure", "recovery")


@query("select event_id, 'to ' || user_id as address from events where event_type <> 'view'")
def e6_outbox_sent(spark, sf_dir):
    """What an outbox has sent after every row came twice and a batch was replayed: each pending row once."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    folder = new_folder(spark, "outbox")
    send = lambda claimed: claimed.select("event_id", F.concat(F.lit("to "), "user_id").alias("address"))
    box = S.Outbox(spark, folder, "event_id", send)
    seen = []

    def sink(batch_rows: DataFrame, batch: int) -> None:
        box(batch_rows, batch)
        box(batch_rows, batch)  # as a restart replays it
        seen.append(batch)

    pending = rows.where("event_type <> 'view'")
    again = pending.union(pending.withColumn("ts", F.col("ts") + F.expr("interval 3 hours")))
    restarted(again, "ts", "event_id", "user_id", lambda s: s.where("event_type <> 'view'"), sink)
    return box.sent(max(seen) + 1).select("event_id", "address")
