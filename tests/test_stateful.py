"""Stateful streams against plain loops: limits with first state, lives with and without a bound, late rows, restarts, an outbox that fails."""

import pytest
from pyspark.sql import functions as F

from loomgrid.operators.grid import new_folder
from loomgrid.plans import stateful as Q
from loomgrid.streaming import stateful as S

HOUR = 3_600_000_000


def micros(df):
    return df.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def test_quota_with_first_state_as_by_hand(spark, sf_dir):
    known = {r.user_id: r.at for r in Q.earlier(spark, sf_dir).collect()}
    used: dict = {}
    want = []
    for r in sorted(micros(Q.uses(spark, sf_dir)).collect(), key=lambda r: (r.at, str(r.event_id))):
        mine = used.setdefault(r.user_id, [(known[r.user_id], "before")] if r.user_id in known else [])
        mine[:] = [u for u in mine if u[0] > r.at - 48 * HOUR]
        if r.back:
            mine[:] = [u for u in mine if u[1] != str(r.event_id)]
            want.append((r.user_id, r.event_id, r.at, None))
            continue
        allowed = len(mine) < 2
        if allowed:
            mine.append((r.at, str(r.event_id)))
        want.append((r.user_id, r.event_id, r.at, allowed))
    got = [(r.user_id, r.event_id, r["at"], r.allowed) for r in Q.e8_quota_stream(spark, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {a for *_, a in got} == {True, False, None}


def test_lives_of_at_most_two_items(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    folder = Q.restarted(rows, "ts", "event_id", "user_id", lambda s: S.lives(s, "user_id", "ts", "event_id", "event_type", 60, 2))
    got = sorted(tuple(r) for r in Q._out(folder, rows, "user_id long, item string, first long, last long, uses long, ended string").collect())
    alive: dict = {}
    want = []

    def expire(user, at):
        for item, (first, last, n) in list(alive[user].items()):
            if last + 60 * HOUR < at:
                want.append((user, item, first, last, n, "ttl"))
                del alive[user][item]

    for r in sorted(micros(rows).collect(), key=lambda r: r.at):
        mine = alive.setdefault(r.user_id, {})
        expire(r.user_id, r.at)
        first, _, n = mine.get(r.event_type, (r.at, r.at, 0))
        mine[r.event_type] = (first, r.at, n + 1)
        if len(mine) > 2:
            oldest = min(mine, key=lambda x: mine[x][1])
            want.append((r.user_id, oldest, *mine.pop(oldest), "lru"))
    for user in alive:
        expire(user, 1 << 62)
    assert got == sorted(want)
    assert {r[-1] for r in got} == {"ttl", "lru"}


def feed(spark, folder, n, rows):
    df = spark.createDataFrame(rows, "user_id long, event_id long, t string, status string")
    df.select("user_id", "event_id", F.col("t").cast("timestamp").alias("ts"), "status").coalesce(1).write.parquet(f"{folder}/in/{n}")
    return spark.readStream.schema("user_id long, event_id long, ts timestamp, status string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_late_rows_within_the_allowance_count_and_later_ones_do_not(spark):
    folder = new_folder(spark, "test")
    history = lambda s: S.history(s, "user_id", "ts", "event_id", ["status"])
    S.to_end(history(feed(spark, folder, 0, [(1, 1, "2024-01-01", "a"), (1, 3, "2024-01-03", "c")])), folder)
    S.to_end(history(feed(spark, folder, 1, [(1, 2, "2024-01-02", "b")])), folder)  # two days late at most: counts
    S.to_end(history(feed(spark, folder, 2, [(2, 9, "2024-02-01", "z")])), folder)
    S.to_end(history(feed(spark, folder, 3, [(1, 4, "2024-01-02 12:00:00", "lost"), (1, 5, "2024-01-31", "d")])), folder)
    S.to_end(history(feed(spark, folder, 4, [(3, 1, "2024-06-01", "y")])), folder)
    got = sorted((r.user_id, r.ident, r.before, r.after) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(1, "1", None, "a"), (1, "2", "a", "b"), (1, "3", "b", "c"), (1, "5", "c", "d"), (2, "9", None, "z")]


def test_recoveries_within_their_time(spark):
    folder = new_folder(spark, "test")

    def build(s):
        side = lambda kind: s.where(F.col("status") == kind).select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("ident"))
        return S.recovered(side("failed"), side("well"), "user_id", "1 day")

    S.to_end(build(feed(spark, folder, 0, [(1, 1, "2024-01-01 10:00:00", "failed"), (2, 2, "2024-01-01 10:00:00", "failed")])), folder)
    S.to_end(build(feed(spark, folder, 1, [(1, 3, "2024-01-02 10:00:00", "well"), (1, 4, "2024-01-02 10:00:01", "well"), (1, 5, "2024-01-01 10:00:00", "well"), (2, 6, "2024-01-05", "well")])), folder)
    S.to_end(build(feed(spark, folder, 2, [(9, 7, "2024-02-01", "failed"), (9, 8, "2024-02-01", "well")])), folder)
    got = sorted((r.user_id, r.failure, r.recovery or 0) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(1, 1, 3), (2, 2, 0)]


def test_outbox_that_fails_between_claim_and_send_sends_once(spark):
    folder, calls = new_folder(spark, "test"), []

    def send(rows):
        calls.append(rows.count())
        if len(calls) == 1:
            raise OSError("no line")
        return rows

    box = S.Outbox(spark, folder, "id", send)
    first, second = spark.createDataFrame([(1,), (2,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    with pytest.raises(OSError):
        box(first, 0)
    again = S.Outbox(spark, folder, "id", send)  # after a restart
    again(spark.createDataFrame([(1,), (2,), (7,)], "id long"), 0)  # the claim stands, whatever the replay holds
    again(first, 0)
    again(second, 1)
    again(second, 1)
    assert sorted(tuple(r) for r in again.sent(2).select("id", "batch").collect()) == [(1, 0), (2, 0), (3, 1)]
    assert calls == [2, 2, 1]
