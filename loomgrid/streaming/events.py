"""Idempotent events, snapshots to history, counted limits, notices and an outbox.

Keyed rules are ``applyInPandasWithState`` functions whose state is bounded for each key; each has a batch form in DataFrame
operations that gives the same rows for the same events, whatever their order or repetition.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loomgrid.operators import relational

#: Late records count for two days past a period's end.
LATE = "2 days"
TRACKED = ["status", "tier", "price", "period_end", "cancel_at_end", "failed_at", "ended_at"]


def in_time(arrived: Column, period_end: Column, late: str = LATE) -> Column:
    """Whether a record came before its period's end or within the allowance after it."""
    return arrived <= period_end + F.expr(f"interval {late}")


def once(events: DataFrame, ident: str = "event_id", ts: str = "ts", late: str = LATE) -> DataFrame:
    """Each event once by its id; a stream forgets ids older than the allowance for late records."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([ident])
    return relational.latest(events, [ident], [F.col(ts)])


def without_returned(uses: DataFrame, returned: DataFrame, ident: str) -> DataFrame:
    """The uses that were not given back; of either, repeated rows count once."""
    return once(uses, ident).join(returned.select(ident).distinct(), ident, "left_anti")


def history(snapshots: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, order, field, before, after): a row for each field that differs from the key's snapshot before; the first has no before.

    Fields are compared as text.  One window, then the changed fields alone are turned into rows.
    """
    line = Window.partitionBy(key).orderBy(*order)
    paired = snapshots.select(key, *order, *(F.col(f).cast("string").alias(f) for f in fields), *(F.lag(F.col(f).cast("string")).over(line).alias(f"_{f}") for f in fields))
    changes = F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("before"), F.col(f).alias("after"))) for f in fields))
    return paired.select(key, *order, F.inline(F.array_compact(changes)))


def sticky_minimum(snapshots: DataFrame, key: str, order: list[str], holds: Column, value: Column) -> DataFrame:
    """``snapshots`` with ``held``: the least value since the condition last began to hold, null while it does not."""
    line = Window.partitionBy(key).orderBy(*order)
    marked = snapshots.withColumns({"_holds": F.coalesce(holds, F.lit(False)), "_value": value})
    begun = marked.withColumn("_run", F.sum(F.when(F.col("_holds") & F.coalesce(~F.lag("_holds").over(line), F.lit(True)), 1).otherwise(0)).over(line))
    least = F.min(F.when(F.col("_holds"), F.col("_value"))).over(Window.partitionBy(key, "_run").orderBy(*order))
    return begun.withColumn("held", F.when(F.col("_holds"), least)).drop("_holds", "_value", "_run")


def history_stream(snapshots: DataFrame, key: str, at: str, fields: list[str], keep_days: int | None = None) -> DataFrame:
    """The same as a stream: the state is the key's last snapshot, so older and repeated ones change nothing.

    With ``keep_days`` a key's state goes when the watermark is so far past its last snapshot; the next one then counts as the first.
    """
    kind = dict(snapshots.dtypes)[key]
    expiry = None if keep_days is None else int(timedelta(days=keep_days).total_seconds() * 1000)

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get) if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(at).itertuples(index=False):
            now = [None if pd.isna(v) else str(v) for v in (getattr(row, f) for f in fields)]
            when = getattr(row, at).value
            if last is not None and when <= last[0]:
                continue
            before = last[1:] if last is not None else [None] * len(fields)
            out += [(keys[0], getattr(row, at), f, b, a) for f, b, a in zip(fields, before, now, strict=True) if a != b]
            last = [when, *now]
        if last is not None:
            state.update(tuple(last))
            if expiry is not None:
                state.setTimeoutTimestamp(max(last[0] // 1_000_000 + expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, at, "field", "before", "after"])

    held = "at long, " + ", ".join(f"f{i} string" for i in range(len(fields)))
    rows = (snapshots if expiry is None else snapshots.withWatermark(at, LATE)).select(key, at, *(F.col(f).cast("string").alias(f) for f in fields))
    timeout = GroupStateTimeout.NoTimeout if expiry is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {at} timestamp, field string, before string, after string", held, "append", timeout)


def quota_stream(requests: DataFrame, key: str, at: str, ident: str, value: int, hours: int, back: str | None = None, late: str | None = None) -> DataFrame:
    """(key, ident, at, allowed): a rolling limit of ``value`` uses in ``hours``; only allowed uses count.

    A row whose ``back`` column is true gives the use of that ident back, and is answered with null.  The state holds the times in the
    period and their idents, at most ``value`` of them.  With ``late`` it goes when the watermark, so far behind the newest row, has left
    the last use's period; rows later than that are dropped.
    """
    kinds = dict(requests.dtypes)
    period = timedelta(hours=hours).total_seconds() * 1e6
    columns = [key, at, ident, *([back] if back else [])]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for row in pd.concat(list(batches)).sort_values([at, ident]).itertuples(index=False):
            now, name = getattr(row, at).value // 1000, str(getattr(row, ident))
            used = [u for u in used if u[0] > now - period]
            if back and bool(getattr(row, back)):
                used = [u for u in used if u[1] != name]
                out.append((keys[0], getattr(row, ident), getattr(row, at), None))
                continue
            allowed = len(used) < value
            if allowed:
                used.append((now, name))
            out.append((keys[0], getattr(row, ident), getattr(row, at), allowed))
        state.update(([t for t, _ in used], [n for _, n in used]))
        last = max((t for t, _ in used), default=0)
        if late is not None:
            state.setTimeoutTimestamp(max(int((last + period) // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, ident, at, "allowed"]).astype({"allowed": "boolean"})

    rows = (requests if late is None else requests.withWatermark(at, late)).select(*columns)
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {ident} {kinds[ident]}, {at} timestamp, allowed boolean", "used array<long>, idents array<string>", "append", timeout)


#: A notice and the days from a failure at which it is due.
SLOTS = {"failed": 0, "reminder": 3, "last": 6}


def notices(failures: DataFrame, now: str, key: str = "account") -> DataFrame:
    """(key, failed_at, slot, due): what is to be sent now, each slot of a failure once.

    ``failures`` has the key, failed_at, recovered_at, cancelling, and ``sent``, an array of slots.  Nobody who asked to cancel is
    dunned; ``recovered`` goes only to those to whom ``failed`` went; where several slots are due the latest is sent.
    """
    moment = F.lit(now).cast("timestamp")
    failed, recovered = F.col("failed_at").cast("timestamp"), F.col("recovered_at").cast("timestamp")
    open_ = recovered.isNull() & ~F.coalesce("cancelling", F.lit(False))
    due = F.array_compact(F.array(*(F.when(open_ & (failed + F.make_dt_interval(days=F.lit(d)) <= moment), F.struct(F.lit(d).alias("d"), F.lit(s).alias("slot"))) for s, d in SLOTS.items())))
    latest = F.array_max(due)
    sent = F.coalesce("sent", F.array().cast("array<string>"))
    well = recovered.isNotNull() & (recovered <= moment) & F.array_contains(sent, "failed") & ~F.array_contains(sent, "recovered")
    slot = F.when(well, "recovered").when(latest.isNotNull() & ~F.array_contains(sent, latest["slot"]), latest["slot"])
    return failures.select(key, "failed_at", slot.alias("slot")).where("slot is not null").dropDuplicates([key, "failed_at", "slot"])


def pending(outbox: DataFrame, now: str, attempts: int = 5, days: int = 3) -> DataFrame:
    """Unsent rows with attempts left and young enough, oldest first by their creation."""
    moment = F.lit(now).cast("timestamp")
    return outbox.where(F.col("sent_at").isNull() & (F.col("attempts") < attempts) & (F.col("created_at").cast("timestamp") > moment - F.make_dt_interval(days=F.lit(days))))


def reconcile(stored: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, kind): rows that are missing, gone or corrected when what is stored is compared with what is so."""
    a, s = actual.alias("a"), stored.alias("s")
    both = s.join(a, F.col(f"s.{key}") == F.col(f"a.{key}"), "full_outer")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"s.{f}").eqNullSafe(F.col(f"a.{f}"))
    kind = F.when(F.col(f"s.{key}").isNull(), "missing").when(F.col(f"a.{key}").isNull(), "gone").when(differs, "corrected")
    return both.select(F.coalesce(F.col(f"s.{key}"), F.col(f"a.{key}")).alias(key), kind.alias("kind")).where("kind is not null")
