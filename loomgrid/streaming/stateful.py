"""Rules with typed state and timers on Structured Streaming, that give the batch forms' rows for input in any order.

Rows of a key wait in a list until the watermark has passed them, then they are taken in the order of their event time: a timer at the
earliest waiting row wakes the key.  So rows that come late, but within the allowance, change nothing, and state of a key that nothing
comes from goes by its own timer.  Everything a key holds is bounded by the allowance and the rule, not by the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Late records count for two days.
LATE = "2 days"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Takes the rows (at, ident, fields...) of a key in order; ``at`` in microseconds, fields as text.

    A rule says what it holds (``begin``), what comes of due rows (``step``), and from when on its state is of no use (``ends``).
    """

    def __init__(self, fields: list[str], columns: list[str]) -> None:
        self.fields, self.columns = fields, columns

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: list[tuple], now: int) -> list[tuple]:
        """The output rows, without the key, of due rows; called without any when only time has passed."""
        raise NotImplementedError

    def ends(self) -> int | None:
        """The moment in microseconds at which the rule wants to be woken, if no row comes before."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = ", ".join(["at long", "ident string", *(f"f{i} string" for i in range(len(self.fields)))])
        self.waiting = handle.getListState("waiting", held)
        self.begin(handle)

    def _due(self, key: tuple, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        rows = sorted([*(tuple(r) for r in self.waiting.get()), *new])
        due = [r for r in rows if r[0] <= watermark]
        left = rows[len(due) :]
        if left:
            self.waiting.put(left)
        elif rows:
            self.waiting.clear()
        out = self.step(key, due, watermark)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wake = [x for x in (left[0][0] if left else None, self.ends()) if x is not None]
        if wake:
            self.handle.registerTimer(max(-(-min(wake) // 1000), watermark // 1000 + 1))
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=self.columns)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r[0]), str(r[1]), *(None if pd.isna(v) else str(v) for v in r[2:])) for part in rows for r in part[["at", "ident", *self.fields]].itertuples(index=False)]
        yield from self._due(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


class History(InOrder):
    """Which fields changed against the key's snapshot before; the first has no before.  The state is the last snapshot."""

    def begin(self, handle):
        self.last = handle.getValueState("last", ", ".join(f"f{i} string" for i in range(len(self.fields))))

    def step(self, key, rows, now):
        if not rows:
            return []
        before = tuple(self.last.get()) if self.last.exists() else (None,) * len(self.fields)
        out = []
        for at, ident, *now_ in rows:
            out += [(ident, at, f, b, a) for f, b, a in zip(self.fields, before, now_, strict=True) if a != b]
            before = tuple(now_)
        self.last.update(before)
        return out


class Quota(InOrder):
    """A rolling limit of uses; only allowed ones count, and a use that is given back counts no more.

    The state is the list of uses of the period, ``most`` of them at most; it goes when the last of them has left the period.
    """

    def __init__(self, most: int, period: int, columns: list[str]) -> None:
        super().__init__(["back"], columns)
        self.most, self.period = most, period

    def begin(self, handle):
        self.used = handle.getListState("used", "at long, ident string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Uses from before the stream, (at, ident) of each."""
        self.used.put([(int(r.at), str(r.ident)) for r in initialState.itertuples(index=False)])

    def step(self, key, rows, now):
        used, out = [tuple(u) for u in self.used.get()], []
        for at, ident, back in rows:
            used = [u for u in used if u[0] > at - self.period]
            if back == "true":
                used = [u for u in used if u[1] != ident]
                out.append((ident, at, None))
                continue
            allowed = len(used) < self.most
            if allowed:
                used.append((at, ident))
            out.append((ident, at, allowed))
        self.held = [u for u in used if u[0] > now - self.period]
        if self.held:
            self.used.put(self.held)
        else:
            self.used.clear()
        return out

    def ends(self):
        return max(u[0] for u in self.held) + self.period if self.held else None


class Lives(InOrder):
    """Items that live until nothing has used them for ``ttl``, or until ``most`` others of the key were used later.

    A row when an item's life ends: (item, first use, last use, uses, what ended it).  The state maps a living item to its uses.
    """

    def __init__(self, ttl: int, most: int, columns: list[str]) -> None:
        super().__init__(["item"], columns)
        self.ttl, self.most = ttl, most

    def begin(self, handle):
        self.items = handle.getMapState("items", "item string", "first long, last long, uses long")

    def step(self, key, rows, now):
        alive = {k[0]: tuple(v) for k, v in self.items.iterator()}
        before, out = dict(alive), []

        def expire(at: int) -> None:
            for item, (first, last, uses) in sorted(alive.items(), key=lambda x: x[1][1]):
                if last + self.ttl < at:
                    out.append((item, first, last, uses, "ttl"))
                    del alive[item]

        for at, _, item in rows:
            expire(at)
            first, _, uses = alive.get(item, (at, at, 0))
            alive[item] = (first, at, uses + 1)
            if len(alive) > self.most:
                oldest = min(alive, key=lambda x: alive[x][1])
                out.append((oldest, *alive.pop(oldest), "lru"))
        expire(now)
        for item in before.keys() - alive.keys():
            self.items.removeKey((item,))
        for item, v in alive.items():
            if before.get(item) != v:
                self.items.updateValue((item,), v)
        self.alive = alive
        return out

    def ends(self):
        return min(v[1] for v in self.alive.values()) + self.ttl + 1 if self.alive else None


def _rows(stream: DataFrame, key: str, at: str, ident: str, late: str, **fields) -> DataFrame:
    """The columns that ``InOrder`` reads, under a watermark."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.select(key, at, F.unix_micros(at).alias("at"), F.col(ident).cast("string").alias("ident"), *(c.cast("string").alias(f) for f, c in fields.items()))


def history(stream: DataFrame, key: str, at: str, ident: str, fields: list[str], late: str = LATE) -> DataFrame:
    """(key, ident, at, field, before, after) in micros; each change once, whatever order snapshots come in within the allowance."""
    kind = dict(stream.dtypes)[key]
    rows = _rows(stream, key, at, ident, late, **{f: F.col(f) for f in fields})
    return rows.groupBy(key).transformWithStateInPandas(History(fields, [key, "ident", "at", "field", "before", "after"]), f"{key} {kind}, ident string, at long, field string, before string, after string", "append", "eventtime")


def quota(stream: DataFrame, key: str, at: str, ident: str, most: int, hours: int, back=None, late: str = LATE, before: DataFrame | None = None) -> DataFrame:
    """(key, ident, at, allowed); null for a use given back.  ``before`` (key, at, ident) has uses from before the stream."""
    kind = dict(stream.dtypes)[key]
    rows = _rows(stream, key, at, ident, late, back=F.lit(False) if back is None else back)
    rule = Quota(most, hours * 3_600_000_000, [key, "ident", "at", "allowed"])
    return rows.groupBy(key).transformWithStateInPandas(rule, f"{key} {kind}, ident string, at long, allowed boolean", "append", "eventtime", None if before is None else before.groupBy(key))


def lives(stream: DataFrame, key: str, at: str, ident: str, item: str, hours: int, most: int, late: str = LATE) -> DataFrame:
    """(key, item, first, last, uses, ended): a row for each life of an item that has ended."""
    kind = dict(stream.dtypes)[key]
    rows = _rows(stream, key, at, ident, late, item=F.col(item))
    rule = Lives(hours * 3_600_000_000, most, [key, "item", "first", "last", "uses", "ended"])
    return rows.groupBy(key).transformWithStateInPandas(rule, f"{key} {kind}, item string, first long, last long, uses long, ended string", "append", "eventtime")


def recovered(failures: DataFrame, recoveries: DataFrame, key: str, within: str, late: str = LATE) -> DataFrame:
    """(key, failure, failed_at, recovery): each failure with each recovery of its key within the time after it, or null when none can come any more.

    Both are streams of (key, at, ident); the watermarks tell when a failure's time is over, and bound what both sides hold.
    """
    f = failures.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).select(F.col(key), F.col("ident").alias("failure"), F.col("at").alias("failed_at"))
    r = recoveries.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).select(F.col(key).alias("_key"), F.col("ident").alias("recovery"), F.col("at").alias("recovered_at"))
    met = F.expr(f"{key} = _key and recovered_at > failed_at and recovered_at <= failed_at + interval {within}")
    return f.join(r, met, "left_outer").select(key, "failure", "failed_at", "recovery")


# ---------------------------------------------------------------- a sink that sends nothing twice


class Outbox:
    """Sends pending rows once, whatever batches are replayed.

    A batch first claims its rows, under its own number; what another batch has claimed is not its to send.  Then it sends what it has
    claimed and not sent.  A batch that fails between the two, or runs again after a restart, finds its claim and goes on from there.
    Claims and deliveries are tables in the shared folder, one part a batch, which is written whole or not at all.
    """

    def __init__(self, spark: SparkSession, folder: str, ident: str, send: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.folder, self.ident, self.send = spark, folder, ident, send

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place)

    def _others(self, what: str, batch: int) -> DataFrame | None:
        """The ids in the parts of the batches before."""
        parts = [p for p in (f"{self.folder}/{what}/{b}" for b in range(batch)) if self._exists(p)]
        return self.spark.read.parquet(*parts).select(self.ident) if parts else None

    def __call__(self, rows: DataFrame, batch: int) -> None:
        claim, sent = f"{self.folder}/claims/{batch}", f"{self.folder}/sent/{batch}"
        if not self._exists(claim):
            mine, others = rows.dropDuplicates([self.ident]), self._others("claims", batch)
            mine = mine if others is None else mine.join(others, self.ident, "left_anti")
            mine.write.mode("overwrite").parquet(claim)
        if not self._exists(sent):
            self.send(self.spark.read.parquet(claim)).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(sent)

    def sent(self, batches: int) -> DataFrame:
        return self.spark.read.parquet(*(p for p in (f"{self.folder}/sent/{b}" for b in range(batches)) if self._exists(p)))


# ---------------------------------------------------------------- running to the end


def to_end(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None] | None = None) -> int:
    """Run a stream over all that is there now, from its checkpoint in ``folder``; the number of its last batch.

    The rows go to ``folder``/out, or to a sink for each batch.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{folder}/out").start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        return query.lastProgress["batchId"] if query.lastProgress else -1
    finally:
        spark.conf.set(PROVIDER, before)
