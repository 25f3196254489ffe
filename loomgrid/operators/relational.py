"""Usage, quotas, layered settings, plans and payments over event and account tables; built-in operators only."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import scalars


def moment(rows: DataFrame, ts: str, at: str | datetime, **shift: int) -> Column:
    """A literal of the column's own type, so that comparing with it is pushed to the scan."""
    at = datetime.fromisoformat(at) if isinstance(at, str) else at
    return F.lit((at + timedelta(**shift)).isoformat(sep=" ")).cast(rows.schema[ts].dataType)


def midnight(now: str) -> datetime:
    return datetime.fromisoformat(now).replace(hour=0, minute=0, second=0, microsecond=0)


def daily_usage(events: DataFrame, now: str, days: int = 30, ts: str = "ts", generated: Column | None = None) -> DataFrame:
    """(day, generations, exports) for each of the last ``days`` UTC days, days without events included.

    Events are counted by day before they meet the series, which has ``days`` rows.
    """
    today = midnight(now)
    is_generated = (F.col("kind") == "GENERATE") if generated is None else generated
    counted = (
        events.where((F.col(ts) >= moment(events, ts, today, days=1 - days)) & (F.col(ts) < moment(events, ts, today, days=1)))
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count_if(is_generated).alias("g"), F.count_if(~is_generated).alias("e"))
    )
    series = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit((today - timedelta(days=days - 1)).date()), F.lit(today.date()))).alias("day"))
    joined = series.join(counted, "day", "left")
    return joined.select("day", F.coalesce("g", F.lit(0)).alias("generations"), F.coalesce("e", F.lit(0)).alias("exports"))


def bar_shares(series: DataFrame) -> DataFrame:
    """Each day's two counts in percent of the busiest day's total; zeros where nothing happened."""
    most = F.max(F.col("generations") + F.col("exports")).over(Window.partitionBy())  # one row a day of a bounded series
    share = lambda c: F.when(most == 0, 0.0).otherwise(F.col(c) * 100.0 / most)
    return series.select("day", share("generations").alias("generations_pct"), share("exports").alias("exports_pct"))


def window_counts(events: DataFrame, now: str, by: str = "kind", ts: str = "ts") -> DataFrame:
    """Counts since midnight, over 7 and 30 days with today, and over all time, in one pass."""
    upto = F.col(ts) <= moment(events, ts, now)
    since = lambda n: F.count_if(upto & (F.col(ts) >= moment(events, ts, midnight(now), days=-n)))
    return events.groupBy(by).agg(since(0).alias("today"), since(6).alias("seven_days"), since(29).alias("thirty_days"), F.count_if(upto).alias("all_time"))


def period_over_period(events: DataFrame, now: str, days: int, ts: str = "ts") -> DataFrame:
    """(current, previous, change): this range, the equal one before it, the change in whole percent; one scan, bounded by both ranges."""
    start, before = moment(events, ts, midnight(now), days=1 - days), moment(events, ts, midnight(now), days=1 - 2 * days)
    seen = events.where((F.col(ts) >= before) & (F.col(ts) <= moment(events, ts, now)))
    counted = seen.agg(F.count_if(F.col(ts) >= start).alias("current"), F.count_if(F.col(ts) < start).alias("previous"))
    return counted.withColumn("change", scalars.percent_change(F.col("current"), F.col("previous")))


def by_label(events: DataFrame, label: Column, recent: Column, missing: str = "not recorded") -> DataFrame:
    """(label, recent, all_time, position): null labels are one row, which stands last; then the most first, then by name."""
    counted = events.groupBy(F.coalesce(label, F.lit(missing)).alias("label")).agg(F.count_if(recent).alias("recent"), F.count("*").alias("all_time"))
    order = Window.orderBy(F.col("label") == missing, F.desc("all_time"), "label")  # one row a label
    return counted.withColumn("position", F.row_number().over(order).cast("long"))


#: Declared limits; each becomes a part of one expression.
MAX_LIMITS = 1000


def limit_use(uses: DataFrame, limits: DataFrame, now: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, limit_id, value, used, left, next_at) for each counted limit in force.

    ``limits`` has limit_id, value and period_hours; a null value is no limit.  Uses count in (now - period, now].  Where none is
    left and the value is above 0, one more is allowed a period after the (used - value + 1)-th oldest use: the value-th newest,
    which is found by rank, so no user's uses are gathered.
    """
    in_force = limits.where("value is not null").limit(MAX_LIMITS + 1).collect()  # a declared list of limits
    if len(in_force) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    longest = max((r.period_hours for r in in_force), default=0)
    seen = uses.select(key, ts).where((F.col(ts) > moment(uses, ts, now, hours=-longest)) & (F.col(ts) <= moment(uses, ts, now)))
    applies = F.array(*(F.when(F.col(ts) > moment(uses, ts, now, hours=-r.period_hours), F.struct(F.lit(r.limit_id).alias("limit_id"), F.lit(r.value).cast("long").alias("value"), F.lit(r.period_hours).alias("period_hours"))) for r in in_force))
    inside = seen.select(key, ts, F.inline(F.array_compact(applies))) if in_force else seen.selectExpr("*", "'' limit_id", "0L value", "0 period_hours").limit(0)
    span = F.make_dt_interval(hours=F.col("period_hours"))
    newest = Window.partitionBy(key, "limit_id").orderBy(F.desc(ts))
    ranked = inside.withColumn("nth", F.row_number().over(newest))
    used = ranked.groupBy(key, "limit_id", "value", "period_hours").agg(F.count("*").alias("used"), F.max(F.when(F.col("nth") == F.col("value"), F.col(ts))).alias("edge"))
    left = F.greatest(F.lit(0), F.col("value") - F.col("used"))
    return used.select(key, "limit_id", "value", "used", left.alias("left"), F.when((left == 0) & (F.col("value") > 0), F.col("edge") + span).alias("next_at"))


def decide_quota(use: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, allowed, limit_id, next_at): of used-up limits the one with the longest wait; never (a value of 0) beats any time."""
    wait = F.when(F.col("left") == 0, F.struct(F.col("next_at").isNull().alias("never"), "next_at", F.col("limit_id").alias("id")))
    worst = use.groupBy(key).agg(F.max(wait).alias("w"))
    return worst.select(key, F.col("w").isNull().alias("allowed"), F.col("w.id").alias("limit_id"), F.col("w.next_at").alias("next_at"))


def rolling_use(events: DataFrame, hours: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Each event with how many of its key lie in the period that ends with it, its start not included."""
    order = F.col(ts).cast("timestamp")
    frame = Window.partitionBy(key).orderBy(F.unix_micros(order)).rangeBetween(-(hours * 3_600_000_000 - 1), 0)
    return events.withColumn("used", F.count("*").over(frame))


LAYERS = ["site", "audience", "tier", "person"]


def resolve_layers(settings: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """(keys, value, layer): of each setting the value of the highest layer that has a row; a null value counts as a value.

    ``settings`` has the keys, layer and value.  Settings that ``known`` does not list are dropped.
    """
    rank = F.array_position(F.array(*(F.lit(x) for x in LAYERS)), F.col("layer"))
    rows = settings if known is None else settings.join(known, known.columns, "left_semi")
    best = rows.groupBy(*keys).agg(F.max(F.struct(rank.alias("rank"), "layer", "value")).alias("best"))
    return best.select(*keys, F.col("best.value").alias("value"), F.col("best.layer").alias("layer"))


def drop_defaults(settings: Column, default: str = "on") -> Column:
    """A map without the entries that have the default value."""
    return F.map_filter(settings, lambda _, v: v != default)


def entitlement(status: Column, kind: Column, period_end: Column, first_failed: Column, now: Column, grace_days: int = 7, late_days: int = 2) -> Column:
    """A struct of tier, until and reason, by the first rule that holds.

    A given tier lasts to its end exactly; a paid one to its period's end and an allowance for late records; a failing one no
    longer than its grace from the first failure.
    """
    allowance = F.expr(f"interval {late_days} days")
    late_end, grace_end = period_end + allowance, first_failed + F.expr(f"interval {grace_days} days")

    def told(tier: bool, reason: str | None, until: Column | None = None) -> Column:
        return F.struct(F.lit(tier).alias("tier"), (F.lit(None).cast("timestamp") if until is None else until).alias("until"), F.lit(reason).cast("string").alias("reason"))

    no_period, over = told(False, "no-period-recorded"), told(False, "period-ended")
    return (
        F.when(status.isNull(), told(False, "no-subscription"))
        .when((kind == "grant") & ((status != "active") | period_end.isNull() | (now >= period_end)), told(False, "given-ended"))
        .when(kind == "grant", told(True, None, period_end))
        .when(status == "incomplete", told(False, "first-payment-pending"))
        .when(status == "incomplete_expired", told(False, "first-payment-never-made"))
        .when(status.isin("unpaid", "canceled", "paused"), F.struct(F.lit(False).alias("tier"), F.lit(None).cast("timestamp").alias("until"), status.alias("reason")))
        .when(~status.isin("trialing", "active", "past_due"), told(False, "unknown-status"))
        .when(period_end.isNull(), no_period)
        .when(now >= late_end, over)
        .when((status == "past_due") & first_failed.isNotNull() & (now >= grace_end), told(False, "grace-ended"))
        .when((status == "past_due") & first_failed.isNotNull(), told(True, None, F.least(grace_end, late_end)))
        .otherwise(told(True, None, late_end))
    )


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def unused_share(start: Column, end: Column, at: Column) -> Column:
    """The share of a period not yet provided: 1 before it starts, 0 once it has ended or if it has no length."""
    length = _micros(end) - _micros(start)
    left = (_micros(end) - _micros(at)) / length
    return F.when(length <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), left)))


def refundable_left(amount: Column, refunded: Column) -> Column:
    return F.greatest(F.lit(0), amount - refunded)


def unused_refund(amount: Column, refunded: Column, start: Column, end: Column, at: Column) -> Column:
    """Minor units of the unused part, rounded up, never more than is left; null without a period."""
    return F.when(start.isNotNull() & end.isNotNull(), F.least(refundable_left(amount, refunded), F.ceil(amount * unused_share(start, end, at))))


def refund_amount(amount: Column, refunded: Column, start: Column, end: Column, at: Column, ask: Column, asked: Column) -> Column:
    """A struct of amount and refusal for ``all``, ``unused`` or a written amount."""
    left, unused, typed = refundable_left(amount, refunded), unused_refund(amount, refunded, start, end, at), scalars.money_minor(asked)

    def no(why: str) -> Column:
        return F.struct(F.lit(None).cast("long").alias("amount"), F.lit(why).alias("refusal"))

    def yes(what: Column) -> Column:
        return F.struct(what.cast("long").alias("amount"), F.lit(None).cast("string").alias("refusal"))

    return (
        F.when(left == 0, no("nothing-left")).when(ask == "all", yes(left)).when((ask == "unused") & unused.isNull(), no("no-period")).when((ask == "unused") & (unused == 0), no("period-over"))
        .when(ask == "unused", yes(unused)).when(typed.isNull(), no("not-an-amount")).when(typed == 0, no("zero")).when(typed > left, no("too-much")).otherwise(yes(typed))
    )


def withdrawal_refunds(payments: DataFrame, started: Column, at: Column) -> DataFrame:
    """Refunds above zero of payments made since the start; a payment without a period is given back whole."""
    amount = F.coalesce(unused_refund(F.col("amount"), F.col("refunded"), F.col("period_start"), F.col("period_end"), at), refundable_left(F.col("amount"), F.col("refunded")))
    return payments.where(F.col("paid_at") >= started).withColumn("refund", amount.cast("long")).where("refund > 0")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order; the filter on rank 1 lets Spark drop the others before the shuffle."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def offered_tiers(prices: DataFrame) -> DataFrame:
    """(tier, month, year, position): the newest current price of each tier and interval, cheapest by the month first.

    A tier with only a yearly price counts a twelfth of it.
    """
    newest = latest(prices.where("current"), ["tier", "interval"], [F.desc("created")])
    wide = newest.groupBy("tier").pivot("interval", ["MONTH", "YEAR"]).agg(F.first("amount"))
    monthly = F.coalesce(F.col("MONTH").cast("double"), F.col("YEAR") / 12.0)
    position = F.row_number().over(Window.orderBy(monthly, "tier")).cast("long")  # one row a tier
    return wide.select("tier", F.col("MONTH").alias("month"), F.col("YEAR").alias("year"), position.alias("position"))


def paginate(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page in the order; a page beyond the last is the last, one below the first the first."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(1, page), pages) - 1) * size).limit(size)


def keep_history(tries: DataFrame, key: str, recent: int = 5, pinned: int = 5) -> DataFrame:
    """Of each key the newest unpinned rows and the first pinned ones, each up to its cap."""
    order = Window.partitionBy(key, "pinned").orderBy(F.when(F.col("pinned"), F.lit(0)).otherwise(-F.col("since")), F.when(F.col("pinned"), F.col("number")).otherwise(-F.col("number")))
    ranked = tries.withColumn("_nth", F.row_number().over(order))
    return ranked.where((F.col("pinned") & (F.col("_nth") <= pinned)) | (~F.col("pinned") & (F.col("_nth") <= recent))).drop("_nth")


def upsert(old: DataFrame, new: DataFrame, key: list[str], when: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` by key: inserted where absent, else in place of the old row where ``when`` holds (columns o, n)."""
    had, has = F.col("o.__here").isNotNull(), F.col("n.__here").isNotNull()
    both = old.withColumn("__here", F.lit(1)).alias("o").join(new.withColumn("__here", F.lit(1)).alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    take = has & (~had | (F.lit(True) if when is None else F.coalesce(when, F.lit(False))))
    return both.select(*(F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns))


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, one a key."""
    return old.unionByName(new.dropDuplicates(key).join(old, key, "left_anti").select(old.columns))


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition is not true; null does not delete."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def untie(rows: DataFrame, owners: DataFrame, column: str, owner_key: str) -> DataFrame:
    """``rows`` with the column null where no owner has that key."""
    known = owners.select(F.col(owner_key).alias("_known")).distinct()
    return rows.join(known, F.col(column) == F.col("_known"), "left").withColumn(column, F.col("_known")).select(rows.columns)


def first_refusal(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, null if none does."""
    return F.coalesce(*(F.when(condition, F.lit(name)) for condition, name in rules))


def all_refusals(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for condition, name in rules)))


def checks(row: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(check, ok) for each named condition of a one-row frame."""
    pairs = ", ".join(f"'{name}', `{name}`" for name in conditions)
    return row.select(*(c.alias(n) for n, c in conditions.items())).select(F.expr(f"stack({len(conditions)}, {pairs}) as (check, ok)"))
