import hashlib
import hmac

from pyspark.sql import functions as F

from loomgrid.functions import scalars as S
from loomgrid.operators import palette as P
from loomgrid.operators import relational as R


def test_signature_is_hmac(spark):
    texts = ["", "body", "ü" * 300]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.signature(F.col("t"), "key").alias("s")).collect()]
    assert got == [hmac.new(b"key", t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_text_and_money(spark):
    rows = [("12.50", 1250), ("12,5", 1250), ("12", 1200), ("€12.50", 1250), ("-1", None), ("1.234", None), ("", None), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(S.money_minor(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [m for _, m in rows]
    one = spark.range(1)
    letters = one.select(*(S.page_letter(F.lit(i)).alias(f"l{i}") for i in (0, 25, 26, 27, 701, 702))).first()
    assert list(letters) == ["A", "Z", "AA", "AB", "ZZ", "AAA"]
    parts = one.select(S.label_parts(F.lit("310 - Black - dark")).alias("p"), S.rgb_of_hex(F.lit("#0A10ff")).alias("c"), S.thread_number(F.lit("dmc 321")).alias("n"), S.xml_unescape(S.xml_escape(F.lit("a<&>\"\t"))).alias("x")).first()
    assert (parts.p.code, parts.p.name, tuple(parts.c), parts.n, parts.x) == ("310", "Black - dark", (10, 16, 255), "321", 'a<&>"\t')


def test_strict_extremes_and_rounding(spark):
    row = spark.range(1).select(S.strict_least(F.lit(1.0), F.lit(float("nan"))).alias("n"), S.strict_greatest(F.lit(1.0), F.lit(None).cast("double")).alias("g"), S.half_up(F.lit(-0.5)).alias("h"), S.half_up(F.lit(2.5)).alias("k"), S.csv_cell(F.lit('a"b')).alias("c")).first()
    assert row.n != row.n and row.g is None and (row.h, row.k, row.c) == (0, 3, '"a""b"')


def test_withdrawal_deadline_over_summer_time(spark):
    df = spark.createDataFrame([("2026-03-20 12:00:00",), ("2026-10-20 22:30:00",)], "t string").select(S.withdrawal_deadline(F.col("t").cast("timestamp")).cast("string").alias("d"))
    assert [r.d for r in df.collect()] == ["2026-04-03 22:00:00", "2026-11-04 23:00:00"]


def test_entitlement_grace_and_grants(spark):
    rows = [(None, "paid", None, None), ("past_due", "paid", "2026-02-01", "2026-01-10"), ("past_due", "paid", "2026-02-01", "2026-01-01"), ("active", "grant", "2026-01-12", None), ("active", "paid", "2026-01-11", None), ("active", "paid", "2026-01-09", None)]
    df = spark.createDataFrame(rows, "status string, kind string, e string, f string")
    told = R.entitlement(F.col("status"), F.col("kind"), F.col("e").cast("timestamp"), F.col("f").cast("timestamp"), F.lit("2026-01-12").cast("timestamp"))
    got = [(r.t.tier, r.t.reason) for r in df.select(told.alias("t")).collect()]
    assert got == [(False, "no-subscription"), (True, None), (False, "grace-ended"), (False, "given-ended"), (True, None), (False, "period-ended")]


def test_upsert_takes_nulls_and_conditions(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (None, "m")], "k int, v string")
    assert sorted(map(tuple, R.upsert(old, new, ["k"]).collect()), key=repr) == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "m")], key=repr)
    assert sorted(map(tuple, R.upsert(old, new, ["k"], F.col("o.v").isNull()).collect()), key=repr) == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "n")], key=repr)


def test_relative_and_wait_words(spark):
    df = spark.createDataFrame([("2026-01-12 11:59:30",), ("2026-01-12 11:10:00",), ("2026-01-12 02:00:00",), ("2026-01-11 23:00:00",), ("2026-01-02 00:00:00",), ("2025-10-03 00:00:00",)], "t string")
    got = [r.w for r in df.select(S.saved_when(F.col("t").cast("timestamp"), F.lit("2026-01-12 12:00:00").cast("timestamp")).alias("w")).collect()]
    assert got == ["Just now", "50 min ago", "10 h ago", "Yesterday", "2 Jan", "3 Oct 2025"]
    waits = [r.w for r in spark.createDataFrame([(1,), (61,), (3600,), (3601 * 3,), (86400 * 3,)], "s int").select(S.wait_words(F.col("s")).alias("w")).collect()]
    assert waits == ["in 1 minute", "in 2 minutes", "in 1 hour", "in 4 hours", "in 3 days"]
