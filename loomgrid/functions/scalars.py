"""Numbers, text, money and time as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CM_PER_INCH = 2.54
#: Fixed values of the thread estimate: waste, strand length of a skein in cm (6 strands of 8 m).
OVERHEAD = 2.0
SKEIN_STRAND_CM = 4800


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity: floor(x + 0.5)."""
    return F.floor(x + 0.5)


def strict_least(*columns: Column) -> Column:
    """The least value, NaN or null if any is: unlike ``least``, which skips nulls and ranks NaN as largest."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | c.isNull()
    nan = F.lit(False)
    for c in columns:
        nan = nan | F.isnan(c)
    return F.when(bad, None).when(nan, F.lit(float("nan"))).otherwise(F.least(*columns))


def strict_greatest(*columns: Column) -> Column:
    bad, nan = F.lit(False), F.lit(False)
    for c in columns:
        bad, nan = bad | c.isNull(), nan | F.isnan(c)
    return F.when(bad, None).when(nan, F.lit(float("nan"))).otherwise(F.greatest(*columns))


def percent_change(current: Column, previous: Column) -> Column:
    """Whole percent, halves up; null where there was nothing before."""
    return F.when(previous == 0, None).otherwise(half_up((current - previous) * 100.0 / previous)).cast("long")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(x.cast("int")), 2, "0") for x in (r, g, b))))


def rgb_of_hex(text: Column) -> Column:
    """A struct r, g, b of ``#rrggbb`` (the hash may be absent); null for anything else."""
    digits = F.regexp_extract(text, "^#?([0-9a-fA-F]{6})$", 1)
    part = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def page_letter(index: Column, digits: int = 4) -> Column:
    """0 is A, 25 is Z, 26 is AA: bijective base 26, as many letters as it takes (at most ``digits``)."""
    out, n = F.lit(""), index.cast("long") + 1
    for _ in range(digits):
        out = F.when(n > 0, F.concat(F.char(F.pmod(n - 1, F.lit(26)) + 65), out)).otherwise(out)
        n = F.when(n > 0, F.floor((n - 1) / 26)).otherwise(F.lit(0))
    return out


def xml_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def xml_unescape(text: Column) -> Column:
    for name, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#9;", "\t"), ("&#10;", "\n"), ("&#13;", "\r"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(raw))
    return text


def csv_cell(text: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def money_minor(text: Column) -> Column:
    """``12.50``, ``12,5``, ``12`` or ``€12.50`` in minor units; null for anything else."""
    pattern = r"^\s*[€$£]?\s*(\d{1,7})(?:[.,](\d{1,2}))?\s*$"
    whole, part = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(whole != "", whole.cast("long") * 100 + F.rpad(part, 2, "0").cast("long"))


def money_text(minor: Column, sign: str = "€") -> Column:
    return F.concat(F.lit(sign), F.format_number(minor / 100.0, 2))


def thread_number(text: Column, brand: str = "DMC") -> Column:
    """The code of ``DMC 321``; null where the text names no such thread."""
    code = F.regexp_extract(text, rf"(?i)^\s*{brand}\s+([0-9A-Za-z]+)\s*$", 1)
    return F.when(code != "", code)


def thread_label(code: Column, name: Column) -> Column:
    return F.when((name.isNull()) | (name == ""), code).otherwise(F.concat_ws(" - ", code, name))


def label_parts(label: Column) -> Column:
    """(code, name) of ``code - name``, split at the first separator; without one the whole is the name."""
    at = F.instr(label, " - ")
    return F.when(at > 0, F.struct(F.left(label, at - 1).alias("code"), F.substr(label, at + 3).alias("name"))).otherwise(F.struct(F.lit(None).cast("string").alias("code"), label.alias("name")))


def skeins(stitches: Column, aida: Column) -> Column:
    """Skeins to buy: none for no stitch, else at least one; three strands on coarse cloth, two on fine."""
    strands = F.when(aida <= 11, 3).otherwise(2)
    centimetres = strands * (2 * (2**0.5 + 1) * CM_PER_INCH * OVERHEAD / aida)
    return F.when(stitches <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(stitches * centimetres / SKEIN_STRAND_CM))).cast("long")


def finished_cm(cells: Column, aida: Column) -> Column:
    return F.format_number(cells / aida * CM_PER_INCH, 1)


def all_words(text: Column, query: str) -> Column:
    """Whether the text holds every word of the query, whatever the case."""
    held = F.lit(True)
    for word in query.lower().split():
        held = held & F.lower(text).contains(word)
    return held


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def zone_midnight_after(ts: Column, days: int, zone: str) -> Column:
    """The moment the ``days``-th day after ts's day begins in the zone, summer time or not."""
    local = F.to_date(F.from_utc_timestamp(ts, zone))
    return F.to_utc_timestamp(F.date_add(local, days).cast("timestamp"), zone)


def withdrawal_deadline(ts: Column, zone: str = "Europe/Berlin", days: int = 14) -> Column:
    """The end of the 14th day after the day of the contract, which is not counted."""
    return zone_midnight_after(ts, days + 1, zone)


def month_range(day: Column) -> Column:
    """(from, to) of the calendar month, the end not included."""
    first = F.trunc(day, "MM")
    return F.struct(first.alias("from"), F.add_months(first, 1).alias("to"))


def iso_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def wait_words(seconds: Column) -> Column:
    """``in 12 minutes``, ``in 3 hours``, ``in 2 days``: always rounded up."""

    def unit(n: Column, word: str) -> Column:
        return F.concat(F.lit("in "), n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    minutes = F.greatest(F.lit(1), F.ceil(seconds / 60))
    hours = F.ceil(minutes / 60)
    return F.when(minutes < 60, unit(minutes, "minute")).when(hours < 48, unit(hours, "hour")).otherwise(unit(F.ceil(hours / 24), "day"))


def saved_when(ts: Column, now: Column) -> Column:
    ago = F.unix_timestamp(now) - F.unix_timestamp(ts)
    same_day = F.to_date(ts) == F.to_date(now)
    return (
        F.when(ago < 60, "Just now")
        .when(ago < 3600, F.concat(F.floor(ago / 60).cast("string"), F.lit(" min ago")))
        .when(same_day, F.concat(F.floor(ago / 3600).cast("string"), F.lit(" h ago")))
        .when(F.to_date(ts) == F.date_sub(F.to_date(now), 1), "Yesterday")
        .when(F.year(ts) == F.year(now), F.date_format(ts, "d MMM"))
        .otherwise(F.date_format(ts, "d MMM yyyy"))
    )


def mulberry_step(state: Column) -> tuple[Column, Column]:
    """(next state, 32-bit draw) of the Mulberry32 generator, on longs that hold unsigned 32-bit values."""
    mask = F.lit(0xFFFFFFFF)

    def times(a: Column, b: Column) -> Column:
        """The low 32 bits of a product, by halves so that a long never overflows."""
        low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
        return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)

    s = (state + 0x6D2B79F5).bitwiseAND(mask)
    t = times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
    return s, t.bitwiseXOR(F.shiftright(t, 14))


def free_name(name: Column, taken: Column) -> Column:
    """``name``, or with the least number from 2 on that makes it one that is not taken (an array; null: none)."""
    held = F.coalesce(taken, F.array().cast("array<string>"))
    numbered = F.transform(F.sequence(F.lit(2), F.size(held) + 2), lambda n: F.concat_ws(" ", name, n.cast("string")))
    return F.when(~F.array_contains(held, name), name).otherwise(F.get(F.filter(numbered, lambda n: ~F.array_contains(held, n)), F.lit(0)))


#: Signs of a chart's colours, handed out in turn.
SYMBOLS = "+x#o*%=/<>^v"


def symbol_for(index: Column, symbols: str = SYMBOLS) -> Column:
    """The colour's sign: the set is handed out in order and begins again when it ends."""
    return F.substring(F.lit(symbols), (F.pmod(index, F.lit(len(symbols))) + 1).cast("int"), F.lit(1))


def mix_of_two(at: list[Column], one: list[float], two: list[float]) -> tuple[Column, Column]:
    """(weight of the second, distance left) of the mixture of two points, weights summing to 1, that comes nearest to a point; all of the first where they are the same."""
    way = [b - a for a, b in zip(one, two, strict=True)]
    length = sum(w * w for w in way)
    from_one = [c - a for c, a in zip(at, one, strict=True)]
    weight = sum((d * w for d, w in zip(from_one, way, strict=True)), F.lit(0.0)) / length if length else F.lit(0.0)
    left = [d - weight * w for d, w in zip(from_one, way, strict=True)]
    return weight, F.sqrt(sum((x * x for x in left), F.lit(0.0)))
