"""Time text and arithmetic on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of the header, three letters each.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def from_epoch(sec: Column) -> Column:
    """Inverse of :func:`epoch_seconds`."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return base + F.make_dt_interval(F.floor(sec / 86400).cast("int"), F.lit(0), F.lit(0),
                                     F.pmod(sec, F.lit(86400)).cast("decimal(18,6)"))


def header_date(ts: Column) -> Column:
    """``Mon dd`` with a blank-padded day."""
    return F.concat(F.date_format(ts, "MMM"), F.lit(" "),
                    F.lpad(F.dayofmonth(ts).cast("string"), 2, " "))


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def header_time(ts: Column) -> Column:
    """``Mon dd HH:MM:SS``, the 15-character header."""
    return F.concat(header_date(ts), F.lit(" "), clock_text(ts))


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def has_header(text: Column) -> Column:
    """Does the text start with something laid out like the 15-character header?"""
    def at(i: int) -> Column:
        return F.substring(text, i, 1)
    return ((F.length(text) >= 16) & (at(4) == " ") & (at(7) == " ") & (at(10) == ":")
            & (at(13) == ":") & (at(16) == " "))


def header_fields(text: Column) -> Column:
    """Struct of the numbers in a header: ``year`` (if given), ``mon`` … ``sec``.

    A year follows the time only when it is four digits and a blank. ``cut``
    is the number of characters the header takes. Null without a header, which
    also spares other lines the casts: a failing one is slow.
    """
    place = F.position(F.lower(F.substring(text, 1, 3)), F.lit(MONTHS))
    dated = F.substring(text, 17, 5).rlike("^[0-9]{4} ")

    def number(start: int) -> Column:
        return F.trim(F.substring(text, start, 2)).try_cast("int")

    return F.when(has_header(text), F.struct(
        F.when(dated, F.substring(text, 17, 4).try_cast("int")).alias("year"),
        F.when(place % 3 == 1, F.floor((place + 2) / 3).cast("int")).alias("mon"),
        number(5).alias("day"), number(8).alias("hour"), number(11).alias("min"),
        number(14).alias("sec"),
        F.when(dated, 21).otherwise(16).alias("cut")))


def header_ts(h: Column, ref_ts: Column) -> Column:
    """Time of a header from its fields; null when it is no valid time.

    Without a year it is the one that puts the time at most a day after
    ``ref_ts`` and less than a year before that: a sender's clock may be
    ahead, also over New Year. A 29 February that does not exist is one of the year before.
    """
    def place(mon: Column, day: Column, hour: Column, minute: Column, sec: Column) -> Column:
        return (((mon * 100 + day) * 100 + hour) * 100 + minute) * 100 + sec

    latest = ref_ts + F.expr("INTERVAL '1' DAY")
    now = place(*[f(latest).cast("bigint") for f in (F.month, F.dayofmonth, F.hour, F.minute,
                                                     F.second)])
    then = place(h["mon"].cast("bigint"), h["day"], h["hour"], h["min"], h["sec"])
    year = F.coalesce(h["year"], F.year(latest) - (then > now).cast("int"))

    def build(y: Column) -> Column:
        return F.try_make_timestamp_ntz(y, h["mon"], h["day"], h["hour"], h["min"],
                                        h["sec"].cast("decimal(16,6)"))

    leap = h["year"].isNull() & (h["mon"] == 2) & (h["day"] == 29)
    return F.when(h.isNotNull(), F.coalesce(build(year), F.when(leap, build(year - 1))))
