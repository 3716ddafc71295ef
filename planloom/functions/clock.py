"""Clock times as minutes since midnight."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from planloom.functions.let import let

# Blank characters, as a set to strip and as a pattern.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233,
                           8239, 8287, 12288)))
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
# 12-hour clock, hour 1-12, minute 0-59, AM or PM directly after the minute.
CLOCK = r"^(1[0-2]|0[1-9]|[1-9]):([0-5][0-9]|[0-9])[AaPp][Mm]$"
INVALID_TIME = "Invalid Time"


def strip(text: Column) -> Column:
    """Remove blanks of every kind at both ends (``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(BLANKS))


def clock_minutes(text: Column) -> Column:
    """``9:05AM`` as 545; null if the text is no such time."""
    def read(clock: Column) -> Column:
        hour = F.substring_index(clock, ":", 1).try_cast("int")
        after = F.substring_index(clock, ":", -1)
        minute = F.left(after, F.length(after) - 2).try_cast("int")
        half = F.when(F.upper(F.right(after, F.lit(2))) == "PM", 720).otherwise(0)
        return F.when(clock.rlike(CLOCK), hour % 12 * 60 + minute + half)
    return let(strip(text), read)


def clock_text(minutes: Column) -> Column:
    """545 as ``9:05AM``; times past midnight wrap, null gives ``Invalid Time``."""
    of_day = F.pmod(minutes, F.lit(1440)).cast("int")
    hour = F.pmod(F.floor(of_day / 60) + 11, F.lit(12)) + 1
    minute = F.lpad((of_day % 60).cast("string"), 2, "0")
    half = F.when(of_day >= 720, "PM").otherwise("AM")
    return F.when(minutes.isNull(), INVALID_TIME).otherwise(
        F.concat(hour.cast("string"), F.lit(":"), minute, half))


def range_minutes(text: Column) -> Column:
    """``10:30AM to 1:30PM`` as a struct of two minutes; null unless it splits in two at ``to``."""
    def bounds(halves: Column) -> Column:
        window = F.struct(clock_minutes(F.get(halves, F.lit(0))).alias("open_min"),
                          clock_minutes(F.get(halves, F.lit(1))).alias("close_min"))
        return F.when(F.size(halves) == 2, window)
    return let(let(F.split(text, "to"), bounds),
               lambda w: F.when(w["open_min"].isNotNull() & w["close_min"].isNotNull(), w))


# The shape of a proposed slot.
SLOT = r"[A-Za-z]+, [0-9]+:[0-9]+ - [0-9]+:[0-9]+"


def half_hours(text: Column) -> Column:
    """``14:30`` as 14.5; only the minute text ``30`` counts as half an hour."""
    hour = F.substring_index(text, ":", 1).try_cast("double")
    return hour + F.when(F.substring_index(text, ":", -1) == "30", 0.5).otherwise(0.0)


def slot(text: Column) -> Column:
    """First proposed slot in a text as (day, start, end); ('', -1, -1) if there is none."""
    def read(found: Column) -> Column:
        hours = F.substring_index(found, ", ", -1)
        some = F.struct(F.substring_index(found, ",", 1).alias("day"),
                        half_hours(F.substring_index(hours, " - ", 1)).alias("start_hour"),
                        half_hours(F.substring_index(hours, " - ", -1)).alias("end_hour"))
        none = F.struct(F.lit("").alias("day"), F.lit(-1.0).alias("start_hour"), F.lit(-1.0).alias("end_hour"))
        return F.when(found == "", none).otherwise(some)
    return let(F.regexp_extract(text, SLOT, 0), read)
