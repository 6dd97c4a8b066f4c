"""Number formats and sentences.  Numbers stay raw in the operators; text is made last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuspulse.functions.codes import day_name

# ---- fixed values: number and clock patterns ---------------------------------
PERCENT = "#.##"
SIGNED_PERCENT = "+#.##;-#.##"
TWO_DECIMALS = "#.00"
CLOCK = "hh:mma"
CLOCK_SECONDS = "hh:mm:ss a"
CLOCK_SPACED = "hh:mm a"

# ---- fixed values: sentences -------------------------------------------------
MORNING_TEXT = "On %s, all charge ports are taken up by %s"
MIDDAY_TEXT = "On %s, some charge ports are available between %s and %s"
AFTERNOON_TEXT = "On %s, at the end of the day, charge ports start to be available at %s"
ALL_DAY_TEXT = "On %s, charge ports are available the entire day"
INITIAL_TEXT = "%s: Initial charge port status counts"
NONZERO_TEXT = "%s: Available count became non-zero from %d -> %d, a change of %d (%s) (%s of %d)"
INCREASED_TEXT = "%s: Available count increased from %d -> %d, a change of +%d (%s) (%s of %d)"
DECREASED_TEXT = "%s: Available count decreased from %d -> %d, a change of -%d (%s) (%s of %d)"
ZERO_TEXT = "%s: Available count went to zero from %d, a change of -%d (%s) (%s of %d)"
DEPLETION_TEXT = (
    "By %s %d ports predicted all gone in %s minutes at a rate of %s/min over last %d velocities"
)
AVAILABLE_TEXT = "It is forecasted that charge ports will be available in %s @ %s for %s"
UNAVAILABLE_TEXT = "It is forecasted that all charge ports will be unavailable in %s @ %s"
COUNT_OF_TOTAL_TEXT = "%d of %d (%s)"


def format_pattern(value: Column, pattern: str) -> Column:
    """Number text by pattern, half-even."""
    return F.call_function("format_number", value, F.lit(pattern))


def percent(part: Column, total: Column) -> Column:
    """part / total * 100 as double; NULL for an empty total."""
    return F.try_divide(part.cast("double"), total.cast("double")) * F.lit(100.0)


def percent_text(value: Column) -> Column:
    return F.concat(format_pattern(value, PERCENT), F.lit("%"))


def percent_change(old: Column, new: Column, total: Column | None = None) -> Column:
    return percent(new - old, old if total is None else total)


def percent_change_text(old: Column, new: Column, total: Column | None = None) -> Column:
    """Signed percent text; empty where the base is 0, NULL without an old value."""
    base = old if total is None else total
    value = percent_change(old, new, total)
    return F.when(base == 0, F.lit("")).otherwise(
        F.concat(format_pattern(value, SIGNED_PERCENT), F.lit("%"))
    )


def two_decimals(value: Column) -> Column:
    return format_pattern(value, TWO_DECIMALS)


def clock_of_minute(minute: Column) -> Column:
    """Minute of day to clock text; any date serves."""
    midnight = F.lit("2017-11-12 00:00:00").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("MINUTE", minute, midnight), CLOCK)


def duration_text(minutes: Column) -> Column:
    """Whole minutes as ``'2 hours, 5 minutes'``; ``'0'`` for none."""
    hours = F.floor(minutes / 60).cast("int")
    rest = F.pmod(minutes, F.lit(60)).cast("int")
    text = F.concat_ws(
        ", ",
        F.when(hours > 0, F.format_string("%d hours", hours)),
        F.when(rest > 0, F.format_string("%d minutes", rest)),
    )
    return F.when(minutes == 0, F.lit("0")).otherwise(text)


def slot_key(date: Column, dow: Column, hour: Column, slot: Column) -> Column:
    """Display form of a slot, month 0-based: ``MM_dd_dow_HH_ss``."""
    return F.format_string(
        "%02d_%02d_%02d_%02d_%02d", F.month(date) - 1, F.day(date), dow, hour, slot
    )


def split_outlet_key(key: Column) -> tuple[Column, Column]:
    """``device_outlet`` to its two parts; the outlet may itself hold the separator."""
    parts = F.split(key, "_", 2)
    return parts[0], parts[1]


def window_name(label: str, dow: Column, start_minute: Column, end_minute: Column) -> Column:
    def clock(minute: Column) -> list[Column]:
        return [F.floor(minute / 60).cast("int"), F.pmod(minute, F.lit(60)).cast("int")]

    return F.format_string(
        label.replace("%", "%%") + ": %d;%d:%d-%d:%d",
        dow, *clock(start_minute), *clock(end_minute),
    )


def morning_text(dow: Column, end_minute: Column) -> Column:
    return F.format_string(MORNING_TEXT, day_name(dow), clock_of_minute(end_minute))


def midday_text(dow: Column, start_minute: Column, end_minute: Column) -> Column:
    return F.format_string(
        MIDDAY_TEXT, day_name(dow), clock_of_minute(start_minute), clock_of_minute(end_minute)
    )


def afternoon_text(dow: Column, start_minute: Column) -> Column:
    return F.format_string(AFTERNOON_TEXT, day_name(dow), clock_of_minute(start_minute))


def all_day_text(dow: Column) -> Column:
    return F.format_string(ALL_DAY_TEXT, day_name(dow))


def transition_text(
    kind: Column, local: Column, old: Column, new: Column, total: Column
) -> Column:
    at = F.date_format(local, CLOCK_SECONDS)
    tail = (percent_change_text(old, new), percent_change_text(old, new, total), total)
    return (
        F.when(kind == "initial", F.format_string(INITIAL_TEXT, at))
        .when(kind == "became_nonzero", F.format_string(NONZERO_TEXT, at, old, new, new - old, *tail))
        .when(kind == "increased", F.format_string(INCREASED_TEXT, at, old, new, new - old, *tail))
        .when(kind == "decreased", F.format_string(DECREASED_TEXT, at, old, new, old - new, *tail))
        .when(kind == "went_to_zero", F.format_string(ZERO_TEXT, at, old, old - new, *tail))
    )


def depletion_text(
    empty_local: Column, avail: Column, seconds: Column, velocity: Column, count: Column
) -> Column:
    return F.format_string(
        DEPLETION_TEXT,
        F.date_format(empty_local, CLOCK_SPACED),
        avail,
        two_decimals(seconds / F.lit(60.0)),
        two_decimals(velocity),
        count,
    )


def count_of_total(avail: Column, total: Column) -> Column:
    return F.format_string(COUNT_OF_TOTAL_TEXT, avail, total, percent_text(percent(avail, total)))
