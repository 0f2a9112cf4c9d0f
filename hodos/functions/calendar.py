"""Calendar columns, hour spine, reporting day and the Greek public-holiday table.

Everything works on ``TIMESTAMP_NTZ`` read as UTC and stays inside generated code: no
formatter objects, no Python functions.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# First hour of the published sensor history.
SPINE_START = datetime(2020, 11, 13)

# Greek public holidays, fixed values: (month, day, name) and offsets in days from
# Orthodox Easter Sunday.
FIXED_HOLIDAYS = (
    (1, 1, "New Year's Day"),
    (1, 6, "Epiphany"),
    (3, 25, "Independence Day"),
    (5, 1, "Labour Day"),
    (8, 15, "Assumption Day"),
    (10, 28, "Ochi Day"),
    (12, 25, "Christmas Day"),
    (12, 26, "Glorifying Mother of God"),
)
EASTER_HOLIDAYS = (
    (-48, "Clean Monday"),
    (-2, "Good Friday"),
    (1, "Easter Monday"),
    (50, "Whit Monday"),
)


def naive(moment: Column | datetime | str) -> Column:
    """``moment`` as a naive UTC timestamp column."""
    if isinstance(moment, Column):
        return moment.cast("timestamp_ntz")
    if isinstance(moment, datetime):
        if moment.tzinfo is not None:
            moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
        moment = moment.isoformat(sep=" ")
    return F.lit(moment).cast("timestamp_ntz")


def as_date(day: Column | str | object) -> Column:
    return (day if isinstance(day, Column) else F.lit(str(day))).cast("date")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {n} HOUR")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAY")


def full_hour(moment: Column | datetime | str) -> Column:
    # date_trunc answers in TIMESTAMP, hence the cast back.
    return F.date_trunc("HOUR", naive(moment)).cast("timestamp_ntz")


def full_day(moment: Column | datetime | str) -> Column:
    return F.date_trunc("DAY", naive(moment)).cast("timestamp_ntz")


def day_name(moment: Column) -> Column:
    """Full English weekday name."""
    names = F.array(*[F.lit(name) for name in DAYS])
    return F.element_at(names, F.weekday(moment) + 1)


def day_rank(name: Column) -> Column:
    """Sort key for weekday names, Monday first."""
    return F.array_position(F.array(*[F.lit(day) for day in DAYS]), name)


def clock(moment: Column) -> Column:
    """``HH:MM`` of a timestamp."""
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    return F.concat(two(F.hour(moment)), F.lit(":"), two(F.minute(moment)))


def calendar_columns(moment: Column) -> list[Column]:
    return [
        moment.cast("date").alias("processed_date"),
        F.year(moment).alias("processed_year"),
        F.month(moment).alias("processed_month"),
        day_name(moment).alias("processed_day"),
        clock(moment).alias("processed_hour"),
    ]


def month_number(year: Column, month: Column) -> Column:
    """Months since year 0; one comparable number for a (year, month) partition."""
    return year.cast("int") * 12 + month.cast("int")


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def hour_spine(spark: SparkSession, first: Column | datetime, last: Column | datetime) -> DataFrame:
    """Every full hour from ``first`` to ``last``, both included."""
    slots = F.sequence(naive(first), full_hour(last), hours(1))
    return spark.range(1).select(F.explode(slots).alias("hourly_slot"))


def day_spine(spark: SparkSession, first: Column | object, last: Column | object) -> DataFrame:
    slots = F.sequence(as_date(first), as_date(last), days(1))
    return spark.range(1).select(F.explode(slots).alias("day"))


def month_spans(spark: SparkSession, first: Column | object, last: Column | object) -> DataFrame:
    """The calendar months of a date range, each clipped to the range."""
    first, last = as_date(first), as_date(last)
    start = F.explode(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH")))
    return (
        spark.range(1)
        .select(start.alias("month_start"))
        .select(
            "month_start",
            F.greatest(F.col("month_start"), first).alias("first_day"),
            F.least(F.last_day("month_start"), last).alias("last_day"),
        )
    )


def reporting_day(moment: Column, rollover_hour: int = 6) -> Column:
    """Business day that rolls over at ``rollover_hour`` UTC instead of midnight."""
    return (naive(moment) - hours(rollover_hour)).cast("date")


def next_local_hour(moment: Column, zone: str = "Europe/Athens") -> Column:
    """The next full wall-clock hour in ``zone`` for a naive UTC timestamp."""
    local = F.from_utc_timestamp(moment.cast("timestamp"), zone)
    return full_hour(local.cast("timestamp_ntz")) + hours(1)


def orthodox_easter(year: Column) -> Column:
    """Gregorian date of Orthodox Easter Sunday, valid 1900-2099.

    The Julian computus in integer arithmetic; the calendars are 13 days apart over the
    whole validity range.
    """
    moon = (F.lit(19) * (year % 19) + 15) % 30
    sunday = (F.lit(2) * (year % 4) + F.lit(4) * (year % 7) - moon + 34) % 7
    march_days = moon + sunday + 114
    month = F.floor(march_days / 31).cast("int")
    julian = F.make_date(year, month, march_days % 31 + 1)
    return F.date_add(julian, 13)


def greek_holidays(spark: SparkSession, first_year: Column | int = 1900, last_year: Column | int = 2099) -> DataFrame:
    """One row per holiday and year. Twelve rows a year, so at most 2,400 rows in all."""
    span = F.sequence(F.lit(first_year).cast("int"), F.lit(last_year).cast("int"))
    years = spark.range(1).select(F.explode(span).alias("year"))
    easter = orthodox_easter(F.col("year"))
    rows = [
        F.struct(F.make_date(F.col("year"), F.lit(month), F.lit(day)).alias("holiday_date"), F.lit(name).alias("holiday_name"))
        for month, day, name in FIXED_HOLIDAYS
    ] + [
        F.struct(F.date_add(easter, offset).alias("holiday_date"), F.lit(name).alias("holiday_name"))
        for offset, name in EASTER_HOLIDAYS
    ]
    return years.select(F.explode(F.array(*rows)).alias("h")).select("h.holiday_date", "h.holiday_name")
