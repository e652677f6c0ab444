"""Calendar arithmetic: Monday-Friday business days, exchange sessions, execution dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MONDAY = "1970-01-05"


def _weekdays_before(d: Column) -> Column:
    """Business days from a fixed Monday up to d, d not included."""
    k = F.datediff(d, F.lit(_MONDAY).cast("date"))
    return (F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)), F.lit(5))).cast("int")


def busday_count(a: Column, b: Column) -> Column:
    """Business days in [a, b); for a > b minus those in (b, a]. Null if either is null."""
    back = _weekdays_before(F.date_add(a, 1)) - _weekdays_before(F.date_add(b, 1))
    return F.when(a <= b, _weekdays_before(b) - _weekdays_before(a)).otherwise(-back)


def busday_add(d: Column, n: int | Column) -> Column:
    """The n-th business day after d, n at least 0; a weekend counts as the Friday before it."""
    k = F.datediff(d, F.lit(_MONDAY).cast("date"))
    total = F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)), F.lit(4)) + (n if isinstance(n, Column) else F.lit(n))
    days = F.floor(total / 5) * 7 + F.pmod(total, F.lit(5))
    return F.date_add(F.lit(_MONDAY).cast("date"), days.cast("int"))


def last_closed_session(ts: Column, hour: int = 17, minute: int = 5) -> Column:
    """The day itself from hour:minute on, else the weekday before it; a weekend takes its Friday."""
    d = ts.cast("date")
    closed = F.hour(ts) * 60 + F.minute(ts) >= hour * 60 + minute
    weekday = F.weekday(d)  # Monday is 0
    before = F.date_sub(d, F.when(weekday == 0, 3).when(weekday == 6, 2).otherwise(1))
    on_weekend = F.date_sub(d, weekday - 4)
    return F.when(weekday > 4, on_weekend).when(closed, d).otherwise(before)


def execution_date(decided: Column, latest_news: Column, hour: int = 17, minute: int = 5) -> Column:
    """Struct (date, reason): the business day after the decision where no news came after the
    evening cut of the weekday before it, else one day later."""
    day = decided.cast("date")
    eve = F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))
    cut = F.to_timestamp(F.concat_ws(" ", eve.cast("string"), F.lit(f"{hour:02d}:{minute:02d}:00")))
    late = F.coalesce(latest_news > cut, F.lit(False))
    return F.struct(
        F.when(late, busday_add(day, 2)).otherwise(busday_add(day, 1)).alias("date"),
        F.when(late, F.lit("late news")).otherwise(F.lit(None).cast("string")).alias("reason"),
    )


def session_table(days: DataFrame, day: str = "d") -> DataFrame:
    """(d, ord, next_d): distinct sessions with their 0-based ordinal. A calendar is small; its
    ordinals come from one window over the distinct days alone."""
    w = Window.orderBy("d")
    return days.select(F.col(day).alias("d")).filter("d is not null").distinct().select("d", (F.row_number().over(w) - 1).alias("ord"), F.lead("d").over(w).alias("next_d"))


def next_session(df: DataFrame, sessions: DataFrame, day: str = "d") -> DataFrame:
    """df with `next_d`: the first session strictly after `day`, null beyond the last one.

    `day` need not be a session itself: sessions and days are laid on one line per month start,
    and the least later session is taken by an as-of join looking forward.
    """
    from ..operators.asof import asof_join

    s = sessions.select(F.col("d").alias("next_d"))
    return asof_join(df, s, [], day, "next_d", value_cols=["next_d"], direction="forward", strict=True)


def sessions_between(df: DataFrame, sessions: DataFrame, entry: str, exit: str) -> DataFrame:
    """df with `n_sessions`: sessions in (entry, exit], both being sessions themselves; null if either isn't."""
    s = sessions.select("d", "ord")
    a = s.select(F.col("d").alias(entry), F.col("ord").alias("_from"))
    b = s.select(F.col("d").alias(exit), F.col("ord").alias("_to"))
    return df.join(a, entry, "left").join(b, exit, "left").withColumn("n_sessions", F.col("_to") - F.col("_from")).drop("_from", "_to")
