"""As-of joins by union and fill, in slices of time: linear in both sides, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import busday_count
from ..sources.shared import written
from .ranks import cut_points, part_of, parts_of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    value_cols: list[str] | None = None,
    offset_days: int = 0,
    direction: str = "backward",
    strict: bool = False,
    tie: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """left with the columns of the last right row whose time is at most left's (minus offset_days).

    `direction="forward"` takes the first right row at or after it; `strict` excludes equal
    times. Of right rows at one time the greatest `tie` counts. Left rows without a match, a
    null time or a null key get nulls; repeated left rows stay.

    With `slices`, a key's rows are cut at that many quantiles of all times, and each slice is
    told the last right row before it (the first after it), so a key with a third of all rows is
    as many tasks' work. Without `by` the different times of left are joined so, once each: they,
    right and what is found are written, and left's own rows only look their time up.
    """
    cols = value_cols or [c for c in right.columns if c not in by]
    back = direction == "backward"
    at = F.date_sub(left[left_time].cast("date"), offset_days) if offset_days else left[left_time]
    if not by and not slices:
        times = written(left.select(at.alias("_asked_t")).filter("_asked_t is not null").distinct())
        told = asof_join(times, written(right), [], "_asked_t", right_time, cols, direction=direction, strict=strict, tie=tie, slices=parts_of(left))
        told = written(told.select("_asked_t", F.struct(*cols).alias("_told")))
        met = left.withColumn("_asked_t", at).join(told, "_asked_t", "left")
        return met.select(*(F.col(f"`{c}`") for c in left.columns if c not in cols), *(F.col(f"_told.`{c}`").alias(c) for c in cols))
    lt = left.withColumn("_t", at)
    packed = F.struct(*(right[c] for c in cols))
    rt = right.filter(right[right_time].isNotNull()).select(*by, right[right_time].alias("_t"), packed.alias("_v"), (right[tie] if tie else F.lit(0)).alias("_tie"))
    keys = list(by)
    if slices:
        cuts = cut_points(lt.select("_t").unionByName(rt.select("_t")), F.col("_t"), slices)
        lt, rt = (x.withColumn("_slice", part_of(F.col("_t"), cuts)) for x in (lt, rt))
        # a row for each slice of a key on either side: the key's slices are fewer than the cuts
        ends = rt.groupBy(*by, "_slice", "_t").agg(F.max_by(F.struct("_t", "_v", "_tie"), "_tie").alias("_e"))
        ends = ends.groupBy(*by, "_slice").agg((F.max_by if back else F.min_by)("_e", "_t").alias("_e"))
        asked = lt.groupBy(*by, "_slice").agg(F.first(F.lit(True)).alias("_asked"))
        told = asked.unionByName(ends, allowMissingColumns=True).groupBy(*by, "_slice").agg(F.first("_asked", True).alias("_asked"), F.first("_e", True).alias("_e"))
        over = Window.partitionBy(*by).orderBy(F.col("_slice") if back else F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = told.withColumn("_e", F.last("_e", True).over(over)).filter("_asked and _e is not null")
        rt = rt.select(*by, "_slice", "_t", "_v", "_tie").unionByName(carried.select(*by, "_slice", "_e._t", "_e._v", "_e._tie"))
        keys.append("_slice")
    left_cols = [c for c in left.columns]
    rows = lt.withColumn("_l", F.struct(*(left[c] for c in left_cols))).select(*keys, "_t", "_l").withColumn("_right", F.lit(False)).unionByName(rt.withColumn("_right", F.lit(True)), allowMissingColumns=True)
    # at equal times right rows come first, unless only strictly earlier (later) ones count
    order = [F.col("_t").asc() if back else F.col("_t").desc(), F.col("_right").asc() if strict else F.col("_right").desc(), F.col("_tie").asc()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_m", F.last(F.when(F.col("_right"), F.col("_v")), ignorenulls=True).over(w)).filter(~F.col("_right"))
    match = F.when(F.col("_t").isNotNull(), F.col("_m"))
    return found.select(*(F.col(f"_l.`{c}`") for c in left_cols if c not in cols), *(match[c].alias(c) for c in cols))


def asof_filing(points: DataFrame, headers: DataFrame, by: list[str], time: str, fallback_days: int = 45, years: int = 3) -> DataFrame:
    """Points with the filing last received by then: (ref_date, received_on, version) or nulls.

    A missing receipt is ref_date + fallback_days; of one receipt day the later ref_date
    counts; filings of calendar years before year(time) - years + 1 are out.
    """
    h = headers.withColumn("received_on", F.coalesce("received_on", F.date_add("ref_date", fallback_days)))
    j = asof_join(points, h, by, time, "received_on", ["ref_date", "received_on", "version"], tie="ref_date")
    fresh = F.year("ref_date") > F.year(time) - years
    return j.withColumns({c: F.when(fresh, F.col(c)) for c in ("ref_date", "received_on", "version")})


def asof_shares(points: DataFrame, shares: DataFrame, by: list[str], time: str) -> DataFrame:
    """Points with shares outstanding: the last count of this or last year, less treasury, 0 at least."""
    j = asof_join(points, shares, by, time, "ref_date", ["ref_date", "total", "treasury"])
    fresh = F.year("ref_date") >= F.year(time) - 1
    net = F.greatest(F.lit(0.0), F.coalesce(F.col("total"), F.lit(0.0)) - F.coalesce(F.col("treasury"), F.lit(0.0)))
    return j.withColumn("outstanding", F.when(fresh, net)).drop("ref_date", "total", "treasury")


def asof_earnings(points: DataFrame, earnings: DataFrame, by: list[str], time: str, max_bdays: int | None = None) -> DataFrame:
    """Points with the last earnings that have a realised value, optionally at most max_bdays business days old."""
    cols = [c for c in earnings.columns if c not in by]
    j = asof_join(points, earnings.filter("realized is not null"), by, time, "announced_on", cols)
    if max_bdays is None:
        return j
    near = busday_count(F.col("announced_on"), F.col(time)) <= max_bdays
    return j.withColumns({c: F.when(near, F.col(c)) for c in cols})


def days_since(points: DataFrame, reports: DataFrame, by: list[str], time: str, reported: str, slices: int | None = None) -> DataFrame:
    """Points with `days`, the calendar days since the last report by then; null without one."""
    j = asof_join(points, reports.select(*by, F.col(reported).alias("_reported")), by, time, "_reported", ["_reported"], slices=slices)
    return j.withColumn("days", F.datediff(time, "_reported")).drop("_reported")


def yoy_growth(points: DataFrame, values: DataFrame, by: list[str], time: str, told: str, value: str, slices: int | None = None) -> DataFrame:
    """Points with `growth`: (last value by then - the one of 365 days before) / its size; null without both, or where the old one is 0."""
    known = values.filter(F.col(value).isNotNull())
    j = asof_join(points, known.select(*by, told, F.col(value).alias("_new")), by, time, told, ["_new"], slices=slices)
    j = asof_join(j, known.select(*by, told, F.col(value).alias("_old")), by, time, told, ["_old"], offset_days=365, slices=slices)
    return j.withColumn("growth", F.try_divide(F.col("_new") - F.col("_old"), F.abs("_old"))).drop("_new", "_old")


def align_benchmark(bars: DataFrame, index: DataFrame, time: str = "d", value: str = "close") -> DataFrame:
    """Bars with `bench`, the benchmark's last value by each bar's day."""
    return asof_join(bars, index.select(F.col(time).alias("_bench_d"), F.col(value).alias("bench")), [], time, "_bench_d", ["bench"])


def align_inner(a: DataFrame, b: DataFrame, on: list[str], a_col: str, b_col: str) -> DataFrame:
    """Days that both series have, without nulls."""
    return a.join(b, on).filter(F.col(a_col).isNotNull() & F.col(b_col).isNotNull())


def bar_on(points: DataFrame, bars: DataFrame, by: list[str], time: str = "d", order: str | None = None) -> DataFrame:
    """Points with the close of exactly their day, else null; of repeated bars the last by `order`, else the one of greatest close: a table has no order of its own."""
    last = F.max_by("close", F.struct(*([order] if order else []), "close"))
    one = bars.groupBy(*by, time).agg(last.alias("close"))
    return points.join(one, [*by, time], "left")


def mark_price(points: DataFrame, bars: DataFrame, by: list[str], time: str, entry: str) -> DataFrame:
    """Points with `mark`: the close of the day, else the last one before, else the entry price; `carried` tells which."""
    j = asof_join(points, bars.select(*by, F.col("d").alias("_bar_d"), "close"), by, time, "_bar_d", ["_bar_d", "close"])
    carried: Column = F.when(F.col("close").isNull(), "entry price").when(F.col("_bar_d") < F.col(time), "earlier close")
    return j.withColumn("mark", F.coalesce("close", entry)).withColumn("carried", carried).drop("_bar_d", "close")


def macro_asof(points: DataFrame, macro: DataFrame, time: str, lag_days: int = 11) -> DataFrame:
    """Points x series: each monthly value visible from its month's end plus lag_days."""
    m = macro.withColumn("available_on", F.date_add(F.last_day("ref_date"), lag_days))
    names = macro.select("series").distinct()
    return asof_join(points.join(F.broadcast(names)), m, ["series"], time, "available_on", ["value"])
