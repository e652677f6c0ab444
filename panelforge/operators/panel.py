"""Rolling and cross-sectional panel features; every window has its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import exact_quantiles


def _w(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order)


def simple_return(df: DataFrame, by: list[str], order: str, col: str = "close", name: str = "ret") -> DataFrame:
    """x / previous x - 1; null without a previous value. Nulls aren't padded."""
    return df.withColumn(name, F.try_divide(F.col(col), F.lag(col).over(_w(by, order))) - 1)


def quality_flags(bars: DataFrame, by: list[str], order: str = "d") -> DataFrame:
    """bars with `quality`: 'zero volume', 'null close', 'large move', joined by |; no row goes."""
    move = F.abs(F.try_divide(F.col("close"), F.lag("close").over(_w(by, order))) - 1)
    flags = F.array_compact(F.array(F.when(F.col("volume") == 0, "zero volume"), F.when(F.col("close").isNull(), "null close"), F.when(move > 0.30, "large move")))
    return bars.withColumn("quality", F.array_join(flags, "|"))


def momentum(df: DataFrame, by: list[str], order: str, long: int = 252, skip: int = 21, col: str = "close") -> DataFrame:
    w = _w(by, order)
    return df.withColumn("momentum", F.try_divide(F.lag(col, skip).over(w), F.lag(col, long).over(w)) - 1)


def reversal(df: DataFrame, by: list[str], order: str, days: int = 21, col: str = "close") -> DataFrame:
    return df.withColumn("reversal", F.try_divide(F.col(col), F.lag(col, days).over(_w(by, order))) - 1)


def relative_volume(df: DataFrame, by: list[str], order: str, days: int = 20) -> DataFrame:
    """Today's volume over the mean of the `days` before; null with fewer or a mean that isn't positive."""
    w = _w(by, order).rowsBetween(-days, -1)
    mean = F.when(F.count("volume").over(w) >= days, F.avg("volume").over(w))
    return df.withColumn("relative_volume", F.when(mean > 0, F.col("volume") / mean))


def rolling_beta(df: DataFrame, by: list[str], order: str, ret: str, bench: str, rows: int = 252, least: int = 200) -> DataFrame:
    """`beta`: slope of ret on bench over the last rows - 1 returns; 1.0 with `beta_fallback` where pairs or variance lack.

    Sums over the rolling rows are differences of running totals, so the cost doesn't grow with `rows`.
    """
    run = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    both = F.col(ret).isNotNull() & F.col(bench).isNotNull()
    y, x = F.when(both, F.col(ret)).otherwise(0.0), F.when(both, F.col(bench)).otherwise(0.0)
    parts = {"_n": both.cast("double"), "_x": x, "_y": y, "_xy": x * y, "_xx": x * x}
    totals = df.withColumns({k: F.sum(c).over(run) for k, c in parts.items()})
    n, sx, sy, sxy, sxx = (F.col(k) - F.coalesce(F.lag(k, rows - 1).over(_w(by, order)), F.lit(0.0)) for k in parts)
    rolled = totals.withColumns({"_n2": n, "_cov": n * sxy - sx * sy, "_var": n * sxx - sx * sx})
    ok = (F.col("_n2") >= least) & (F.col("_var") > 1e-12)
    out = rolled.withColumns({"beta": F.when(ok, F.col("_cov") / F.col("_var")).otherwise(F.lit(1.0)), "beta_fallback": ~ok})
    return out.drop(*parts, "_n2", "_cov", "_var")


def window_beta(df: DataFrame, by: list[str], order: str, ret: str, bench: str, days: int = 70, least: int = 20) -> DataFrame:
    """`beta`: covariance over variance (ddof 1) within `days` calendar days; null where pairs or variance lack."""
    n = F.datediff(F.col(order), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*by).orderBy(n).rangeBetween(-days, 0)
    both = F.col(ret).isNotNull() & F.col(bench).isNotNull()
    y, x = F.when(both, F.col(ret)), F.when(both, F.col(bench))
    var = F.var_samp(x).over(w)
    return df.withColumn("beta", F.when((F.count(y).over(w) >= least) & (var > 0), F.covar_samp(y, x).over(w) / var))


def forward_label(df: DataFrame, by: list[str], order: str, ahead: int = 5, col: str = "close", bench: str = "bench", beta: str = "beta") -> DataFrame:
    """`y`: return over the next rows less beta times the benchmark's; rows without that future go."""
    w = _w(by, order)
    y = F.lead(col, ahead).over(w) / F.col(col) - 1 - F.col(beta) * (F.lead(bench, ahead).over(w) / F.col(bench) - 1)
    return df.withColumn("y", y).filter("y is not null")


def event_excess_return(events: DataFrame, bars: DataFrame, by: list[str], event_day: str, ahead: int = 5, beta: Column | None = None) -> DataFrame:
    """Events with `excess`: the asset's return from its first bar at or after the event over `ahead` more rows, less beta times the benchmark's (`bench` in bars)."""
    from .asof import asof_join

    w = _w(by, "d")
    later = bars.select(*by, "d", "close", "bench", F.lead("close", ahead).over(w).alias("_c"), F.lead("bench", ahead).over(w).alias("_b"))
    own = F.col("_c") / F.col("close") - 1 - (F.lit(1.0) if beta is None else beta) * (F.col("_b") / F.col("bench") - 1)
    ahead_bars = later.select(*by, F.col("d").alias("first_d"), own.alias("excess"))
    return asof_join(events, ahead_bars, by, event_day, "first_d", ["first_d", "excess"], direction="forward")


def ffill(df: DataFrame, by: list[str], order: str, col: str, limit: int = 3) -> DataFrame:
    """col with nulls filled from at most `limit` rows before."""
    return df.withColumn(col, F.last(col, ignorenulls=True).over(_w(by, order).rowsBetween(-limit, 0)))


def rolling_compound(df: DataFrame, by: list[str], order: str, col: str = "value", rows: int = 12) -> DataFrame:
    """`compound`: percentages compounded over `rows` rows, in percent; null with fewer."""
    w = _w(by, order).rowsBetween(-(rows - 1), 0)
    total = F.exp(F.sum(F.log1p(F.col(col) / 100)).over(w)) - 1
    return df.withColumn("compound", F.when(F.count(col).over(w) == rows, total * 100))


def date_ordinal(df: DataFrame, day: str = "d") -> DataFrame:
    """df with `ord`, the 0-based ordinal of its day among all its days."""
    from ..functions.timeutil import session_table

    return df.join(F.broadcast(session_table(df, day).select(F.col("d").alias(day), "ord")), day)


def impute_cross_section(df: DataFrame, features: list[str], day: str, train_end) -> DataFrame:
    """Nulls become the day's median, else the median of days up to train_end, else 0; `<f>_missing` tells."""
    train = df.filter(F.col(day) <= F.lit(train_end))
    known = {f: exact_quantiles(train, f, [0.5])[0] for f in features}
    w = Window.partitionBy(day)
    told = df.withColumns({f"{f}_missing": F.col(f).isNull() for f in features})
    return told.withColumns({f: F.coalesce(F.col(f), F.median(f).over(w), F.lit(known[f]).cast("double"), F.lit(0.0)) for f in features})


def zscore(df: DataFrame, by: list[str], col: str, name: str = "z", least: int = 3) -> DataFrame:
    """(x - mean) / (population deviation + 1e-12) within `by`; null where fewer than `least` values are."""
    w = Window.partitionBy(*by)
    z = (F.col(col) - F.avg(col).over(w)) / (F.stddev_pop(col).over(w) + 1e-12)
    return df.withColumn(name, F.when(F.count(col).over(w) >= least, z))


def rank_cross_section(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """`rank` by score, highest first, 1-based, no shared ranks."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), tie)))


def topk(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in `order`."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def sector_returns(bars: DataFrame, universe: DataFrame, at, days: int = 60) -> DataFrame:
    """Per sector: mean, median and number of the assets' last/first - 1 within the calendar days up to `at`."""
    inside = bars.filter((F.col("d") <= F.lit(at)) & (F.col("d") >= F.date_sub(F.lit(at).cast("date"), days)))
    own = inside.groupBy("asset").agg((F.max_by("close", "d") / F.min_by("close", "d") - 1).alias("r"), F.count("*").alias("points")).filter("points >= 2")
    return own.join(universe.select("asset", "sector"), "asset").groupBy("sector").agg(F.avg("r").alias("mean"), F.median("r").alias("median"), F.count("*").alias("n"))


def trailing_drawdown(df: DataFrame, by: list[str], order: str, col: str = "equity", rows: int = 21) -> DataFrame:
    """`trailing_dd`: fall from the highest of the last `rows` values; 0 while there are fewer."""
    w = _w(by, order).rowsBetween(-(rows - 1), 0)
    top = F.max(col).over(w)
    return df.withColumn("trailing_dd", F.when(F.count("*").over(w) >= rows, (top - F.col(col)) / top).otherwise(F.lit(0.0)))


def benchmark_returns(index: DataFrame, by: list[str], start, cutoff) -> DataFrame:
    """Daily returns of an index within [start, cutoff], without the first null."""
    cut = index.filter((F.col("d") >= F.lit(start)) & (F.col("d") <= F.lit(cutoff)))
    return simple_return(cut, by, "d").filter("ret is not null")


def cumulative(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """Running total, change from the first and from the previous row."""
    w = _w(by, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"running": F.sum(col).over(run), "vs_first": F.col(col) - F.first(col).over(run), "vs_previous": F.col(col) - F.lag(col).over(w)})


def macro_features(macro: DataFrame, rows: int = 21) -> DataFrame:
    """Level, change and relative change over `rows` observations, 0.0 with a shorter history."""
    w = Window.partitionBy("series").orderBy("ref_date")
    old = F.lag("value", rows).over(w)
    return macro.select("series", "ref_date", F.col("value").alias("level"), F.coalesce(F.col("value") - old, F.lit(0.0)).alias("change"), F.coalesce(F.try_divide(F.col("value"), old) - 1, F.lit(0.0)).alias("relative"))
