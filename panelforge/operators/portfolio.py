"""Portfolio tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .replicates import resampled_paths

#: A path is shallow that never falls so far from a top.
A_FLOOR = -0.20


def trade_pnl(df: DataFrame, rate: float = 0.004) -> DataFrame:
    """df with gross, costs (both legs) and net of each trade."""
    gross = (F.col("exit_px") - F.col("entry_px")) * F.col("qty")
    costs = rate * F.col("entry_px") * F.col("qty") + rate * F.col("exit_px") * F.col("qty")
    return df.withColumns({"gross": gross, "costs": costs, "net": gross - costs})


def select_entries(preds: DataFrame, held: DataFrame, slots: int = 3, per_sector: int = 2, least_score: float = 0.30, least_volume: float = 1.5) -> DataFrame:
    """(portfolio, d, asset, sector, rank): by rank, at most `per_sector` in a sector and `slots` in all, held ones counted; held assets aren't bought again.

    preds: (portfolio, d, asset, sector, rank, score, relative_volume); held: (portfolio, d, asset, sector).
    """
    key = ["portfolio", "d"]
    pool = preds.filter((F.col("score") > least_score) & (F.col("relative_volume") > least_volume)).join(held.select(*key, "asset"), [*key, "asset"], "left_anti")
    in_sector = held.groupBy(*key, "sector").agg(F.count("*").alias("_hs"))
    in_all = held.groupBy(*key).agg(F.count("*").alias("_ha"))
    p = pool.join(in_sector, [*key, "sector"], "left").join(in_all, key, "left")
    p = p.withColumn("_rs", F.row_number().over(Window.partitionBy(*key, "sector").orderBy("rank", "asset"))).filter(F.col("_rs") <= per_sector - F.coalesce("_hs", F.lit(0)))
    p = p.withColumn("_ra", F.row_number().over(Window.partitionBy(*key).orderBy("rank", "asset"))).filter(F.col("_ra") <= slots - F.coalesce("_ha", F.lit(0)))
    return p.select(*key, "asset", "sector", "rank")


def close_signals(positions: DataFrame, scores: DataFrame, bdays: int = 5, floor: float = -0.30) -> DataFrame:
    """positions (asset, entry_d, d) that close on d: 'deadline' from bdays business days on, else 'reversal' under the floor."""
    from ..functions.timeutil import busday_add

    j = positions.join(scores.select("asset", "d", "score"), ["asset", "d"], "left")
    why = F.when(busday_add(F.col("entry_d"), bdays) <= F.col("d"), "deadline").when(F.col("score") < floor, "reversal")
    return j.withColumn("reason", why).filter("reason is not null").drop("score")


def resolve_exits(entries: DataFrame, bars: DataFrame, sessions: DataFrame, stop: float = 0.92, take: float = 1.15, horizon: int = 5, from_entry: bool = False, reversals: DataFrame | None = None) -> DataFrame:
    """entries (trade_id, asset, entry_d, entry_px) with exit_d, exit_px and reason.

    The first session after entry whose low is at most stop * entry, or whose high is at least
    take * entry; stop wins on one day; days without a bar are skipped. Else the deadline: the
    open of the session after `horizon` sessions, the last close before where that has no bar,
    and the last known close at the end of the calendar. `from_entry` lets the entry's own
    session stop or take, as for entries at its open. `reversals` (trade_id, d) closes a trade
    at the open of the session after its first signal, if nothing else has by then; a deadline
    on that session wins. Sessions are joined by ordinals of a
    bounded horizon, not by range.
    """
    from .asof import asof_join

    s = sessions.select("d", "ord")
    at = entries.join(s.select(F.col("d").alias("entry_d"), F.col("ord").alias("_e")), "entry_d").withColumn("_by", F.lit("deadline"))
    at = at.withColumn("_due", F.col("_e") + horizon + 1)
    if reversals is not None:
        signals = reversals.join(s, "d").join(at.select("trade_id", "_e"), "trade_id").filter(F.col("ord") > F.col("_e")).groupBy("trade_id").agg((F.min("ord") + 1).alias("_r"))
        at = at.join(signals, "trade_id", "left").withColumn("_by", F.when(F.col("_r") < F.col("_due"), "reversal").otherwise("deadline")).withColumn("_due", F.least("_due", "_r")).drop("_r")
    first_step = F.col("_e") + (0 if from_entry else 1)
    steps = at.select("trade_id", "asset", "entry_px", F.explode(F.sequence(first_step, F.greatest(first_step, F.col("_due") - 1))).alias("ord"), "_due").filter("ord < _due").drop("_due").join(s, "ord")
    seen = steps.join(bars.select("asset", "d", "low", "high"), ["asset", "d"])
    hit = seen.withColumn("_why", F.when(F.col("low") <= stop * F.col("entry_px"), F.struct(F.lit(0).alias("p"), F.lit("stop").alias("reason"), (stop * F.col("entry_px")).alias("px"))).when(F.col("high") >= take * F.col("entry_px"), F.struct(F.lit(1).alias("p"), F.lit("take").alias("reason"), (take * F.col("entry_px")).alias("px"))))
    first = hit.filter("_why is not null").groupBy("trade_id").agg(F.min_by("_why", "d").alias("_why"), F.min("d").alias("_hit_d"))
    last = s.agg(F.max("ord").alias("_last"))
    due = at.crossJoin(F.broadcast(last)).withColumn("ord", F.least("_due", "_last")).join(s.select("ord", F.col("d").alias("_due_d")), "ord").withColumn("_open_ended", F.col("_due") > F.col("_last"))
    marked = asof_join(due, bars.select("asset", F.col("d").alias("_bar_d"), "open", "close"), ["asset"], "_due_d", "_bar_d", ["_bar_d", "open", "close"])
    px = F.when(F.col("_open_ended"), F.coalesce("close", "entry_px")).when(F.col("_bar_d") == F.col("_due_d"), F.col("open")).otherwise(F.coalesce("close", "entry_px"))
    j = marked.join(first, "trade_id", "left")
    return j.select(
        "trade_id", "asset", "entry_d", "entry_px", F.coalesce("_hit_d", "_due_d").alias("exit_d"), F.coalesce("_why.px", px).alias("exit_px"),
        F.coalesce("_why.reason", F.when(F.col("_open_ended"), F.lit("end of window")).otherwise(F.col("_by"))).alias("reason"),
    )


def size_orders(orders: DataFrame, share: float = 0.15) -> DataFrame:
    """orders (equity, open) with `qty` = floor(share * equity / open) and `skipped`, why it is 0."""
    bad = F.col("open").isNull() | (F.col("open") <= 0)
    qty = F.when(bad, F.lit(0)).otherwise(F.floor(share * F.col("equity") / F.col("open"))).cast("bigint")
    return orders.withColumn("qty", qty).withColumn("skipped", F.when(bad, "no price").when(F.col("qty") == 0, "too small"))


def equity_curve(trades: DataFrame, bars: DataFrame, days: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(portfolio, d, equity): capital, money in and out up to d, and open positions at their last close (entry price without any).

    trades: (portfolio, asset, entry_d, exit_d, qty, entry_px, exit_px, costs). Positions are
    running sums of what came in and went out, so no trade is repeated for each day it is open.
    """
    from .asof import asof_join

    put = F.col("qty") * F.col("entry_px")
    into = trades.select("portfolio", "asset", F.col("entry_d").alias("d"), F.col("qty").alias("dq"), put.alias("dcost"), (-put).alias("x"))
    out = trades.select("portfolio", "asset", F.col("exit_d").alias("d"), (-F.col("qty")).alias("dq"), (-put).alias("dcost"), (F.col("qty") * F.col("exit_px") - F.col("costs")).alias("x"))
    grid = trades.select("portfolio", "asset").distinct().join(F.broadcast(days.select("d"))).withColumns({c: F.lit(0.0) for c in ("dq", "dcost", "x")})
    daily = grid.unionByName(into).unionByName(out).groupBy("portfolio", "asset", "d").agg(*(F.sum(c).alias(c) for c in ("dq", "dcost", "x")))
    run = Window.partitionBy("portfolio", "asset").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    held = daily.select("portfolio", "asset", "d", *(F.sum(c).over(run).alias(c) for c in ("dq", "dcost", "x"))).join(F.broadcast(days.select("d")), "d", "left_semi")
    marked = asof_join(held, bars.select("asset", F.col("d").alias("_bar_d"), "close"), ["asset"], "d", "_bar_d", ["close"])
    worth = F.when(F.col("close").isNull(), F.col("dcost")).otherwise(F.col("dq") * F.col("close"))
    return marked.groupBy("portfolio", "d").agg((capital + F.sum(F.col("x") + worth)).alias("equity"))


def cooldown_gate(equity: DataFrame, by: list[str], limit: float = 0.10, bdays: int = 5) -> DataFrame:
    """(by..., d, blocked): a fall of more than `limit` from the trailing top blocks bdays business days; while blocked nothing triggers anew.

    The state is one date a portfolio, carried over its days in their order; a group has a row
    for each day of the calendar.
    """
    from ..functions.timeutil import busday_add
    from .panel import trailing_drawdown

    t = trailing_drawdown(equity, by, "d").select(*by, "d", busday_add(F.col("d"), bdays).alias("_until"), (F.col("trailing_dd") > limit).alias("_hit"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        until, blocked = None, []
        for day, after, hit in zip(pdf["d"], pdf["_until"], pdf["_hit"], strict=True):
            if hit and (until is None or day >= until):
                until = after
            blocked.append(until is not None and day < until)
        return pdf[[*by, "d"]].assign(blocked=blocked)

    kinds = ", ".join(f"{c} {t.schema[c].dataType.simpleString()}" for c in [*by, "d"])
    return t.groupBy(*by).applyInPandas(fold, f"{kinds}, blocked boolean")


def dq_events(df: DataFrame, reasons: str, day: str, asset: str) -> DataFrame:
    """(kind, d, asset): one row per reason."""
    return df.select(F.explode(reasons).alias("kind"), F.col(day).alias("d"), F.col(asset).alias("asset"))


def attribution(trades: DataFrame, by: list[str], key: str) -> DataFrame:
    """Per key: trades, total, mean, hit rate, share of the portfolio's total (null if that is 0)."""
    g = trades.groupBy(*by, key).agg(F.count("*").alias("n"), F.sum("net").alias("total"), F.avg("net").alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"))
    return g.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy(*by))))


def trade_stats(trades: DataFrame, by: list[str]) -> DataFrame:
    """Trades, winners, losers, hit rate, payoff, profit factor, costs; +inf without losers, 0 without winners, null without either."""
    win, lose = F.col("net") > 0, F.col("net") < 0
    g = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(win).alias("winners"), F.count_if(lose).alias("losers"), F.sum("costs").alias("costs"),
        F.sum(F.when(win, F.col("net"))).alias("_w"), (-F.sum(F.when(lose, F.col("net")))).alias("_l"), F.avg(F.when(win, F.col("net"))).alias("_aw"), (-F.avg(F.when(lose, F.col("net")))).alias("_al"),
    )
    over = lambda a, b: F.when((F.col("winners") > 0) & (F.col("losers") > 0), F.col(a) / F.col(b)).when(F.col("winners") > 0, F.lit(float("inf"))).when(F.col("losers") > 0, F.lit(0.0))
    return g.select(*by, "n", "winners", "losers", (F.col("winners") / F.col("n")).alias("hit_rate"), over("_aw", "_al").alias("payoff"), over("_w", "_l").alias("profit_factor"), "costs")


def risk_stats(equity: DataFrame, by: list[str], rf: float = 0.0) -> DataFrame:
    """(by..., n, vol, sharpe, sortino) of daily returns over 252 sessions; the downside deviation is over all returns."""
    from .panel import simple_return

    daily = (1 + rf) ** (1 / 252) - 1
    r = simple_return(equity, by, "d", "equity").filter("ret is not null")
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("ret").alias("_sd"), F.avg(F.col("ret") - daily).alias("_x"), F.sqrt(F.avg(F.pow(F.least(F.col("ret") - daily, F.lit(0.0)), F.lit(2)))).alias("_down"))
    year = 252**0.5
    few = F.col("n") < 2
    sharpe = F.when(few | (F.col("_sd") == 0), 0.0).otherwise(F.col("_x") / F.col("_sd") * year)
    sortino = F.when(few, 0.0).when(F.col("_down") == 0, F.lit(float("inf"))).otherwise(F.col("_x") / F.col("_down") * year)
    return g.select(*by, "n", F.when(few, 0.0).otherwise(F.col("_sd") * year).alias("vol"), sharpe.alias("sharpe"), sortino.alias("sortino"))


def drawdown_stats(equity: DataFrame, by: list[str]) -> DataFrame:
    """(by..., max_drawdown, length, recovery): the deepest fall from a running top, rows from the last time at the top to the trough, rows from there to the first value at the top again (null if never)."""
    w = Window.partitionBy(*by).orderBy("d")
    e = equity.withColumns({"_i": F.row_number().over(w), "_top": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    e = e.withColumns({"_dd": (F.col("equity") - F.col("_top")) / F.col("_top"), "_at": F.max(F.when(F.col("equity") == F.col("_top"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    worst = e.groupBy(*by).agg(F.min("_dd").alias("max_drawdown"), F.min_by(F.struct("_i", "_top", "_at"), F.struct("_dd", "_i")).alias("_t"))
    again = e.select(*by, "_i", "equity").join(worst, by).filter((F.col("_i") > F.col("_t._i")) & (F.col("equity") >= F.col("_t._top"))).groupBy(*by).agg(F.min("_i").alias("_back"))
    j = worst.join(again, by, "left")
    fell = F.col("max_drawdown") < 0
    return j.select(*by, "max_drawdown", F.when(fell, F.col("_t._i") - F.col("_t._at")).otherwise(0).alias("length"), F.when(fell, F.col("_back") - F.col("_t._i")).alias("recovery"))


def return_stats(equity: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, total_return, annual_return) from the first to the last value; null without any return."""
    g = equity.groupBy(*by).agg((F.count("*") - 1).alias("n"), (F.max_by("equity", "d") / F.min_by("equity", "d") - 1).alias("total_return"))
    return g.withColumn("annual_return", F.when(F.col("n") > 0, F.pow(1 + F.col("total_return"), 252 / F.col("n")) - 1))


def risk_free(windows: DataFrame, macro: DataFrame, series: str, override: float | None = None) -> DataFrame:
    """windows (start, stop) with `rate` and `label`: the override, else the series' mean in the window / 100, else 0."""
    m = macro.filter(F.col("series") == series).select("ref_date", "value")
    g = windows.join(m, (F.col("ref_date") >= F.col("start")) & (F.col("ref_date") <= F.col("stop")), "left").groupBy(*windows.columns).agg((F.avg("value") / 100).alias("_m"))
    given = F.lit(override).cast("double")
    label = F.when(given.isNotNull(), "override").when(F.col("_m").isNotNull(), "series").otherwise("none")
    return g.select(*windows.columns, F.coalesce(given, "_m", F.lit(0.0)).alias("rate"), label.alias("label"))


def bootstrap_trades(trades: DataFrame, by: list[str], order: str, replicates: int = 10_000, seed: int = 42, capital: float = 100_000.0) -> DataFrame:
    """(by..., rep, ret, max_drawdown) of as many trades as a group has, drawn with replacement; without trades an error."""
    return resampled_paths(trades, by, order, replicates, seed, capital, permute=False)


def permute_trades(trades: DataFrame, by: list[str], order: str, replicates: int = 10_000, seed: int = 42, capital: float = 100_000.0) -> DataFrame:
    """(by..., rep, ret, max_drawdown) of a group's trades in random orders; the return is always the same. Under two trades an error."""
    return resampled_paths(trades, by, order, replicates, seed, capital, permute=True)


def replicate_trades(trades: DataFrame, by: list[str], order: str, replicates: int = 10_000, seed: int = 42, capital: float = 100_000.0, floor: float | None = None) -> DataFrame:
    """(by..., kind, rep, ret, max_drawdown): the rows of bootstrap_trades and permute_trades from one pass over the words that both go by. Under two trades an error.

    With `floor`, `shallow` in the place of max_drawdown: whether that is above the floor, which most paths of falling amounts tell in their first trades.
    """
    return resampled_paths(trades, by, order, replicates, seed, capital, permute=None, floor=floor)


def distribution_summary(paths: DataFrame, by: list[str], bench: float | None = None) -> DataFrame:
    """Percentiles, mean and deviation (ddof 0) of returns and shares of good replicates; paths tell max_drawdown, or `shallow` for A_FLOOR."""
    shallow = F.col("shallow") if "shallow" in paths.columns else F.col("max_drawdown") > A_FLOOR
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    p = F.percentile("ret", F.array(*map(F.lit, q)))
    g = paths.groupBy(*by).agg(p.alias("_p"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.avg((F.col("ret") > 0).cast("double")).alias("p_gain"), F.avg((F.col("ret") > F.lit(bench).cast("double")).cast("double")).alias("p_beats"), F.avg(shallow.cast("double")).alias("p_shallow"))
    return g.select(*by, *(F.col("_p")[i].alias(f"p{int(x * 100):02d}") for i, x in enumerate(q)), "mean", "sd", "p_gain", "p_beats", "p_shallow")
