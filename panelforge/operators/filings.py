"""Statement items, ratios and scoring responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..functions.timeutil import busday_count


def pick_account(lines: DataFrame, keys: list[str], codes: list[str], description: str, scale: float = 1000.0) -> DataFrame:
    """(keys..., value): the first code in the list that has a value, else the first account whose description matches, times scale."""
    order = F.array_position(F.array(*map(F.lit, codes)), F.col("account"))
    by_code = F.min_by("value", order)
    coded = lines.filter(F.col("account").isin(codes) & F.col("value").isNotNull()).groupBy(*keys).agg(by_code.alias("_c"))
    described = lines.filter(F.col("account_desc").rlike(f"(?i){description}") & F.col("value").isNotNull()).groupBy(*keys).agg(F.min_by("value", "account").alias("_d"))
    every = lines.select(*keys).distinct()
    return every.join(coded, keys, "left").join(described, keys, "left").select(*keys, (F.coalesce("_c", "_d") * scale).alias("value"))


def ttm(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., ref_date, value, reason): year-to-date plus last year's rest; an annual figure is itself; a missing piece gives null and the reason.

    lines: (keys..., ref_date, value), one row each, year-to-date values.
    """
    year_ago = lines.select(*keys, F.last_day(F.add_months("ref_date", 12)).alias("ref_date"), F.col("value").alias("_before"))
    annual = lines.filter(F.month("ref_date") == 12).select(*keys, (F.year("ref_date") + 1).alias("_y"), F.col("value").alias("_annual"))
    j = lines.withColumn("_y", F.year("ref_date")).join(year_ago, [*keys, "ref_date"], "left").join(annual, [*keys, "_y"], "left")
    whole = F.month("ref_date") == 12
    out = F.when(whole, F.col("value")).otherwise(F.col("value") + (F.col("_annual") - F.col("_before")))
    reason = F.when(whole, None).when(F.col("_annual").isNull(), "no prior annual").when(F.col("_before").isNull(), "no prior year to date")
    return j.select(*keys, "ref_date", out.alias("value"), reason.alias("reason"))


def ttm_known(points: DataFrame, lines: DataFrame, keys: list[str], time: str, fallback_days: int = 45, slices: int | None = None) -> DataFrame:
    """points (keys..., time) with (ref_date, value, reason): trailing twelve months of what was received by then.

    lines: (keys..., ref_date, received_on, version, value), year-to-date values, each version with
    its own receipt. The last filing received by the time counts, of one day the later ref_date,
    then the later version. Its year of ago and the annual before are likewise those received by
    the time, so a later receipt never changes an earlier value. A missing receipt is ref_date +
    fallback_days, but an annual without one never counts for others.
    """
    from .asof import asof_join

    seen = lines.select(*keys, "ref_date", "version", "value", "received_on", F.coalesce("received_on", F.date_add("ref_date", fallback_days)).alias("_seen"))
    filed = seen.select(*keys, "_seen", "ref_date", F.col("value").alias("_now"), F.struct("ref_date", "version").alias("_k"))
    j = asof_join(points, filed, keys, time, "_seen", ["ref_date", "_now"], tie="_k", slices=slices)
    j = j.withColumns({"_annual_on": F.make_date(F.year("ref_date") - 1, F.lit(12), F.lit(31)), "_year_ago": F.last_day(F.add_months("ref_date", -12))})
    annual = seen.filter(F.month("ref_date") == 12).select(*keys, F.col("ref_date").alias("_annual_on"), "received_on", "version", F.col("value").alias("_annual"))
    before = seen.select(*keys, F.col("ref_date").alias("_year_ago"), "_seen", "version", F.col("value").alias("_before"))
    j = asof_join(j, annual, [*keys, "_annual_on"], time, "received_on", ["_annual"], tie="version", slices=slices)
    j = asof_join(j, before, [*keys, "_year_ago"], time, "_seen", ["_before"], tie="version", slices=slices)
    whole = F.month("ref_date") == 12
    reason = F.when(F.col("ref_date").isNull(), "no filing").when(F.col("_now").isNull(), "no year to date").when(whole, None).when(F.col("_before").isNull(), "no prior year to date").when(F.col("_annual").isNull(), "no prior annual")
    value = F.when(whole, F.col("_now")).otherwise(F.col("_now") + (F.col("_annual") - F.col("_before")))
    return j.select(*points.columns, "ref_date", value.alias("value"), reason.alias("reason"))


def extract_fundamentals(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key from long items (item, value): cash and debt are sums whose all-zero total is null; ebitda is ebit plus |d&a|, else ebit with a warning."""
    v = lambda *names: F.sum(F.when(F.col("item").isin(list(names)), F.col("value")))
    g = items.groupBy(*keys).agg(
        v("revenue").alias("revenue"), v("profit").alias("profit"), v("equity").alias("equity"), v("ebit").alias("ebit"), v("depreciation").alias("_da"),
        F.nullif(F.coalesce(v("cash", "investments"), F.lit(0.0)), F.lit(0.0)).alias("cash"), F.nullif(F.coalesce(v("debt short", "debt long"), F.lit(0.0)), F.lit(0.0)).alias("debt"),
    )
    ebitda = F.when(F.col("_da").isNull(), F.col("ebit")).otherwise(F.col("ebit") + F.abs("_da"))
    warn = F.array_compact(F.array(F.when(F.col("_da").isNull(), "ebitda without depreciation"), F.when(F.col("cash").isNull(), "no cash"), F.when(F.col("debt").isNull(), "no debt")))
    return g.withColumns({"ebitda": ebitda, "net_debt": F.col("debt") - F.col("cash"), "warnings": warn}).drop("_da")


def valuation_ratios(df: DataFrame) -> DataFrame:
    """df (profit, revenue, equity, net_debt, ebitda, market_cap) with margin, roe, leverage, pe (only for a profit) and pb (only for positive equity)."""
    over = lambda a, b: F.when(F.col(b).isNotNull() & (F.col(b) != 0), F.col(a) / F.col(b))
    notes = F.array_compact(F.array(F.when(F.coalesce(F.col("profit") <= 0, F.lit(True)), "no pe"), F.when(F.coalesce(F.col("equity") <= 0, F.lit(True)), "no pb")))
    return df.withColumns({"margin": over("profit", "revenue"), "roe": over("profit", "equity"), "leverage": over("net_debt", "ebitda"), "pe": F.when(F.col("profit") > 0, F.col("market_cap") / F.col("profit")), "pb": F.when(F.col("equity") > 0, F.col("market_cap") / F.col("equity")), "notes": notes})


def parse_score_response(df: DataFrame, col: str) -> DataFrame:
    """df with the clamped fields of a JSON scoring response and `warnings`; what is no JSON object is `rejected`."""
    kind = "struct<score_total: string, score_news: string, score_macro: string, score_sector: string, score_fundamentals: string, confidence: string, reason: string>"
    j = df.withColumn("_j", F.from_json(col, kind))
    fields = {c: clamp(F.col(f"_j.{c}"), -1, 1) for c in ("score_total", "score_news", "score_macro", "score_sector", "score_fundamentals")}
    fields |= {"confidence": clamp(F.col("_j.confidence"), 0, 1), "reason": F.col("_j.reason"), "rejected": F.coalesce(F.col("_j.score_total").isNull() & F.col("_j.confidence").isNull(), F.lit(True)) | F.col("_j").isNull()}
    out = j.withColumns(fields)
    far = F.abs(F.col("score_total") - F.col("score_news")) > 0.25
    return out.withColumn("warnings", F.array_compact(F.array(F.when(far, "total far from news")))).drop("_j")


def neutral_fill(points: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Points with their score, or zeros where there is none; has_event tells whether there was news (n_news > 0)."""
    j = points.join(scores, keys, "left")
    return j.withColumns({"score": F.coalesce("score", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.0)), "has_event": F.coalesce(F.col("n_news") > 0, F.lit(False))})


def earnings_block(day: Column, announced: Column, realized: Column, comparable: Column, estimated: Column, move: Column) -> Column:
    """Lines about the last earnings; the reaction only from one business day on; null without a realised or comparable value."""
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), F.format_number(c, 2)))
    reaction = F.when(busday_count(announced, day) >= 1, line("move %", move))
    text = F.concat_ws("\n", F.concat(F.lit("announced: "), announced.cast("string")), line("realized", realized), line("comparable", comparable), line("estimated", estimated), reaction)
    return F.when(realized.isNotNull() | comparable.isNotNull(), text)


FUNDAMENTAL_FEATURES = ["days_since_report", "profit_growth", "pe", "pb", "roe", "margin", "leverage"]
MACRO_FEATURES = ["rate_level", "rate_change", "fx_change"]
PANEL_FEATURES = ["momentum", "reversal", *FUNDAMENTAL_FEATURES, "relative_volume", *MACRO_FEATURES, "score", "confidence", "n_news"]
PANEL_FLAGS = ["beta_fallback", "fundamentals_missing", "score_degraded"]


def build_panel(
    bars: DataFrame,
    index: DataFrame,
    universe: DataFrame,
    scores: DataFrame,
    long: int = 252,
    skip: int = 21,
    beta_rows: int = 252,
    beta_least: int = 200,
    ahead: int = 5,
    fundamentals: DataFrame | None = None,
    macro: DataFrame | None = None,
    rate_series: str = "rate",
    fx_series: str = "fx",
) -> DataFrame:
    """Days x active assets with label, PANEL_FEATURES, PANEL_FLAGS and has_event.

    fundamentals: (asset, received_on, profit, pe, pb, roe, margin, leverage), of which each day
    takes the last received by then, and the profit of 365 days before; without them these
    features are null. macro: (series, ref_date, available_on, value), whose features are
    those of the last observation available; changes are 0 with a short history. scores:
    (asset, d, score, has_event), also with confidence and n_news; a missing score is 0
    without an event. Rows without a label go. One shuffle by asset serves the windows and
    as-of joins, one by asset and day the scores.
    """
    from . import panel as p
    from .asof import asof_join
    from .universe import _member

    one = p.simple_return(index.withColumn("_one", F.lit(0)), ["_one"], "d", name="bench_ret").select("d", F.col("close").alias("bench"), "bench_ret")
    r = p.simple_return(bars, ["asset"], "d").join(one, "d")
    f = p.relative_volume(p.reversal(p.momentum(p.rolling_beta(r, ["asset"], "d", "ret", "bench_ret", beta_rows, beta_least), ["asset"], "d", long, skip), ["asset"], "d", skip), ["asset"], "d")
    y = p.forward_label(f, ["asset"], "d", ahead).join(universe.select("asset", "sector", "valid_from", "valid_to"), "asset").filter(_member(F.col("d")))
    given = {c: F.col(c) if c in scores.columns else F.lit(None) for c in ("confidence", "n_news")}
    s = scores.select("asset", "d", "score", "has_event", *(e.cast("double").alias(c) for c, e in given.items()))
    j = y.join(s, ["asset", "d"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("score", "confidence", "n_news")} | {"has_event": F.coalesce("has_event", F.lit(False))})
    j = j.withColumn("score_degraded", F.col("has_event") & (F.col("confidence") == 0))
    j = j.select("asset", "d", "sector", "momentum", "reversal", "relative_volume", "beta", "beta_fallback", "score", "confidence", "n_news", "has_event", "score_degraded", "y")

    items = ["profit", "pe", "pb", "roe", "margin", "leverage"]
    if fundamentals is None:
        j = j.withColumns({c: F.lit(None).cast("double") for c in FUNDAMENTAL_FEATURES})
    else:
        j = asof_join(j, fundamentals, ["asset"], "d", "received_on", ["received_on", *items])
        before = fundamentals.select("asset", F.col("received_on").alias("_before_on"), F.col("profit").alias("_before"))
        j = asof_join(j, before, ["asset"], "d", "_before_on", ["_before"], offset_days=365)
        growth = F.try_divide(F.col("profit") - F.col("_before"), F.abs("_before"))
        j = j.withColumns({"days_since_report": F.datediff("d", "received_on").cast("double"), "profit_growth": growth}).drop("received_on", "profit", "_before")
    j = j.withColumn("fundamentals_missing", F.col("pe").isNull() | F.col("pb").isNull())

    if macro is None:
        j = j.withColumns({c: F.lit(None).cast("double") for c in MACRO_FEATURES})
    else:
        known = p.macro_features(macro).join(macro.select("series", "ref_date", "available_on"), ["series", "ref_date"])
        days = index.select("d").distinct()
        for series, names in ((rate_series, {"level": "rate_level", "change": "rate_change"}), (fx_series, {"relative": "fx_change"})):
            own = known.filter(F.col("series") == series).select("available_on", *(F.col(old).alias(new) for old, new in names.items()))
            days = asof_join(days, own, [], "d", "available_on", list(names.values()), tie="available_on")
        j = j.join(days.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("rate_change", "fx_change")}), "d", "left")
    return j.select("asset", "d", "sector", *PANEL_FEATURES, "beta", *PANEL_FLAGS, "has_event", "y")


def build_context(points: DataFrame, news: DataFrame, fundamentals: DataFrame, macro: DataFrame, bars: DataFrame, earnings: DataFrame, series: list[str], most: int = 8, days: int = 60, hidden: bool = False) -> DataFrame:
    """points (asset, d, sector, ...) with `context`: what was known of the asset on that day, as JSON, and after a blank line the block of its last earnings.

    The `most` best news of the day by weight, time and id (news: asset, d, news_id, title, body,
    source, source_weight, published_at); the last fundamentals received (asset, received_on,
    pe, pb, roe, margin, leverage); the last available value of each of `series` (macro: series,
    available_on, value); the mean of the sector's returns over `days` calendar days at its last
    session; earnings: (asset, announced_on, realized, comparable, estimated, move_pct). What is
    missing isn't in the JSON. `hidden` leaves the asset and all but the news out. Only lists of
    at most `most` news are gathered.
    """
    from .asof import asof_join
    from .panel import topk

    top = topk(news, ["asset", "d"], [F.desc("source_weight"), F.desc("published_at"), "news_id"], most)
    place = F.struct((-F.col("source_weight")).alias("a"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("b"), F.col("news_id").alias("c"), F.struct("news_id", "title", "source", "source_weight", F.col("published_at").cast("string").alias("published_at"), F.col("body").alias("content")).alias("item"))
    told = top.groupBy("asset", "d").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["item"]).alias("news"))
    none = F.filter(F.array(F.lit(None).cast(told.schema["news"].dataType.elementType)), lambda x: x.isNotNull())
    heard = lambda x: x.join(told, ["asset", "d"], "left").withColumn("news", F.coalesce("news", none))
    if hidden:
        return heard(points).withColumn("context", F.to_json(F.struct(F.col("d").alias("day"), "news"))).drop("news")
    # texts come last: the joins by time have the rows of an asset or a sector in one task
    ratios = ["pe", "pb", "roe", "margin", "leverage"]
    j = asof_join(points, fundamentals, ["asset"], "d", "received_on", ["received_on", *ratios])
    asked = points.select("d").distinct().withColumn("series", F.explode(F.array(*map(F.lit, series))))
    known = asof_join(asked, macro.select("series", "available_on", "value"), ["series"], "d", "available_on", ["value"], tie="available_on")
    known = known.filter("value is not null").groupBy("d").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "value")))).alias("macro"))
    span = Window.partitionBy("asset").orderBy(F.datediff("d", F.lit("1970-01-01"))).rangeBetween(-days, 0)
    own = bars.select("asset", "d", (F.col("close") / F.first("close").over(span) - 1).alias("_r"), F.count("*").over(span).alias("_n")).filter("_n >= 2")
    sectors = own.join(points.select("asset", "sector").distinct(), "asset").groupBy("sector", F.col("d").alias("_session")).agg(F.avg("_r").alias("sector_return"))
    j = asof_join(j.join(known, "d", "left"), sectors, ["sector"], "d", "_session", ["sector_return"])
    j = asof_join(j, earnings, ["asset"], "d", "announced_on", ["announced_on", "realized", "comparable", "estimated", "move_pct"])
    j = heard(j)
    block = earnings_block(F.col("d"), *(F.col(c) for c in ("announced_on", "realized", "comparable", "estimated", "move_pct")))
    payload = F.to_json(F.struct(F.col("d").alias("day"), "asset", "news", "sector", F.when(F.col("received_on").isNotNull(), F.struct(*ratios)).alias("fundamentals"), "macro", "sector_return"))
    return j.select(*points.columns, F.concat_ws("\n\n", payload, block).alias("context"))


def versions_running(df: DataFrame, by: list[str]) -> DataFrame:
    """Version rows with a running cost and the change from first and previous version."""
    w = Window.partitionBy(*by).orderBy("version")
    return df.withColumns({"running_cost": F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)), "vs_first": F.col("ic") - F.first("ic").over(w), "vs_previous": F.col("ic") - F.lag("ic").over(w)})
