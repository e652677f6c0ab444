"""Queries of the filings, model and streaming families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import event_weight
from ..operators import boosting, filings, model, panel
from ..sources.shared import written
from ..streaming import twins
from . import views as v
from .registry import query
from .views import sql


def latest_lines(spark, d):
    from ..operators.news import latest_version

    return latest_version(v.statement_lines(spark, d), ["entity", "ref_date", "account"], "version", []).drop("version")


_LINES = "lines as (select entity, ref_date, account, value from (select *, row_number() over (partition by entity, ref_date, account order by version desc) as rn from statement_lines) where rn = 1)"


@query("f4_pick_account", sql(f"with {_LINES} select entity, ref_date, round(1000 * coalesce(max(case when account = '2-HIGH' then value end), max(case when account = '1-URGENT' then value end), arg_min(value, account) filter (account ilike '%low%')), 2) as value from lines group by 1, 2", "statement_lines"))
def f4(spark, d):
    lines = latest_lines(spark, d).withColumn("account_desc", F.col("account"))
    return filings.pick_account(lines, ["entity", "ref_date"], ["2-HIGH", "1-URGENT"], "low").select("entity", "ref_date", F.round("value", 2).alias("value"))


@query("f5_ttm", sql(f"with {_LINES} select a.entity, a.account, a.ref_date, round(case when month(a.ref_date) = 12 then a.value else a.value + (y.value - b.value) end, 2) as value, case when month(a.ref_date) = 12 then null when y.value is null then 'no prior annual' when b.value is null then 'no prior year to date' end as reason from lines a left join lines b on a.entity = b.entity and a.account = b.account and a.ref_date = last_day(b.ref_date + interval 12 month) left join lines y on a.entity = y.entity and a.account = y.account and month(y.ref_date) = 12 and year(y.ref_date) + 1 = year(a.ref_date)", "statement_lines"))
def f5(spark, d):
    return filings.ttm(latest_lines(spark, d), ["entity", "account"]).select("entity", "account", "ref_date", F.round("value", 2).alias("value"), "reason")


_ITEMS = "case account when '1-URGENT' then 'revenue' when '2-HIGH' then 'profit' when '3-MEDIUM' then 'equity' when '4-NOT SPECIFIED' then 'cash' else 'debt long' end"


def fundamentals(spark, d):
    item = F.expr(_ITEMS)
    i = latest_lines(spark, d).withColumn("item", item)
    ebit = i.filter("item = 'profit'").select("entity", "ref_date", F.lit("ebit").alias("item"), (F.col("value") * 2).alias("value"))
    return filings.extract_fundamentals(i.select("entity", "ref_date", "item", "value").unionByName(ebit), ["entity", "ref_date"])


_FUND = f"f as (select entity, ref_date, max(value) filter (i = 'revenue') as revenue, max(value) filter (i = 'profit') as profit, max(value) filter (i = 'equity') as equity, max(value) filter (i = 'cash') as cash, max(value) filter (i = 'debt long') as debt, 2 * max(value) filter (i = 'profit') as ebitda from (select *, {_ITEMS} as i from lines) group by 1, 2)"


@query("f6_extract_fundamentals", sql(f"with {_LINES}, {_FUND} select entity, ref_date, round(revenue, 2) as revenue, round(ebitda, 2) as ebitda, round(debt - cash, 2) as net_debt, concat_ws(',', 'ebitda without depreciation', case when cash is null then 'no cash' end, case when debt is null then 'no debt' end) as warnings from f", "statement_lines"))
def f6(spark, d):
    return fundamentals(spark, d).select("entity", "ref_date", *(F.round(c, 2).alias(c) for c in ("revenue", "ebitda", "net_debt")), F.array_join("warnings", ",").alias("warnings"))


@query("f3_valuation_ratios", sql(f"with {_LINES}, {_FUND} select entity, ref_date, round(profit / nullif(revenue, 0), 6) as margin, round(profit / nullif(equity, 0), 6) as roe, round((debt - cash) / nullif(ebitda, 0), 6) as leverage, round(case when profit > 0 then 1e6 / profit end, 6) as pe, round(case when equity > 0 then 1e6 / equity end, 6) as pb from f", "statement_lines"))
def f3(spark, d):
    r = filings.valuation_ratios(fundamentals(spark, d).withColumn("market_cap", F.lit(1e6)))
    return r.select("entity", "ref_date", *(F.round(c, 6).alias(c) for c in ("margin", "roe", "leverage", "pe", "pb")))


_SCORES = ("score_total", "score_news", "score_macro", "score_sector", "score_fundamentals")


@query("f8_parse_score_response", """with t as (select event_id, event_type, event_id % 7 as k, greatest(-1, least(1, value / 50))::double as a, greatest(-1, least(1, value / 100))::double as b from events)
    select event_id, case when k < 3 then 0 when k = 3 then 1 else a end::double as score_total, case when k < 3 then 0 when k = 3 then -1 else b end::double as score_news,
           case when k < 3 then 0 when k = 3 then 1 else 0.25 end::double as score_macro, case when k < 3 then 0 when k = 3 then -1 else -0.5 end::double as score_sector,
           case when k < 3 then 0 when k = 3 then 1 else 0.75 end::double as score_fundamentals, case when k < 3 then 0 when k = 3 then 1 else 0.5 end::double as confidence,
           case when k = 2 then 'text' when k = 3 then 'far' when k > 3 then 'of ' || event_type end as reason, k < 2 as rejected,
           case when k < 3 then false when k = 3 then true else abs(a - b) > 0.25 end as far from t""")
def f8(spark, d):
    """Responses that are cut off, no object, texts in place of numbers, out of range, or whole."""
    k, value = F.col("event_id") % 7, F.col("value")
    whole = F.to_json(F.struct((value / 50).alias("score_total"), (value / 100).alias("score_news"), F.lit("0.25").alias("score_macro"), F.lit(-0.5).alias("score_sector"), F.lit(0.75).alias("score_fundamentals"), F.lit(0.5).alias("confidence"), F.concat(F.lit("of "), "event_type").alias("reason")))
    far = '{"score_total": 5, "score_news": -9, "score_macro": 1e9, "score_sector": "-2", "score_fundamentals": 1.5, "confidence": 7, "reason": "far"}'
    texts = '{"score_total": "abc", "score_news": null, "confidence": "NaN", "reason": "text"}'
    response = F.when(k == 0, F.lit('{"score_total": 0.5, "conf')).when(k == 1, F.lit("[1, 2]")).when(k == 2, F.lit(texts)).when(k == 3, F.lit(far)).otherwise(whole)
    e = v.table(spark, d, "events").withColumn("j", response)
    return filings.parse_score_response(e, "j").select("event_id", *_SCORES, "confidence", "reason", "rejected", (F.size("warnings") > 0).alias("far"))


@query("f9_neutral_fill", sql("select b.asset, b.d, round(case when has_event then score else 0 end, 6) as score, coalesce(has_event, false) as has_event from bars b left join scores using (asset, d)", "bars", "scores"))
def f9(spark, d):
    s = v.scores(spark, d).filter("has_event").select("asset", "d", "score", "confidence", F.lit(1).alias("n_news"))
    return filings.neutral_fill(v.bars(spark, d).select("asset", "d"), s, ["asset", "d"]).select("asset", "d", F.round("score", 6).alias("score"), "has_event")


@query("f10_earnings_block", sql("select entity, announced_on, case when realized is not null then 'announced: ' || announced_on || chr(10) || 'realized: ' || format('{:,.2f}', realized) || chr(10) || 'estimated: ' || format('{:,.2f}', estimated) || chr(10) || 'move %: 1.00' end as block from earnings", "earnings"))
def f10(spark, d):
    e = v.earnings(spark, d)
    b = filings.earnings_block(F.date_add("announced_on", 7), F.col("announced_on"), F.col("realized"), F.lit(None).cast("double"), F.col("estimated"), F.lit(1.0))
    return e.select("entity", "announced_on", b.alias("block"))


def small_panel(spark, d):
    """The panel of prices and scores with whole windows, written: fits read it again and again."""
    bars, index, universe = (written(f(spark, d)) for f in (v.bars, v.index_bars, v.universe))
    p = written(filings.build_panel(bars, index, universe, v.scores_of(bars)))
    return written(panel.date_ordinal(panel.impute_cross_section(p, ["momentum", "reversal", "relative_volume"], "d", "1999-12-31")))


FEATURES = ["momentum", "reversal", "relative_volume", "beta", "score"]


def panel_inputs(spark, d):
    """Fundamentals by asset (the brand's number names the nation that files for it) and macro series with their dates of availability."""
    h = v.filing_headers(spark, d).select("entity", "ref_date", F.coalesce("received_on", F.date_add("ref_date", 45)).alias("received_on"))
    r = filings.valuation_ratios(fundamentals(spark, d).withColumn("market_cap", F.lit(1e6))).join(h, ["entity", "ref_date"])
    own = v.universe(spark, d).select("asset", (F.col("k") % 25).alias("entity"))
    f = own.join(r, "entity").select("asset", "received_on", "profit", "pe", "pb", "roe", "margin", "leverage")
    return f, v.macro(spark, d).withColumn("available_on", F.date_add(F.last_day("ref_date"), 11))


_PANEL_SQL = f"""with {_LINES}, {_FUND},
    ix as (select d, close, close / lag(close) over (order by d) - 1 as bench_ret from index_bars),
    ret as (select b.*, b.close / lag(b.close) over (partition by asset order by b.d) - 1 as ret, i.close as bench, i.bench_ret from bars b join ix i on b.d = i.d),
    w as (select asset, d, close, lag(close, 21) over o / lag(close, 252) over o - 1 as momentum, close / lag(close, 21) over o - 1 as reversal,
          case when count(volume) over q >= 20 and avg(volume) over q > 0 then volume / avg(volume) over q end as relative_volume,
          regr_slope(ret, bench_ret) over z as s, regr_count(ret, bench_ret) over z as n, lead(close, 5) over o / close - 1 as ahead, lead(bench, 5) over o / bench - 1 as bench_ahead
          from ret window o as (partition by asset order by d), q as (partition by asset order by d rows between 20 preceding and 1 preceding), z as (partition by asset order by d rows between 250 preceding and current row)),
    y as (select *, case when n >= 200 and s is not null then s else 1 end as beta, not (n >= 200 and s is not null) as beta_fallback from w where ahead is not null),
    fu as (select asset, coalesce(received_on, f.ref_date + 45) as received_on, profit, case when profit > 0 then 1e6 / profit end as pe, case when equity > 0 then 1e6 / equity end as pb,
           profit / nullif(equity, 0) as roe, profit / nullif(revenue, 0) as margin, (debt - cash) / nullif(ebitda, 0) as leverage
           from f join filing_headers h on f.entity = h.entity and f.ref_date = h.ref_date join universe u on u.k % 25 = f.entity),
    mf as (select series, (last_day(ref_date) + 11)::date as available_on, value as level, coalesce(value - o, 0) as change, coalesce(value / nullif(o, 0) - 1, 0) as relative from (select *, lag(value, 21) over (partition by series order by ref_date) as o from macro)),
    mr as (select * from mf where series = '1-URGENT'), mx as (select * from mf where series = '2-HIGH')
    select y.asset, y.d, u.sector, round(momentum, 6) as momentum, round(reversal, 6) as reversal, datediff('day', a.received_on, y.d)::double as days_since_report,
           round((a.profit - b.profit) / nullif(abs(b.profit), 0), 6) as profit_growth, round(a.pe, 6) as pe, round(a.pb, 6) as pb, round(a.roe, 6) as roe, round(a.margin, 6) as margin, round(a.leverage, 6) as leverage,
           round(relative_volume, 6) as relative_volume, round(mr.level, 6) as rate_level, round(coalesce(mr.change, 0), 6) as rate_change, round(coalesce(mx.relative, 0), 6) as fx_change,
           round(score, 6) as score, round(case when has_event and hash_zero then 0 else confidence end, 6) as confidence, has_event::int::double as n_news, round(beta, 6) as beta, beta_fallback,
           a.pe is null or a.pb is null as fundamentals_missing, has_event and hash_zero as score_degraded, has_event, round(ahead - beta * bench_ahead, 6) as y
    from y join universe u on y.asset = u.asset and (valid_from is null or valid_from <= y.d) and (valid_to is null or y.d <= valid_to)
    join (select *, score > 0.9 as hash_zero from scores) s on s.asset = y.asset and s.d = y.d
    asof left join fu a on y.asset = a.asset and y.d >= a.received_on
    asof left join fu b on y.asset = b.asset and y.d - 365 >= b.received_on
    asof left join mr on y.d >= mr.available_on asof left join mx on y.d >= mx.available_on"""


def full_panel(spark, d):
    f, m = (written(x) for x in panel_inputs(spark, d))
    bars, index, universe = (written(f(spark, d)) for f in (v.bars, v.index_bars, v.universe))
    s = v.scores_of(bars).withColumns({"n_news": F.col("has_event").cast("int"), "confidence": F.when(F.col("has_event") & (F.col("score") > 0.9), 0.0).otherwise(F.col("confidence"))})
    return filings.build_panel(bars, index, universe, s, fundamentals=f, macro=m, rate_series="1-URGENT", fx_series="2-HIGH")


@query("w18_build_panel", sql(_PANEL_SQL, "bars", "index_bars", "statement_lines", "filing_headers", "universe", "macro", "scores"))
def w18(spark, d):
    p = full_panel(spark, d)
    return p.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in p.dtypes))


_CONTEXT_SQL = f"""with {_LINES}, {_FUND},
    fu as (select asset, coalesce(received_on, f.ref_date + 45) as received_on, profit / nullif(equity, 0) as roe, profit / nullif(revenue, 0) as margin from f join filing_headers h on f.entity = h.entity and f.ref_date = h.ref_date join universe u on u.k % 25 = f.entity),
    p as (select distinct n.asset, published_at::date as d, sector, k from news n join universe u on n.asset = u.asset),
    top as (select asset, d, count(*) as n_news, min(news_id) as least_id, max(case when rn = 1 then news_id end) as first_id, sum(length(body)) as n_chars from (select *, published_at::date as d, row_number() over (partition by asset, published_at::date order by source_weight desc, published_at desc, news_id) as rn from news) where rn <= 8 group by 1, 2),
    mr as (select (last_day(ref_date) + 11)::date as available_on, value from macro where series = '1-URGENT'),
    own as (select asset, d, close / first_value(close) over w - 1 as r, count(*) over w as n from bars window w as (partition by asset order by d range between interval 60 days preceding and current row)),
    sec as (select sector, d, avg(r) as sector_return from own join universe using (asset) where n >= 2 and asset in (select asset from p) group by 1, 2),
    ea as (select asset, announced_on, realized from earnings join universe u on u.k % 25 = entity)
    select p.asset, p.d, n_news, first_id, n_chars::bigint as n_chars, round(a.roe, 6) as roe, round(a.margin, 6) as margin, round(mr.value, 6) as rate, round(sector_return, 6) as sector_return, case when ea.realized is not null then 'announced: ' || ea.announced_on end as announced
    from p join top on p.asset = top.asset and p.d = top.d
    asof left join fu a on p.asset = a.asset and p.d >= a.received_on
    asof left join mr on p.d >= mr.available_on
    asof left join sec on p.sector = sec.sector and p.d >= sec.d
    asof left join ea on p.asset = ea.asset and p.d >= ea.announced_on"""


@query("j12_full_context", sql(_CONTEXT_SQL, "bars", "statement_lines", "filing_headers", "universe", "macro", "news", "earnings"))
def j12_full(spark, d):
    fundamentals, m = panel_inputs(spark, d)
    n = v.news(spark, d).withColumn("d", F.col("published_at").cast("date"))
    u = v.universe(spark, d).select("asset", "sector", F.col("k").alias("_k"))
    own = u.select("asset", (F.col("_k") % 25).alias("entity"))
    e = v.earnings(spark, d).join(own, "entity").select("asset", "announced_on", "realized", F.lit(None).cast("double").alias("comparable"), "estimated", F.lit(None).cast("double").alias("move_pct"))
    points = n.select("asset", "d").distinct().join(u.drop("_k"), "asset")
    c = filings.build_context(points, n, fundamentals, m, v.bars(spark, d), e, ["1-URGENT", "2-HIGH"])
    kind = "struct<news: array<struct<news_id: bigint, content: string>>, fundamentals: struct<roe: double, margin: double>, macro: map<string, double>, sector_return: double>"
    parts = F.split("context", "\n\nannounced: ", 2)
    c = c.withColumns({"j": F.from_json(parts[0], kind), "announced": F.regexp_extract("context", r"\}\n\n(announced: \S+)\n", 1)})
    return c.select(
        "asset", "d", F.size("j.news").cast("bigint").alias("n_news"), F.col("j.news")[0]["news_id"].alias("first_id"), F.aggregate("j.news", F.lit(0).cast("bigint"), lambda t, x: t + F.length(x["content"])).alias("n_chars"),
        *(F.round(F.col(c), 6).alias(name) for c, name in (("j.fundamentals.roe", "roe"), ("j.fundamentals.margin", "margin"))), F.round(F.col("j.macro")["1-URGENT"], 6).alias("rate"), F.round("j.sector_return", 6).alias("sector_return"),
        F.when(F.col("announced") != "", F.col("announced")).alias("announced"),
    )


@query("m8_event_weight", sql("select asset, d, case when has_event then 5.0 else 1.0 end::double as weight from scores", "scores"))
def m8(spark, d):
    return v.scores(spark, d).select("asset", "d", event_weight(F.col("has_event")).cast("double").alias("weight"))


@query("m1_purged_folds", sql("with o as (select asset, d, dense_rank() over (order by d) - 1 as ord from labels_y), n as (select count(distinct d) as n from labels_y), f as (select i as fold, n - (n // 6) * 5 + (i - 1) * (n // 6) as first, n - (n // 6) * 5 + i * (n // 6) - 1 as last from n, range(1, 6) r(i)) select fold::int as fold, case when ord >= first then 'test' else 'train' end as side, count(*) as n from o join f on ord + 10 <= first or ord between first and last group by 1, 2", "labels_y"))
def m1(spark, d):
    y = panel.date_ordinal(v.labels(spark, d))
    n = y.agg(F.max("ord") + 1).first()[0]
    return model.purged_folds(y, n).groupBy("fold", "side").agg(F.count("*").alias("n"))


@query("m2_train_predict")
def m2(spark, d):
    p = small_panel(spark, d)
    train, test = model.embargoed(p, "2000-01-01")
    return model.predict(model.train_gbt(train, FEATURES), test, FEATURES).select("asset", "d", "y_pred", "rank")


@query("m5_predict_universe")
def m5(spark, d):
    p = written(full_panel(spark, d).filter("y is not null"))
    ready = written(panel.date_ordinal(panel.impute_cross_section(p, filings.PANEL_FEATURES, "d", "1999-12-31")))
    m = model.train_gbt(model.embargoed(ready, "2000-01-01")[0], filings.PANEL_FEATURES)
    news = v.news(spark, d).select("asset", F.col("published_at").cast("date").alias("d"), "published_at")
    return model.predict_universe(m, p.filter("d > date'1999-12-31'"), filings.PANEL_FEATURES, news, "1999-12-31")


@query("m3_staged_ic")
def m3(spark, d):
    p = small_panel(spark, d)
    n = p.agg(F.max("ord") + 1).first()[0] or 0
    return model.cross_validated_stages(p, n, FEATURES)


@query("m6_walk_forward")
def m6(spark, d):
    return boosting.walk_forward_windows(small_panel(spark, d), FEATURES).select("asset", "d", "y_pred", "rank", "month")


@query("m7_importance_signs")
def m7(spark, d):
    p = small_panel(spark, d)
    m = model.train_gbt(model.embargoed(p, "2000-01-01")[0], FEATURES)
    return model.importance_signs(m, p, FEATURES, {"score": 1, "momentum": 1, "reversal": -1})


def event_stream(spark, d):
    path = f"{d}/events.parquet"
    e = spark.read.parquet(path)
    s = spark.readStream.schema(e.schema).parquet(f"{d}/event*.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("x1_stream_dedupe")
def x1(spark, d):
    s = event_stream(spark, d).withColumn("title", F.concat_ws(" ", "event_type", "props"))
    return twins.run_once(spark, twins.stream_dedupe(s, ["user_id"], "title", "ts").select("event_id", "user_id"), "x1")


@query("x2_stream_cooldown")
def x2(spark, d):
    s = event_stream(spark, d).select(F.col("user_id").alias("portfolio"), F.col("ts").cast("date").alias("d"), (100 + F.col("value")).alias("equity"))
    return twins.run_once(spark, twins.stream_cooldown(s), "x2")


@query("x3_stream_daily", "select ts::date as d, event_type, count(*) as n, round(sum(value), 4) as total from events where ts::date < (select max(ts) - interval 1 day from events)::date group by 1, 2")
def x3(spark, d):
    out = twins.run_once(spark, twins.stream_daily(event_stream(spark, d), ["event_type"], "ts", "value"), "x3")
    return out.select("d", "event_type", "n", F.round("total", 4).alias("total"))
