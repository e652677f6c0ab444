"""Queries of the calendar, as-of and panel families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, timeutil
from ..operators import asof, panel
from ..sources import feeds
from . import views as v
from .registry import query
from .views import sql


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def returns(spark, d):
    """Bars with own and benchmark returns, the benchmark's close as `bench`."""
    b = panel.simple_return(v.bars(spark, d), ["asset"], "d")
    i = v.index_bars(spark, d).withColumn("one", F.lit(0))
    i = panel.simple_return(i, ["one"], "d", name="bench_ret").select("d", F.col("close").alias("bench"), "bench_ret")
    return b.join(i, "d")


_RET = """with ret as materialized (select b.*, b.close / lag(b.close) over (partition by asset order by b.d) - 1 as ret, i.close as bench, i.bench_ret
    from bars b join (select d, close, close / lag(close) over (order by d) - 1 as bench_ret from index_bars) i on b.d = i.d) """


@query("s1_load_bars", sql("select b.asset, b.d, b.close as close, volume, r.open as close_raw from bars b left join (select asset, d, open from bars where volume > 20) r on r.asset = b.asset and r.d = b.d where b.d between date '1996-01-01' and date '2000-06-30'", "bars"))
def s1(spark, d):
    raw = v.bars(spark, d).filter("volume > 20").select("asset", "d", F.col("open").alias("close"))
    return feeds.load_bars(v.bars(spark, d), raw, "1996-01-01", "2000-06-30", "1995-06-01").select("asset", "d", "close", "volume", "close_raw")


@query("f1_quality_flags", sql("select asset, d, concat_ws('|', case when volume = 0 then 'zero volume' end, case when close is null then 'null close' end, case when abs(close / lag(close) over (partition by asset order by d) - 1) > 0.30 then 'large move' end) as quality from bars", "bars"))
def f1(spark, d):
    return panel.quality_flags(v.bars(spark, d), ["asset"]).select("asset", "d", "quality")


@query("f2_simple_return", sql("select asset, d, round(close / lag(close) over (partition by asset order by d) - 1, 6) as ret from bars", "bars"))
def f2(spark, d):
    return panel.simple_return(v.bars(spark, d), ["asset"], "d").select("asset", "d", *r6("ret"))


@query("f7_clamp", "select event_id, greatest(-5, least(20, coalesce(try_cast(value as double), 0)))::double as clamped from events")
def f7(spark, d):
    return v.table(spark, d, "events").select("event_id", scalars.clamp(F.col("value").cast("string"), -5, 20).alias("clamped"))


_BD = "(5 * (datediff('day', date '1970-01-05', {0}) // 7) + least(datediff('day', date '1970-01-05', {0}) % 7, 5))"


@query("f11_busday_count", f"select o_orderkey, l_linenumber, l_partkey, l_suppkey, (case when a <= b then {_BD.format('b')} - {_BD.format('a')} else -({_BD.format('(a + 1)')} - {_BD.format('(b + 1)')}) end)::int as n from (select o_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate::date as a, l_shipdate::date as b from orders join lineitem on l_orderkey = o_orderkey)")
def f11(spark, d):
    j = v.table(spark, d, "orders").join(v.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", timeutil.busday_count(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("n"))


_BA = "(date '1970-01-05' + ((t // 5) * 7 + t % 5)::int)"


@query("f12_busday_add", f"select o_orderkey, {_BA} as due from (select o_orderkey, (k // 7) * 5 + least(k % 7, 4) + 5 as t from (select o_orderkey, datediff('day', date '1970-01-05', o_orderdate::date) as k from orders))")
def f12(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", timeutil.busday_add(F.col("o_orderdate").cast("date"), 5).alias("due"))


@query("f13_next_session", sql("select o_orderkey, (select min(d) from sessions where d > o_orderdate::date) as next_d from orders", "sessions"))
def f13(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return timeutil.next_session(o, v.sessions(spark, d)).select("o_orderkey", "next_d")


@query("f14_sessions_between", sql("select trade_id, portfolio, b.ord - a.ord as n_sessions from trades left join sessions a on a.d = entry_d left join sessions b on b.d = exit_d", "trades", "sessions"))
def f14(spark, d):
    return timeutil.sessions_between(v.trades(spark, d), v.sessions(spark, d), "entry_d", "exit_d").select("trade_id", "portfolio", "n_sessions")


@query("f15_execution_date", "select event_id, case when late then b2 else b1 end as due, case when late then 'late news' end as reason from (select event_id, ts > (day - (case isodow(day) when 1 then 3 when 7 then 2 else 1 end)::int) + interval '17 hours 5 minutes' as late, " + _BA.replace("t ", "t1 ") + " as b1, " + _BA.replace("t ", "t2 ") + " as b2 from (select *, (k // 7) * 5 + least(k % 7, 4) + 1 as t1, (k // 7) * 5 + least(k % 7, 4) + 2 as t2 from (select event_id, ts, (ts + interval 9 hour)::date as day, datediff('day', date '1970-01-05', (ts + interval 9 hour)::date) as k from events)))")
def f15(spark, d):
    e = v.table(spark, d, "events").withColumn("x", timeutil.execution_date(F.expr("ts + interval 9 hours"), F.col("ts").cast("timestamp")))
    return e.select("event_id", F.col("x.date").alias("due"), "x.reason")


@query("f16_hash_uniform", f"select o_orderkey, {v._u('o_orderkey')} as u from orders")
def f16(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", scalars.hash_uniform("o_orderkey").alias("u"))


@query("f17_daily_rate", sql("select series, ref_date, round(pow(1 + value / 1000, 1.0 / 252) - 1, 6) as rate from macro", "macro"))
def f17(spark, d):
    return v.macro(spark, d).select("series", "ref_date", F.round(scalars.daily_rate(F.col("value") / 1000), 6).alias("rate"))


@query("f21_macro_features", sql("select series, ref_date, round(value, 6) as level, round(coalesce(value - o, 0), 6) as change, round(coalesce(value / nullif(o, 0) - 1, 0), 6) as relative from (select *, lag(value, 21) over (partition by series order by ref_date) as o from macro)", "macro"))
def f21(spark, d):
    return panel.macro_features(v.macro(spark, d)).select("series", "ref_date", *r6("level", "change", "relative"))


@query("p6_last_closed_session", "select event_id, case when isodow(dd) > 5 then dd - (isodow(dd) - 5)::int when hour(ts) * 60 + minute(ts) >= 1025 then dd else dd - (case when isodow(dd) = 1 then 3 else 1 end)::int end as closed from (select event_id, ts, ts::date as dd from events)")
def p6(spark, d):
    return v.table(spark, d, "events").select("event_id", timeutil.last_closed_session(F.col("ts")).alias("closed"))


@query("w1_momentum", sql("select asset, d, round(lag(close, 21) over w / lag(close, 252) over w - 1, 6) as momentum from bars window w as (partition by asset order by d)", "bars"))
def w1(spark, d):
    return panel.momentum(v.bars(spark, d), ["asset"], "d").select("asset", "d", *r6("momentum"))


@query("w2_reversal", sql("select asset, d, round(close / lag(close, 21) over w - 1, 6) as reversal from bars window w as (partition by asset order by d)", "bars"))
def w2(spark, d):
    return panel.reversal(v.bars(spark, d), ["asset"], "d").select("asset", "d", *r6("reversal"))


@query("w3_relative_volume", sql("select asset, d, round(case when n >= 20 and m > 0 then volume / m end, 6) as relative_volume from (select *, count(volume) over w as n, avg(volume) over w as m from bars window w as (partition by asset order by d rows between 20 preceding and 1 preceding))", "bars"))
def w3(spark, d):
    return panel.relative_volume(v.bars(spark, d), ["asset"], "d").select("asset", "d", *r6("relative_volume"))


@query("w4_days_since", sql("select entity, d, datediff('day', received_on, d) as days from points asof left join (select entity, coalesce(received_on, ref_date + 45) as received_on from filing_headers) h using (entity) where true" .replace("using (entity) where true", "on points.entity = h.entity and points.d >= h.received_on").replace("select entity, d,", "select points.entity, points.d,", 1), "points", "filing_headers"))
def w4(spark, d):
    h = v.filing_headers(spark, d).select("entity", F.coalesce("received_on", F.date_add("ref_date", 45)).alias("received_on"))
    return asof.days_since(v.points(spark, d), h, ["entity"], "d", "received_on").select("entity", "d", "days")


_E = "(select entity, announced_on, realized from earnings where realized is not null)"


@query("w5_yoy_growth", sql(f"select p.entity, p.d, round((e.realized - o.realized) / nullif(abs(o.realized), 0), 6) as growth from points p asof left join {_E} e on p.entity = e.entity and p.d >= e.announced_on asof left join {_E} o on p.entity = o.entity and p.d - 365 >= o.announced_on", "points", "earnings"))
def w5(spark, d):
    g = asof.yoy_growth(v.points(spark, d), v.earnings(spark, d), ["entity"], "d", "announced_on", "realized", slices=8)
    return g.select("entity", "d", *r6("growth"))


@query("w6_rolling_beta", sql(_RET + "select asset, d, round(case when n >= 200 and s is not null then s else 1 end, 6) as beta, not (n >= 200 and s is not null) as beta_fallback from (select asset, d, regr_slope(ret, bench_ret) over w as s, regr_count(ret, bench_ret) over w as n from ret window w as (partition by asset order by d rows between 250 preceding and current row))", "bars", "index_bars"))
def w6(spark, d):
    return panel.rolling_beta(returns(spark, d), ["asset"], "d", "ret", "bench_ret").select("asset", "d", *r6("beta"), "beta_fallback")


@query("w7_window_beta", sql(_RET + "select asset, d, round(case when n >= 20 and vv > 0 then c / vv end, 6) as beta from (select asset, d, count(ret) over w as n, covar_samp(ret, case when ret is not null then bench_ret end) over w as c, var_samp(case when ret is not null then bench_ret end) over w as vv from ret window w as (partition by asset order by d range between interval 70 day preceding and current row))", "bars", "index_bars"))
def w7(spark, d):
    return panel.window_beta(returns(spark, d), ["asset"], "d", "ret", "bench_ret").select("asset", "d", *r6("beta"))


@query("w8_forward_label", sql("select asset, d, round(y, 6) as y from labels_y", "labels_y"))
def w8(spark, d):
    return v.labels(spark, d).select("asset", "d", *r6("y"))


@query("w9_event_excess_return", sql(_RET + ", later as (select asset, d, lead(close, 5) over w / close - 1 - (lead(bench, 5) over w / bench - 1) as excess from ret window w as (partition by asset order by d)) select n.news_id, n.asset, l.d as first_d, round(l.excess, 6) as excess from news n asof left join later l on n.asset = l.asset and n.published_at::date <= l.d", "bars", "index_bars", "news"))
def w9(spark, d):
    n = v.news(spark, d).select("news_id", "asset", F.col("published_at").cast("date").alias("day"))
    return panel.event_excess_return(n, returns(spark, d), ["asset"], "day").select("news_id", "asset", "first_d", *r6("excess"))


@query("w10_ffill", sql("select asset, d, last_value(c ignore nulls) over (partition by asset order by d rows between 3 preceding and current row) as close from (select asset, d, case when volume >= 30 then close end as c from bars)", "bars"))
def w10(spark, d):
    b = v.bars(spark, d).withColumn("close", F.when(F.col("volume") >= 30, F.col("close")))
    return panel.ffill(b, ["asset"], "d", "close").select("asset", "d", "close")


@query("w11_rolling_compound", sql("select series, ref_date, round(case when n = 12 then (exp(s) - 1) * 100 end, 4) as compound from (select series, ref_date, count(value) over w as n, sum(ln(1 + value / 10000)) over w as s from macro window w as (partition by series order by ref_date rows between 11 preceding and current row))", "macro"))
def w11(spark, d):
    m = v.macro(spark, d).withColumn("value", F.col("value") / 100)
    return panel.rolling_compound(m, ["series"], "ref_date").select("series", "ref_date", F.round("compound", 4).alias("compound"))


@query("w12_date_ordinal", sql("select asset, bars.d, o.ord from bars join (select d, row_number() over (order by d) - 1 as ord from (select distinct d from bars)) o on bars.d = o.d", "bars"))
def w12(spark, d):
    return panel.date_ordinal(v.bars(spark, d)).select("asset", "d", "ord")


@query("w13_impute_cross_section", sql("with f as (select asset, d, case when volume < 30 then null else close end as x from bars), t as (select median(x) as m from f where d <= date '1999-12-31') select asset, d, coalesce(x, median(x) over (partition by d), m, 0) as x, x is null as x_missing from f, t", "bars"))
def w13(spark, d):
    f = v.bars(spark, d).select("asset", "d", F.when(F.col("volume") >= 30, F.col("close")).alias("x"))
    return panel.impute_cross_section(f, ["x"], "d", "1999-12-31").select("asset", "d", "x", "x_missing")


@query("w14_zscore", sql("select asset, d, round(case when count(close) over w >= 3 then (close - avg(close) over w) / (stddev_pop(close) over w + 1e-12) end, 6) as z from bars window w as (partition by d)", "bars"))
def w14(spark, d):
    return panel.zscore(v.bars(spark, d), ["d"], "close").select("asset", "d", *r6("z"))


@query("w15_rank_cross_section", sql("select asset, d, row_number() over (partition by d order by score desc, asset)::int as rank from scores", "scores"))
def w15(spark, d):
    return panel.rank_cross_section(v.scores(spark, d), ["d"], "score", "asset").select("asset", "d", "rank")


@query("w16_topk", sql("select asset, day, news_id from (select asset, published_at::date as day, news_id, row_number() over (partition by asset, published_at::date order by source_weight desc, published_at desc, news_id) as rn from news) where rn <= 2", "news"))
def w16(spark, d):
    n = v.news(spark, d).withColumn("day", F.col("published_at").cast("date"))
    return panel.topk(n, ["asset", "day"], [F.desc("source_weight"), F.desc("published_at"), "news_id"], 2).select("asset", "day", "news_id")


@query("w17_sector_returns", sql("select sector, round(avg(r), 6) as mean, round(median(r), 6) as median, count(*) as n from (select asset, arg_max(close, d) / arg_min(close, d) - 1 as r from bars where d between date '2000-06-30' - 60 and date '2000-06-30' group by asset having count(*) >= 2) join universe using (asset) group by sector", "bars", "universe"))
def w17(spark, d):
    return panel.sector_returns(v.bars(spark, d), v.universe(spark, d), "2000-06-30").select("sector", *r6("mean", "median"), "n")


@query("w20_cumulative", sql("select series, ref_date, round(sum(value) over w, 4) as running, round(value - first_value(value) over w, 6) as vs_first, round(value - lag(value) over (partition by series order by ref_date), 6) as vs_previous from macro window w as (partition by series order by ref_date rows unbounded preceding)", "macro"))
def w20(spark, d):
    return panel.cumulative(v.macro(spark, d), ["series"], "ref_date", "value").select("series", "ref_date", F.round("running", 4).alias("running"), *r6("vs_first", "vs_previous"))


@query("w21_trailing_drawdown", sql("select portfolio, d, round(case when n >= 21 then (t - equity) / t else 0 end, 6) as trailing_dd from (select *, count(*) over w as n, max(equity) over w as t from equity window w as (partition by portfolio order by d rows between 20 preceding and current row))", "equity"))
def w21(spark, d):
    return panel.trailing_drawdown(v.equity(spark, d), ["portfolio"], "d").select("portfolio", "d", *r6("trailing_dd"))


@query("w22_benchmark_returns", sql("select d, round(r, 6) as ret from (select d, close / lag(close) over (order by d) - 1 as r from index_bars where d between date '1996-01-01' and date '2000-06-30') where r is not null", "index_bars"))
def w22(spark, d):
    i = v.index_bars(spark, d).withColumn("index", F.lit("all"))
    return panel.benchmark_returns(i, ["index"], "1996-01-01", "2000-06-30").select("d", *r6("ret"))


_H = "(select entity, ref_date, version, coalesce(received_on, ref_date + 45) as received_on from filing_headers)"


@query("j1_asof_filing", sql(f"select p.entity, p.d, case when ok then ref_date end as ref_date, case when ok then received_on end as received_on, case when ok then version end as version from (select p.entity, p.d, h.ref_date, h.received_on, h.version, year(h.ref_date) > year(p.d) - 3 as ok from points p asof left join {_H} h on p.entity = h.entity and p.d >= h.received_on) p", "points", "filing_headers"))
def j1(spark, d):
    return asof.asof_filing(v.points(spark, d), v.filing_headers(spark, d), ["entity"], "d").select("entity", "d", "ref_date", "received_on", "version")


@query("j2_asof_join", sql("select p.entity, p.d, e.announced_on, round(e.estimated, 6) as estimated from points p asof left join earnings e on p.entity = e.entity and p.d >= e.announced_on", "points", "earnings"))
def j2(spark, d):
    return asof.asof_join(v.points(spark, d), v.earnings(spark, d), ["entity"], "d", "announced_on", ["announced_on", "estimated"], slices=16).select("entity", "d", "announced_on", *r6("estimated"))


@query("j3_asof_year_before", sql("select p.entity, p.d, e.announced_on from points p asof left join earnings e on p.entity = e.entity and p.d - 365 >= e.announced_on", "points", "earnings"))
def j3(spark, d):
    return asof.asof_join(v.points(spark, d), v.earnings(spark, d), ["entity"], "d", "announced_on", ["announced_on"], offset_days=365, slices=16).select("entity", "d", "announced_on")


@query("j4_asof_shares", sql("select p.entity, p.d, round(case when year(e.announced_on) >= year(p.d) - 1 then greatest(0, e.estimated - coalesce(e.realized, 0)) end, 6) as outstanding from points p asof left join earnings e on p.entity = e.entity and p.d >= e.announced_on", "points", "earnings"))
def j4(spark, d):
    s = v.earnings(spark, d).select("entity", F.col("announced_on").alias("ref_date"), F.col("estimated").alias("total"), F.col("realized").alias("treasury"))
    return asof.asof_shares(v.points(spark, d), s, ["entity"], "d").select("entity", "d", *r6("outstanding"))


@query("j5_asof_earnings", sql(f"select p.entity, p.d, e.announced_on, e.realized from points p asof left join {_E} e on p.entity = e.entity and p.d >= e.announced_on", "points", "earnings"))
def j5(spark, d):
    return asof.asof_earnings(v.points(spark, d), v.earnings(spark, d), ["entity"], "d").select("entity", "d", "announced_on", "realized")


@query("j6_asof_earnings_tolerance", sql(f"select entity, d, case when near then announced_on end as announced_on, case when near then realized end as realized from (select p.entity, p.d, e.announced_on, e.realized, {_BD.format('p.d')} - {_BD.format('e.announced_on')} <= 5 as near from points p asof left join {_E} e on p.entity = e.entity and p.d >= e.announced_on)", "points", "earnings"))
def j6(spark, d):
    return asof.asof_earnings(v.points(spark, d), v.earnings(spark, d), ["entity"], "d", max_bdays=5).select("entity", "d", "announced_on", "realized")


@query("j7_align_benchmark", sql("select o_orderkey, round(i.close, 6) as bench from orders o asof left join index_bars i on o.o_orderdate::date >= i.d", "index_bars"))
def j7(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return asof.align_benchmark(o, v.index_bars(spark, d)).select("o_orderkey", *r6("bench"))


@query("j8_align_inner", sql(_RET + "select a.asset, a.d, round(a.ret, 6) as ret_a, round(b.ret, 6) as ret_b from ret a join ret b on a.d = b.d and substr(b.asset, 7)::int = substr(a.asset, 7)::int + 1 where a.ret is not null and b.ret is not null", "bars", "index_bars"))
def j8(spark, d):
    """Each asset beside the one of the next number."""
    r = panel.simple_return(v.bars(spark, d), ["asset"], "d").select("asset", "d", F.round("ret", 6).alias("ret_a"))
    before = F.concat(F.lit("Brand#"), (F.substring("asset", 7, 9).cast("int") - 1).cast("string"))
    return asof.align_inner(r, r.select(before.alias("asset"), "d", F.col("ret_a").alias("ret_b")), ["asset", "d"], "ret_a", "ret_b")


@query("j9_bar_on", sql("select n.news_id, b.close from news n left join bars b on n.asset = b.asset and n.published_at::date = b.d", "bars", "news"))
def j9(spark, d):
    n = v.news(spark, d).select("news_id", "asset", F.col("published_at").cast("date").alias("d"))
    return asof.bar_on(n, v.bars(spark, d), ["asset"]).select("news_id", "close")


@query("j10_mark_price", sql("select n.news_id, coalesce(b.close, 100)::double as mark, case when b.close is null then 'entry price' when b.d < n.published_at::date then 'earlier close' end as carried from news n asof left join bars b on n.asset = b.asset and n.published_at::date >= b.d", "bars", "news"))
def j10(spark, d):
    n = v.news(spark, d).select("news_id", "asset", F.col("published_at").cast("date").alias("d"), F.lit(100.0).alias("px"))
    return asof.mark_price(n, v.bars(spark, d), ["asset"], "d", "px").select("news_id", "mark", "carried")


@query("p7_macro_asof", sql("select p.d, m.series, round(m.value, 6) as value from (select distinct d, series from points, (select distinct series from macro)) p asof left join (select series, value, last_day(ref_date) + 11 as a from macro) m on p.series = m.series and p.d >= m.a".replace("select p.d, m.series", "select p.d, p.series", 1), "points", "macro"))
def p7(spark, d):
    days = v.points(spark, d).select("d").distinct()
    return asof.macro_asof(days, v.macro(spark, d), "d").select("d", "series", *r6("value"))
