"""Queries of reports: what was known when, funnels with their counts, calibration and searches."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import asof, filings, panel, stats
from ..operators import universe as un
from ..sources import feeds
from ..sources.shared import written
from . import views as v
from .registry import query
from .stats_queries import _COST, _boot, _ic, _U, costs, r6
from .views import sql

_VERSIONS = "versions as (select l.entity, account, l.ref_date, l.version, value, h.received_on + 25 * (l.version - 1) as received_on, coalesce(h.received_on + 25 * (l.version - 1), l.ref_date + 45) as seen from statement_lines l join filing_headers h on l.entity = h.entity and l.ref_date = h.ref_date)"


def versions(spark, d):
    """Statement lines, each version with its own receipt; those of some entities lack one."""
    h = v.filing_headers(spark, d).select("entity", "ref_date", "received_on")
    late = F.date_add("received_on", (25 * (F.col("version") - 1)).cast("int"))
    return v.statement_lines(spark, d).join(h, ["entity", "ref_date"]).withColumn("received_on", late)


@query("f5_ttm_known", sql(f"""with {_VERSIONS}, accounts as (select distinct account from versions),
    asked as (select p.entity, a.account, p.d from points p, accounts a),
    now as (select a.entity, a.account, a.d, arg_max({{'ref': k.ref_date, 'value': k.value}}, (k.seen, k.ref_date, k.version)) as x from asked a left join versions k on k.entity = a.entity and k.account = a.account and k.seen <= a.d group by 1, 2, 3),
    filed as (select entity, account, d, x.ref as ref_date, x.value as value from now),
    yearly as (select f.entity, f.account, f.d, arg_max(k.value, (k.received_on, k.version)) as annual from filed f join versions k on k.entity = f.entity and k.account = f.account and k.ref_date = make_date(year(f.ref_date) - 1, 12, 31) and k.received_on <= f.d group by 1, 2, 3),
    before as (select f.entity, f.account, f.d, arg_max(k.value, (k.seen, k.version)) as old from filed f join versions k on k.entity = f.entity and k.account = f.account and k.ref_date = last_day(f.ref_date - interval 12 month) and k.seen <= f.d group by 1, 2, 3)
    select f.entity, f.account, f.d, f.ref_date, round(case when month(f.ref_date) = 12 then f.value else f.value + (annual - old) end, 2) as value,
           case when f.ref_date is null then 'no filing' when month(f.ref_date) = 12 then null when old is null then 'no prior year to date' when annual is null then 'no prior annual' end as reason
    from filed f left join yearly using (entity, account, d) left join before using (entity, account, d)""", "statement_lines", "filing_headers", "points"))
def f5_known(spark, d):
    lines = versions(spark, d)
    asked = v.points(spark, d).crossJoin(F.broadcast(lines.select("account").distinct()))
    told = filings.ttm_known(asked, lines, ["entity", "account"], "d", slices=8)
    return told.select("entity", "account", "d", "ref_date", F.round("value", 2).alias("value"), "reason")


def _whole(src: str, a: str, b: str) -> str:
    return f"(select ic, n from {_ic(f'(select 1 as one, * from {src})', 'one', a, b)})"


_MOMENTUM = "moved as (select s.*, m.momentum from signals s left join (select asset, d, lag(close, 21) over w / lag(close, 252) over w - 1 as momentum from bars window w as (partition by asset order by d)) m using (asset, d))"


@query("a3_baselines_whole", sql(f"""with {_MOMENTUM}, event as (select * from moved where has_event),
    parts as (select 'all' as scope, m.ic as a, b.ic as b, m.n as n from {_whole('moved', 'score', 'y')} m, {_whole('moved', 'momentum', 'y')} b
        union all select 'event', m.ic, b.ic, (select count(*) from event) from {_whole('event', 'score', 'y')} m, {_whole('event', 'momentum', 'y')} b)
    select scope, round(a, 6) as ic_score, case when scope = 'all' or n > 30 then round(b, 6) end as ic_momentum, case when scope = 'all' or n > 30 then round(a - greatest(0, b), 6) end as gap from parts""", "signals", "bars"))
def a3_whole(spark, d):
    bars = written(v.bars(spark, d))
    m = panel.momentum(bars, ["asset"], "d").select("asset", "d", "momentum")
    s = v.scores_of(bars).join(v.labels_of(bars, v.index_bars(spark, d)), ["asset", "d"])
    # four correlations and the count of events read it
    s = written(s.join(m, ["asset", "d"], "left"))
    return stats.ic_baselines(s, [], "score", ["momentum"], "y", "has_event").select("scope", *r6("ic_score", "ic_momentum", "gap"))


_BETA = "beta_labels as (select asset, d, y as y_beta from (select b.asset, b.d, lead(b.close, 5) over w / b.close - 1 - (0.5::double + 0.25::double * u.sector) * (lead(i.close, 5) over w / i.close - 1) as y from bars b join index_bars i on b.d = i.d join universe u on u.asset = b.asset window w as (partition by b.asset order by b.d)) where y is not null)"


@query("a12_full_calibration", sql(f"""with {_BETA}, e as (select x.*, y_beta, tokens_in <= 5 as degraded, tokens_out::double as lexical, latency > 5.9 as flagged, case when d < date '1998-01-01' then 'seen' else 'unseen' end as segment
        from evaluations x join beta_labels using (asset, d) where model = 'a'),
    doubled as (select *, 'all' as part from e union all select *, segment from e), g as (select * from doubled where not degraded), {_boot('g', 'part', 'event_id', ['score'], 1000)},
    ci as (select part, quantile_cont(ic_score, 0.025) as lo, quantile_cont(ic_score, 0.975) as hi from reps group by 1),
    told as (select part, count(*) as n, count(*) filter (flagged) as n_flagged from g group by 1),
    every as (select part, count(*) as n_all, count(*) filter (degraded) as n_degraded, avg(degraded::int) as rate from doubled group by 1)
    select v.part, t.n, round(i.ic, 6) as ic, round(lo, 6) as lo, round(hi, 6) as hi, round(b.ic, 6) as ic_beta, round(l.ic, 6) as ic_baseline, round(i.ic - l.ic, 6) as gap, n_flagged, n_all, n_degraded, round(rate, 6) as rate,
           case when rate > 0.15 then 'invalid' when rate > 0.05 then 'caveat' else 'ok' end as note
    from every v join told t using (part) join ci using (part) join {_ic('g', 'part', 'score', 'y')} i using (part) join {_ic('g', 'part', 'score', 'y_beta')} b using (part) join {_ic('g', 'part', 'lexical', 'y')} l using (part)""", "evaluations", "bars", "index_bars", "universe"))
def a12_full(spark, d):
    u = v.universe(spark, d).select("asset", (0.5 + 0.25 * F.col("sector")).alias("beta"))
    bars = v.bars(spark, d).join(v.index_bars(spark, d).withColumnRenamed("close", "bench"), "d").join(u, "asset")
    beta = panel.forward_label(bars, ["asset"], "d").select("asset", "d", F.col("y").alias("y_beta"))
    e = v.evaluations(spark, d).filter("model = 'a'").join(beta, ["asset", "d"]).withColumns({
        "lexical": F.col("tokens_out").cast("double"), "segment": F.when(F.col("d") < "1998-01-01", "seen").otherwise("unseen"),
        "flags": F.when(F.col("latency") > 5.9, F.array(F.lit("slow"))).otherwise(F.array()),
    })
    r = stats.full_calibration(e, "segment", "score", "y", "y_beta", "lexical", "flags", F.col("tokens_in") <= 5, "event_id")
    return r.select("part", "n", *r6("ic", "lo", "hi", "ic_beta", "ic_baseline", "gap"), "n_flagged", "n_all", "n_degraded", *r6("rate"), "note")


@query("f18_usage_estimate", sql(f"select model, 5000 as n_events, round(5000 * avg(cost), 4) as cost, round(5000 * avg(cost) - 2 * stddev_samp(cost) * sqrt(5000), 4) as low, round(5000 * avg(cost) + 2 * stddev_samp(cost) * sqrt(5000), 4) as high from {_COST} group by 1", "evaluations"))
def f18_estimate(spark, d):
    return stats.usage_estimate(costs(spark, d), 5000).select("model", "n_events", *(F.round(c, 4).alias(c) for c in ("cost", "low", "high")))


_MEMBER = "(valid_from is null or valid_from <= d) and (valid_to is null or d <= valid_to)"


@query("p17_sector_members_by_day", sql(f"select d, sector, array_to_string(list_sort(list(asset)), ',') as assets from sessions, universe where {_MEMBER} group by 1, 2", "sessions", "universe"))
def p17_by_day(spark, d):
    m = un.sector_members(v.universe(spark, d), v.sessions(spark, d).select("d"))
    return m.select("d", "sector", F.array_join("assets", ",").alias("assets"))


@query("u8_active_over", sql("select asset from universe where (valid_from is null or valid_from <= date '2000-03-31') and (valid_to is null or valid_to >= date '2000-03-01') and (valid_from is null or valid_to is null or valid_from <= valid_to)", "universe"))
def u8_active(spark, d):
    return un.active_over(v.universe(spark, d), "2000-03-01", "2000-03-31")


@query("p5_lookahead_report", sql("""select 'prices' as kind, count(*) as n, count(*) filter (d > date '2000-06-30') as n_late, max(d)::timestamp as latest from bars
    union all select 'filings', count(*), count(*) filter (received_on > date '2000-06-30'), max(received_on)::timestamp from filing_headers
    union all select 'macro', count(*), count(*) filter (ref_date > date '2000-06-30'), max(ref_date)::timestamp from macro
    union all select 'scores', count(*), count(*) filter (d > date '2000-06-30'), max(d)::timestamp from scores""", "bars", "filing_headers", "macro", "scores"))
def p5_report(spark, d):
    kinds = {"prices": (v.bars(spark, d), "d"), "filings": (v.filing_headers(spark, d), "received_on"), "macro": (v.macro(spark, d), "ref_date"), "scores": (v.scores(spark, d), "d")}
    return un.lookahead_report(kinds, "2000-06-30 17:05:00").withColumn("latest", F.col("latest").cast("timestamp_ntz"))


@query("j14_event_funnel", sql(f"""with near as (select asset, news_id, unnest(generate_series(published_at::date, published_at::date + 7, interval 1 day))::date as d from news),
    sets as (select asset, d, sha256(array_to_string(list_sort(list(news_id::varchar)), '||')) as k from near group by 1, 2),
    act as (select u.asset, s.d from (select d from sessions) s, universe u where {_MEMBER.replace('valid_from <= d', 'valid_from <= s.d').replace('d <= valid_to', 's.d <= valid_to')}),
    told as (select act.*, k, exists (select 1 from labels_y y where y.asset = act.asset and y.d = act.d) as has_y from act left join sets on sets.asset = act.asset and sets.d = act.d),
    seen as (select *, min(case when has_y and k is not null then d end) over (partition by asset, k) as f from told)
    select count(*) as n_candidates, count(*) filter (has_y and d = f and k is not null) as n_sampled, count(*) filter (k is null) as n_no_news, count(*) filter (k is not null and d > f) as n_duplicate,
           count(*) filter (k is not null and coalesce(d < f, true) or k is not null and d = f and not has_y) as n_no_label from seen""", "sessions", "universe", "news", "labels_y"))
def j14_funnel(spark, d):
    """The counts come with the one pass that writes the sample."""
    counts = Observation()
    judged = un.judged_events(v.sessions(spark, d), v.universe(spark, d), v.news(spark, d), v.labels(spark, d), counts=counts)
    judged.filter("verdict = 'sampled'").write.format("noop").mode("overwrite").save()
    names = ["n_candidates", "n_sampled", "n_no_news", "n_duplicate", "n_no_label"]
    return spark.createDataFrame([tuple(counts.get[c] for c in names)], ", ".join(f"{c} bigint" for c in names))


_PROBE = """judged as (select *, row_number() over (order by md5('42|' || event_id), event_id) as spot, case when not tokens_in > 5 then 'valid' when not d >= date '1998-01-01' then 'clean' when not y is not null then 'labelled' end as failed from evaluations where model = 'a'),
    taken as (select * from judged where failed is null order by spot limit 100), edge as (select case when count(*) < 100 then 9223372036854775807 else max(spot) end as m from taken)"""


def probed(spark, d):
    filters = {"valid": F.col("tokens_in") > 5, "clean": F.col("d") >= "1998-01-01", "labelled": F.col("y").isNotNull()}
    return un.sample_passing(v.evaluations(spark, d).filter("model = 'a'"), ["event_id"], 100, filters)


@query("j15_sample_passing", sql(f"with {_PROBE} select event_id, tokens_in, d from taken", "evaluations"))
def j15_passing(spark, d):
    return probed(spark, d)[0].select("event_id", "tokens_in", "d")


@query("j15_probe_counts", sql(f"with {_PROBE} select count(*) as n_probed, count(*) filter (failed is null) as n_taken, count(*) filter (failed = 'valid') as failed_valid, count(*) filter (failed = 'clean') as failed_clean, count(*) filter (failed = 'labelled') as failed_labelled from judged, edge where spot <= m", "evaluations"))
def j15_counts(spark, d):
    return probed(spark, d)[1]


def _round(src: str, name: str) -> str:
    """DuckDB CTEs: correlations of the strengths `src` (alpha), and the best of each target's grid in `src`."""
    signal = f"(select alpha, y, greatest(-1.0, least(1.0, alpha * z + sqrt(1 - alpha * alpha) * noise)) as signal from ev, (select distinct alpha from {src}))"
    return f"""{name}_ic as (select alpha, coalesce(ic, 0) as ic from {_ic(signal, 'alpha', 'signal', 'y')}),
        {name}_at as (select g.target, g.k, g.alpha, i.ic from {src} g join {name}_ic i using (alpha)),
        {name}_best as (select target, min({{'far': abs(ic - target), 'alpha': alpha, 'ic': ic}}) as x, coalesce(min(k) filter (ic >= target), 16) as over from {name}_at group by 1)"""


_TARGETS = [0.0, 0.05, 0.1, 0.15, 0.2, 0.3]


@query("a21_alpha_search", sql(f"""with zs as (select asset, d, y, case when count(y) over w >= 3 then (y - avg(y) over w) / (stddev_pop(y) over w + 1e-12) end as z from labels_y window w as (partition by d)),
    ev as (select *, sqrt(-2 * ln(greatest({_U('n1')}, 1e-12))) * cos(2 * 3.141592653589793 * {_U('n2')}) as noise from zs where {_U('event')} < 0.15 and z is not null),
    targets as (select unnest([{', '.join(f'{t}::double' for t in _TARGETS)}]) as target),
    g1 as (select target, k, k / 16.0::double as alpha from targets, range(17) r(k) where target > 0 or k = 0), {_round('g1', 'r1')},
    held as (select target, greatest(over - 1, 0) / 16.0::double as lo, greatest(over, 1) / 16.0::double as hi from r1_best where target > 0 and x.far >= 0.005),
    g2 as (select target, k, lo + (hi - lo) * k / 16 as alpha from held, range(17) r(k)), {_round('g2', 'r2')},
    every as (select target, x from r1_best union all select target, x from r2_best)
    select target, min(x).alpha as alpha, round(min(x).ic, 6) as ic from every group by 1""", "labels_y"))
def a21_search(spark, d):
    z = panel.zscore(v.labels(spark, d), ["d"], "y").withColumn("day", F.col("d").cast("string"))
    # two rounds tell 256ths of the strength
    return stats.find_alphas(z, _TARGETS, ["asset", "day"], "z", "y", rounds=2).select("target", "alpha", *r6("ic"))


@query("s9_normalize_observations", sql("select series, ref_date, round(value, 2) as value from macro where month(ref_date) <> 6", "macro"))
def s9_b(spark, d):
    """The numeric variant; a missing number comes as a point."""
    number = F.when(F.month("ref_date") == 6, ".").otherwise(F.round("value", 2).cast("string"))
    m = v.macro(spark, d).select("series", F.struct(F.col("ref_date").cast("string").alias("date"), number.alias("value")).alias("o"))
    # a payload for each series and year, as the service sends them
    raw = m.groupBy("series", F.substring("o.date", 1, 4).alias("year")).agg(F.to_json(F.struct(F.collect_list("o").alias("observations"))).alias("payload"))
    return feeds.normalize_macro_b(raw)


@query("j9_last_of_repeats", sql("select p.entity, p.d, h.value from points p left join (select entity, received_on, arg_max(value, (version, value)) as value from (select h.entity, h.received_on, l.version, l.value from filing_headers h join statement_lines l on l.entity = h.entity and l.ref_date = h.ref_date) group by 1, 2) h on h.entity = p.entity and h.received_on = p.d", "points", "filing_headers", "statement_lines"))
def j9_last(spark, d):
    """Of several rows of a day the one that comes last by its order."""
    h = v.filing_headers(spark, d).select("entity", "ref_date", F.col("received_on").alias("d")).join(v.statement_lines(spark, d).select("entity", "ref_date", "version", F.col("value").alias("close")), ["entity", "ref_date"])
    return asof.bar_on(v.points(spark, d), h.filter("d is not null"), ["entity"], order="version").select("entity", "d", F.col("close").alias("value"))
