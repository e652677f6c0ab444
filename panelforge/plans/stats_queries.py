"""Queries of the statistics and portfolio families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import panel, stats, universe
from ..operators import portfolio as pf
from . import views as v
from .registry import query
from .views import sql


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def _rank(c: str, by: str) -> str:
    return f"(rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0)"


def _ic(src: str, by: str, a: str, b: str, least: int = 3) -> str:
    """DuckDB's twin of stats.spearman."""
    return f"(select {by}, case when n >= {least} and va > 0 and vb > 0 then c end as ic, n from (select {by}, corr(ra, rb) as c, count(*) as n, var_pop(ra) as va, var_pop(rb) as vb from (select {by}, {_rank(a, by)} as ra, {_rank(b, by)} as rb from {src} where {a} is not null and {b} is not null) group by {by}))"


@query("a1_spearman", sql(f"select d, round(ic, 6) as ic, n from {_ic('signals', 'd', 'score', 'y')}", "signals"))
def a1(spark, d):
    return stats.spearman(v.signals(spark, d), ["d"], "score", "y").select("d", *r6("ic"), "n")


def _whole_ic(src: str, a: str, b: str, least: int = 3) -> str:
    """The same over all rows."""
    return f"(select ic, n from {_ic(f'(select 1 as one, * from {src})', 'one', a, b, least)})"


@query("a1_global", sql(f"select round(ic, 6) as ic, n from {_whole_ic('signals', 'score', 'y')}", "signals"))
def a1_global(spark, d):
    return stats.spearman(v.signals(spark, d), [], "score", "y").select(*r6("ic"), "n")


@query("a2_global", sql(f"select round(ic, 6) as ic, n, 'all' as scope from {_whole_ic('signals', 'score', 'y')} union all select round(ic, 6), n, 'event' from {_whole_ic('(select * from signals where has_event)', 'score', 'y')}", "signals"))
def a2_global(spark, d):
    return stats.ic_report(v.signals(spark, d), "score", "y", "has_event", []).select(*r6("ic"), "n", "scope")


@query("a2_ic_report", sql(f"select asset, round(ic, 6) as ic, n, 'all' as scope from {_ic('signals', 'asset', 'score', 'y')} union all select asset, round(ic, 6), n, 'event' from {_ic('(select * from signals where has_event)', 'asset', 'score', 'y')}", "signals"))
def a2(spark, d):
    return stats.ic_report(v.signals(spark, d), "score", "y", "has_event", ["asset"]).select("asset", *r6("ic"), "n", "scope")


@query("a3_ic_baselines", sql(f"select asset, round(a.ic, 6) as ic_score, round(b.ic, 6) as ic_confidence, round(a.ic - greatest(0, b.ic), 6) as gap from {_ic('signals', 'asset', 'score', 'y')} a full join {_ic('signals', 'asset', 'confidence', 'y')} b using (asset)", "signals"))
def a3(spark, d):
    return stats.ic_baselines(v.signals(spark, d), ["asset"], "score", ["confidence"], "y").select("asset", *r6("ic_score", "ic_confidence", "gap"))


def _boot(src: str, by: str, unit: str, scores: list[str], reps: int) -> str:
    """DuckDB's twin of stats.bootstrap_ic, on the expanded sample; `by` may be empty."""
    keys, over = (f"{by}, ", f"partition by {by}") if by else ("", "")
    ics = ", ".join(f"case when var_pop(r_{s}) > 0 and var_pop(r_y) > 0 then corr(r_{s}, r_y) end as ic_{s}" for s in scores)
    ranks = ", ".join(f"{_rank(c, keys + 'rep')} as r_{c}" for c in ["y", *scores])
    same = " and ".join(f"x.{c} = u.{c}" for c in [*(by.split(", ") if by else []), unit])
    word = v.group_word(*(by.split(", ") if by else ["null"]))
    return f"""units as (select *, row_number() over ({over} order by {unit}) - 1 as i, count(*) over ({over}) as m, {word} as g from (select distinct {keys}{unit} from {src})),
        {v.words('units', 'i', reps)},
        drawn as (select {keys}rep, ((word * m::ubigint) >> 32)::bigint as i from words),
        times as (select {keys}rep, i, count(*) as k from drawn group by all),
        boot as (select x.*, t.rep, u.m from times t join units u using ({keys}i) join {src} x on {same}, range(t.k)),
        reps as (select {keys}rep, max(m) as n_units, {ics} from (select {keys}rep, m, {ranks} from boot) group by {keys}rep)"""


_BLOCK = "floor((5 * (datediff('day', date '1995-01-02', a.d) // 7) + least(datediff('day', date '1995-01-02', a.d) % 7, 5)) / 5)::int"
_PAIR = f"pair as (select a.asset, a.d, {_BLOCK} as block, a.score as score_a, b.score as score_b, a.y from evaluations a join evaluations b on a.event_id = b.event_id and a.model = 'a' and b.model = 'b')"


def pair(spark, d):
    e = v.evaluations(spark, d)
    b = e.filter("model = 'b'").select("event_id", F.col("score").alias("score_b"))
    both = e.filter("model = 'a'").join(b, "event_id").select("asset", "d", F.col("score").alias("score_a"), "score_b", "y")
    return universe.add_blocks(both, "d", "1995-01-02")


@query("a4_bootstrap_ic", sql(f"with {_PAIR}, {_boot('pair', 'asset', 'd', ['score_a'], 1000)} select asset, rep::int as rep, round(ic_score_a, 6) + 0.0 as ic_score_a from reps", "evaluations"))
def a4(spark, d):
    # of one asset and day there is one row, so rows are drawn
    return stats.bootstrap_ic(pair(spark, d), ["asset"], "d", ["score_a"], "y").select("asset", "rep", (F.round("ic_score_a", 6) + 0.0).alias("ic_score_a"))


def _interval(x: str, src: str = "reps") -> str:
    return f"round(quantile_cont({x}, 0.025), 6) as lo, round(quantile_cont({x}, 0.975), 6) as hi, round(avg({x}), 6) as mean, round(avg(({x} <= 0)::int), 6) as p_not_positive, count({x}) as n_reps, (select count(*) from pair) as n, max(n_units) as n_units from {src}"


_TOLD = ("lo", "hi", "mean", "p_not_positive")


@query("a5_bootstrap_by_date", sql(f"with {_PAIR}, {_boot('pair', '', 'd', ['score_a'], 1000)} select {_interval('coalesce(ic_score_a, 0)')}", "evaluations"))
def a5(spark, d):
    reps = stats.bootstrap_ic(pair(spark, d), [], "d", ["score_a"], "y")
    return stats.bootstrap_summary(reps, [], "ic_score_a", least_units=10, undefined=0.0).select(*r6(*_TOLD), "n_reps", "n", "n_units")


@query("a7_bootstrap_by_block", sql(f"with {_PAIR}, {_boot('pair', '', 'block', ['score_a'], 1000)} select {_interval('ic_score_a')}", "evaluations"))
def a7(spark, d):
    reps = stats.bootstrap_ic(pair(spark, d), [], "block", ["score_a"], "y")
    return stats.bootstrap_summary(reps, [], "ic_score_a").select(*r6(*_TOLD), "n_reps", "n", "n_units")


@query("a8_paired_bootstrap", sql(f"with {_PAIR}, {_boot('pair', '', 'block', ['score_a', 'score_b'], 1000)} select {_interval('ic_score_b - ic_score_a')}", "evaluations"))
def a8(spark, d):
    reps = stats.bootstrap_ic(pair(spark, d), [], "block", ["score_a", "score_b"], "y").withColumn("delta", F.col("ic_score_b") - F.col("ic_score_a"))
    return stats.bootstrap_summary(reps, [], "delta").select(*r6(*_TOLD), "n_reps", "n", "n_units")


@query("a9_ic_by_group", sql(f"with g as (select asset, count(*) as n, count_if(round(score, 1) = 0) as n_zero from (select * from evaluations where model = 'a') group by 1 having count(*) >= 10) select asset, g.n, n_zero::bigint as n_zero, round(ic, 6) as ic from g join {_ic('(select asset, round(score, 1) as s1, y from evaluations where model = chr(97))', 'asset', 's1', 'y')} i using (asset)", "evaluations"))
def a9(spark, d):
    e = v.evaluations(spark, d).filter("model = 'a'").withColumn("score", F.round("score", 1))
    return stats.ic_by_group(e, ["asset"], "score", "y").select("asset", "n", "n_zero", *r6("ic"))


@query("a11_split_valid", sql("select asset, n, n_degraded, round(rate, 6) as rate, case when rate > 0.15 then 'invalid' when rate > 0.05 then 'caveat' else 'ok' end as note from (select asset, count(*) as n, count_if(tokens_in <= 5)::bigint as n_degraded, avg((tokens_in <= 5)::int) as rate from evaluations group by 1)", "evaluations"))
def a11(spark, d):
    return stats.split_valid(v.evaluations(spark, d), ["asset"], F.col("tokens_in") <= 5).select("asset", "n", "n_degraded", *r6("rate"), "note")


@query("a12_calibration_report", sql(f"select model, n_degraded, round(ic, 6) as ic from (select model, count_if(tokens_in <= 5)::bigint as n_degraded from evaluations group by 1) join {_ic('(select * from evaluations where tokens_in > 5)', 'model', 'score', 'y')} i using (model)", "evaluations"))
def a12(spark, d):
    return stats.calibration_report(v.evaluations(spark, d), ["model"], "score", "y", F.col("tokens_in") <= 5).select("model", "n_degraded", *r6("ic"))


@query("a14_compare_models", sql(f"with {_PAIR} select asset, round(a.ic, 6) as ic_a, round(b.ic, 6) as ic_b, round(a.ic - b.ic, 6) as delta, round(s, 6) as share_close from {_ic('pair', 'asset', 'score_a', 'y')} a join {_ic('pair', 'asset', 'score_b', 'y')} b using (asset) join (select asset, avg((abs(score_a - score_b) < 0.2)::int) as s from pair group by 1) using (asset)", "evaluations"))
def a14(spark, d):
    return stats.paired_delta(pair(spark, d), ["asset"], "score_a", "score_b", "y").select("asset", *r6("ic_a", "ic_b", "delta", "share_close"))


@query("a15_collinearity", sql("select 'confidence' as feature, round(corr(score, confidence), 6) as r from signals union all select 'y', round(corr(score, y), 6) from signals", "signals"))
def a15(spark, d):
    return stats.collinearity(v.signals(spark, d), "score", ["confidence", "y"]).select("feature", *r6("r"))


@query("a16_count_segments", sql("select asset, count(*) as n, count_if(d >= date '2001-06-01')::bigint as n_clean, count_if(d >= date '2001-06-01') < 30 as few from signals where has_event group by 1", "signals"))
def a16(spark, d):
    s = v.signals(spark, d).filter("has_event").withColumn("clean", F.col("d") >= "2001-06-01")
    return stats.count_segments(s, ["asset"], "clean")


_COST = "(select *, tokens_in / 1e6 * case model when 'a' then 3.0 else 15.0 end + tokens_out / 1e6 * case model when 'a' then 15.0 else 75.0 end as cost from evaluations)"


def costs(spark, d):
    prices = spark.createDataFrame([("a", 3.0, 15.0), ("b", 15.0, 75.0)], "model string, price_in double, price_out double")
    return stats.usage_cost(v.evaluations(spark, d), prices)


@query("f18_usage_cost", sql(f"select event_id, model, round(cost, 9) as cost from {_COST}", "evaluations"))
def f18(spark, d):
    return costs(spark, d).select("event_id", "model", F.round("cost", 9).alias("cost"))


@query("a17_usage_summary", sql(f"select model, count(*) as n, round(sum(cost), 6) as total_cost, round(avg(cost), 9) as mean_cost, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.9), 6) as p90, round(quantile_cont(latency, 0.95), 6) as p95, round(avg((tokens_in <= 5)::int), 6) as fallback_rate from {_COST} group by 1", "evaluations"))
def a17(spark, d):
    return stats.usage_summary(costs(spark, d), ["model"], F.col("tokens_in") <= 5).select("model", "n", *r6("total_cost"), F.round("mean_cost", 9).alias("mean_cost"), *r6("p50", "p90", "p95", "fallback_rate"))


@query("a19_selection_funnel", sql("select d, count(*) as n, count_if(has_event)::bigint as n_event, count_if(has_event and score > 0.3)::bigint as n_score, count_if(has_event and score > 0.3 and confidence > 0.7)::bigint as n_pool, count_if(has_event and score > 0.3 and not confidence > 0.7)::bigint as cut_by_volume from scores group by rollup(d)", "scores"))
def a19(spark, d):
    return stats.selection_funnel(v.scores(spark, d), "d", F.col("has_event"), F.col("score") > 0.3, F.col("confidence") > 0.7)


@query("a20_ic_sweep", sql(f"select k, round(ic, 6) as ic, n, coalesce(ic >= lag(ic) over (order by k), true) as rising from {_ic('(select round(confidence, 1) as k, score, y from signals)', 'k', 'score', 'y')}", "signals"))
def a20(spark, d):
    return stats.ic_sweep(v.signals(spark, d).withColumn("k", F.round("confidence", 1)), "k", "score", "y").select("k", *r6("ic"), "n", "rising")


_U = lambda x: v._u("asset", "d::varchar", f"'{x}'")


@query("a21_signal_sweep", sql(f"""with z as (select asset, d, y, case when count(y) over w >= 3 then (y - avg(y) over w) / (stddev_pop(y) over w + 1e-12) end as z from labels_y window w as (partition by d)),
    e as (select *, alpha, greatest(-1.0, least(1.0, alpha * z + sqrt(1 - alpha * alpha) * sqrt(-2 * ln(greatest({_U('n1')}, 1e-12))) * cos(2 * 3.141592653589793 * {_U('n2')}))) as signal from z, (values (0.0::double), (0.1::double), (0.2::double), (0.4::double)) a(alpha) where {_U('event')} < 0.15 and z is not null)
    select alpha, round(ic, 6) as ic, n from {_ic('e', 'alpha', 'signal', 'y')}""", "labels_y"))
def a21(spark, d):
    z = panel.zscore(v.labels(spark, d), ["d"], "y").withColumn("day", F.col("d").cast("string"))
    s = stats.signal_sweep(z, [0.0, 0.1, 0.2, 0.4], ["asset", "day"], "z")
    return stats.spearman(s, ["alpha"], "signal", "y").select("alpha", *r6("ic"), "n")


@query("a22_variant_report", sql(f"select model, round(ic, 6) as ic, n, k as n_distinct from {_ic('evaluations', 'model', 'score', 'y')} i join (select model, count(distinct round(score, 6)) as k from evaluations group by 1) using (model)", "evaluations"))
def a22(spark, d):
    return stats.variant_report(v.evaluations(spark, d), "model", "score", "y").select("model", *r6("ic"), "n", "n_distinct")


@query("a22_variant_gaps", sql(f"""with e as (select *, tokens_in > 20 as event, tokens_out::double as base from evaluations)
    select model, round(i.ic, 6) as ic, round(x.ic, 6) as ic_event, round(x.ic - b.ic, 6) as gap, i.n, k as n_distinct
    from {_ic('e', 'model', 'score', 'y')} i join {_ic('(select * from e where event)', 'model', 'score', 'y')} x using (model) join {_ic('(select * from e where event)', 'model', 'base', 'y')} b using (model)
    join (select model, count(distinct round(score, 6)) as k from evaluations group by 1) using (model)""", "evaluations"))
def a22_gaps(spark, d):
    e = v.evaluations(spark, d).withColumns({"event": F.col("tokens_in") > 20, "base": F.col("tokens_out").cast("double")})
    return stats.variant_report(e, "model", "score", "y", "event", "base").select("model", *r6("ic", "ic_event", "gap"), "n", "n_distinct")


@query("a23_latest_time", sql("select b.asset, b.d, m as latest from (select distinct asset, d from bars) b left join (select asset, published_at::date as d, max(published_at) as m from news group by 1, 2) using (asset, d)", "bars", "news"))
def a23(spark, d):
    m = v.news(spark, d).groupBy("asset", F.col("published_at").cast("date").alias("d")).agg(F.max("published_at").alias("latest"))
    return v.bars(spark, d).select("asset", "d").join(m, ["asset", "d"], "left")


@query("a24_sample_profile", sql("select strftime(d, '%Y-%m') as month, count(*) as n, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as sd, round(avg(y), 6) as y_mean, count(*) > 5 as crowded from evaluations where model = 'a' group by 1", "evaluations"))
def a24(spark, d):
    e = v.evaluations(spark, d).filter("model = 'a'").withColumn("month", F.date_format("d", "yyyy-MM"))
    return stats.sample_profile(e, ["month"], "score", "y").select("month", "n", *r6("mean", "sd", "y_mean"), "crowded")


@query("a25_run_profile", sql("select reason, coalesce(n, 0) as n from (values ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO'), ('none')) t(reason) left join (select reason, count(*) as n from trades group by 1) using (reason)", "trades"))
def a25(spark, d):
    reasons = spark.createDataFrame([(x,) for x in ("AF", "AO", "NF", "NO", "RF", "RO", "none")], "reason string")
    return stats.run_profile(v.trades(spark, d), reasons)


_PARTS = ("full", "clean")
_SUMMARY = [f"{c}_{part}" for part in _PARTS for c in ("ic", "lo", "hi", "gap")] + ["lexical_clean", "cost", "degraded_rate", "latency", "dispersion"]


@query("a18_version_table", sql(f"""with e as (select *, model || year(d)::varchar as version, tokens_in > 10 as clean, tokens_in <= 5 as degraded, tokens_out::double as lexical from {_COST}),
    p as (select *, 'full' as part from e union all select *, 'clean' from e where clean), {_boot('p', 'version, part', 'd', ['score'], 1000)},
    ci as (select version, part, quantile_cont(ic_score, 0.025) as lo, quantile_cont(ic_score, 0.975) as hi from reps where ic_score is not null group by 1, 2),
    m as (select i.version, i.part, i.n, i.ic, l.ic as lexical, i.ic - l.ic as gap, lo, hi from {_ic('p', 'version, part', 'score', 'y')} i join {_ic('p', 'version, part', 'lexical', 'y')} l on i.version = l.version and i.part = l.part left join ci on i.version = ci.version and i.part = ci.part),
    t as (select version, sum(cost) as cost, avg(degraded::int) as degraded_rate, quantile_cont(latency, 0.5) as latency, stddev_samp(score) filter (not degraded) as dispersion, (count(*) filter (not degraded and score = 0))::bigint as zeros from e group by 1)
    select t.version, f.n as n_full, c.n as n_clean, zeros, round(f.ic, 6) as ic_full, round(f.lo, 6) as lo_full, round(f.hi, 6) as hi_full, round(f.gap, 6) as gap_full, round(c.ic, 6) as ic_clean, round(c.lo, 6) as lo_clean, round(c.hi, 6) as hi_clean, round(c.gap, 6) as gap_clean,
           round(c.lexical, 6) as lexical_clean, round(cost, 6) as cost, round(degraded_rate, 6) as degraded_rate, round(latency, 6) as latency, round(dispersion, 6) as dispersion
    from t left join (select * from m where part = 'full') f using (version) left join (select * from m where part = 'clean') c using (version)""", "evaluations"))
def a18_table(spark, d):
    e = costs(spark, d).withColumns({"version": F.concat("model", F.year("d").cast("string")), "clean": F.col("tokens_in") > 10, "degraded": F.col("tokens_in") <= 5, "lexical": F.col("tokens_out").cast("double")})
    r = stats.version_summary(e, ["version"], "score", "lexical", "y", "clean", "degraded", "d")
    return r.select("version", "n_full", "n_clean", "zeros", *r6(*_SUMMARY))


@query("m4_plateau", sql(f"""with g as (select stage, avg(ic) as mean_ic, stddev_pop(ic) as sd from {_ic('(select *, month(d)::int as stage from evaluations)', 'model, stage', 'score', 'y')} group by 1),
    b as (select * from g order by mean_ic desc, stage limit 1), f as (select min(g.stage) as first from g, b where g.mean_ic >= b.mean_ic - 0.5 * b.sd)
    select g.stage, round(g.mean_ic, 6) as mean_ic, round(g.sd, 6) as sd, g.stage = case when first < 0.3 * b.stage then b.stage else first end as chosen from g, b, f""", "evaluations"))
def m4(spark, d):
    from ..operators.model import plateau_table

    ics = stats.spearman(v.evaluations(spark, d).withColumn("stage", F.month("d")), ["model", "stage"], "score", "y")
    return plateau_table(ics).select("stage", *r6("mean_ic", "sd"), "chosen")


@query("f19_verdict", sql(f"select asset, case when ic is null then 'undefined' when ic > 0.15 then 'strong' when ic >= 0.10 then 'good' when ic >= 0 then 'weak' else 'negative' end as verdict from {_ic('signals', 'asset', 'score', 'y')}", "signals"))
def f19(spark, d):
    return stats.spearman(v.signals(spark, d), ["asset"], "score", "y").select("asset", scalars.verdict(F.col("ic")).alias("verdict"))


@query("f20_choose_model", sql(f"with {_PAIR} select asset, case when b.ic - a.ic > 0.05 then 'B' else 'A' end as chosen from {_ic('pair', 'asset', 'score_a', 'y')} a join {_ic('pair', 'asset', 'score_b', 'y')} b using (asset)", "evaluations"))
def f20(spark, d):
    p = stats.paired_delta(pair(spark, d), ["asset"], "score_a", "score_b", "y")
    return p.select("asset", scalars.choose_model(-F.col("delta")).alias("chosen"))


@query("w19_worst_discordance", sql(f"select asset, d from (select *, row_number() over (partition by asset order by x, d) as rn from (select asset, d, ({_rank('score_a', 'asset')} / count(*) over (partition by asset) - 0.5) * ({_rank('y', 'asset')} / count(*) over (partition by asset) - 0.5) as x from (select * from pair))) where rn <= 5".join([f"with {_PAIR} ", ""]), "evaluations"))
def w19(spark, d):
    return stats.worst_discordance(pair(spark, d), ["asset"], "score_a", "y", 5, ["d"]).select("asset", "d")


_PREDS = "preds as (select k % 2 as portfolio, d, s.asset, sector, row_number() over (partition by d order by score desc, s.asset)::int as rank, score, volume / 20 as relative_volume from scores s join universe using (asset) join bars b using (asset, d)), held as (select portfolio, d, asset, sector from preds where asset in ('Brand#2', 'Brand#3', 'Brand#9'))"


def preds(spark, d):
    s = v.scores(spark, d).join(v.universe(spark, d), "asset").join(v.bars(spark, d).select("asset", "d", "volume"), ["asset", "d"])
    r = panel.rank_cross_section(s, ["d"], "score", "asset")
    return r.select((F.col("k") % 2).alias("portfolio"), "d", "asset", "sector", "rank", "score", (F.col("volume") / 20).alias("relative_volume"))


@query("b1_select_entries", sql(f"""with {_PREDS}, pool as (select p.* from preds p where score > 0.30 and relative_volume > 1.5 and not exists (select 1 from held h where h.portfolio = p.portfolio and h.d = p.d and h.asset = p.asset)),
    s as (select *, row_number() over (partition by portfolio, d, sector order by rank, asset) as rs, (select count(*) from held h where h.portfolio = pool.portfolio and h.d = pool.d and h.sector = pool.sector) as hs, (select count(*) from held h where h.portfolio = pool.portfolio and h.d = pool.d) as ha from pool),
    t as (select *, row_number() over (partition by portfolio, d order by rank, asset) as ra from s where rs <= 2 - hs) select portfolio, d, asset, sector, rank from t where ra <= 3 - ha""", "scores", "universe", "bars"))
def b1(spark, d):
    p = preds(spark, d)
    held = p.filter(F.col("asset").isin("Brand#2", "Brand#3", "Brand#9")).select("portfolio", "d", "asset", "sector")
    return pf.select_entries(p, held)


@query("b2_close_signals", sql("select asset, entry_d, d, case when late then 'deadline' else 'reversal' end as reason from (select asset, d - 4 as entry_d, d, score, date '1970-01-05' + ((t // 5) * 7 + t % 5)::int <= d as late from (select *, (k // 7) * 5 + least(k % 7, 4) + 3 as t from (select *, datediff('day', date '1970-01-05', d - 4) as k from scores))) where late or score < -0.3", "scores"))
def b2(spark, d):
    s = v.scores(spark, d)
    return pf.close_signals(s.select("asset", F.date_sub("d", 4).alias("entry_d"), "d"), s, bdays=3)


def entries(spark, d, price="close"):
    e = v.scores(spark, d).filter("has_event").join(v.bars(spark, d).select("asset", "d", price), ["asset", "d"])
    return e.select(F.concat_ws("|", "asset", F.col("d").cast("string")).alias("trade_id"), "asset", F.col("d").alias("entry_d"), F.col(price).alias("entry_px"))


def _exits(price: str, first: int, signals: bool) -> str:
    """Exits in SQL: entries at a bar's price, from how many sessions later they may stop or take, and whether signals close them."""
    reversal = "(select e.trade_id, min(s.ord) + 1 as r from e join scores x using (asset) join sessions s on s.d = x.d where s.ord > e.ord and s.ord < e.ord + 6 and x.score < -0.9 group by 1)" if signals else "(select null::varchar as trade_id, null::bigint as r)"
    return f"""with e as (select asset || '|' || d::varchar as trade_id, asset, d as entry_d, {price} as entry_px, ord from scores join bars b using (asset, d) join sessions s using (d) where has_event),
    g as (select e.*, least(e.ord + 6, coalesce(r, e.ord + 6)) as due, case when r < e.ord + 6 then 'reversal' else 'deadline' end as by_what from e left join {reversal} q using (trade_id)),
    mx as (select max(ord) as m from sessions),
    h as (select trade_id, s.d, case when low <= 0.92::double * entry_px then 'stop' else 'take' end as why, case when low <= 0.92::double * entry_px then 0.92::double * entry_px else 1.15::double * entry_px end as px from g join sessions s on s.ord >= g.ord + {first} and s.ord < due join bars b on b.asset = g.asset and b.d = s.d where low <= 0.92::double * entry_px or high >= 1.15::double * entry_px),
    f as (select trade_id, min(d) as hit_d, arg_min(why, d) as why, arg_min(px, d) as px from h group by 1),
    u as (select g.*, s.d as due_d, due > m as open_ended from g, mx join sessions s on s.ord = least(due, m)),
    k as (select u.*, b.d as bar_d, b.open, b.close from u asof left join bars b on u.asset = b.asset and u.due_d >= b.d),
    x as (select k.trade_id, k.asset, entry_d, entry_px, coalesce(hit_d, due_d) as exit_d, coalesce(px, case when open_ended then coalesce(close, entry_px) when bar_d = due_d then open else coalesce(close, entry_px) end) as exit_px, coalesce(why, case when open_ended then 'end of window' else by_what end) as reason from k left join f using (trade_id))
    select trade_id, asset, entry_d, exit_d, exit_px, reason from x"""


@query("b3_resolve_exits", sql(_exits("close", 1, False), "scores", "bars", "sessions"))
def b3(spark, d):
    x = pf.resolve_exits(entries(spark, d), v.bars(spark, d), v.sessions(spark, d))
    return x.select("trade_id", "asset", "entry_d", "exit_d", "exit_px", "reason")


@query("b3_exits_from_open", sql(_exits("open", 0, False), "scores", "bars", "sessions"))
def b3_open(spark, d):
    x = pf.resolve_exits(entries(spark, d, "open"), v.bars(spark, d), v.sessions(spark, d), from_entry=True)
    return x.select("trade_id", "asset", "entry_d", "exit_d", "exit_px", "reason")


@query("b4_reversal_exits", sql(_exits("close", 1, True), "scores", "bars", "sessions"))
def b4(spark, d):
    e = entries(spark, d)
    late = F.col("d").between(F.date_add("entry_d", 1), F.date_add("entry_d", 60))
    signals = e.select("trade_id", "asset", "entry_d").join(v.scores(spark, d).filter("score < -0.9").select("asset", "d"), "asset").filter(late).select("trade_id", "d")
    x = pf.resolve_exits(e, v.bars(spark, d), v.sessions(spark, d), reversals=signals)
    return x.select("trade_id", "asset", "entry_d", "exit_d", "exit_px", "reason")


@query("b5_end_of_window", sql(_exits("close", 1, False) .replace("select trade_id, asset, entry_d, exit_d, exit_px, reason from x", "select trade_id, exit_d, round(exit_px, 6) as exit_px, round(0.004 * 100 * exit_px, 6) as exit_cost, round((exit_px - entry_px) * 100 - 0.004 * 100 * (entry_px + exit_px), 6) as net from x where reason = 'end of window'"), "scores", "bars", "sessions"))
def b5(spark, d):
    x = pf.resolve_exits(entries(spark, d), v.bars(spark, d), v.sessions(spark, d)).filter("reason = 'end of window'").withColumn("qty", F.lit(100))
    return pf.trade_pnl(x).select("trade_id", "exit_d", *r6("exit_px"), F.round(0.004 * F.col("qty") * F.col("exit_px"), 6).alias("exit_cost"), *r6("net"))


@query("b6_size_orders", sql("select portfolio, e.d, (case when b.open > 0 then floor(0.15::double * equity / b.open) else 0 end)::bigint as qty, case when b.open is null or b.open <= 0 then 'no price' when floor(0.15::double * equity / b.open) = 0 then 'too small' end as skipped from equity e left join bars b on b.asset = 'Brand#' || (portfolio + 1) and b.d = e.d", "equity", "bars"))
def b6(spark, d):
    e = v.equity(spark, d).withColumn("asset", F.concat(F.lit("Brand#"), (F.col("portfolio") + 1).cast("string")))
    return pf.size_orders(e.join(v.bars(spark, d).select("asset", "d", "open"), ["asset", "d"], "left")).select("portfolio", "d", "qty", "skipped")


@query("b7_trade_pnl", sql("select trade_id, portfolio, gross, costs, net from trades", "trades"))
def b7(spark, d):
    return v.trades(spark, d).select("trade_id", "portfolio", "gross", "costs", "net")


@query("b8_equity_curve", sql("""with t as (select portfolio, 'Brand#' || (portfolio + 1) as asset, entry_d, exit_d, qty, entry_px, exit_px, costs from trades),
    x as (select portfolio, asset, entry_d as d, qty as q, qty * entry_px as c, -qty * entry_px as x from t union all select portfolio, asset, exit_d, -qty, -qty * entry_px, qty * exit_px - costs from t
        union all select portfolio, asset, s.d, 0, 0, 0 from (select distinct portfolio, asset from t), sessions s),
    g as (select portfolio, asset, d, sum(q) as q, sum(c) as c, sum(x) as x from x group by all),
    r as (select portfolio, asset, d, sum(q) over w as q, sum(c) over w as c, sum(x) over w as x from g window w as (partition by portfolio, asset order by d rows unbounded preceding))
    select r.portfolio, r.d, round(100000 + sum(x + case when b.close is null then c else q * b.close end) + 3.3e-7, 2) as equity from r asof left join bars b on b.asset = r.asset and r.d >= b.d where exists (select 1 from sessions s where s.d = r.d) group by 1, 2""", "trades", "sessions", "bars"))
def b8(spark, d):
    t = v.trades(spark, d).withColumn("asset", F.concat(F.lit("Brand#"), (F.col("portfolio") + 1).cast("string")))
    # amounts in whole cents lie on ties of rounding; both engines round them a little off
    return pf.equity_curve(t, v.bars(spark, d), v.sessions(spark, d)).select("portfolio", "d", F.round(F.col("equity") + 3.3e-7, 2).alias("equity"))


@query("b9_cooldown_gate")
def b9(spark, d):
    return pf.cooldown_gate(v.equity(spark, d), ["portfolio"], limit=0.02)


_DQ = "select unnest(string_split(q, '|')) as kind, d, asset from (select asset, d, concat_ws('|', case when volume < 20 then 'zero volume' end, case when abs(close / lag(close) over (partition by asset order by d) - 1) > 0.30 then 'large move' end) as q from bars) where q <> ''"


@query("b10_dq_events", sql(_DQ, "bars"))
def b10(spark, d):
    b = panel.quality_flags(v.bars(spark, d).withColumn("volume", F.when(F.col("volume") < 20, 0).otherwise(F.col("volume"))), ["asset"])
    return pf.dq_events(b.filter("quality <> ''").withColumn("why", F.split("quality", "\\|")), "why", "d", "asset")


@query("a25_top_warnings", sql(f"select kind, n, f.d as first_d, f.asset as first_asset from (select kind, count(*) as n, min({{'d': d, 'asset': asset}}) as f from ({_DQ}) group by 1) order by n desc, kind limit 5", "bars"))
def a25_warnings(spark, d):
    return stats.top_warnings(b10(spark, d))


@query("b11_attribution", sql("select portfolio, reason, n, round(total, 4) as total, round(mean, 4) as mean, round(hit_rate, 6) as hit_rate, round(total / nullif(sum(total) over (partition by portfolio), 0), 6) as share from (select portfolio, reason, count(*) as n, sum(net) as total, avg(net) as mean, avg((net > 0)::int) as hit_rate from trades group by 1, 2)", "trades"))
def b11(spark, d):
    a = pf.attribution(v.trades(spark, d), ["portfolio"], "reason")
    return a.select("portfolio", "reason", "n", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"), *r6("hit_rate", "share"))


@query("b12_trade_stats", sql("select portfolio, n, winners, losers, round(winners / n, 6) as hit_rate, round(case when winners > 0 and losers > 0 then aw / al when winners > 0 then 'inf'::double when losers > 0 then 0 end, 6) as payoff, round(case when winners > 0 and losers > 0 then w / l when winners > 0 then 'inf'::double when losers > 0 then 0 end, 6) as profit_factor from (select portfolio, count(*) as n, count_if(net > 0)::bigint as winners, count_if(net < 0)::bigint as losers, sum(net) filter (net > 0) as w, -sum(net) filter (net < 0) as l, avg(net) filter (net > 0) as aw, -avg(net) filter (net < 0) as al from trades group by 1)", "trades"))
def b12(spark, d):
    return pf.trade_stats(v.trades(spark, d), ["portfolio"]).select("portfolio", "n", "winners", "losers", *r6("hit_rate", "payoff", "profit_factor"))


@query("b13_risk_stats", sql("with r as (select * from (select portfolio, equity / lag(equity) over (partition by portfolio order by d) - 1 as ret from equity) where ret is not null) select portfolio, count(*) as n, round(stddev_samp(ret) * sqrt(252), 6) as vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) as sharpe, round(avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252), 6) as sortino from r group by 1", "equity"))
def b13(spark, d):
    return pf.risk_stats(v.equity(spark, d), ["portfolio"]).select("portfolio", "n", *r6("vol", "sharpe", "sortino"))


@query("b14_drawdown_stats", sql("""with e as (select *, row_number() over w as i, max(equity) over (w rows unbounded preceding) as top from equity window w as (partition by portfolio order by d)),
    f as (select *, (equity - top) / top as dd, max(case when equity = top then i end) over (partition by portfolio order by i rows unbounded preceding) as at_top from e),
    t as (select * from (select *, row_number() over (partition by portfolio order by dd, i) as rn from f) where rn = 1)
    select t.portfolio, round(t.dd, 6) as max_drawdown, (case when t.dd < 0 then t.i - t.at_top else 0 end)::int as length, (case when t.dd < 0 then (select min(e.i) from e where e.portfolio = t.portfolio and e.i > t.i and e.equity >= t.top) - t.i end)::int as recovery from t""", "equity"))
def b14(spark, d):
    return pf.drawdown_stats(v.equity(spark, d), ["portfolio"]).select("portfolio", *r6("max_drawdown"), F.col("length").cast("int").alias("length"), F.col("recovery").cast("int").alias("recovery"))


@query("b15_return_stats", sql("select portfolio, n, round(r, 6) as total_return, round(pow(1 + r, 252.0 / n) - 1, 6) as annual_return from (select portfolio, count(*) - 1 as n, arg_max(equity, d) / arg_min(equity, d) - 1 as r from equity group by 1)", "equity"))
def b15(spark, d):
    return pf.return_stats(v.equity(spark, d), ["portfolio"]).select("portfolio", "n", *r6("total_return", "annual_return"))


@query("b16_risk_free", sql("select portfolio, round(coalesce(avg(m.value) / 100, 0), 6) as rate, case when avg(m.value) is null then 'none' else 'series' end as label from (select portfolio, min(d) as a, max(d) as b from equity group by 1) left join macro m on m.series = '1-URGENT' and m.ref_date between a and b group by 1", "equity", "macro"))
def b16(spark, d):
    w = v.equity(spark, d).groupBy("portfolio").agg(F.min("d").alias("start"), F.max("d").alias("stop"))
    return pf.risk_free(w, v.macro(spark, d), "1-URGENT").select("portfolio", *r6("rate"), "label")


_REPS = 1000
_NUMBERED = f"t as (select portfolio, trade_id, net, row_number() over (partition by portfolio order by trade_id, net) - 1 as i, count(*) over (partition by portfolio) as n, {v.group_word('portfolio')} as g from trades), {v.words('(select portfolio, i, n, g from t)', 'i', _REPS)}"
_RUN = """e as (select *, greatest(100000, max(eq) over (partition by portfolio, rep order by slot rows unbounded preceding)) as top from q),
    paths as (select portfolio, rep, arg_max(eq, slot) / 100000 - 1 as ret, least(0, min((eq - top) / top)) as max_drawdown from e group by 1, 2)"""
_DRAW = f"""{_NUMBERED}, q as (select p.portfolio, p.rep, p.i as slot, 100000 + sum(t.net) over w as eq from words p join t on t.portfolio = p.portfolio and t.i = ((p.word * p.n::ubigint) >> 32)::bigint
        window w as (partition by p.portfolio, p.rep order by p.i rows unbounded preceding)), {_RUN}"""
_SHUFFLE = f"""{_NUMBERED}, q as (select p.portfolio, p.rep, row_number() over w as slot, 100000 + sum(t.net) over w as eq from words p join t on t.portfolio = p.portfolio and t.i = p.i
        window w as (partition by p.portfolio, p.rep order by p.word, p.i rows unbounded preceding)), {_RUN}"""


@query("b17_bootstrap_trades", sql(f"with {_DRAW} select portfolio, rep::int as rep, round(ret, 6) as ret, round(max_drawdown, 6) as max_drawdown from paths", "trades"))
def b17(spark, d):
    return pf.bootstrap_trades(v.trades(spark, d), ["portfolio"], "trade_id", _REPS).select("portfolio", "rep", *r6("ret", "max_drawdown"))


@query("b18_permute_trades", sql(f"with {_SHUFFLE} select portfolio, rep::int as rep, round(ret, 6) as ret, round(max_drawdown, 6) as max_drawdown from paths", "trades"))
def b18(spark, d):
    return pf.permute_trades(v.trades(spark, d), ["portfolio"], "trade_id", _REPS).select("portfolio", "rep", *r6("ret", "max_drawdown"))


@query("b19_distribution_summary", sql(f"with {_DRAW} select portfolio, round(quantile_cont(ret, 0.05), 6) as p05, round(quantile_cont(ret, 0.5), 6) as p50, round(quantile_cont(ret, 0.95), 6) as p95, round(avg(ret), 6) as mean, round(stddev_pop(ret), 6) as sd, avg((ret > 0)::int) as p_gain, avg((max_drawdown > -0.2)::int) as p_shallow from paths group by 1", "trades"))
def b19(spark, d):
    paths = pf.bootstrap_trades(v.trades(spark, d), ["portfolio"], "trade_id", _REPS)
    return pf.distribution_summary(paths, ["portfolio"]).select("portfolio", *r6("p05", "p50", "p95", "mean", "sd"), "p_gain", "p_shallow")


@query("b19_final_report")
def b19_final(spark, d):
    """Both kinds of replicates at the 10,000 of a final report; SQL would make a row of each draw."""
    told = pf.distribution_summary(pf.replicate_trades(v.trades(spark, d), ["portfolio"], "trade_id", floor=pf.A_FLOOR), ["portfolio", "kind"])
    return told.select("portfolio", *(c for c in told.columns if c not in ("portfolio", "kind")), "kind")
