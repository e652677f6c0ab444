"""Queries of the universe, event, news and text families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import news as nw
from ..operators import universe as un
from . import views as v
from .registry import query
from .views import sql

_MEMBER = "(valid_from is null or valid_from <= d) and (valid_to is null or d <= valid_to)"


@query("p1_active_universe", sql(f"select d, asset, sector from sessions, universe where {_MEMBER}", "sessions", "universe"))
def p1(spark, d):
    return un.active_universe(v.sessions(spark, d).select("d"), v.universe(spark, d))


@query("p2_clip_to_membership", sql("select b.asset, b.d from bars b left join universe using (asset) where valid_to is null or d <= valid_to", "bars", "universe"))
def p2(spark, d):
    return un.clip_to_membership(v.bars(spark, d), v.universe(spark, d)).select("asset", "d")


@query("p3_asof_cut", "select event_id from events where ts <= timestamp '2024-01-15 12:00:00'")
def p3(spark, d):
    return un.asof_cut(v.table(spark, d, "events"), "ts", "2024-01-15 12:00:00").select("event_id")


@query("p4_news_window", sql("select news_id, asset from news where published_at between timestamp '2000-01-05' and timestamp '2000-01-20'", "news"))
def p4(spark, d):
    return un.window_rows(v.news(spark, d), "published_at", "2000-01-05 00:00:00", "2000-01-20 00:00:00").select("news_id", "asset")


@query("p5_lookahead_violations", "select event_type, count(*) as n from events where ts > timestamp '2024-01-25' group by 1")
def p5(spark, d):
    return un.lookahead_violations(v.table(spark, d, "events"), "ts", "2024-01-25 00:00:00").groupBy("event_type").agg(F.count("*").alias("n"))


_WHITE = [("src1", 0.9), ("src7", 0.75), ("src", 0.5)]


@query("p8_weight_sources", sql("select news_id, arg_min(w, ord) as weight from news, (values (0, 'src1', 0.9::double), (1, 'src7', 0.75::double), (2, 'src', 0.5::double)) t(ord, entry, w) where contains(source || ' ' || lower(asset), entry) group by 1", "news"))
def p8(spark, d):
    return un.weight_sources(v.news(spark, d).select("news_id", "source", "asset"), _WHITE, "source", "asset").select("news_id", "weight")


@query("p9_resolve_names", sql("select news_id, coalesce(case when substr(n.asset, 7)::int <= 20 then 'Company ' || substr(n.asset, 7) end, n.asset) as display from news n", "news"))
def p9(spark, d):
    names = v.universe(spark, d).filter("k <= 20").select("asset", F.concat(F.lit("Company "), F.col("k").cast("string")).alias("name"))
    return un.resolve_names(v.news(spark, d).select("news_id", "asset"), names).select("news_id", "display")


@query("p10_attach_sector", sql("select asset, d, sector from bars join universe using (asset)", "bars", "universe"))
def p10(spark, d):
    return un.attach_sector(v.bars(spark, d), v.universe(spark, d)).select("asset", "d", "sector")


@query("p11_sector_peer", sql(f"with act as (select d, asset, sector, k from sessions, universe where {_MEMBER}), o as (select *, row_number() over (partition by d, sector order by k) as rn from act) select a.d, a.asset, p.asset as peer from o a left join o p on a.d = p.d and a.sector = p.sector and p.rn = case when a.rn = 1 then 2 else 1 end", "sessions", "universe"))
def p11(spark, d):
    return un.sector_peer(v.sessions(spark, d).select("d"), v.universe(spark, d))


@query("p12_tag_exposure", sql("select news_id, case when published_at::date < date '2000-01-12' then 'seen' else 'unseen' end as segment, coalesce(published_at >= timestamp '2000-01-12', false) as clean from news", "news"))
def p12(spark, d):
    n = v.news(spark, d).withColumn("day", F.col("published_at").cast("date"))
    return un.tag_exposure(n, "day", "published_at", "2000-01-12").select("news_id", "segment", "clean")


@query("p13_is_fallback", sql("select asset, d, not has_event or confidence < 0.3 or score < -0.9 as fallback from scores", "scores"))
def p13(spark, d):
    s = v.scores(spark, d).withColumn("warnings", F.when(F.col("score") < -0.9, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return s.select("asset", "d", scalars.is_fallback(F.col("has_event"), F.col("confidence"), F.col("warnings")).alias("fallback"))


@query("p14_classify_degradation", "select event_id, case when event_type = 'error' then 'parse error' when event_type = 'view' then 'empty response' end as degradation from events")
def p14(spark, d):
    w = F.when(F.col("event_type") == "error", F.array(F.lit("a parse error"), F.lit("call failed"))).when(F.col("event_type") == "view", F.array(F.lit("empty response!"))).otherwise(F.array().cast("array<string>"))
    return v.table(spark, d, "events").select("event_id", scalars.classify_degradation(w).alias("degradation"))


@query("p15_was_evaluated", "select event_id, case when event_type = 'error' then false when event_type = 'click' then true else coalesce(user_id % 3 > 0, false) end as evaluated from events")
def p15(spark, d):
    t = F.col("event_type")
    return v.table(spark, d, "events").select("event_id", scalars.was_evaluated(F.when(t == "error", t), F.when(t == "click", t), F.col("user_id") % 3).alias("evaluated"))


@query("p16_score_degraded", sql("select asset, d, has_event and round(confidence, 1) = 0.5 as degraded from scores", "scores"))
def p16(spark, d):
    return v.scores(spark, d).select("asset", "d", scalars.score_degraded(F.col("has_event"), F.round("confidence", 1) - 0.5).alias("degraded"))


@query("p17_sector_members", sql("select sector, array_to_string(list_sort(list(asset)), ',') as assets from universe group by 1", "universe"))
def p17(spark, d):
    return un.sector_members(v.universe(spark, d)).select("sector", F.array_join("assets", ",").alias("assets"))


@query("j11_pair_scores", sql("select event_id, round(max(score) filter (model = 'a'), 6) as score_a, round(max(score) filter (model = 'b'), 6) as score_b, round(max(y) filter (model = 'a'), 6) as y from evaluations group by 1 having count(distinct model) = 2", "evaluations"))
def j11(spark, d):
    e = v.evaluations(spark, d)
    p = un.pair_scores(e.filter("model = 'a'"), e.filter("model = 'b'"), "event_id")
    return p.select("event_id", *(F.round(c, 6).alias(c) for c in ("score_a", "score_b", "y")))


@query("j12_build_context", sql("select asset, day, n, first_id, case when h.version is null then null else h.version end as version from (select asset, day, count(*) as n, min(news_id) as first_id from (select *, published_at::date as day, row_number() over (partition by asset, published_at::date order by source_weight desc, published_at desc, news_id) as rn from news) where rn <= 8 group by 1, 2) c asof left join (select entity, coalesce(received_on, ref_date + 45) as r, version from filing_headers where received_on is not null) h on substr(c.asset, 7)::int - 1 = h.entity and c.day >= h.r", "news", "filing_headers"))
def j12(spark, d):
    from ..operators.asof import asof_join
    from ..operators.panel import topk

    n = v.news(spark, d).withColumn("day", F.col("published_at").cast("date"))
    top = topk(n, ["asset", "day"], [F.desc("source_weight"), F.desc("published_at"), "news_id"], 8)
    c = top.groupBy("asset", "day").agg(F.to_json(F.array_sort(F.collect_list(F.struct("news_id", "title")))).alias("context"))
    c = c.withColumn("entity", F.substring("asset", 7, 9).cast("int") - 1)
    h = v.filing_headers(spark, d).filter("received_on is not null").withColumn("entity", F.col("entity").cast("int"))
    j = asof_join(c, h, ["entity"], "day", "received_on", ["version"])
    items = F.from_json("context", "array<struct<news_id: bigint, title: string>>")
    return j.select("asset", "day", F.size(items).cast("bigint").alias("n"), F.array_min(F.transform(items, lambda x: x["news_id"])).alias("first_id"), "version")


@query("j13_pending", sql("select event_id from evaluations group by 1 having count_if(model = 'a') > 0 and count_if(model = 'b' and tokens_in > 25) = 0", "evaluations"))
def j13(spark, d):
    e = v.evaluations(spark, d)
    return un.pending(e.filter("model = 'a'"), e.filter("model = 'b' and tokens_in > 25"), ["event_id"]).select("event_id")


@query("j13_alignment", sql("select count(*) as n, round(avg((a.tokens_in = b.tokens_in)::int), 6) as rate from evaluations a join evaluations b on a.event_id = b.event_id and a.model = 'a' and b.model = 'b'", "evaluations"))
def j13b(spark, d):
    e = v.evaluations(spark, d)
    return un.alignment(e.filter("model = 'a'"), e.filter("model = 'b'"), "event_id", ["tokens_in"]).select("n", F.round("rate", 6).alias("rate"))


@query("j14_sample_events", sql(f"""with near as (select asset, news_id, unnest(generate_series(published_at::date, published_at::date + 7, interval 1 day))::date as d from news),
    sets as (select asset, d, count(*) as n_news, sha256(array_to_string(list_sort(list(news_id::varchar)), '||')) as set_key from near group by 1, 2)
    select d, asset, n_news, set_key from (select s.d, u.asset, n_news, set_key, row_number() over (partition by u.asset, set_key order by s.d) as rn from sessions s join universe u on {_MEMBER} join sets on sets.asset = u.asset and sets.d = s.d where exists (select 1 from labels_y y where y.asset = u.asset and y.d = s.d)) where rn = 1""".replace("valid_from <= d)", "valid_from <= s.d)").replace("or d <= valid_to", "or s.d <= valid_to"), "sessions", "universe", "news", "labels_y"))
def j14(spark, d):
    return un.sample_events(v.sessions(spark, d), v.universe(spark, d), v.news(spark, d), v.labels(spark, d))


@query("j15_sample_random", sql("select event_id from evaluations where model = 'a' order by md5('42|' || event_id), event_id limit 50", "evaluations"))
def j15(spark, d):
    return un.sample_random(v.evaluations(spark, d).filter("model = 'a'"), ["event_id"], 50).select("event_id")


@query("a6_add_blocks", sql("select asset, d, floor((5 * (datediff('day', date '1970-01-05', d) // 7) + least(datediff('day', date '1970-01-05', d) % 7, 5) - (5 * (datediff('day', date '1970-01-05', date '1995-01-02') // 7) + least(datediff('day', date '1970-01-05', date '1995-01-02') % 7, 5))) / 5)::int as block from bars", "bars"))
def a6(spark, d):
    return un.add_blocks(v.bars(spark, d), "d", "1995-01-02").select("asset", "d", "block")


@query("u1_latest_version", sql("select entity, ref_date, account, version, round(value, 2) as value from (select *, row_number() over (partition by entity, ref_date, account order by version desc) as rn from statement_lines) where rn = 1", "statement_lines"))
def u1(spark, d):
    return nw.latest_version(v.statement_lines(spark, d), ["entity", "ref_date", "account"], "version", []).select("entity", "ref_date", "account", "version", F.round("value", 2).alias("value"))


@query("u2_latest_per_key", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def u2(spark, d):
    return nw.latest_per_key(v.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("u3_dedupe_exact", sql("select asset, title, min(news_id) as news_id, count(*) - 1 as n_dropped from news group by 1, 2", "news"))
def u3(spark, d):
    return nw.dedupe_exact(v.news(spark, d), ["asset", "title"], ["news_id"]).select("asset", "title", "news_id", "n_dropped")


_NORM = "left(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), 80)"


@query("u4_dedupe_fuzzy")
def u4(spark, d):
    n = v.news(spark, d)
    return nw.dedupe_fuzzy(n, ["asset"], "title", "published_at", ["source_weight"], "news_id").select("news_id", "asset")


@query("u4_fuzzy_pairs", sql(f"with t as (select news_id, asset, {_NORM} as t, epoch(published_at)::bigint as s, source_weight as w from news) select a.news_id as first, b.news_id as then_id from t a join t b on a.asset = b.asset and abs(a.s - b.s) < 86400 * 20 and (a.w > b.w or a.w = b.w and a.news_id < b.news_id) where length(a.t) > 0 and length(b.t) > 0 and 1 - levenshtein(a.t, b.t)::double / greatest(length(a.t), length(b.t)) > 0.85", "news"))
def u4b(spark, d):
    n = v.news(spark, d).select("news_id", "asset", scalars.normalize_title(F.col("title")).alias("t"), F.unix_timestamp(F.col("published_at").cast("timestamp")).alias("s"), F.col("source_weight").alias("w")).filter("length(t) > 0")
    n = n.withColumn("bucket", F.floor(F.col("s") / (86400 * 20)))
    o = n.select("asset", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.col("news_id").alias("then_id"), F.col("t").alias("t2"), F.col("s").alias("s2"), F.col("w").alias("w2"))
    j = n.join(o, ["asset", "bucket"]).filter("abs(s - s2) < 86400 * 20 and (w > w2 or w = w2 and news_id < then_id)")
    return j.filter(nw.levenshtein_ratio(F.col("t"), F.col("t2")) > 0.85).select(F.col("news_id").alias("first"), "then_id")


@query("u5_normalize_title", sql(f"select news_id, {_NORM} as title_norm from news", "news"))
def u5(spark, d):
    return v.news(spark, d).select("news_id", scalars.normalize_title(F.col("title")).alias("title_norm"))


_HASH = "left(sha256(concat_ws('|', source, strftime(published_at, '%Y-%m-%dT%H:%M:%S'), title)), 16)"


@query("u6_news_set_key", sql(f"select asset, published_at::date as day, count(*) as n, sha256(array_to_string(list_sort(list({_HASH})), '||')) as set_key from news group by 1, 2", "news"))
def u6(spark, d):
    n = v.news(spark, d).withColumn("day", F.col("published_at").cast("date"))
    return nw.news_set_keys(n, ["asset", "day"], scalars.news_hash(F.col("source"), F.col("published_at"), F.col("title")))


@query("u7_unify_sources")
def u7(spark, d):
    n = v.news(spark, d)
    return nw.unify_sources([n.filter("news_id % 2 = 0"), n.filter("news_id % 2 = 1")], ["asset"], "9999-01-01 00:00:00", 10, "title", "published_at", "source_weight", "news_id").select("asset", "news_id")


@query("u8_set_diff", sql("select asset, d, 'only left' as side from (select asset, d from bars except select asset, d from scores where has_event) union all select asset, d, 'only right' from (select asset, d from scores where has_event except select asset, d from bars)", "bars", "scores"))
def u8(spark, d):
    return nw.set_diff(v.bars(spark, d), v.scores(spark, d).filter("has_event"), ["asset", "d"])


@query("s10_coalesce_series", sql("select series, ref_date, round(value, 6) as value from macro where series in ('1-URGENT', '2-HIGH') union all select series, ref_date, round(value * 2, 6) from macro where series not in ('1-URGENT', '2-HIGH')", "macro"))
def s10(spark, d):
    m = v.macro(spark, d)
    from ..sources.feeds import coalesce_series

    out = coalesce_series(m.filter("series in ('1-URGENT', '2-HIGH')"), m.withColumn("value", F.col("value") * 2))
    return out.select("series", "ref_date", F.round("value", 6).alias("value"))


@query("s13_unify_news", sql("select asset, title, min(news_id % 3)::int as file_rank from news group by 1, 2", "news"))
def s13(spark, d):
    n = v.news(spark, d)
    return nw.unify_news([n.filter(f"news_id % 3 = {k}") for k in range(3)], ["asset", "title"]).select("asset", "title", "file_rank")


@query("s14_search_entities", "select c_custkey from customer where regexp_matches(c_name, '(?i)customer#0+1') or regexp_matches(c_mktsegment, '(?i)customer#0+1')")
def s14(spark, d):
    from ..sources.feeds import search_entities

    return search_entities(v.table(spark, d, "customer"), "customer#0+1", ["c_name", "c_mktsegment"]).select("c_custkey")


@query("s15_entity_key_map", "select c_nationkey as id, max(c_name) as name from customer group by 1")
def s15(spark, d):
    from ..sources.feeds import entity_key_map

    return entity_key_map(v.table(spark, d, "customer"), "c_nationkey", "c_name", "c_custkey").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"))


def raw_feed(spark, d):
    """Every document as a feed of two records, its whole text and a short notice, which a fifth of the feeds tell twice; of some the time or the source code is none."""
    n = v.news(spark, d)
    k = F.col("news_id")
    title = F.regexp_replace("title", "[*•-]|^By ", "")
    rest = F.substr("body", F.length("title") + 1)
    at = F.date_format("published_at", "MM/dd/yyyy HH:mm:ss")
    first = F.concat(F.lit(" "), F.when(k % 11 == 0, F.regexp_replace(at, "^..", "13")).otherwise(at), F.lit("["), F.upper("source"), F.lit("]\nPrint\n"), title, rest, F.lit("\n"))
    dateline = F.when(k % 3 == 0, F.lit("By A Writer\n")).when(k % 3 == 1, F.lit("(City) -- ")).otherwise(F.lit(""))
    second = F.concat(F.lit(" "), at, F.lit("[SRC1]\nNotice that closes feed "), k.cast("string"), F.lit("\n"), dateline, F.lit("of source "), "source", F.lit("\n"))
    return n.select(k.alias("feed_id"), F.concat(F.lit("Menu\nShare\n"), first, second, F.when(k % 5 == 4, second).otherwise(F.lit(""))).alias("text"), second.alias("notice"))


#: The same records in SQL: (news_id, part, bad, source, record).
_RECORDS = r"""rec as (
    select news_id, 1 as part, news_id % 11 = 0 as bad, source, published_at, trim(regexp_replace(title, '[*•-]|^By ', '', 'g'), ' ') as title, chr(10) || regexp_replace(title, '[*•-]|^By ', '', 'g') || substr(body, length(title) + 1) || chr(10) as record from news
    union all
    select news_id, unnest(range(2, case when news_id % 5 = 4 then 4 else 3 end)), false, 'src1', published_at, 'Notice that closes feed ' || news_id, chr(10) || 'Notice that closes feed ' || news_id || chr(10) || case news_id % 3 when 0 then 'By A Writer' || chr(10) when 1 then '(City) -- ' else '' end || 'of source ' || source || chr(10) from news)"""
_CODES = "case when substr(source, 4)::int < 10 then source else 'other' end"


def parsed(spark, d):
    codes = spark.createDataFrame([(f"SRC{k}", f"src{k}") for k in range(10)], "code string, name string")
    rec = nw.parse_anchor(nw.segment_records(raw_feed(spark, d), "text"), codes)
    return rec.withColumn("title", nw.extract_title(F.col("record")))


@query("t1_segment_records", sql(f"with {_RECORDS} select news_id as feed_id, count(*) as n_records from rec group by 1", "news"))
def t1(spark, d):
    return nw.segment_records(raw_feed(spark, d), "text").groupBy("feed_id").agg(F.count("*").alias("n_records"))


@query("t2_parse_anchor", sql(f"with {_RECORDS} select news_id as feed_id, case when not bad then strftime(published_at, '%Y-%m-%d %H:%M:%S') end as published_at, {_CODES} as source from rec", "news"))
def t2(spark, d):
    return parsed(spark, d).select("feed_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "source")


@query("t3_extract_title", sql(f"with {_RECORDS} select news_id as feed_id, 2 as part, title from rec where part >= 2", "news"))
def t3(spark, d):
    return parsed(spark, d).filter("title like 'Notice that closes feed %'").select("feed_id", F.lit(2).alias("part"), "title")


@query("t4_extract_summary", sql("select news_id, asset || ' has weight ' || source || ' ends' as summary from news", "news"))
def t4(spark, d):
    record = F.concat(F.lit(" 01/02/2000 03:04:05[SRC1]\n"), "title", F.lit("\nSummary by us\n - "), "asset", F.lit("  has\n*\tweight "), "source", F.lit("\n• ends\nBy A Writer\n"), "body")
    return v.news(spark, d).select("news_id", nw.extract_summary(record).alias("summary"))


@query("t5_extract_body", sql(f"with {_RECORDS} select news_id as feed_id, case news_id % 3 when 1 then '(City) -- ' else '' end || 'of source ' || n.source as body from rec join news n using (news_id) where part >= 2", "news"))
def t5(spark, d):
    return parsed(spark, d).filter("title like 'Notice that closes feed %'").select("feed_id", nw.extract_body(F.col("record")).alias("body"))


@query("t8_detect_content_column", sql(f"with {_RECORDS} select case when count(*) filter (part = 1) >= count(*) then 0 else 1 end as place from rec", "news"))
def t8(spark, d):
    f = raw_feed(spark, d).withColumn("short", F.left("text", F.lit(50)))
    return nw.detect_content_column(f, ["short", "text"])


@query("t9_parse_report", sql(f"with {_RECORDS} select {_CODES} as source, count(*) as n_records, count_if(bad)::bigint as n_bad_date, count_if({_CODES} = 'other')::bigint as n_unknown, count_if(part = 3)::bigint as n_again from rec group by 1", "news"))
def t9(spark, d):
    return nw.parse_report(parsed(spark, d)).drop("n_bad_title")


@query("t10_parse_percent", "select event_id, round(value, 2) as pct from events")
def t10(spark, d):
    return v.table(spark, d, "events").select("event_id", scalars.parse_percent(F.concat(F.format_number("value", 2), F.lit("%"))).alias("pct"))


@query("t11_parse_period_end", "select o_orderkey, last_day(case when year(o_orderdate) < 2000 then (o_orderdate + interval 100 year)::date else o_orderdate::date end) as period_end from orders")
def t11(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", scalars.parse_period_end(F.date_format("o_orderdate", "MM/yy")).alias("period_end"))


@query("t12_normalize_symbol", "select p_partkey, case when upper(p_brand) = 'BRAND#1' then 'BRAND#25' else upper(p_brand) end || '.SA' as symbol from part")
def t12(spark, d):
    return v.table(spark, d, "part").select("p_partkey", scalars.normalize_symbol(F.concat(F.lit(" "), F.col("p_brand")), {"BRAND#1": "BRAND#25"}, ".SA").alias("symbol"))


@query("t13_anonymize_entities", sql("select news_id, regexp_replace(title, case when news_id % 2 = 0 then 'the' else 'of' end, '[X]', 'gi') as title from news", "news"))
def t13(spark, d):
    n = v.news(spark, d).withColumn("k", (F.col("news_id") % 2).cast("int"))
    names = spark.createDataFrame([(0, "the", "[X]"), (1, "of", "[X]")], "k int, name string, replacement string")
    return nw.anonymize_entities(n, names, "k", ["title"]).select("news_id", "title")


@query("t14_audit_language", sql("select news_id, concat_ws(',', case when regexp_matches(lower(body), '(later|eventually)') then 'hindsight' end, case when regexp_matches(body, '[0-9]{4}') then 'year' end) as found from news", "news"))
def t14(spark, d):
    return v.news(spark, d).select("news_id", F.array_join(nw.audit_language(F.col("body"), {"hindsight": "(?i)(later|eventually)", "year": "[0-9]{4}"}), ",").alias("found"))


_LEX = {"the": 1, "les": 1, "die": 1, "of": -1, "des": -1, "der": -1}


@query("t15_lexical_sentiment", sql("with w as (select asset, unnest(regexp_extract_all(lower(body), '[a-zà-öø-ÿ]+')) as w from news), c as (select asset, count_if(w in ('the', 'les', 'die')) as n_pos, count_if(w in ('of', 'des', 'der')) as n_neg from w group by 1) select asset, n_pos::bigint as n_pos, n_neg::bigint as n_neg, round(coalesce((n_pos - n_neg) / nullif(n_pos + n_neg, 0), 0), 6) as sentiment from c", "news"))
def t15(spark, d):
    s = nw.lexical_sentiment(v.news(spark, d), _LEX, ["asset"], F.col("body"))
    return s.select("asset", "n_pos", "n_neg", F.round("sentiment", 6).alias("sentiment"))
