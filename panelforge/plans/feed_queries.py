"""Queries of feeds that are rendered from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filings, stats
from ..operators import news as nw
from ..sources import feeds
from ..sources.shared import new_path
from . import views as v
from .news_queries import raw_feed
from .registry import query
from .stats_queries import _ic
from .views import sql

def _url():
    return F.concat(F.lit("http://"), F.col("source"), F.lit(".com/"), F.col("news_id").cast("string"))


@query("s6_normalize_curated_news", sql("select news_id, concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(body), '')) as body, case when news_id % 10 = 0 then 'unknown' else source end as source, case when news_id % 7 = 0 then 1.0::double else source_weight end as source_weight from news", "news"))
def s6(spark, d):
    raw = v.news(spark, d).select(
        F.col("news_id").cast("string").alias("url"), F.col("asset").alias("ticker"), F.col("title").alias("titulo"), F.col("title").alias("resumo_ia"), F.col("body").alias("corpo"), "published_at",
        F.when(F.col("news_id") % 10 != 0, F.col("source")).alias("fonte"), F.when(F.col("news_id") % 7 == 0, "?").otherwise(F.col("source_weight").cast("string")).alias("peso"),
    )
    return feeds.normalize_curated_news(raw).select(F.col("url").cast("bigint").alias("news_id"), "body", "source", "source_weight")


@query("s7_normalize_feed_a", sql("select 'http://' || source || '.com/' || news_id as url, title, source, strftime(published_at, '%Y-%m-%d %H:%M') as published_at from news where published_at <= timestamp '2000-01-20'", "news"))
def s7(spark, d):
    item = F.struct("title", _url().alias("url"), F.col("source").alias("domain"), F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    raw = v.news(spark, d).groupBy("asset").agg(F.to_json(F.struct(F.collect_list(item).alias("articles"))).alias("payload"))
    return feeds.normalize_feed_a(raw, "2000-01-20 00:00:00").select("url", "title", "source", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"))


@query("s8_normalize_feed_b", sql("select 'http://' || source || '.com/' || news_id as url, source || '.com' as source, trim(title || ' ' || source) as body from news where published_at between timestamp '2000-01-05' and timestamp '2000-02-04'", "news"))
def s8(spark, d):
    item = F.struct("title", F.col("title").alias("description"), F.col("source").alias("content"), _url().alias("url"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"))
    raw = v.news(spark, d).groupBy("asset").agg(F.to_json(F.struct(F.collect_list(item).alias("articles"))).alias("payload"))
    return feeds.normalize_feed_b(raw, "1999-01-01 00:00:00", "2000-02-04 00:00:00").select("url", "source", "body")


@query("s9_normalize_macro", sql("select series, ref_date, round(value, 2) as value from macro", "macro"))
def s9(spark, d):
    item = F.struct(F.date_format("ref_date", "dd/MM/yyyy").alias("data"), F.round("value", 2).cast("string").alias("valor"))
    raw = v.macro(spark, d).groupBy("series").agg(F.to_json(F.collect_list(item)).alias("payload"))
    return feeds.normalize_macro_a(raw)


@query("t6_strip_boilerplate", sql("select news_id, trim(title) as text from news", "news"))
def t6(spark, d):
    text = F.concat(F.lit("Print\nShare\n"), F.col("title"), F.lit("\n<tag>\nCopyright someone 2000\nMenu"))
    return v.news(spark, d).select("news_id", F.trim(nw.strip_boilerplate(text)).alias("text"))


@query("t7_segment_columns", sql("select news_id as feed_id, case when news_id % 4 = 3 then 2 else 3 end::bigint as n_records, case when news_id % 4 = 3 then 0 else 1 end::int as column_rank from news", "news"))
def t7(spark, d):
    """The second column holds a record of its own and, of every other feed, the first column's notice again; of a fourth it is empty."""
    k = F.col("feed_id")
    own = F.concat(F.lit(" 01/02/2003 04:05:06[SRC2]\nOther column of feed "), k.cast("string"), F.lit("\nsaid there\n"))
    other = F.when(k % 4 != 3, F.concat(own, F.when(k % 2 == 0, F.col("notice")).otherwise(F.lit("")))).otherwise(F.lit(""))
    f = raw_feed(spark, d).withColumn("other", other)
    return nw.segment_columns(f, ["text", "other"], ["feed_id"]).groupBy("feed_id").agg(F.count("*").alias("n_records"), F.max("column_rank").alias("column_rank"))


@query("a13_placebo_delta", sql(f"with pair as (select a.asset, a.d, a.score as score_a, b.score as score_b, a.y from evaluations a join evaluations b on a.event_id = b.event_id and a.model = 'a' and b.model = 'b') select year, round(a.ic - b.ic, 6) as delta from {_ic('(select *, year(d) as year from pair)', 'year', 'score_a', 'y')} a join {_ic('(select *, year(d) as year from pair)', 'year', 'score_b', 'y')} b using (year)", "evaluations"))
def a13(spark, d):
    from .stats_queries import pair

    p = pair(spark, d).withColumn("year", F.year("d").cast("bigint"))
    return stats.paired_delta(p, ["year"], "score_a", "score_b", "y").select("year", F.round("delta", 6).alias("delta"))


@query("a18_version_summary", sql("select model, version, round(sum(cost) over w, 4) as running_cost, round(ic - first_value(ic) over w, 6) as vs_first from (select model, year(d)::bigint as version, sum(tokens_in) / 1000.0 as cost, avg(score) as ic from evaluations group by 1, 2) window w as (partition by model order by version)", "evaluations"))
def a18(spark, d):
    e = v.evaluations(spark, d).groupBy("model", F.year("d").cast("bigint").alias("version")).agg((F.sum("tokens_in") / 1000.0).cast("double").alias("cost"), F.avg("score").alias("ic"))
    r = filings.versions_running(e, ["model"])
    return r.select("model", "version", F.round("running_cost", 4).alias("running_cost"), F.round("vs_first", 6).alias("vs_first"))


def filings_file(spark, d):
    """Statement lines as a delimited file of text; some versions, dates and values can't be read."""
    lines = v.statement_lines(spark, d)
    e = F.col("entity")
    rows = lines.select(
        e.cast("string").alias("CD_CVM"), F.lit("çã").alias("CNPJ_CIA"), F.col("ref_date").cast("string").alias("DT_REFER"),
        F.when(e % 9 == 0, "sem data").otherwise(F.date_add("ref_date", 30).cast("string")).alias("DT_RECEB"), F.when(e % 5 == 0, "x").otherwise(F.col("version").cast("string")).alias("VERSAO"),
        F.lit("ÚLTIMO").alias("ORDEM_EXERC"), F.col("account").alias("CD_CONTA"), F.col("account").alias("DS_CONTA"), F.when(F.month("ref_date") == 6, "N/A").otherwise(F.format_string("%.2f", "value")).alias("VL_CONTA"), F.lit("z").alias("OTHER"),
    )
    path = new_path(spark, "filings")
    rows.write.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).csv(path)
    return feeds.read_filings(spark, path)


_FILED = "select entity::int as entity, ref_date, case when entity % 9 <> 0 then ref_date + 30 end as received_on, case when entity % 5 = 0 then 0 else version end as version, account, case when month(ref_date) <> 6 then round(value, 2) end as value from statement_lines"


@query("s2_read_filings", sql(_FILED, "statement_lines"))
def s2(spark, d):
    f = filings_file(spark, d).filter("ORDEM_EXERC = 'ÚLTIMO' and CNPJ_CIA = 'çã'")
    return f.select(F.col("CD_CVM").alias("entity"), F.col("DT_REFER").alias("ref_date"), F.col("DT_RECEB").alias("received_on"), F.col("VERSAO").alias("version"), F.col("CD_CONTA").alias("account"), F.round("VL_CONTA", 2).alias("value"))


@query("s4_write_filings", sql(f"select 'annual' as kind, year(ref_date)::int as year, count(*) as n, round(sum(value), 2) as total from ({_FILED}) group by 2", "statement_lines"))
def s4(spark, d):
    path = new_path(spark, "filings-parquet")
    feeds.write_filings(filings_file(spark, d), path, "annual")
    return spark.read.parquet(path).groupBy("kind", "year").agg(F.count("*").alias("n"), F.round(F.sum("VL_CONTA"), 2).alias("total"))


@query("s5_read_news_csv", sql("select news_id, asset, title, source, case when news_id % 11 = 0 then 1.0 else source_weight end as source_weight, strftime(published_at, '%Y-%m-%d %H:%M:%S') as published_at from (select *, row_number() over () as rn from news) where title <> ''", "news"))
def s5(spark, d):
    n = v.news(spark, d).filter("title <> ''")
    path = new_path(spark, "news")
    rows = n.select(
        F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("data"), F.col("asset").alias("ticker"), F.col("title").alias("titulo"), F.col("source").alias("fonte"), F.col("news_id").cast("string").alias("url"),
        F.when(F.col("news_id") % 11 == 0, "heavy").otherwise(F.col("source_weight").cast("string")).alias("peso"), F.col("body").alias("corpo"), F.lit("").alias("resumo_ia"),
    )
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    r = feeds.normalize_curated_news(feeds.read_news_csv(spark, path))
    return r.select(F.col("url").cast("bigint").alias("news_id"), "asset", "title", "source", "source_weight", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("s11_normalize_earnings", sql("select entity, announced_on, round(realized, 2) as realized, round(estimated, 2) as estimated, round(1.5::double, 2) as surprise_pct, last_day(announced_on) as period_end, null::double as pe from earnings where entity % 6 <> 0", "earnings"))
def s11(spark, d):
    e = v.earnings(spark, d)
    sheet = e.select(
        F.when(F.col("entity") % 6 == 0, "n/a").otherwise(F.date_format("announced_on", "MM/dd/yyyy")).alias("Dt divulg"), F.col("entity").cast("string").alias("Per"), F.date_format("announced_on", "MM/yy").alias("Per ref"),
        F.coalesce(F.format_number("realized", 2), F.lit("N.M.")).alias("Divulgado"), F.lit("").alias("Comp"), F.format_number("estimated", 2).alias("Estimado"), F.lit("1.50%").alias("%Surp"), F.lit("N.M.").alias("Var prç%"),
    )
    r = feeds.normalize_earnings(sheet, "all").filter("comparable is null and move_pct is null")
    century = F.when(F.year("period_end") > 2050, F.add_months("period_end", -1200)).otherwise(F.when(F.year("announced_on") < 2000, F.add_months("period_end", -1200)).otherwise(F.col("period_end")))
    return r.select(F.col("period").cast("bigint").alias("entity"), "announced_on", *(F.round(c, 2).alias(c) for c in ("realized", "estimated", "surprise_pct")), F.last_day(century).alias("period_end"), "pe")


@query("s12_write_news_csv", sql("select asset, strftime(published_at, '%Y-%m-%d %H:%M:%S') as published_at, title, row_number() over (order by asset, published_at, title) - 1 as place from news where title <> ''", "news"))
def s12(spark, d):
    path = new_path(spark, "news-sorted")
    feeds.write_news_csv(v.news(spark, d).filter("title <> ''"), path)
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    # places in the order of the files, which have the ranges in turn
    parts = r.select("asset", "published_at", "title", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f"), F.monotonically_increasing_id().alias("i"))
    order = Window.partitionBy("f").orderBy("i")
    sizes = parts.groupBy("f").agg(F.count("*").alias("c"))
    before = sizes.select(F.col("f").alias("g"), "c").join(sizes.select("f"), F.col("g") < F.col("f")).groupBy("f").agg(F.sum("c").alias("before"))
    placed = parts.withColumn("k", F.row_number().over(order) - 1).join(before, "f", "left")
    return placed.select("asset", F.date_format(F.col("published_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("published_at"), "title", (F.coalesce("before", F.lit(0)) + F.col("k")).alias("place"))


@query("a10_evaluation_metrics", sql(f"""with e as (select *, tokens_in > 10 as clean, tokens_out::double as lexical from evaluations),
    m as (select 'full' as part, * from e union all select 'clean', * from e where clean),
    i as (select * from {_ic('(select model, part, score, y from m)', 'model, part', 'score', 'y')}), b as (select * from {_ic('(select model, part, lexical, y from m)', 'model, part', 'lexical', 'y')})
    select model, part, i.n, round(i.ic, 6) as ic, round(b.ic, 6) as baseline, round(i.ic - b.ic, 6) as gap, round(c.coverage, 6) as coverage from i join b using (model, part) join (select model, part, avg((score <> 0)::int) as coverage from m group by 1, 2) c using (model, part)""", "evaluations"))
def a10(spark, d):
    e = v.evaluations(spark, d).withColumns({"clean": F.col("tokens_in") > 10, "lexical": F.col("tokens_out").cast("double")})
    r = stats.evaluation_metrics(e, ["model"], "score", "lexical", "y", "clean")
    return r.select("model", "part", "n", *(F.round(c, 6).alias(c) for c in ("ic", "baseline", "gap", "coverage")))
