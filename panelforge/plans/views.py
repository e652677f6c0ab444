"""Views of the driver's tables as panel data, as DataFrames and as DuckDB SQL.

Each view is a pair: a function (spark, sf_dir) -> DataFrame and the SQL of the same rows.
`sql(body, views...)` puts the SQL of the views, and of those they need, before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"))
    return li.join(part, "l_partkey").select("asset", F.col("l_shipdate").cast("date").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = priced_lines(spark, sf_dir)
    return p.groupBy("asset", "d").agg(F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume"))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_shipdate").cast("date").alias("d")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.timeutil import session_table

    return session_table(index_bars(spark, sf_dir))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("p_brand", 7, 9).cast("int")
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("asset"), k.alias("k")).distinct()
    return b.select(
        "asset",
        "k",
        (F.col("k") % 5).alias("sector"),
        F.when(F.col("k") % 4 == 0, F.date_add(F.lit("1996-01-01").cast("date"), F.col("k") * 30)).alias("valid_from"),
        F.when(F.col("k") % 6 == 0, F.date_add(F.lit("2000-01-01").cast("date"), F.col("k") * 10)).alias("valid_to"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("ref_date")).agg((F.avg("o_totalprice") / 1000).alias("value"))


def filing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity")), "o_custkey")
    q = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2))
    h = o.select("entity", q.alias("ref_date"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("version")).groupBy("entity", "ref_date").agg(F.max("version").alias("version"))
    return h.withColumn("received_on", F.when(F.col("entity") % 7 != 0, F.date_add("ref_date", (F.col("entity") % 30 + 20).cast("int"))))


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity")), "o_custkey")
    q = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2))
    quarterly = o.groupBy("entity", q.alias("ref_date"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("version"), F.col("o_orderpriority").alias("account")).agg(F.round(F.sum("o_totalprice"), 2).alias("amount"))
    w = Window.partitionBy("entity", F.year("ref_date"), "version", "account").orderBy("ref_date").rowsBetween(Window.unboundedPreceding, 0)
    return quarterly.select("entity", "ref_date", "version", "account", F.sum("amount").over(w).alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, d): every nation on the first of every month of 1995 to 2001."""
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity"))
    return e.select("entity", F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month"))).alias("d"))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity")), "o_custkey").filter("o_orderpriority = '1-URGENT'")
    return o.groupBy("entity", F.col("o_orderdate").cast("date").alias("announced_on")).agg(F.when(F.max("o_orderkey") % 3 != 0, F.max("o_totalprice")).alias("realized"), F.min("o_totalprice").alias("estimated"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    src = F.substring("source", 4, 9).cast("int")
    return d.select(
        F.col("doc_id").alias("news_id"),
        F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("asset"),
        F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"),
        F.coalesce("text", F.lit("")).alias("body"),
        "source",
        (F.lit(1.0) - src % 5 * 0.125).alias("source_weight"),
        (F.unix_timestamp(F.lit("2000-01-01 00:00:00")) + F.col("doc_id") * 37 * 60).cast("timestamp").cast("timestamp_ntz").alias("published_at"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(bars(spark, sf_dir))


def scores_of(bars: DataFrame) -> DataFrame:
    b = bars.select("asset", "d")
    u = lambda n: hash_uniform(F.col("asset"), F.col("d").cast("string"), F.lit(n))
    return b.select("asset", "d", (u("u1") < 0.15).alias("has_event"), (2 * u("u2") - 1).alias("score"), (0.5 + 0.4 * u("u3")).alias("confidence"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, d, y): five-bar return less that of the benchmark."""
    return labels_of(bars(spark, sf_dir), index_bars(spark, sf_dir))


def labels_of(bars: DataFrame, index_bars: DataFrame) -> DataFrame:
    from ..operators.panel import forward_label

    b = bars.join(index_bars.withColumnRenamed("close", "bench"), "d").withColumn("beta", F.lit(1.0))
    return forward_label(b, ["asset"], "d").select("asset", "d", "y")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).join(labels(spark, sf_dir), ["asset", "d"])


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).filter("has_event")
    models = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model")
    e = s.select("asset", "d", "y", models)
    u = lambda n: hash_uniform(F.col("asset"), F.col("d").cast("string"), F.col("model"), F.lit(n))
    return e.select(
        F.concat_ws("|", "asset", F.col("d").cast("string")).alias("event_id"), "model", "asset", "d", (2 * u("s") - 1).alias("score"), "y",
        F.floor(1 + 50 * u("i")).cast("bigint").alias("tokens_in"), F.floor(1 + 20 * u("o")).cast("bigint").alias("tokens_out"), (4 + 2 * u("l")).alias("latency"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("entry_d"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("portfolio"), F.col("c_mktsegment").alias("sector"))
    li = table(spark, sf_dir, "lineitem").withColumn("exit_d", F.col("l_shipdate").cast("date"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, "o_custkey").filter("exit_d >= entry_d")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    j = j.select(
        "portfolio", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"), "sector", F.concat("l_returnflag", "l_linestatus").alias("reason"),
        "entry_d", "exit_d", F.col("l_quantity").alias("qty"), px.alias("entry_px"), (px * (1 + F.col("l_tax") - F.col("l_discount"))).alias("exit_px"),
    )
    from ..operators.portfolio import trade_pnl

    return trade_pnl(j)


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).groupBy("portfolio", F.col("exit_d").alias("d")).agg(F.sum("net").alias("net"))
    w = Window.partitionBy("portfolio").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("portfolio", "d", F.round(100000 + F.sum(F.col("net")).over(w) / 100, 4).alias("equity"))


_PX = "l_extendedprice / l_quantity"
_QUARTER = "(date_trunc('quarter', o_orderdate)::date + interval 3 month - interval 1 day)::date"


def _u(*cols: str, seed: int = 42) -> str:
    """DuckDB's twin of hash_uniform."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(cols)})), 1, 8))::bigint / 4294967296.0)"


VIEWS: dict[str, str] = {
    "bars": f"""select p_brand as asset, l_shipdate::date as d, first({_PX} order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as open, max({_PX}) as high, min({_PX}) as low,
        last({_PX} order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as close, sum(l_quantity) as volume
        from lineitem join part on l_partkey = p_partkey where l_quantity > 0 group by 1, 2""",
    "index_bars": "select l_shipdate::date as d, sum(l_extendedprice) / sum(l_quantity) as close from lineitem group by 1",
    "sessions": "select d, row_number() over (order by d) - 1 as ord, lead(d) over (order by d) as next_d from (select distinct d from index_bars)",
    "universe": """select asset, k, k % 5 as sector, case when k % 4 = 0 then date '1996-01-01' + k * 30 end as valid_from, case when k % 6 = 0 then date '2000-01-01' + k * 10 end as valid_to
        from (select distinct p_brand as asset, substr(p_brand, 7)::int as k from part)""",
    "macro": "select o_orderpriority as series, date_trunc('month', o_orderdate)::date as ref_date, avg(o_totalprice) / 1000 as value from orders group by 1, 2",
    "filing_headers": f"""select entity, ref_date, version, case when entity % 7 <> 0 then ref_date + (entity % 30 + 20)::int end as received_on
        from (select c_nationkey as entity, {_QUARTER} as ref_date, max(o_orderkey % 3 + 1)::int as version from orders join customer on o_custkey = c_custkey group by 1, 2)""",
    "statement_lines": f"""select entity, ref_date, version, account, sum(amount) over (partition by entity, year(ref_date), version, account order by ref_date) as value
        from (select c_nationkey as entity, {_QUARTER} as ref_date, (o_orderkey % 3 + 1)::int as version, o_orderpriority as account, round(sum(o_totalprice), 2) as amount from orders join customer on o_custkey = c_custkey group by 1, 2, 3, 4)""",
    "points": "select n_nationkey as entity, unnest(generate_series(date '1995-01-01', date '2001-12-01', interval 1 month))::date as d from nation",
    "earnings": """select c_nationkey as entity, o_orderdate::date as announced_on, case when max(o_orderkey) % 3 <> 0 then max(o_totalprice) end as realized, min(o_totalprice) as estimated
        from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT' group by 1, 2""",
    "news": """select doc_id as news_id, 'Brand#' || (doc_id % 25 + 1) as asset, split_part(coalesce(text, ''), chr(10), 1) as title, coalesce(text, '') as body, source,
        1.0::double - substr(source, 4)::int % 5 * 0.125::double as source_weight, timestamp '2000-01-01' + to_minutes(doc_id * 37) as published_at from documents""",
    "scores": f"""select asset, d, {_u("asset", "d::varchar", "'u1'")} < 0.15 as has_event, 2 * {_u("asset", "d::varchar", "'u2'")} - 1 as score, 0.5 + 0.4 * {_u("asset", "d::varchar", "'u3'")} as confidence from bars""",
    "labels_y": """select * from (select asset, b.d, lead(b.close, 5) over w / b.close - 1 - 1.0::double * (lead(i.close, 5) over w / i.close - 1) as y from bars b join index_bars i on b.d = i.d window w as (partition by asset order by b.d)) where y is not null""",
    "signals": "select * from scores join labels_y using (asset, d)",
    "evaluations": f"""select asset || '|' || d::varchar as event_id, model, asset, d, 2 * {_u("asset", "d::varchar", "model", "'s'")} - 1 as score, y, floor(1 + 50 * {_u("asset", "d::varchar", "model", "'i'")})::bigint as tokens_in,
        floor(1 + 20 * {_u("asset", "d::varchar", "model", "'o'")})::bigint as tokens_out, 4 + 2 * {_u("asset", "d::varchar", "model", "'l'")} as latency
        from signals, (values ('a'), ('b')) m(model) where has_event""",
    "trades": f"""select *, (exit_px - entry_px) * qty as gross, 0.004 * entry_px * qty + 0.004 * exit_px * qty as costs, (exit_px - entry_px) * qty - (0.004 * entry_px * qty + 0.004 * exit_px * qty) as net
        from (select c_nationkey as portfolio, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as trade_id, c_mktsegment as sector, l_returnflag || l_linestatus as reason, o_orderdate::date as entry_d, l_shipdate::date as exit_d,
        l_quantity as qty, {_PX} as entry_px, {_PX} * (1 + l_tax - l_discount) as exit_px from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_shipdate::date >= o_orderdate::date)""",
    "equity": """select portfolio, d, round(100000 + sum(net) over (partition by portfolio order by d) / 100, 4) as equity from (select portfolio, exit_d as d, sum(net) as net from trades group by 1, 2)""",
}
NEEDS = {"sessions": ["index_bars"], "scores": ["bars"], "labels_y": ["bars", "index_bars"], "signals": ["scores", "labels_y"], "evaluations": ["signals"], "equity": ["trades"]}


def sql(body: str, *views: str) -> str:
    """body after the common table expressions of the views and of what they need."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    head = ", ".join(f"{v} as materialized ({VIEWS[v]})" for v in order)
    body = body.strip()
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"


_WORD = 4294967295


def _mixed(expr: str, name: str) -> str:
    """DuckDB columns that end in `name`: the twin of replicates.mixed."""
    x, steps = f"({expr})::ubigint", []
    for k, (shift, factor) in enumerate(((16, 0x7FEB352D), (15, 0x846CA68B))):
        steps += [f"{x} as {name}_{k}a", f"xor({name}_{k}a, {name}_{k}a >> {shift}) as {name}_{k}b", f"({name}_{k}b * {factor}::ubigint) & {_WORD}::ubigint as {name}_{k}c"]
        x = f"{name}_{k}c"
    return ", ".join([*steps, f"xor({x}, {x} >> 16) as {name}"])


def group_word(*by: str, seed: int = 42) -> str:
    """DuckDB's twin of replicates.group_word."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(by)})), 1, 8))::bigint"


def words(src: str, slot: str, replicates: int, name: str = "words") -> str:
    """DuckDB CTEs that end in `name`: src (.., g) for each replicate, with its `word`."""
    return f"""{name}_0 as (select *, {_mixed("g", "wa")}, {_mixed(f"(g + 1) & {_WORD}", "wb")} from {src}),
        {name}_1 as (select *, {_mixed(f"xor({slot}::ubigint, wa)", "wc")} from {name}_0),
        {name}_2 as (select w.*, rep, {_mixed("xor(rep::ubigint, wb)", "wd")} from {name}_1 w, range({replicates}) r(rep)),
        {name} as (select *, {_mixed(f"(wc + wd) & {_WORD}::ubigint", "word")} from {name}_2)"""
