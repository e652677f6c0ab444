"""Readers and normalisers of dated feeds, and the deterministic sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILING_COLUMNS = ("CD_CVM", "CNPJ_CIA", "DT_REFER", "DT_RECEB", "VERSAO", "ORDEM_EXERC", "CD_CONTA", "DS_CONTA", "VL_CONTA")
NEWS_COLUMNS = ("data", "ticker", "titulo", "fonte", "url", "peso", "corpo", "resumo_ia")


def load_bars(adjusted: DataFrame, raw: DataFrame, start, cutoff, warmup) -> DataFrame:
    """Adjusted bars with the raw close of the day, within [start, cutoff]; a start before the warm-up date raises."""
    if str(start) < str(warmup):
        raise ValueError(f"bars before {warmup} are not to be asked for")
    cut = adjusted.filter((F.col("d") >= F.lit(start)) & (F.col("d") <= F.lit(cutoff)))
    return cut.join(raw.select("asset", "d", F.col("close").alias("close_raw")), ["asset", "d"], "left")


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated Latin-1 filings, all text first, then typed: what can't be read is null, a null version 0."""
    raw = spark.read.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).csv(path)
    kept = raw.select(*(c for c in FILING_COLUMNS if c in raw.columns))
    as_type: dict[str, Column] = {"CD_CVM": F.col("CD_CVM").try_cast("int"), "VERSAO": F.coalesce(F.col("VERSAO").try_cast("int"), F.lit(0)), "VL_CONTA": F.col("VL_CONTA").try_cast("double")}
    as_type |= {c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date") for c in ("DT_REFER", "DT_RECEB")}
    return kept.withColumns({c: e for c, e in as_type.items() if c in kept.columns})


def write_filings(df: DataFrame, path: str, kind: str) -> None:
    """Parquet by kind and year of the reference date; the years that df has are replaced, so writing again changes nothing."""
    told = df.withColumn("kind", F.lit(kind)).withColumn("year", F.year("DT_REFER"))
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "year").parquet(path)


def read_news_csv(spark: SparkSession, path: str) -> DataFrame:
    """Curated news; a missing column raises, as does a time without a zone when it is read."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in NEWS_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"news file lacks {missing}")
    zoned = F.col("data").rlike("(Z|[+-]\\d{2}:?\\d{2})$")
    return raw.withColumn("published_at", F.when(zoned, F.to_timestamp("data")).otherwise(F.raise_error(F.concat(F.lit("time without zone: "), F.col("data"))).cast("timestamp")))


def normalize_curated_news(df: DataFrame, default_source: str = "unknown") -> DataFrame:
    """(asset, title, body, url, published_at, source, source_weight); body joins summary and text, a bad weight is 1.0."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.select(
        F.col("ticker").alias("asset"), F.col("titulo").alias("title"), F.concat_ws("\n\n", full(F.col("resumo_ia")), full(F.col("corpo"))).alias("body"), "url", "published_at",
        F.coalesce(full(F.col("fonte")), F.lit(default_source)).alias("source"), F.coalesce(F.col("peso").try_cast("double"), F.lit(1.0)).alias("source_weight"),
    )


def normalize_feed_a(df: DataFrame, cutoff) -> DataFrame:
    """JSON text `payload` with articles {title, url, domain, seendate}: one row per article with a readable time by the cutoff."""
    kind = "struct<articles: array<struct<title: string, url: string, domain: string, seendate: string>>>"
    a = df.select(F.explode(F.from_json("payload", kind)["articles"]).alias("a")).select("a.*")
    at = F.coalesce(F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp("seendate"))
    rows = a.select("title", F.lit("").alias("body"), "url", at.alias("published_at"), F.coalesce("domain", F.lit("unknown")).alias("source"))
    return rows.filter(F.col("published_at").isNotNull() & (F.col("published_at") <= F.lit(cutoff)))


def normalize_feed_b(df: DataFrame, start, cutoff, reach_days: int = 30) -> DataFrame:
    """JSON text `payload` with articles {title, description, content, url, publishedAt}; the start is clamped to cutoff - reach_days."""
    kind = "struct<articles: array<struct<title: string, description: string, content: string, url: string, publishedAt: string>>>"
    a = df.select(F.explode(F.from_json("payload", kind)["articles"]).alias("a")).select("a.*")
    end = F.lit(cutoff).cast("timestamp")
    begin = F.greatest(F.lit(start).cast("timestamp"), end - F.make_interval(days=F.lit(reach_days)))
    rows = a.select("title", F.trim(F.concat_ws(" ", "description", "content")).alias("body"), "url", F.try_to_timestamp("publishedAt").alias("published_at"), F.try_parse_url("url", F.lit("HOST")).alias("source"))
    return rows.filter((F.col("published_at") >= begin) & (F.col("published_at") <= end) & (begin < end))


def normalize_macro_a(df: DataFrame) -> DataFrame:
    """JSON text `payload` [{data: dd/MM/yyyy, valor}] -> (series, ref_date, value)."""
    rows = df.select("series", F.explode(F.from_json("payload", "array<struct<data: string, valor: string>>")).alias("o"))
    return rows.select("series", F.try_to_timestamp("o.data", F.lit("dd/MM/yyyy")).cast("date").alias("ref_date"), F.col("o.valor").try_cast("double").alias("value"))


def normalize_macro_b(df: DataFrame) -> DataFrame:
    """JSON text `payload` {observations: [{date, value}]}; what isn't a number is skipped."""
    rows = df.select("series", F.explode(F.from_json("payload", "struct<observations: array<struct<date: string, value: string>>>")["observations"]).alias("o"))
    return rows.select("series", F.col("o.date").cast("date").alias("ref_date"), F.col("o.value").try_cast("double").alias("value")).filter("value is not null")


def coalesce_series(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The fallback's rows only of series that the primary lacks."""
    return primary.unionByName(fallback.join(primary.select("series").distinct(), "series", "left_anti").select(primary.columns))


EARNINGS_NAMES = {"Dt divulg": "announced_on", "Per": "period", "Per ref": "period_ref", "Divulgado": "realized", "Comp": "comparable", "Estimado": "estimated", "%Surp": "surprise_pct", "Var prç%": "move_pct", "P/L": "pe"}


def normalize_earnings(df: DataFrame, asset: str) -> DataFrame:
    """Earnings sheet by fixed names; a missing required column raises; rows without a valid date go."""
    from ..functions.scalars import parse_percent, parse_period_end

    required = [c for c in EARNINGS_NAMES if c != "P/L"]
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"earnings sheet lacks {missing}")
    named = df if "P/L" in df.columns else df.withColumn("P/L", F.lit(None).cast("string"))
    out = named.select(*(F.col(f"`{old}`").alias(new) for old, new in EARNINGS_NAMES.items()))
    typed = out.withColumns({"announced_on": F.try_to_timestamp("announced_on", F.lit("MM/dd/yyyy")).cast("date"), "period_end": parse_period_end(F.col("period_ref"))} | {c: parse_percent(F.col(c)) for c in ("realized", "comparable", "estimated", "surprise_pct", "move_pct", "pe")})
    return typed.filter("announced_on is not null").withColumn("asset", F.lit(asset))


def write_news_csv(df: DataFrame, path: str, partitions: int | None = None, part_bytes: int = 32 << 20) -> None:
    """CSV in fixed column order, range-partitioned and sorted by (asset, time, title); without `partitions`, so many that a file has some `part_bytes`."""
    cols = ["asset", "published_at", "title", "source", "source_weight", "url", "body"]
    keys = ["asset", "published_at", "title"]
    df = df.select(*(c for c in cols if c in df.columns))
    if partitions is None:
        size = df.agg(F.sum(F.octet_length(F.concat_ws(",", *(F.col(c).cast("string") for c in df.columns))).cast("bigint"))).first()[0] or 0
        partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("header", True).option("escape", '"').csv(path)


def search_entities(df: DataFrame, pattern: str, cols: list[str]) -> DataFrame:
    """Rows of which any column matches the pattern, whatever the case; null is no match."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False))
    return df.filter(hit)


def entity_key_map(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): of repeated keys the last row's value."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
