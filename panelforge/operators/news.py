"""News tables: exact and fuzzy dedupe, segmentation of raw feeds, sentiment."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import normalize_title
from ..sources.shared import shared_folder


def latest_version(df: DataFrame, keys: list[str], version: str, ties: list[str]) -> DataFrame:
    """One row per key: the greatest version, then the greatest `ties`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version), *(F.desc(t) for t in ties))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_r")).select(*keys, "_r.*")


def dedupe_exact(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in `order`, with `n_dropped`, how many it stands for besides."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "n_dropped": F.count("*").over(w) - 1}).filter("_rn = 1").drop("_rn")


def news_set_keys(df: DataFrame, by: list[str], item: Column) -> DataFrame:
    """(by..., n, set_key): SHA-256 of the sorted item hashes; the order of items is of no account."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "||").cast("binary"), 256).alias("set_key"))


def unify_news(dfs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of files; of rows with equal keys the first file's counts."""
    ranked = [d.withColumn("file_rank", F.lit(k)) for k, d in enumerate(dfs)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return every.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("file_rank"))).filter("_rn = 1").drop("_rn")


def set_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., side): keys that only one table has."""
    left = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("only left"))
    right = b.select(*keys).distinct().join(a.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("only right"))
    return left.unionByName(right)


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def _sign_counts(title: Column) -> Column:
    """How often each sign that a normalised title can have stands in it."""
    return F.array(*(F.length(title) - F.length(F.translate(title, c, "")) for c in " abcdefghijklmnopqrstuvwxyz0123456789"))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def _written(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def dedupe_fuzzy(df: DataFrame, by: list[str], title: str, ts: str, order: list[str], uid: str, threshold: float = 0.85, hours: int = 24, ratio=similarity_ratio) -> DataFrame:
    """Greedy dedupe: in the order of `order` (weight first, descending) then uid, a row goes if a kept row of its group has a title more similar than `threshold` less than `hours` away.

    Candidate pairs share a group and lie in the same or the next bucket of `hours`. The greedy
    result is reached in rounds: a row without an earlier undecided neighbour is kept, and the
    neighbours after it go; each round is written, so its plan stays short.
    """
    seconds = hours * 3600
    t = F.unix_timestamp(F.col(ts).cast("timestamp"))
    rows = df.select(*by, F.col(uid).alias("_u"), normalize_title(F.col(title)).alias("_title"), t.alias("_s"), F.struct(*[-F.col(c) for c in order], F.col(uid)).alias("_o"))
    bounded = ratio is similarity_ratio
    rows = rows.withColumn("_signs", _sign_counts(F.col("_title")) if bounded else F.lit(None))
    a = rows.withColumn("_b", F.floor(F.col("_s") / seconds))
    b = rows.withColumn("_b", F.explode(F.array(F.floor(F.col("_s") / seconds) - 1, F.floor(F.col("_s") / seconds), F.floor(F.col("_s") / seconds) + 1)))
    other = b.select(*by, "_b", F.col("_u").alias("_v"), F.col("_title").alias("_title2"), F.col("_s").alias("_s2"), F.col("_o").alias("_o2"), F.col("_signs").alias("_signs2"))
    near = a.join(other, [*by, "_b"]).filter((F.col("_o") < F.col("_o2")) & (F.abs(F.col("_s") - F.col("_s2")) < seconds))
    if bounded:
        # what two titles share is at most what their counts of signs and their lengths share
        la, lb = F.length("_title"), F.length("_title2")
        shared = F.aggregate(F.zip_with("_signs", "_signs2", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
        near = near.filter((2 * F.least(la, lb) > threshold * (la + lb)) & (2 * shared > threshold * (la + lb)))
    edges = _written(near.filter(ratio(F.col("_title"), F.col("_title2")) > threshold).select(F.col("_u").alias("first"), F.col("_v").alias("then")))
    open_edges, gone = edges, df.select(F.col(uid).alias("_gone")).limit(0)
    while not open_edges.isEmpty():
        kept = open_edges.select("first").distinct().join(open_edges.select(F.col("then").alias("first")).distinct(), "first", "left_anti")
        lost = _written(open_edges.join(kept, "first", "left_semi").select(F.col("then").alias("_gone")).distinct())
        gone = gone.unionByName(lost)
        left = open_edges.join(kept, "first", "left_anti")
        left = left.join(lost.select(F.col("_gone").alias("first")), "first", "left_anti").join(lost.select(F.col("_gone").alias("then")), "then", "left_anti")
        open_edges = _written(left.select("first", "then"))
    return df.join(gone.withColumnRenamed("_gone", uid), uid, "left_anti")


def unify_sources(dfs: list[DataFrame], by: list[str], cutoff, k: int, title: str, ts: str, weight: str, uid: str, ratio=similarity_ratio) -> DataFrame:
    """Union of sources by the cutoff, fuzzy dedupe, then the first k of each group by weight and time."""
    every = reduce(DataFrame.unionByName, dfs).filter(F.col(ts) <= F.lit(cutoff))
    one = dedupe_fuzzy(every, by, title, ts, [weight], uid, ratio=ratio)
    w = Window.partitionBy(*by).orderBy(F.desc(weight), F.desc(ts), uid)
    return one.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


#: A record starts at a line that holds this: a time and a source code.
ANCHOR = "\\d{2}/\\d{2}/\\d{4} +\\d{2}:\\d{2}:\\d{2}\\[\\w+\\]"


def segment_records(df: DataFrame, text: str, anchor: str = ANCHOR) -> DataFrame:
    """df with `pos` and `record`: pieces of the text from one anchor line to the next; what stands before the first goes."""
    pieces = F.split(text, f"(?m)(?=^[^\\n]*{anchor})")
    cols = [c for c in df.columns if c != text]
    return df.select(*cols, F.posexplode(pieces).alias("pos", "record")).filter(F.col("record").rlike(f"^[^\\n]*{anchor}"))


def parse_anchor(df: DataFrame, code_map: DataFrame, record: str = "record") -> DataFrame:
    """`published_at` (null where invalid), `code` and `source` (unknown codes become 'other')."""
    stamp = F.regexp_extract(record, "(\\d{2}/\\d{2}/\\d{4} +\\d{2}:\\d{2}:\\d{2})\\[", 1)
    at = F.try_to_timestamp(F.regexp_replace(stamp, " +", " "), F.lit("MM/dd/yyyy HH:mm:ss"))
    out = df.withColumns({"published_at": at, "code": F.regexp_extract(record, "\\[(\\w+)\\]", 1)})
    return out.join(F.broadcast(code_map.select("code", F.col("name").alias("source"))), "code", "left").withColumn("source", F.coalesce("source", F.lit("other")))


#: Lines of the page around a record rather than of it.
CHROME = "^(\\s*|\\s*(Print|Share|Back|Menu|Subscribe.*|Updated on.*|By .*)|\\s*[-*•].*)$"


def extract_title(record: Column, least: int = 10) -> Column:
    """The first line after the anchor that is no chrome; null if that is shorter than `least`."""
    lines = F.slice(F.split(record, "\n"), 2, 10_000_000)
    first = F.get(F.filter(lines, lambda x: ~x.rlike(CHROME)), F.lit(0))
    return F.when(F.length(F.trim(first)) >= least, F.trim(first))


def extract_summary(record: Column) -> Column:
    """The lines between 'Summary' and the by-line, without bullets, white space as single blanks."""
    part = F.regexp_extract(record, "(?s)\\nSummary[^\\n]*\\n(.*?)(?=\\nBy [^\\n]*|\\n\\([A-Z][^\\n]*\\) --|\\z)", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(part, "(?m)^\\s*[-*•]\\s*", ""), "\\s+", " "))


def extract_body(record: Column) -> Column:
    """From the dateline on, else after the by-line, else after the title."""
    pick = lambda p: F.nullif(F.trim(F.regexp_extract(record, p, 1), F.lit(" \n")), F.lit(""))
    title = extract_title(record)
    after = F.trim(F.substr(record, F.position(title, record) + F.length(title)), F.lit(" \n"))
    return F.coalesce(pick("(?s)\\n(\\([A-Z][^\\n]*\\) --.*)"), pick("(?s)\\nBy [^\\n]*\\n(.*)"), F.when(title.isNotNull(), after))


def strip_boilerplate(text: Column) -> Column:
    """Without chrome lines, inline tags, what follows the first footer and a trailing run of menu numbers."""
    t = F.regexp_replace(text, "(?m)^\\s*(Print|Share|Back|Menu|Subscribe[^\\n]*)\\s*$\\n?", "")
    t = F.regexp_replace(t, "<[^>\\n]+>", "")
    t = F.regexp_replace(t, "(?s)\\n(To contact the (reporter|editor)|Copyright ).*", "")
    return F.trim(F.regexp_replace(t, "(\\s+\\d{1,2}\\)){2,}\\s*$", ""), F.lit(" \n"))


def detect_content_column(df: DataFrame, cols: list[str], anchor: str = ANCHOR) -> DataFrame:
    """(place): 0-based column with most anchors, the first on a tie, -1 without any."""
    sums = df.agg(*(F.sum(F.coalesce(F.regexp_count(c, F.lit(anchor)), F.lit(0))).alias(f"n{k}") for k, c in enumerate(cols)))
    counts = F.array(*(F.col(f"n{k}") for k in range(len(cols))))
    return sums.select(F.when(F.array_max(counts) > 0, F.array_position(counts, F.array_max(counts)) - 1).otherwise(F.lit(-1)).cast("int").alias("place"))


def segment_columns(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Records of several text columns; of equal (published_at, title) the first column's counts."""
    parts = [segment_records(df.select(*keys, F.col(c).alias("text")), "text").withColumn("column_rank", F.lit(k)) for k, c in enumerate(cols)]
    every = reduce(DataFrame.unionByName, parts)
    stamp = F.try_to_timestamp(F.regexp_extract("record", "(\\d{2}/\\d{2}/\\d{4} \\d{2}:\\d{2}:\\d{2})\\[", 1), F.lit("MM/dd/yyyy HH:mm:ss"))
    named = every.withColumns({"published_at": stamp, "title": extract_title(F.col("record"))})
    w = Window.partitionBy(*keys, "published_at", "title").orderBy("column_rank", "pos")
    return named.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def parse_report(records: DataFrame) -> DataFrame:
    """Per source: records, bad dates, bad titles, repeats of (time, title) and unknown codes."""
    w = Window.partitionBy("published_at", "title").orderBy("source", "pos", "record")
    good = F.col("published_at").isNotNull() & F.col("title").isNotNull()
    r = records.withColumn("_again", good & (F.row_number().over(w) > 1))
    return r.groupBy("source").agg(F.count("*").alias("n_records"), F.count_if(F.col("published_at").isNull()).alias("n_bad_date"), F.count_if(F.col("title").isNull()).alias("n_bad_title"), F.count_if("_again").alias("n_again"), F.count_if(F.col("source") == "other").alias("n_unknown"))


def anonymize_entities(df: DataFrame, names: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """cols with the literal name of the row's entity replaced, whatever its case; names: (key, name, replacement)."""
    j = df.join(names, key, "left")
    quoted = F.concat(F.lit("(?i)"), F.regexp_replace(F.col("name"), "([\\\\.^$|?*+()\\[\\]{}])", "\\\\$1"))
    return j.withColumns({c: F.when(F.col("name").isNull(), F.col(c)).otherwise(F.regexp_replace(F.col(c), quoted, F.col("replacement"))) for c in cols}).drop("name", "replacement")


def audit_language(text: Column, patterns: dict[str, str]) -> Column:
    """Labels of the patterns that match, in the order given."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in patterns.items())))


def lexical_sentiment(df: DataFrame, lexicon: dict[str, int], by: list[str], text: Column) -> DataFrame:
    """(by..., n_pos, n_neg, sentiment): (pos - neg) / (pos + neg) over all words of a group's texts, 0 without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))
    pos, neg = ([w for w, s in lexicon.items() if s == sign] for sign in (1, -1))
    count = lambda ws: F.size(F.filter(words, lambda w: w.isin(ws)))
    g = df.groupBy(*by).agg(F.sum(count(pos)).alias("n_pos"), F.sum(count(neg)).alias("n_neg"))
    return g.withColumn("sentiment", F.coalesce(F.try_divide(F.col("n_pos") - F.col("n_neg"), F.col("n_pos") + F.col("n_neg")), F.lit(0.0)))
