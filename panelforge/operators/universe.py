"""Membership, cutoffs, weights of sources, exposure: who and what counts when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.timeutil import busday_count


def _member(day: Column) -> Column:
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (day <= F.col("valid_to")))


def active_universe(dates: DataFrame, universe: DataFrame, day: str = "d") -> DataFrame:
    """(day, asset, sector) for each asset that is a member on the day, both ends included. The universe is a list of names, broadcast."""
    return dates.join(universe, _member(F.col(day))).select(day, "asset", "sector")


def clip_to_membership(bars: DataFrame, universe: DataFrame, day: str = "d") -> DataFrame:
    """bars without days after an asset's exit; assets outside the universe stay."""
    u = universe.select("asset", "valid_to")
    return bars.join(u, "asset", "left").filter(F.col("valid_to").isNull() | (F.col(day) <= F.col("valid_to"))).drop("valid_to")


def asof_cut(df: DataFrame, ts: str, cutoff) -> DataFrame:
    """Rows known by the cutoff, itself included."""
    return df.filter(F.col(ts) <= F.lit(cutoff))


def window_rows(df: DataFrame, ts: str, start, cutoff) -> DataFrame:
    """Rows within [start, cutoff]; none if the window is inverted."""
    return df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(cutoff)))


def lookahead_violations(df: DataFrame, ts: str, cutoff, strict: bool = False) -> DataFrame:
    """Rows later than the cutoff; with `strict` reading any raises."""
    late = F.col(ts) > F.lit(cutoff)
    if strict:
        return df.filter(F.when(late, F.raise_error(F.concat(F.lit("look-ahead: "), F.col(ts).cast("string")))).otherwise(F.lit(True)).cast("boolean"))
    return df.filter(late)


def lookahead_report(kinds: dict[str, tuple[DataFrame, str]], cutoff) -> DataFrame:
    """(kind, n, n_late, latest) for each kind of source, (rows, their time column), against the cutoff.

    Days are compared as days. A time without a zone can't be placed against a cutoff: it raises.
    """
    out = None
    for kind, (df, ts) in kinds.items():
        held = df.schema[ts].dataType.simpleString()
        if held not in ("date", "timestamp"):
            raise ValueError(f"{kind}: {ts} is {held}, a day or a time with a zone is needed")
        at = F.lit(cutoff).cast("timestamp")
        late = F.col(ts) > (at.cast("date") if held == "date" else at)
        told = df.agg(F.count("*").alias("n"), F.count_if(late).alias("n_late"), F.max(ts).cast("timestamp").alias("latest")).withColumn("kind", F.lit(kind))
        out = told if out is None else out.unionByName(told)
    return out.select("kind", "n", "n_late", "latest")


def require_no_lookahead(kinds: dict[str, tuple[DataFrame, str]], cutoff) -> None:
    """Raise if any kind of source has a row later than the cutoff; one count of each."""
    late = {r["kind"]: (r["n_late"], r["latest"]) for r in lookahead_report(kinds, cutoff).collect() if r["n_late"]}
    if late:
        raise ValueError(f"look-ahead past {cutoff}: {late}")


def weight_sources(df: DataFrame, whitelist: list[tuple[str, float]], domain: str, url: str) -> DataFrame:
    """Rows whose "domain url" contains an entry of the list, with the weight of the first such entry. The list is looked through in place: no shuffle."""
    text = F.concat_ws(" ", F.lower(domain), F.lower(url))
    entries = F.array(*(F.struct(F.lit(e.lower()).alias("e"), F.lit(float(w)).alias("w")) for e, w in whitelist))
    first = F.get(F.filter(entries, lambda x: text.contains(x["e"])), F.lit(0)) if whitelist else F.lit(None).cast("struct<e: string, w: double>")
    return df.withColumn("_hit", first).filter("_hit is not null").select(*df.columns, F.col("_hit.w").alias("weight"))


def resolve_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """df with `display`, the asset's name, else the asset itself."""
    return df.join(names.select("asset", "name"), "asset", "left").withColumn("display", F.coalesce("name", "asset")).drop("name")


def attach_sector(df: DataFrame, universe: DataFrame, strict: bool = True) -> DataFrame:
    """df with `sector`; with `strict` reading an unknown asset raises."""
    j = df.join(universe.select("asset", "sector"), "asset", "left")
    if strict:
        return j.withColumn("sector", F.when(F.col("sector").isNull(), F.raise_error(F.concat(F.lit("unknown asset "), F.col("asset"))).cast("int")).otherwise(F.col("sector")))
    return j


def sector_peer(dates: DataFrame, universe: DataFrame, order: str = "k", day: str = "d") -> DataFrame:
    """(day, asset, peer): the first other active asset of the sector in universe order, else null."""
    act = dates.join(universe, _member(F.col(day))).select(day, "asset", "sector", order)
    by = Window.partitionBy(day, "sector").orderBy(order)
    first = F.first("asset").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    second = F.nth_value("asset", 2).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return act.select(day, "asset", F.when(first == F.col("asset"), second).otherwise(first).alias("peer"))


def tag_exposure(df: DataFrame, event_day: str, latest_news: str, cutoff) -> DataFrame:
    """`segment` by event day against the training cutoff; `clean` where the latest news is not before it."""
    seg = F.when(F.col(event_day) < F.lit(cutoff), "seen").otherwise("unseen")
    return df.withColumns({"segment": seg, "clean": F.coalesce(F.col(latest_news) >= F.lit(cutoff), F.lit(False))})


def sector_members(universe: DataFrame, dates: DataFrame | None = None, day: str = "d") -> DataFrame:
    """(sector, assets) over the whole universe; with dates (day, sector, assets) of the assets that are members on each day."""
    keys, members = ([day, "sector"], active_universe(dates, universe, day)) if dates is not None else (["sector"], universe)
    return members.groupBy(*keys).agg(F.array_sort(F.collect_list("asset")).alias("assets"))


def active_over(universe: DataFrame, start, stop) -> DataFrame:
    """(asset): assets that are members on some day of [start, stop]; none if it is inverted."""
    first, last = F.lit(start).cast("date"), F.lit(stop).cast("date")
    begins, ends = F.coalesce("valid_from", first), F.coalesce("valid_to", last)
    return universe.filter((first <= last) & (begins <= ends) & (begins <= last) & (ends >= first)).select("asset").distinct()


def add_blocks(df: DataFrame, day: str, base, days: int = 5) -> DataFrame:
    """`block`: whole runs of `days` business days since base."""
    return df.withColumn("block", F.floor(busday_count(F.lit(base).cast("date"), F.col(day)) / days).cast("int"))


def sample_events(sessions: DataFrame, universe: DataFrame, news: DataFrame, labels: DataFrame, lookback: int = 7) -> DataFrame:
    """(d, asset, n_news, set_key): active asset-days with news within `lookback` days and a label, the first day of each news set only."""
    return judged_events(sessions, universe, news, labels, lookback).filter("verdict = 'sampled'").select("d", "asset", "n_news", "set_key")


def judged_events(sessions: DataFrame, universe: DataFrame, news: DataFrame, labels: DataFrame, lookback: int = 7, counts: Observation | None = None) -> DataFrame:
    """(d, asset, n_news, set_key, verdict) of every active asset-day: 'sampled', 'no news', 'duplicate' of a set sampled on an earlier day, or 'no label'.

    With `counts`, one action on the result also tells how many of each there are, by
    `counts.get`: n_candidates, n_sampled, n_no_news, n_duplicate and n_no_label.
    """
    act = active_universe(sessions.select("d"), universe)
    near = news.select("asset", "news_id", F.explode(F.sequence(F.col("published_at").cast("date"), F.date_add(F.col("published_at").cast("date"), lookback))).alias("d"))
    sets = near.groupBy("asset", "d").agg(F.count("*").alias("n_news"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("news_id").cast("string"))), "||").cast("binary"), 256).alias("set_key"))
    known = labels.select("asset", "d").distinct().withColumn("_y", F.lit(True))
    j = act.join(sets, ["asset", "d"], "left").join(known, ["asset", "d"], "left")
    accepted = F.min(F.when(F.col("_y") & F.col("set_key").isNotNull(), F.col("d"))).over(Window.partitionBy("asset", "set_key"))
    first = F.col("_first")
    verdict = F.when(F.col("set_key").isNull(), "no news").when(F.col("d") > first, "duplicate").when(F.col("_y") & (F.col("d") == first), "sampled").otherwise("no label")
    out = j.withColumn("_first", accepted).withColumn("verdict", verdict).select("d", "asset", "n_news", "set_key", "verdict")
    if counts is None:
        return out
    of = lambda v: F.count_if(F.col("verdict") == v)
    return out.observe(counts, F.count(F.lit(1)).alias("n_candidates"), of("sampled").alias("n_sampled"), of("no news").alias("n_no_news"), of("duplicate").alias("n_duplicate"), of("no label").alias("n_no_label"))


def sample_random(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of an MD5 of seed and keys: the same rows every time."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary")), *keys).limit(n)


def sample_passing(df: DataFrame, keys: list[str], n: int, filters: dict[str, Column], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(the first n rows in the order of `sample_random` that pass all filters, (n_probed, n_taken, failed_<filter>...)).

    Counters are those of rows that come no later than the last one taken, or of all rows where
    fewer than n pass; a row that fails counts for the first filter it fails.
    """
    told = F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary")).alias("h"), *keys)
    verdict = F.lit(None).cast("string")
    for name, ok in reversed(filters.items()):
        verdict = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(verdict)
    judged = df.withColumns({"_spot": told, "_failed": verdict})
    taken = judged.filter("_failed is null").orderBy("_spot").limit(n)
    last = taken.agg(F.max("_spot").alias("_last"), F.count("*").alias("_n"))
    probed = judged.join(F.broadcast(last)).filter((F.col("_n") < n) | (F.col("_spot") <= F.col("_last")))
    failed = [F.count_if(F.col("_failed") == name).alias(f"failed_{name}") for name in filters]
    return taken.drop("_spot", "_failed"), probed.agg(F.count("*").alias("n_probed"), F.count_if(F.col("_failed").isNull()).alias("n_taken"), *failed)


def pending(events: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Events not yet evaluated."""
    return events.join(done.select(*keys).distinct(), keys, "left_anti")


def alignment(events: DataFrame, done: DataFrame, key: str, same: list[str]) -> DataFrame:
    """(n, rate): share of common keys whose other columns agree."""
    d = done.select(key, *(F.col(c).alias(f"_d_{c}") for c in same))
    ok = F.lit(True)
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    return events.join(d, key).agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("rate"))


def pair_scores(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, score_a, score_b, y) of events that both models scored."""
    return a.select(key, F.col("score").alias("score_a"), "y").join(b.select(key, F.col("score").alias("score_b")), key)
