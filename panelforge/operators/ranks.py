"""Exact ranks and quantiles over all rows of a table, without a task that holds them all.

Values are counted first, so a value's rows are one row from then on. Counts are cut at
approximate quantiles; what lies below each cut is added up from at most as many numbers as
there are cuts, and each part is summed in itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path


def cut_points(df: DataFrame, value: Column, parts: int) -> list:
    """At most parts - 1 different values that cut the rows in parts of about the same size."""
    if parts < 2:
        return []
    shares = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    held = df.agg(F.percentile_approx(value, shares, 100 * parts).alias("c")).first()[0]
    return sorted({c for c in held or [] if c is not None})


def part_of(value: Column, cuts: list) -> Column:
    """How many of the cuts are at most the value; 0 for a null."""
    # plain comparisons: a lambda here can end in constraints that Spark 4.1 fails to carry over a union
    return F.coalesce(sum(((value >= F.lit(c)).cast("int") for c in cuts), F.lit(0)), F.lit(0))


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def value_ranks(df: DataFrame, value: str, parts: int | None = None, times: str | None = None) -> tuple[DataFrame, int]:
    """((value, rank) of every different value, all rows): 1-based ranks with ties at their mean. Nulls have no rank; with `times`, a row stands for that many."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), (F.col(times) if times else F.lit(1)).alias("_k"))
    cuts = cut_points(rows, F.col("_v"), parts or parts_of(df))
    counts = rows.groupBy("_v").agg(F.sum("_k").alias("_n")).withColumn("_part", part_of(F.col("_v"), cuts))
    held = {r["_part"]: r["n"] for r in counts.groupBy("_part").agg(F.sum("_n").alias("n")).collect()}
    below, total = [], 0
    for k in range(len(cuts) + 1):
        below.append(total)
        total += held.get(k, 0)
    # in halves from the start: sums of whole numbers stay exact
    before = F.array(*(F.lit(float(b)) for b in below))[F.col("_part")]
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(F.col("_v").alias(value), (before + upto - (F.col("_n") - 1) / 2).alias("rank")), total


def global_spearman(df: DataFrame, a: str, b: str, least: int = 3, parts: int | None = None) -> DataFrame:
    """One row (ic, n): Spearman correlation over all rows without nulls; null under `least` rows or for a constant.

    Equal pairs are counted and written, since several passes read them; sums are taken about the
    mean rank, which is known beforehand.
    """
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_x"), F.col(b).alias("_y")).agg(F.count("*").alias("_k"))
    path = new_path(df.sparkSession, "pairs")
    pairs.write.parquet(path)
    met = df.sparkSession.read.schema(pairs.schema).parquet(path)
    rx, n = value_ranks(met, "_x", parts, "_k")
    ry, _ = value_ranks(met, "_y", parts, "_k")
    met = met.join(rx.withColumnRenamed("rank", "_rx"), "_x").join(ry.withColumnRenamed("rank", "_ry"), "_y")
    x, y, k = F.col("_rx") - (n + 1) / 2, F.col("_ry") - (n + 1) / 2, F.col("_k")
    g = met.agg(F.sum(k * x * y).alias("_c"), F.sum(k * x * x).alias("_va"), F.sum(k * y * y).alias("_vb"))
    whole = (F.lit(n) >= least) & (F.col("_va") > 0) & (F.col("_vb") > 0)
    return g.select(F.when(whole, F.col("_c") / F.sqrt(F.col("_va") * F.col("_vb"))).alias("ic"), F.lit(n).cast("bigint").alias("n"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], bins: int = 1024, held: int = 4096) -> list[float | None]:
    """Quantiles of all rows with linear interpolation, exact, by refined histograms.

    Each pass counts, for every rank still sought, the rows of its interval in `bins` bins; the
    bin with the rank, from its least to its greatest value, is the next interval. An interval
    of at most `held` different values is read out. A task and the driver hold bins only. Nulls
    and NaN are left out; no rows give nulls.
    """
    rows = df.select(F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    n, lo, hi = rows.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    if not n:
        return [None] * len(shares)
    spots = [s * (n - 1) for s in shares]
    ranks = sorted({k for s in spots for k in (math.floor(s), math.ceil(s))})
    found: dict[int, float] = {}
    open_: dict[tuple[float, float, int], list[int]] = {(lo, hi, 0): ranks}  # (least, greatest, rows below): ranks within
    while open_:
        spans = list(open_)
        cases = []
        for lo, hi, _ in spans:
            wide = hi / 2 - lo / 2  # the width itself may overflow
            place = F.floor((F.col("_v") / 2 - lo / 2) / F.lit(wide) * bins) if wide > 0 else F.lit(0)
            cases.append(F.when(F.col("_v").between(lo, hi), F.least(place, F.lit(bins - 1)).cast("int")))
        where = F.explode(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(i).alias("i"), c.alias("b"))) for i, c in enumerate(cases)])))
        told = rows.select("_v", where.alias("_w")).groupBy("_w").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.approx_count_distinct("_v").alias("d")).collect()
        then: dict[tuple[float, float, int], list[int]] = {}
        for i, span in enumerate(spans):
            below, wanted = span[2], list(open_[span])
            for r in sorted((r for r in told if r["_w"]["i"] == i), key=lambda r: r["_w"]["b"]):
                mine = [k for k in wanted if below <= k < below + r["n"]]
                if mine and r["lo"] == r["hi"]:
                    found |= dict.fromkeys(mine, r["lo"])
                elif mine and r["d"] <= held:
                    at = below
                    for x in rows.filter(F.col("_v").between(r["lo"], r["hi"])).groupBy("_v").count().orderBy("_v").collect():
                        found |= {k: x["_v"] for k in mine if at <= k < at + x["count"]}
                        at += x["count"]
                elif mine:
                    then[r["lo"], r["hi"], below] = mine
                below += r["n"]
        open_ = then
    return [found[math.floor(s)] + (found[math.ceil(s)] - found[math.floor(s)]) * (s - math.floor(s)) for s in spots]
