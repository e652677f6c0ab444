"""Ranks, quantiles and as-of joins that no single task holds."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import asof, ranks, stats


def test_global_correlation_equals_pandas_with_ties(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": np.round(rng.normal(size=3000), 1), "b": rng.integers(0, 40, 3000).astype(float)})
    pdf["b"] += pdf["a"] * 3
    pdf.loc[::97, "a"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double").repartition(3)
    r = stats.spearman(df, [], "a", "b").first()
    assert r.n == pdf["a"].notna().sum() and r.ic == pytest.approx(pdf.corr(method="spearman").iloc[0, 1], abs=1e-12)
    got = {x.a: x["rank"] for x in ranks.value_ranks(df, "a", 7)[0].collect()}
    want = dict(zip(pdf["a"].dropna(), pdf["a"].dropna().rank(), strict=True))
    assert got == want


def test_global_correlation_of_few_constant_or_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    assert stats.spearman(df, [], "a", "b").first() == (None, 2)
    same = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert stats.spearman(same, [], "a", "b").first() == (None, 5)
    assert stats.spearman(df.limit(0), [], "a", "b").first() == (None, 0)


def test_global_ranks_have_no_task_with_all_rows(spark):
    df = spark.range(1000).selectExpr("cast(id % 700 as double) a", "cast(id % 11 as double) b")
    plan = ranks.global_spearman(df, "a", "b")._jdf.queryExecution().executedPlan().toString()
    held = [x for x in plan.split("\n") if "SinglePartition" in x]
    # the one row of sums is all that meets in a single task
    assert len(held) == 1


@pytest.mark.parametrize("held", [1, 4096])
def test_quantiles_are_exact(spark, held):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=2000) ** 3, np.full(500, 0.25), rng.exponential(size=300) * 1e9, [-1e300, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3)
    shares = [0.0, 0.025, 0.5, 0.77, 0.975, 1.0]
    assert ranks.exact_quantiles(df, "v", shares, bins=64, held=held) == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)
    assert ranks.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    assert ranks.exact_quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.1, 0.9]) == [3.0, 3.0]


def test_slices_give_what_one_window_gives(spark):
    rng = random.Random(3)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(400))
    left = spark.createDataFrame([(rng.choice("ab") if rng.random() < 0.9 else None, day() if rng.random() < 0.95 else None, i) for i in range(300)], "k string, t date, i int")
    right = spark.createDataFrame([(rng.choice("abc"), day() if rng.random() < 0.95 else None, i % 3, i) for i in range(60)], "k string, u date, z int, v int")
    for direction in ("backward", "forward"):
        for strict in (False, True):
            for offset in (0, 30):
                a, b = (asof.asof_join(left, right, ["k"], "t", "u", ["u", "z"], offset, direction, strict, "z", slices).collect() for slices in (None, 7))
                assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_one_key_of_a_million_rows_is_even_work(spark):
    n = 1_000_000
    left = spark.range(n).select(F.lit("k").alias("k"), (F.lit(1_600_000_000) + F.col("id") * F.col("id") / n).cast("timestamp").alias("t"))
    right = spark.range(2000).select(F.lit("k").alias("k"), (F.lit(1_600_000_000) + F.col("id") * 500 - 7).cast("timestamp").alias("u"), F.col("id").alias("v"))
    got = asof.asof_join(left, right, ["k"], "t", "u", ["v"], slices=8)
    want = F.least(F.floor((F.unix_timestamp("t") - 1_600_000_000 + 7) / 500), F.lit(1999))
    assert got.filter(F.col("v").isNull() | (F.col("v") != want)).count() == 0 and got.count() == n
    cuts = ranks.cut_points(left, F.col("t"), 8)
    sizes = [r["count"] for r in left.groupBy(ranks.part_of(F.col("t"), cuts).alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * n / 8
