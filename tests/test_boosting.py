"""Windows grown together against one model after the other."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting
from panelforge.operators.replicates import counters

START = dt.date(2024, 1, 1)


def panel_of(spark):
    rng = random.Random(1)
    rows = []
    for k in range(100):
        for a in "abcde":
            x, z = round(rng.gauss(0, 1), 2), rng.random() if rng.random() < 0.95 else None
            rows.append((a, START + dt.timedelta(k), k, x, z, None if k > 95 else (x > 0.3) * 1.0 + 0.5 * (z or 0) + rng.gauss(0, 0.2), rng.random() < 0.2))
    return spark.createDataFrame(rows, "asset string, d date, ord int, x double, z double, y double, has_event boolean").repartition(3)


def one_model(rows, edges, trees, depth, rate, sample, seed):
    """(bins, y, w, id) rows -> a function of bins; node by node, split by split."""
    bins, y, w, ids = rows
    start = (w * y).sum() / w.sum()
    told, grown = np.full(len(y), start), []
    for t in range(trees):
        taken = counters(seed, np.array([t]), ids)[0] < sample * 2**32

        def grow(mine, level, t=t, told=told):
            r, v = (w * (y - told))[mine], w[mine]
            best = None
            for f in range(bins.shape[1]):
                for b in range(31):
                    left = bins[mine, f] <= b
                    lw, rw = v[left].sum(), v[~left].sum()
                    if lw > 0 and rw > 0:
                        gain = r[left].sum() ** 2 / lw + r[~left].sum() ** 2 / rw - r.sum() ** 2 / v.sum()
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, b)
            mean = r.sum() / v.sum() if len(mine) else 0.0
            if level == depth or best is None:
                return mean
            _, f, b = best
            return (f, b, grow(mine[bins[mine, f] <= b], level + 1), grow(mine[bins[mine, f] > b], level + 1))

        tree = grow(np.flatnonzero(taken), 0)
        grown.append(tree)
        told = told + rate * np.array([value(tree, x) for x in bins])
    return lambda x: start + sum(rate * value(tree, x) for tree in grown)


def value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def test_windows_equal_single_models(spark):
    p = panel_of(spark)
    got = boosting.walk_forward_windows(p, ["x", "z"], trees=3, depth=2, rate=0.3, least=20)
    rows = {(r.asset, r.d): r for r in got.collect()}
    pdf = p.withColumn("id", F.pmod(F.xxhash64("asset", "d"), F.lit(1 << 32))).toPandas()
    pdf["month"] = [d.strftime("%Y-%m") for d in pdf.d]
    whole = pdf.dropna(subset=["x", "z"])
    assert {r.month for r in rows.values()} == {"2024-02", "2024-03", "2024-04"} and len(rows) == (whole.month > "2024-01").sum()
    first = 31 - 10
    cut = p.filter(F.col("ord") <= first).dropna(subset=["y", "x", "z"]).agg(*(F.percentile_approx(c, F.array(*(F.lit(k / 32) for k in range(1, 32))), 10_000) for c in ("x", "z"))).first()
    edges = [sorted(set(e)) for e in cut]
    for m, cutoff in (("2024-02", first), ("2024-03", 60 - 10), ("2024-04", 91 - 10)):
        train = whole.dropna(subset=["y"])
        train = train[train.ord <= cutoff]
        bins = boosting.binned(train[["x", "z"]].to_numpy(float), edges)
        f = one_model((bins, train.y.to_numpy(), np.where(train.has_event, 5.0, 1.0), train.id.to_numpy().astype(np.uint32)), edges, 3, 2, 0.3, 0.8, 42)
        mine = whole[whole.month == m]
        for r, x in zip(mine.itertuples(), boosting.binned(mine[["x", "z"]].to_numpy(float), edges), strict=True):
            assert rows[r.asset, r.d].y_pred == pytest.approx(f(x), abs=1e-9)


def test_what_comes_later_changes_nothing(spark):
    p = panel_of(spark)
    told = lambda q: {(r.asset, r.d): r.y_pred for r in boosting.walk_forward_windows(q, ["x", "z"], trees=2).filter("month = '2024-03'").collect()}
    # labels from ten days before the month on are of the future
    other = p.withColumn("y", F.when(F.col("ord") > 50, F.lit(9.0)).otherwise(F.col("y")))
    a, b = told(p), told(other)
    assert a == pytest.approx(b) and len(a) > 100


def test_no_window_no_prediction(spark):
    p = panel_of(spark)
    got = boosting.walk_forward_windows(p.filter("ord < 25"), ["x", "z"])
    assert got.count() == 0 and "y_pred" in got.columns
