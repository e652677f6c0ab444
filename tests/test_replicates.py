"""Lanes of replicates against replicates made one after the other."""

import datetime as dt
import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from panelforge.operators import portfolio, replicates, stats


def word(group, rep, slot):
    def mix(x):
        x = ((x ^ x >> 16) * 0x7FEB352D) & 0xFFFFFFFF
        x = ((x ^ x >> 15) * 0x846CA68B) & 0xFFFFFFFF
        return x ^ x >> 16

    return mix((mix(slot ^ mix(group & 0xFFFFFFFF)) + mix(rep ^ mix((group + 1) & 0xFFFFFFFF))) & 0xFFFFFFFF)


def group_of(*keys):
    return int(hashlib.md5("|".join(["42", *map(str, keys)]).encode()).hexdigest()[:8], 16)


def test_counters_are_functions_of_group_replicate_and_slot():
    got = replicates.counters(2**32 - 1, np.arange(5, 9), np.arange(100, 140))
    assert got.tolist() == [[word(2**32 - 1, r, s) for s in range(100, 140)] for r in range(5, 9)]
    u = replicates.counters(7, np.arange(400), np.arange(500)) / 2**32
    assert abs(u.mean() - 0.5) < 0.003 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.01
    assert set(replicates.drawn(replicates.counters(1, np.arange(50), np.arange(50)), 3).ravel().tolist()) == {0, 1, 2}


@pytest.mark.parametrize("block", [4, 1 << 21])
def test_paths_equal_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(replicates, "A_BLOCK", block)
    rng = random.Random(1)
    rows = [(p, f"{i:03d}", rng.uniform(-9000, 9000)) for p, n in (("a", 2), ("b", 37)) for i in range(n)]
    t = spark.createDataFrame(rows, "p string, id string, net double").repartition(3)
    for permute in (False, True):
        got = {(r.p, r.rep): (r.ret, r.max_drawdown) for r in replicates.resampled_paths(t, ["p"], "id", 300, 42, 100_000.0, permute, lanes=64).collect()}
        want = {}
        for p in "ab":
            net = [x for q, _, x in rows if q == p]
            for rep in range(300):
                w = [word(group_of(p), rep, s) for s in range(len(net))]
                steps = [net[k] for k in sorted(range(len(net)), key=lambda k: (w[k], k))] if permute else [net[x * len(net) >> 32] for x in w]
                at = top = 100_000.0
                worst = 0.0
                for x in steps:
                    at += x
                    top = max(top, at)
                    worst = min(worst, (at - top) / top)
                want[p, rep] = (at / 100_000 - 1, worst)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("drift", [-4000, -300, 0, 300, 4000])
@pytest.mark.parametrize("permute", [False, True])
def test_stretches_that_are_not_walked_hold_no_deeper_fall(monkeypatch, drift, permute):
    monkeypatch.setattr(replicates, "A_CACHE", 16)
    monkeypatch.setattr(replicates, "A_STRETCH", 8)
    rng = np.random.default_rng(3)
    walked = []
    walk = replicates._walk
    monkeypatch.setattr(replicates, "_walk", lambda start, top, steps: walked.append(len(steps)) or walk(start, top, steps))
    for n in (1, 2, 7, 8, 9, 500):
        net = rng.normal(drift, 2500, n)
        net[rng.random(n) < 0.2] = 0.0
        reps = np.arange(40)
        ret, fall = replicates.path_lanes(11, net, reps, 100_000.0, permute)
        w = replicates.counters(11, reps, np.arange(n))
        steps = net[np.argsort(w, axis=1, kind="stable")] if permute else net[replicates.drawn(w, n)]
        at = 100_000.0 + np.cumsum(steps, axis=1)
        tops = np.maximum(np.maximum.accumulate(at, axis=1), 100_000.0)
        assert ret == pytest.approx(at[:, -1] / 100_000 - 1, abs=1e-9)
        assert fall == pytest.approx(np.minimum(((at - tops) / tops).min(axis=1), 0), abs=1e-9)
    # where amounts fall, few stretches can hold a top or the deepest fall
    assert drift > -4000 or sum(walked) < 0.5 * 40 * 500


def test_both_kinds_go_by_words_that_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(replicates, "A_CACHE", 64)
    monkeypatch.setattr(replicates, "A_STRETCH", 8)
    rng, made = np.random.default_rng(5), []
    words = replicates._Lanes.words
    monkeypatch.setattr(replicates._Lanes, "words", lambda self, rep, s, e: made.append(e - s) or words(self, rep, s, e))
    net = rng.normal(-4000, 2500, 500)
    both = replicates.path_lanes(11, net, np.arange(40), 100_000.0, None)
    # all words of falling amounts once; little is made again
    assert sum(made) < 1.2 * 40 * 500
    for got, want in zip(both, [x for permute in (False, True) for x in replicates.path_lanes(11, net, np.arange(40), 100_000.0, permute)], strict=True):
        assert got.tolist() == want.tolist()
    rows = [(p, f"{i:03d}", float(x)) for p, n in (("a", 2), (None, 300)) for i, x in enumerate(rng.normal(-50, 3000, n))]
    t = spark.createDataFrame(rows, "p string, id string, net double")
    got = {tuple(r) for r in portfolio.replicate_trades(t, ["p"], "id", 300).select("kind", "p", "rep", "ret", "max_drawdown").collect()}
    alone = {"bootstrap": portfolio.bootstrap_trades, "permutation": portfolio.permute_trades}
    assert len(got) == 1200 and got == {(k, *r) for k, f in alone.items() for r in f(t, ["p"], "id", 300).select("p", "rep", "ret", "max_drawdown").collect()}
    with pytest.raises(ValueError, match="at least 2"):
        portfolio.replicate_trades(t.limit(0), ["p"], "id", 3)


def test_words_are_told_back():
    x = np.random.default_rng(2).integers(0, 1 << 32, 5000, dtype=np.uint32)
    assert replicates.unmixed(replicates.mixed(x)).tolist() == x.tolist()


@pytest.mark.parametrize(("drift", "spread"), [(-4000, 2500), (-300, 2500), (0, 2500), (300, 2500), (4000, 2500), (0, 30), (20, 300), (-1000, 0), (0, float("inf"))])
def test_a_floor_is_told_as_whole_paths_tell_it(monkeypatch, drift, spread):
    for name, x in (("A_CACHE", 64), ("A_STRETCH", 8), ("A_HEAD", 64), ("A_PART", 100)):
        monkeypatch.setattr(replicates, name, x)
    rng = np.random.default_rng(7)
    for n in (2, 7, 64, 65, 500, 3000):
        net = rng.normal(drift, min(spread, 2500), n)
        net[rng.random(n) < 0.2] = 0.0 if np.isfinite(spread) else np.nan
        for permute in (False, True, None):
            told = replicates.path_lanes(11, net, np.arange(5, 45), 100_000.0, permute, -0.2)
            for k, whole in enumerate(replicates.path_lanes(11, net, np.arange(5, 45), 100_000.0, permute)):
                assert (told[k] <= -0.2).tolist() == (whole <= -0.2).tolist() if k % 2 else told[k] == pytest.approx(whole, abs=1e-9, nan_ok=True)


def test_paths_that_fall_early_are_not_told_in_stretches(monkeypatch):
    for name, x in (("A_CACHE", 64), ("A_STRETCH", 8), ("A_PART", 100)):
        monkeypatch.setattr(replicates, name, x)
    made, told = [], []
    words, bounded = replicates._Lanes.words, replicates.bounded_fall
    monkeypatch.setattr(replicates._Lanes, "words", lambda self, rep, s, e, *at: made.append(e - s) or words(self, rep, s, e, *at))
    monkeypatch.setattr(replicates, "bounded_fall", lambda *x: told.append(1) or bounded(*x))
    net = np.random.default_rng(5).normal(-1000, 2500, 5000)
    _, a, _, b = replicates.path_lanes(11, net, np.arange(40), 100_000.0, None, -0.2)
    assert (a <= -0.2).all() and (b <= -0.2).all() and sum(made) == 40 * 5000 and not told


def test_a_floor_leaves_the_report_as_it_is(spark):
    rng = np.random.default_rng(9)
    rows = [(p, f"{i:03d}", float(x)) for p, n, m in (("a", 2, 0), ("b", 200, -500), ("c", 200, 60), (None, 90, 900)) for i, x in enumerate(rng.normal(m, 2500, n))]
    t = spark.createDataFrame(rows, "p string, id string, net double")
    deep, flags = (portfolio.replicate_trades(t, ["p"], "id", 150, floor=f) for f in (None, portfolio.A_FLOOR))
    assert flags.columns == ["p", "kind", "rep", "ret", "shallow"]
    whole = {(r.p, r.kind, r.rep): (r.ret, r.max_drawdown > -0.2) for r in deep.collect()}
    got = {(r.p, r.kind, r.rep): (r.ret, r.shallow) for r in flags.collect()}
    assert len(got) == 1200 and len(set(x for _, x in got.values())) == 2
    assert all(got[k][1] == whole[k][1] and got[k][0] == pytest.approx(whole[k][0], abs=1e-9) for k in whole) and got.keys() == whole.keys()
    told = [{(r.p, r.kind): tuple(r)[2:] for r in portfolio.distribution_summary(x, ["p", "kind"], 0.1).collect()} for x in (deep, flags)]
    assert all(told[1][k] == pytest.approx(told[0][k], abs=1e-9) for k in told[0]) and len(told[1]) == 8


def test_many_groups_are_cut_in_fewer_blocks(spark):
    t = spark.createDataFrame([(g, f"{i}", float(i)) for g in range(25) for i in range(3)], "g int, id string, net double")
    # a group's trades are shuffled once for each of its blocks
    assert 12 * 20 < portfolio.replicate_trades(t, ["g"], "id", 10_000).rdd.getNumPartitions() <= 300


def test_trades_are_read_once_and_reach_few_blocks(spark):
    t = spark.createDataFrame([("a", f"{i:03d}", float(i)) for i in range(40)], "p string, id string, net double").repartition(1)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    paths = portfolio.replicate_trades(t.mapInArrow(counted, t.schema), ["p"], "id", 10_000)
    assert paths.count() == 20_000 and read.value == 40
    assert paths.rdd.getNumPartitions() <= 32


def test_sorted_rows_are_packed_by_runs(spark):
    read, kind = pa.schema([("p", pa.string()), ("_g", pa.int64()), ("net", pa.float64())]), pa.schema([("p", pa.string()), ("_g", pa.int64()), ("_at", pa.int64()), ("_net", pa.binary())])
    rows = [(p, 3, None if i % 5 == 2 else float(i)) for p, n in ((None, 7), ("a", 1), ("b", 10)) for i in range(n)]
    want = [(None, 0, [0.0, 1, 0, 3]), (None, 1, [4, 5, 6]), ("a", 0, [0]), ("b", 0, [0, 1, 0, 3]), ("b", 1, [4, 5, 6, 0]), ("b", 2, [8, 9])]
    for size in (1, 3, 18):
        batches = (pa.RecordBatch.from_pylist([dict(zip(read.names, r, strict=True)) for r in rows[s : s + size]], read) for s in range(0, len(rows), size))
        got = [r for b in replicates._packed(["p", "_g"], kind, piece=4)(batches) for r in b.to_pylist()]
        assert [(r["p"], r["_at"], np.frombuffer(r["_net"]).tolist()) for r in got] == want and {r["_g"] for r in got} == {3}
    # an amount that isn't known is none, as in a sum
    t = spark.createDataFrame([("a", f"{i}", x) for i, x in enumerate((-500.0, None, 900.0, None))], "p string, id string, net double")
    zero = portfolio.bootstrap_trades(t.fillna(0.0), ["p"], "id", 9).collect()
    assert portfolio.bootstrap_trades(t, ["p"], "id", 9).collect() == zero


def test_too_few_trades_raise(spark):
    t = spark.createDataFrame([("a", "1", 5.0)], "p string, id string, net double")
    assert portfolio.bootstrap_trades(t, ["p"], "id", 3).count() == 3
    with pytest.raises(Exception, match="at least 2"):
        portfolio.permute_trades(t, ["p"], "id", 3).collect()
    for f in (portfolio.bootstrap_trades, portfolio.permute_trades):
        with pytest.raises(ValueError, match="no trades"):
            f(t.limit(0), ["p"], "id", 3)


def test_whole_dates_are_drawn_with_all_assets(spark):
    rng = random.Random(2)
    rows = [(f"a{k}", dt.date(2024, 1, 1) + dt.timedelta(i), round(rng.gauss(0, 1), 1), round(rng.gauss(0, 1), 1) if rng.random() < 0.9 else None) for i in range(25) for k in range(1 + i % 4)]
    df = spark.createDataFrame(rows, "asset string, d date, s double, y double")
    got = stats.bootstrap_ic(df, [], "d", ["s"], "y", 40).collect()
    pdf = pd.DataFrame([r for r in rows if r[3] is not None], columns=["asset", "d", "s", "y"])
    days = sorted(pdf.d.unique())
    for r in got:
        drawn = [days[word(group_of(), r.rep, s) * len(days) >> 32] for s in range(len(days))]
        sample = pd.concat([pdf[pdf.d == x] for x in drawn])
        assert r.ic_s == pytest.approx(sample.s.rank().corr(sample.y.rank()), abs=1e-12)
    assert {(r.n, r.n_units) for r in got} == {(len(pdf), len(days))} and len(got) == 40


def test_few_dates_and_constants_are_told(spark):
    df = spark.createDataFrame([("g", dt.date(2024, 1, 1 + i), float(i), float(i)) for i in range(9)], "g string, d date, s double, y double")
    r = stats.bootstrap_summary(stats.bootstrap_ic(df, [], "d", ["s"], "y", 50), [], "ic_s", least_units=10).first()
    assert (r.lo, r.hi, r.note, r.n_units) == (None, None, "fewer than 10 units", 9)
    flat = stats.bootstrap_ic(df.selectExpr("g", "d", "1.0 as s", "y"), ["g"], "d", ["s"], "y", 20)
    assert {x.ic_s for x in flat.collect()} == {None}
    dropped, zero = (stats.bootstrap_summary(flat, ["g"], "ic_s", undefined=u).first() for u in (None, 0.0))
    assert (dropped.n_reps, dropped.mean, zero.n_reps, zero.mean) == (0, None, 20, 0.0)
