"""Reports: what was known when, funnels, calibration, searches, sinks."""

import datetime as dt
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F


from panelforge.operators import asof, filings, stats
from panelforge.operators import universe as un
from panelforge.sources import feeds
from tests.scipy_free import spearman

D = dt.date


def test_a_later_receipt_never_changes_an_earlier_value(spark):
    schema = "e string, ref_date date, received_on date, version int, value double"
    lines = [
        ("x", D(2022, 9, 30), D(2022, 11, 10), 1, 60.0), ("x", D(2022, 12, 31), D(2023, 3, 20), 1, 100.0),
        ("x", D(2023, 9, 30), D(2023, 11, 10), 1, 75.0), ("x", D(2023, 12, 31), D(2024, 3, 20), 1, 110.0),
    ]
    later = [("x", D(2022, 12, 31), D(2024, 1, 15), 2, 130.0), ("x", D(2023, 9, 30), D(2024, 2, 1), 2, 80.0)]
    points = spark.createDataFrame([("x", D(2022, 12, 1) + dt.timedelta(k * 10)) for k in range(60)] + [("y", D(2023, 1, 1)), ("x", D(2022, 1, 1))], "e string, d date")
    told = lambda rows, slices=None: {(r.e, r.d): (r.ref_date, r.value, r.reason) for r in filings.ttm_known(points, spark.createDataFrame(rows, schema), ["e"], "d", slices=slices).collect()}
    before, after = told(lines), told(lines + later)
    assert told(lines + later, 5) == after
    cut = D(2024, 1, 15)
    assert {k: v for k, v in before.items() if k[1] < cut} == {k: v for k, v in after.items() if k[1] < cut}
    assert after["x", D(2022, 12, 11)] == (D(2022, 9, 30), None, "no prior year to date")
    assert after["x", D(2023, 11, 16)] == (D(2023, 9, 30), 75.0 + 100.0 - 60.0, None)
    # the annual is restated first, then the quarter
    assert after["x", D(2024, 1, 25)] == (D(2022, 12, 31), 130.0, None)
    assert after["x", D(2024, 2, 4)] == (D(2023, 9, 30), 80.0 + 130.0 - 60.0, None)
    assert after["x", D(2024, 3, 25)] == (D(2023, 12, 31), 110.0, None)
    assert after["y", D(2023, 1, 1)] == after["x", D(2022, 1, 1)] == (None, None, "no filing")


def test_an_annual_without_receipt_never_counts(spark):
    schema = "e string, ref_date date, received_on date, version int, value double"
    lines = spark.createDataFrame([("x", D(2022, 9, 30), D(2022, 11, 1), 1, 60.0), ("x", D(2022, 12, 31), None, 1, 100.0), ("x", D(2023, 9, 30), None, 1, 75.0)], schema)
    points = spark.createDataFrame([("x", D(2024, 1, 1)), ("x", D(2023, 3, 1))], "e string, d date")
    got = {r.d: (r.ref_date, r.value, r.reason) for r in filings.ttm_known(points, lines, ["e"], "d").collect()}
    assert got == {D(2024, 1, 1): (D(2023, 9, 30), None, "no prior annual"), D(2023, 3, 1): (D(2022, 12, 31), 100.0, None)}


def test_strengths_are_found(spark):
    rng = random.Random(4)
    rows = [(str(i % 40), str(i // 40), z := rng.gauss(0, 1), z * 0.8 + rng.gauss(0, 0.6)) for i in range(8000)]
    panel = spark.createDataFrame(rows, "asset string, day string, z double, y double")
    got = {r.target: r for r in stats.find_alphas(panel, [-1.0, 0.1, 0.35, 2.0], ["asset", "day"], "z", "y").collect()}
    for t in (0.1, 0.35):
        s = stats.signal_sweep(panel, [got[t].alpha], ["asset", "day"], "z").toPandas()
        assert abs(got[t].ic - t) < 0.005 and spearman(s["signal"], s["y"]) == pytest.approx(got[t].ic, abs=1e-9)
    # out of reach: the nearest, where clipping costs the last strengths a little
    assert got[-1.0].alpha == 0.0 and got[2.0].alpha > 0.95 and got[2.0].ic >= got[0.35].ic


def test_sources_are_weighed_in_place(spark):
    df = spark.createDataFrame([(1, "News.com", "http://a"), (2, "b.org", "http://x/NEWS.com"), (3, None, "u"), (4, "b.org", None)], "id int, domain string, url string")
    got = un.weight_sources(df, [("news.com", 0.9), ("b.org", 0.5)], "domain", "url")
    assert {r.id: r.weight for r in got.collect()} == {1: 0.9, 2: 0.9, 4: 0.5} and got.columns == ["id", "domain", "url", "weight"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert un.weight_sources(df, [], "domain", "url").count() == 0


def test_filings_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2020, 5, 1), 1.0), (2, D(2021, 5, 1), 2.0)], "CD_CVM int, DT_REFER date, VL_CONTA double")
    at = str(tmp_path / "filings")
    for kind, rows in (("a", df), ("a", df), ("b", df), ("a", df.filter("CD_CVM = 2").withColumn("VL_CONTA", F.lit(5.0)))):
        feeds.write_filings(rows, at, kind)
    assert sorted((r.kind, r.year, r.VL_CONTA) for r in spark.read.parquet(at).collect()) == [("a", 2020, 1.0), ("a", 2021, 5.0), ("b", 2020, 1.0), ("b", 2021, 2.0)]


def test_lookahead_over_kinds(spark):
    prices = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 3),), (None,)], "d date")
    news = spark.createDataFrame([(dt.datetime(2024, 1, 2, 12),), (dt.datetime(2024, 1, 2, 18),)], "at timestamp")
    kinds = {"prices": (prices, "d"), "news": (news, "at")}
    assert {(r.kind, r.n, r.n_late) for r in un.lookahead_report(kinds, "2024-01-02 17:00:00").collect()} == {("prices", 3, 1), ("news", 2, 1)}
    with pytest.raises(ValueError, match="look-ahead"):
        un.require_no_lookahead(kinds, "2024-01-02 17:00:00")
    un.require_no_lookahead(kinds, "2024-01-03 17:00:00")
    with pytest.raises(ValueError, match="zone"):
        un.lookahead_report({"news": (news.select(F.col("at").cast("timestamp_ntz").alias("at")), "at")}, "2024-01-02")


def test_sampling_funnels_count_what_they_drop(spark):
    days = [D(2024, 1, 1) + dt.timedelta(k) for k in range(20)]
    sessions = spark.createDataFrame([(x,) for x in days], "d date")
    uni = spark.createDataFrame([("a", 1, None, None), ("b", 1, D(2024, 1, 5), None)], "asset string, sector int, valid_from date, valid_to date")
    news = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 2, 9)), ("b", 2, dt.datetime(2024, 1, 3, 9)), ("a", 3, dt.datetime(2024, 1, 12, 9))], "asset string, news_id int, published_at timestamp_ntz")
    labels = spark.createDataFrame([("a", x) for x in days[3:15]] + [("b", days[9])], "asset string, d date")
    counts = Observation()
    judged = un.judged_events(sessions, uni, news, labels, counts=counts)
    rows = judged.collect()
    n = lambda v: sum(r.verdict == v for r in rows)
    assert counts.get == {"n_candidates": len(rows), "n_sampled": n("sampled"), "n_no_news": n("no news"), "n_duplicate": n("duplicate"), "n_no_label": n("no label")}
    got = {(r.asset, r.d) for r in un.sample_events(sessions, uni, news, labels).collect()}
    # a's first set has its first label on the 4th; b's only label is the 10th
    assert got == {("a", D(2024, 1, 4)), ("b", D(2024, 1, 10)), ("a", D(2024, 1, 12))} and len(rows) == 36


def test_probe_counters(spark):
    df = spark.createDataFrame([(f"e{i}", i % 3 != 0, i % 2 == 0 if i % 5 else None) for i in range(60)], "id string, a boolean, b boolean")
    order = [r.id for r in un.sample_random(df, ["id"], 60).collect()]
    rows = {r.id: r for r in df.collect()}
    for n in (4, 1000, 0):
        taken, counts = un.sample_passing(df, ["id"], n, {"a": F.col("a"), "b": F.col("b")})
        good = [i for i in order if rows[i].a and rows[i].b]
        probed = order[: order.index(good[n - 1]) + 1] if 0 < n <= len(good) else order if n else []
        assert {r.id for r in taken.collect()} == set(good[:n])
        c = counts.first()
        if n:
            assert (c.n_probed, c.n_taken, c.failed_a, c.failed_b) == (len(probed), len(good[:n]), sum(not rows[i].a for i in probed), sum(rows[i].a and not rows[i].b for i in probed))


def test_baselines_of_events_need_thirty_rows(spark):
    rng = random.Random(5)
    for n, told in ((31, True), (30, False)):
        rows = [(i < n, rng.random(), rng.random(), rng.random()) for i in range(100)]
        got = {r.scope: r for r in stats.ic_baselines(spark.createDataFrame(rows, "e boolean, s double, m double, y double"), [], "s", ["m"], "y", "e").collect()}
        some = [r for r in rows if r[0]]
        s, m = (spearman([r[k] for r in some], [r[3] for r in some]) for k in (1, 2))
        assert got["event"].ic_s == pytest.approx(s)
        assert (got["event"].ic_m, got["event"].gap) == ((pytest.approx(m), pytest.approx(s - max(0, m))) if told else (None, None))
        assert got["all"].ic_m is not None


def test_calibration_report_adds_up(spark):
    rng = random.Random(6)
    rows = [(f"e{i}", "seen" if i % 3 else "unseen", rng.random(), rng.random(), rng.random(), rng.random(), ["f"] if i % 7 == 0 else [], i % 10 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, seg string, s double, y double, yb double, b double, flags array<string>, bad boolean")
    got = {r.part: r for r in stats.full_calibration(df, "seg", "s", "y", "yb", "b", "flags", F.col("bad"), "id", 50).collect()}
    for part, r in got.items():
        mine = [x for x in rows if part in ("all", x[1])]
        good = [x for x in mine if not x[7]]
        ic = lambda a, b: spearman([x[a] for x in good], [x[b] for x in good])  # noqa: B023, E731
        assert (r.n, r.n_all, r.n_degraded, r.n_flagged) == (len(good), len(mine), len(mine) - len(good), sum(bool(x[6]) for x in good))
        assert (r.ic, r.ic_beta, r.ic_baseline, r.gap) == pytest.approx((ic(2, 3), ic(2, 4), ic(5, 3), ic(2, 3) - ic(5, 3)))
        assert r.lo < r.hi and r.note == "caveat"
    assert set(got) == {"all", "seen", "unseen"}


def test_members_by_day_and_over_a_range(spark):
    uni = spark.createDataFrame([("a", 1, None, D(2024, 1, 2)), ("b", 1, D(2024, 1, 2), None), ("c", 2, D(2024, 2, 1), D(2024, 1, 1))], "asset string, sector int, valid_from date, valid_to date")
    days = spark.createDataFrame([(D(2024, 1, k),) for k in (1, 2, 3)], "d date")
    assert {(r.d.day, tuple(r.assets)) for r in un.sector_members(uni, days).collect()} == {(1, ("a",)), (2, ("a", "b")), (3, ("b",))}
    over = lambda a, b: {r.asset for r in un.active_over(uni, a, b).collect()}
    assert over("2024-01-01", "2024-01-01") == {"a"} and over("2024-01-02", "2024-03-01") == {"a", "b"} and over("2024-01-03", "2024-01-01") == set()


def test_bar_of_repeats_is_the_last(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, 1), 9.0, 1), ("a", D(2024, 1, 1), 5.0, 2)], "k string, d date, close double, n int")
    p = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2024, 1, 2))], "k string, d date")
    assert [r.close for r in asof.bar_on(p, bars, ["k"], order="n").orderBy("d").collect()] == [5.0, None]
    assert [r.close for r in asof.bar_on(p, bars, ["k"]).orderBy("d").collect()] == [9.0, None]


def test_training_ends_an_embargo_before_the_test(spark):
    from panelforge.operators import model

    rng = random.Random(7)
    rows = [(a, D(2024, 1, 1) + dt.timedelta(k), k, x := rng.random(), (rng.random() + x) * 0.1, rng.random() < 0.2) for k in range(66) for a in "abcd"]
    p = spark.createDataFrame(rows, "asset string, d date, ord int, x double, y double, has_event boolean").cache()
    train, test = model.embargoed(p, "2024-02-10")
    assert train.agg(F.max("ord")).first()[0] + 10 == test.agg(F.min("ord")).first()[0] == 40
    with pytest.raises(ValueError, match="no day"):
        model.embargoed(p, "2025-01-01")
    got = {(r.fold, r.stage): (r.ic, r.n) for r in model.cross_validated_stages(p, 66, ["x"], k=2, trees=3).collect()}
    # blocks of 22: the folds' tests are 22..43 and 44..65
    assert set(got) == {(f, s) for f in (1, 2) for s in (1, 2, 3)} and {n for _, n in got.values()} == {88}
    for fold, first in ((1, 22), (2, 44)):
        m = model.train_gbt(p.filter(F.col("ord") <= first - 10), ["x"], trees=3)
        own = p.filter(F.col("ord").between(first, first + 21))
        last = model.predict(m, own, ["x"]).toPandas()
        assert got[fold, 3][0] == pytest.approx(spearman(last["y_pred"], last["y"]))
    assert model.cross_validated_stages(p.filter("ord < 30"), 30, ["x"], k=2, trees=2, least=200).count() == 0
