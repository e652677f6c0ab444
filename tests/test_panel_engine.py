"""Analytic values and edge rules of the panel engine."""

import datetime as dt
import json
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars, timeutil
from panelforge.operators import asof, filings, model, news, panel, portfolio, stats, universe
from panelforge.sources import feeds
from panelforge.streaming import twins

D = dt.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_business_days_match_numpy(spark):
    rng = np.random.default_rng(1)
    pairs = [(D(2000, 1, 1) + dt.timedelta(int(a)), D(2000, 1, 1) + dt.timedelta(int(b))) for a, b in rng.integers(0, 3000, (200, 2))]
    df = spark.createDataFrame(pairs, "a date, b date")
    got = df.select("a", "b", timeutil.busday_count(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == np.busday_count(r.a, r.b) for r in got)


def test_busday_add_over_weekends(spark):
    df = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 6),), (D(2024, 1, 8),)], "d date")
    assert [r[0] for r in rows(df.select(timeutil.busday_add(F.col("d"), 1)))] == [D(2024, 1, 8), D(2024, 1, 8), D(2024, 1, 9)]


def test_asof_inclusive_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2023, 1, 1)), ("b", D(2024, 1, 5)), ("a", None), (None, D(2024, 1, 5))], "k string, t date")
    right = spark.createDataFrame([("a", D(2024, 1, 5), 1), ("a", D(2024, 1, 1), 2), ("a", None, 3)], "k string, u date, v int")
    got = {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {("a", D(2024, 1, 5)): 1, ("a", D(2023, 1, 1)): None, ("b", D(2024, 1, 5)): None, ("a", None): None, (None, D(2024, 1, 5)): None}


def test_asof_without_key_crosses_months(spark):
    left = spark.createDataFrame([(D(2024, 5, 5),), (D(2023, 1, 1),)], "t date")
    right = spark.createDataFrame([(D(2024, 1, 5), 1), (D(2024, 2, 1), 2)], "u date, v int")
    assert {r.t: r.v for r in asof.asof_join(left, right, [], "t", "u", ["v"]).collect()} == {D(2024, 5, 5): 2, D(2023, 1, 1): None}


def test_later_cutoff_never_changes_earlier_rows(spark):
    h = spark.createDataFrame([("a", D(2024, 3, 31), D(2024, 5, 1), 1), ("a", D(2024, 6, 30), None, 1)], "entity string, ref_date date, received_on date, version int")
    pts = spark.createDataFrame([("a", D(2024, 5, 2)), ("a", D(2024, 8, 13)), ("a", D(2024, 8, 14))], "entity string, d date")
    got = {r.d: r.ref_date for r in asof.asof_filing(pts, h, ["entity"], "d").collect()}
    assert got == {D(2024, 5, 2): D(2024, 3, 31), D(2024, 8, 13): D(2024, 3, 31), D(2024, 8, 14): D(2024, 6, 30)}


def test_spearman_ties_constant_and_few(spark):
    df = spark.createDataFrame([("x", 1.0, 1.0), ("x", 2.0, 2.0), ("x", 2.0, 3.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("f", 1.0, 1.0)], "g string, a double, b double")
    got = {r.g: r.ic for r in stats.spearman(df, ["g"], "a", "b").collect()}
    assert got["c"] is None and got["f"] is None and got["x"] == pytest.approx(0.8660254, abs=1e-6)


def test_bootstrap_of_perfect_score_is_one_in_every_block(spark):
    df = spark.createDataFrame([("g", i // 3, float(i), float(i)) for i in range(6)], "g string, block int, s double, y double")
    got = stats.bootstrap_ic(df, ["g"], "block", ["s"], "y", 10).collect()
    assert len(got) == 10 and all(r.ic_s == pytest.approx(1.0) for r in got)


def test_permutation_extremes(spark):
    t = spark.createDataFrame([("p", str(i), x) for i, x in enumerate([1000.0, 1000.0, -500.0, -500.0])], "p string, id string, net double")
    got = portfolio.permute_trades(t, ["p"], "id", 200).collect()
    dd = [r.max_drawdown for r in got]
    assert {round(r.ret, 9) for r in got} == {0.01} and max(dd) < 0
    assert min(dd) == pytest.approx(-0.01) and max(dd) == pytest.approx(-500 / 101000)


def test_trade_stats_edges(spark):
    t = spark.createDataFrame([("w", 1.0, 0.1), ("l", -1.0, 0.1), ("z", 0.0, 0.1)], "p string, net double, costs double")
    got = {r.p: (r.payoff, r.profit_factor) for r in portfolio.trade_stats(t, ["p"]).collect()}
    assert got == {"w": (float("inf"), float("inf")), "l": (0.0, 0.0), "z": (None, None)}


def test_downside_deviation_over_all_rows(spark):
    e = [100.0]
    for i in range(500):
        e.append(e[-1] * (1.001 if i not in (100, 300) else 0.95))
    df = spark.createDataFrame([("p", D(2020, 1, 1) + dt.timedelta(i), x) for i, x in enumerate(e)], "p string, d date, equity double")
    r = portfolio.risk_stats(df, ["p"]).first()
    assert (0.001 * 498 - 0.1) / 500 / r.sortino * 252**0.5 == pytest.approx(0.0031622776601)


def test_constant_equity_has_no_risk(spark):
    df = spark.createDataFrame([("p", D(2020, 1, i), 5.0) for i in range(1, 6)], "p string, d date, equity double")
    r = portfolio.risk_stats(df, ["p"]).first()
    d = portfolio.drawdown_stats(df, ["p"]).first()
    assert (r.vol, r.sharpe) == (0.0, 0.0) and (d.max_drawdown, d.length, d.recovery) == (0.0, 0, None)


def test_stop_wins_on_one_day(spark):
    s = spark.createDataFrame([(D(2024, 1, i), i) for i in range(1, 9)], "d date, ord int")
    bars = spark.createDataFrame([("a", D(2024, 1, 3), 100.0, 130.0, 80.0, 100.0)], "asset string, d date, open double, high double, low double, close double")
    e = spark.createDataFrame([("t", "a", D(2024, 1, 2), 100.0)], "trade_id string, asset string, entry_d date, entry_px double")
    r = portfolio.resolve_exits(e, bars, s).first()
    assert (r.reason, r.exit_px, r.exit_d) == ("stop", 92.0, D(2024, 1, 3))


def test_cooldown_does_not_extend(spark):
    d0 = D(2024, 1, 1)
    falls = [100.0] * 21 + [85.0] + [84.0] * 9
    df = spark.createDataFrame([("p", d0 + dt.timedelta(i), x) for i, x in enumerate(falls)], "p string, d date, equity double")
    got = [r.blocked for r in portfolio.cooldown_gate(df, ["p"]).orderBy("d").collect()]
    assert not any(got[:21]) and got[21]


def test_entries_equal_the_greedy_loop(spark):
    import random

    rng = random.Random(3)
    preds, held, want = [], [], set()
    for p in range(30):
        names = [(f"a{k}", rng.randrange(3), k) for k in range(10)]
        mine = rng.sample(names, rng.randrange(3))
        held += [(p, D(2024, 1, 1), a, s) for a, s, _ in mine]
        taken, per = len(mine), {}
        for _, s, _ in mine:
            per[s] = per.get(s, 0) + 1
        for a, s, k in names:
            good = rng.random() < 0.7
            preds.append((p, D(2024, 1, 1), a, s, k, 0.5 if good else 0.1, 2.0))
            if good and a not in [m[0] for m in mine] and per.get(s, 0) < 2 and taken < 3:
                want.add((p, a))
                per[s] = per.get(s, 0) + 1
                taken += 1
    pd_ = spark.createDataFrame(preds, "portfolio int, d date, asset string, sector int, rank int, score double, relative_volume double")
    hd = spark.createDataFrame(held, "portfolio int, d date, asset string, sector int")
    assert {(r.portfolio, r.asset) for r in portfolio.select_entries(pd_, hd).collect()} == want


def test_fuzzy_dedupe_is_the_greedy_result(spark):
    base = dt.datetime(2024, 1, 1, 9)
    items = [
        ("a", 1, "Petro anuncia dividendo recorde", base, 1.0),
        ("a", 2, "Petro anuncia dividendo recorde hoje", base + dt.timedelta(hours=2), 0.75),
        ("a", 3, "Petro anuncia dividendo recorde", base + dt.timedelta(hours=48), 1.0),
        ("b", 4, "Petro anuncia dividendo recorde", base, 0.5),
    ]
    df = spark.createDataFrame(items, "asset string, id int, title string, ts timestamp, w double")
    kept = sorted(r.id for r in news.dedupe_fuzzy(df, ["asset"], "title", "ts", ["w"], "id").collect())
    want, seen = [], []
    for a, i, t, ts, w in sorted(items, key=lambda x: (-x[4], x[1])):
        norm = " ".join("".join(c for c in t.lower() if c.isascii() and (c.isalnum() or c == " ")).split())[:80]
        if not any(a == b and abs(ts - u) < dt.timedelta(hours=24) and SequenceMatcher(None, s, norm).ratio() > 0.85 for b, s, u in seen):
            want.append(i)
            seen.append((a, norm, ts))
    assert kept == sorted(want)


def test_segments_and_titles(spark):
    text = "Menu\n 01/15/2025 14:30:00[BN]\nPrint\nA long enough title\nSummary\n- one\n- two\nBy Someone\n(City) -- The body.\n 01/16/2025 09:00:00[XX]\nshort\nA long title that comes too late\n"
    df = spark.createDataFrame([("f", text)], "feed string, text string")
    r = news.segment_records(df, "text").select(news.extract_title(F.col("record")).alias("t"), news.extract_summary(F.col("record")).alias("s"), news.extract_body(F.col("record")).alias("b")).collect()
    assert [x.t for x in r] == ["A long enough title", None]
    assert (r[0].s, r[0].b) == ("one two", "(City) -- The body.")


def test_percent_period_and_clamp(spark):
    df = spark.createDataFrame([("45.64%",), ("1,045.64%",), ("N.M.",), ("",), (None,)], "x string")
    assert [r[0] for r in rows(df.select(scalars.parse_percent(F.col("x"))))] == [45.64, 1045.64, None, None, None]
    assert spark.range(1).select(scalars.parse_period_end(F.lit("06/25"))).first()[0] == D(2025, 6, 30)
    assert [r[0] for r in rows(df.select(scalars.clamp(F.col("x"), -1, 1)))] == [0.0] * 5


def test_lookahead_raises_in_strict_mode(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2),)], "ts timestamp")
    assert universe.lookahead_violations(df, "ts", "2024-01-01 00:00:00").count() == 1
    with pytest.raises(Exception, match="look-ahead"):
        universe.lookahead_violations(df, "ts", "2024-01-01 00:00:00", strict=True).collect()


def test_folds_are_purged(spark):
    p = spark.createDataFrame([(i,) for i in range(60)], "ord int")
    f = model.purged_folds(p, 60, k=5)
    r = f.groupBy("fold").agg(F.max(F.when(F.col("side") == "train", F.col("ord"))).alias("t"), F.min(F.when(F.col("side") == "test", F.col("ord"))).alias("s")).collect()
    assert all(x.t is None or x.t + 10 <= x.s for x in r) and len(r) == 5
    assert model.fold_bounds(6, 5) == []


def test_ttm_by_hand(spark):
    lines = spark.createDataFrame([("e", D(2024, 9, 30), 139.07), ("e", D(2023, 9, 30), 141.64), ("e", D(2023, 12, 31), 641.26)], "entity string, ref_date date, value double")
    got = {r.ref_date: (r.value, r.reason) for r in filings.ttm(lines, ["entity"]).collect()}
    assert got[D(2024, 9, 30)][0] == pytest.approx(638.69) and got[D(2023, 9, 30)] == (None, "no prior annual")


def test_feeds(spark, tmp_path):
    a = spark.createDataFrame([('{"articles": [{"title": "t", "url": "http://x.com/1", "domain": null, "seendate": "20240110T120000Z"}, {"title": "u", "url": "", "domain": "d", "seendate": "junk"}]}',)], "payload string")
    assert [(r.title, r.source) for r in feeds.normalize_feed_a(a, "2024-02-01").collect()] == [("t", "unknown")]
    b = spark.createDataFrame([('{"articles": [{"title": "t", "description": "a", "content": "b", "url": "http://x.com/1", "publishedAt": "2024-01-10T12:00:00Z"}]}',)], "payload string")
    assert [(r.body, r.source) for r in feeds.normalize_feed_b(b, "2020-01-01", "2024-01-20").collect()] == [("a b", "x.com")]
    assert feeds.normalize_feed_b(b, "2025-01-01", "2024-01-20").count() == 0
    m = spark.createDataFrame([("s", '[{"data": "02/01/2024", "valor": "1.5"}, {"data": "x", "valor": "y"}]')], "series string, payload string")
    assert {(r.ref_date, r.value) for r in feeds.normalize_macro_a(m).collect()} == {(D(2024, 1, 2), 1.5), (None, None)}
    p = tmp_path / "f.csv"
    p.write_bytes("CD_CVM;DT_REFER;VERSAO;VL_CONTA;DS_CONTA;OTHER\n7;2024-03-31;;1.5;Lucro líquido;x\nx;bad;2;y;z;x\n".encode("latin-1"))
    r = feeds.read_filings(spark, str(p)).collect()
    assert [(x.CD_CVM, x.DT_REFER, x.VERSAO, x.VL_CONTA) for x in r] == [(7, D(2024, 3, 31), 0, 1.5), (None, None, 2, None)] and r[0].DS_CONTA == "Lucro líquido"
    n = tmp_path / "n.csv"
    n.write_text("data,ticker,titulo\n2024-01-01,a,b\n")
    with pytest.raises(ValueError, match="lacks"):
        feeds.read_news_csv(spark, str(n))


def test_window_features_need_their_rows(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(i), 10.0 + i, 1.0) for i in range(25)], "asset string, d date, close double, volume double")
    r = panel.relative_volume(panel.momentum(df, ["asset"], "d", 10, 2), ["asset"], "d").orderBy("d").collect()
    assert r[9].momentum is None and r[10].momentum == pytest.approx(18 / 10 - 1)
    assert r[19].relative_volume is None and r[20].relative_volume == 1.0


def test_empty_tables(spark):
    e = spark.createDataFrame([], "asset string, d date, close double, volume double, y double, p string, net double, costs double")
    assert panel.momentum(e, ["asset"], "d").count() == 0
    assert stats.spearman(e, ["d"], "close", "y").count() == 0
    assert portfolio.trade_stats(e, ["p"]).count() == 0
    assert asof.asof_join(e.select("asset", "d"), e.select("asset", F.col("d").alias("t"), "close"), ["asset"], "d", "t", ["close"]).count() == 0


def test_stream_dedupe(spark, tmp_path):
    df = spark.createDataFrame([("a", "The Title!", dt.datetime(2024, 1, 1, 9)), ("a", "the title", dt.datetime(2024, 1, 1, 10)), ("b", "the title", dt.datetime(2024, 1, 1, 9))], "asset string, title string, ts timestamp")
    df.write.parquet(str(tmp_path / "n"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "n"))
    out = twins.run_once(spark, twins.stream_dedupe(s, ["asset"], "title", "ts").select("asset"), "dedupe_test")
    assert sorted(r.asset for r in out.collect()) == ["a", "b"]


def test_registered_queries_have_distinct_results(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120
    assert entry.entry(spark).count() > 0


def test_exits_on_the_entry_day_and_by_reversal(spark):
    day = lambda k: dt.date(2024, 1, k)
    bars = spark.createDataFrame([("a", day(k), 100.0 + k, 102.0 + k, lo, 101.0 + k) for k, lo in zip(range(1, 12), [90.0, *[99.0] * 10], strict=True)], "asset string, d date, open double, high double, low double, close double")
    sessions = spark.createDataFrame([(day(k), k - 1) for k in range(1, 12)], "d date, ord int")
    e = spark.createDataFrame([("t", "a", day(1), 101.0)], "trade_id string, asset string, entry_d date, entry_px double")
    exits = lambda **more: portfolio.resolve_exits(e, bars, sessions, **more).select("exit_d", "exit_px", "reason").first()
    assert tuple(exits()) == (day(7), 107.0, "deadline")
    assert tuple(exits(from_entry=True)) == (day(1), pytest.approx(0.92 * 101), "stop")
    signal = lambda k: spark.createDataFrame([("t", day(k)), ("t", day(1))], "trade_id string, d date")
    assert tuple(exits(reversals=signal(3))) == (day(4), 104.0, "reversal")
    assert exits(reversals=signal(6)).reason == "deadline"


def test_cooldown_ends_and_starts_again(spark):
    rows = [("p", dt.date(2024, 1, 1) + dt.timedelta(days=k), 100.0 if k < 21 else 85.0) for k in range(60)]
    got = [r.blocked for r in portfolio.cooldown_gate(spark.createDataFrame(rows, "portfolio string, d date, equity double"), ["portfolio"]).orderBy("d").collect()]
    first = got.index(True)
    assert first == 21 and not all(got[first:]) and got[first : first + 5] == [True] * 5
    assert not any(got[45:])  # by then the top has left the window


def test_context_as_of_the_day(spark):
    day = lambda x: F.lit(x).cast("date")
    points = spark.createDataFrame([("A", "s", 7), ("B", "s", 7)], "asset string, sector string, extra int").withColumn("d", day("2020-03-10"))
    news = spark.createDataFrame([("A", i, f"t{i}", "b", "src", float(i % 3)) for i in range(10)], "asset string, news_id bigint, title string, body string, source string, source_weight double")
    news = news.withColumns({"d": day("2020-03-10"), "published_at": F.lit("2020-03-10 10:00:00").cast("timestamp")})
    fundamentals = spark.createDataFrame([("A", "2020-03-01", 5.0), ("A", "2020-03-11", 9.0)], "asset string, r string, pe double").select("asset", F.col("r").cast("date").alias("received_on"), "pe", *(F.lit(None).cast("double").alias(c) for c in ("pb", "roe", "margin", "leverage")))
    macro = spark.createDataFrame([("rate", "2020-01-11", 4.0), ("rate", "2020-04-11", 3.0)], "series string, a string, value double").select("series", F.col("a").cast("date").alias("available_on"), "value")
    bars = spark.createDataFrame([("A", "2020-03-02", 10.0), ("A", "2020-03-09", 11.0), ("A", "2020-03-11", 99.0)], "asset string, t string, close double").select("asset", F.col("t").cast("date").alias("d"), "close")
    earnings = spark.createDataFrame([("A", 2.0)], "asset string, realized double").select("asset", day("2020-03-05").alias("announced_on"), "realized", *(F.lit(None).cast("double").alias(c) for c in ("comparable", "estimated", "move_pct")))
    got = {r.asset: r for r in filings.build_context(points, news, fundamentals, macro, bars, earnings, ["rate", "fx"]).collect()}
    assert got["A"].extra == 7
    text, block = got["A"].context.split("\n\n")
    j = json.loads(text)
    assert [n["news_id"] for n in j["news"]] == [2, 5, 8, 1, 4, 7, 0, 3] and j["fundamentals"] == {"pe": 5.0} and j["macro"] == {"rate": 4.0}
    assert j["sector_return"] == pytest.approx(0.1) and block.startswith("announced: 2020-03-05\nrealized: 2.00")
    assert json.loads(got["B"].context)["news"] == [] and "fundamentals" not in json.loads(got["B"].context)
    hidden = {r.asset: json.loads(r.context) for r in filings.build_context(points, news, fundamentals, macro, bars, earnings, ["rate"], hidden=True).collect()}
    assert set(hidden["A"]) == {"day", "news"} and len(hidden["A"]["news"]) == 8


def test_plateau_takes_the_first_near_the_best(spark):
    ics = spark.createDataFrame([(f, s, ic + 0.02 * f) for f in (0, 1) for s, ic in ((1, 0.0), (4, 0.095), (8, 0.1))], "fold int, stage int, ic double")
    assert {r.stage: r.chosen for r in model.plateau_table(ics).collect()} == {1: False, 4: True, 8: False}


def test_universe_prediction_keeps_the_measured_volume(spark):
    rows = [("A", 1.0, 0.1, True), ("B", None, 0.3, False), ("C", 2.0, 0.2, True)]
    p = spark.createDataFrame(rows, "asset string, relative_volume double, score double, has_event boolean").withColumns({"sector": F.lit("s"), "d": F.lit("2020-01-02").cast("date"), "y": F.col("score")})
    m = model.train_gbt(p.filter("relative_volume is not null").unionByName(p.filter("relative_volume is not null")), ["relative_volume", "score"], trees=2)
    news = spark.createDataFrame([("A", "2020-01-02 09:00:00"), ("A", "2020-01-02 10:00:00"), ("B", "2020-01-02 10:00:00")], "asset string, t string").select("asset", F.col("t").cast("date").alias("d"), F.col("t").cast("timestamp").alias("published_at"))
    got = {r.asset: r for r in model.predict_universe(m, p, ["relative_volume", "score"], news, "2019-12-31").collect()}
    assert got["B"].relative_volume is None and got["B"].latest_news is None and got["A"].latest_news.hour == 10 and got["C"].latest_news is None
    assert sorted(r["rank"] for r in got.values()) == [1, 2, 3] and got["C"]["rank"] < got["A"]["rank"]


def test_top_warnings_with_first_examples(spark):
    dq = spark.createDataFrame([("x", "2020-01-03", "A"), ("x", "2020-01-02", "B"), ("y", "2020-01-01", "A"), ("z", "2020-01-01", "A")], "kind string, d string, asset string")
    assert [tuple(r) for r in stats.top_warnings(dq, 2).collect()] == [("x", 2, "2020-01-02", "B"), ("y", 1, "2020-01-01", "A")]


def test_walk_forward_learns_from_the_past_alone(spark):
    days = [D(2020, 1, 1) + dt.timedelta(k) for k in range(90)]
    p = spark.createDataFrame([(f"a{i}", day, k, float(i), float(i) * (1 if k < 60 else -1), False) for k, day in enumerate(days) for i in range(4)], "asset string, d date, ord int, x double, y double, has_event boolean")
    got = model.walk_forward(p, ["x"], trees=2).collect()
    assert {r.month for r in got} == {"2020-02", "2020-03"} and len(got) == 4 * (29 + 30)
    # what turns in March isn't known before its labels end an embargo earlier
    assert all(r["rank"] == 1 for r in got if r.asset == "a3")
    assert {r.month for r in model.walk_forward(p, ["x"], ["2020-03"], trees=2).collect()} == {"2020-03"}
    assert model.walk_forward(p.limit(0), ["x"]).count() == 0


def test_fuzzy_dedupe_equals_a_greedy_loop(spark):
    rng = np.random.default_rng(5)
    base = ["shares of the mill rise on strong sales", "shares of the mine rise on strong sales", "rates stay where they are", "rates fall"]
    data = []
    for i in range(120):
        t = list(base[rng.integers(4)])
        for _ in range(rng.integers(0, 8)):
            t[rng.integers(len(t))] = rng.choice(list("abcxyz "))
        data.append((i, "ab"[i % 2], "".join(t) if i % 17 else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 120))), float(rng.integers(1, 4))))
    df = spark.createDataFrame(data, "id int, asset string, title string, ts timestamp, weight double")
    got = {r.id for r in news.dedupe_fuzzy(df, ["asset"], "title", "ts", ["weight"], "id").collect()}
    norm = {r.id: r.t for r in df.select("id", scalars.normalize_title(F.col("title")).alias("t")).collect()}
    kept: list[tuple] = []
    for row in sorted(data, key=lambda r: (-r[4], r[0])):
        near = (k for k in kept if k[1] == row[1] and abs((k[3] - row[3]).total_seconds()) < 86400)
        if not any(norm[k[0]] is not None and norm[row[0]] is not None and SequenceMatcher(None, norm[k[0]], norm[row[0]]).ratio() > 0.85 for k in near):
            kept.append(row)
    assert got == {k[0] for k in kept} and 20 < len(got) < 110


def test_stream_cooldown_is_the_gate(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(p, D(2024, 1, 1) + dt.timedelta(k), float(100 + 12 * rng.standard_normal())) for p in "pq" for k in range(70)]
    df = spark.createDataFrame(rows, "portfolio string, d date, equity double")
    df.write.parquet(str(tmp_path / "e"))
    got = twins.run_once(spark, twins.stream_cooldown(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))), "cooldown_test")
    want = portfolio.cooldown_gate(df, ["portfolio"])
    key = lambda x: {(r.portfolio, r.d): r.blocked for r in x.select("portfolio", "d", "blocked").collect()}
    told = key(got)
    assert told == key(want) and 0 < sum(told.values()) < 140


def test_a_view_that_is_read_again_is_made_once(spark, tmp_path):
    from panelforge.operators import panel
    from panelforge.sources.shared import written

    made = spark.sparkContext.accumulator(0)
    told = spark.createDataFrame([(k, D(2024, 1, 1 + k % 5), None if k % 7 == 0 else float(k)) for k in range(70)], "k int, d date, x double")

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    w = written(told.mapInArrow(count, told.schema))
    assert panel.date_ordinal(panel.impute_cross_section(w, ["x"], "d", "2024-01-03")).count() == 70
    assert w.schema == told.schema and made.value == 70


def test_context_moves_no_texts_through_joins_by_time(spark):
    from panelforge.operators import filings

    day = D(2024, 3, 1)
    points = spark.createDataFrame([("a", day, 1), ("b", day, 1)], "asset string, d date, sector int")
    news = spark.createDataFrame([("a", day, 7, "t", "body text", "s", 1.0, dt.datetime(2024, 3, 1, 9))], "asset string, d date, news_id bigint, title string, body string, source string, source_weight double, published_at timestamp")
    f = spark.createDataFrame([("a", D(2024, 1, 1), 1.0, 2.0, 3.0, 4.0, 5.0)], "asset string, received_on date, pe double, pb double, roe double, margin double, leverage double")
    m = spark.createDataFrame([("r", D(2024, 1, 1), 1.5)], "series string, available_on date, value double")
    bars = spark.createDataFrame([("a", D(2024, 2, k), 10.0 + k) for k in range(1, 5)], "asset string, d date, close double")
    e = spark.createDataFrame([], "asset string, announced_on date, realized double, comparable double, estimated double, move_pct double")
    c = filings.build_context(points, news, f, m, bars, e, ["r"])
    got = {r.asset: r.context for r in c.collect()}
    assert '"content":"body text"' in got["a"] and '"roe":3.0' in got["a"] and '"news":[]' in got["b"] and '"fundamentals"' not in got["b"]
    # no union with rows in time carries the list of news
    lines = [x for x in c._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_l#" in x and "struct" in x]
    assert lines and not any("news" in x for x in lines)


def test_keyless_asof_meets_right_once_for_each_time(spark):
    left = spark.createDataFrame([(k, D(2024, 1, 1 + k % 3)) for k in range(60)] + [(60, None)], "k int, t date")
    right = spark.createDataFrame([(D(2024, 1, 2), "x", 1), (D(2024, 1, 2), "y", 2)], "u date, v string, n int")
    for strict, direction, want in ((False, "backward", {1: None, 2: "y", 3: "y"}), (True, "backward", {1: None, 2: None, 3: "y"}), (True, "forward", {1: "y", 2: None, 3: None})):
        got = asof.asof_join(left, right, [], "t", "u", ["v", "u"], direction=direction, strict=strict, tie="n")
        assert got.columns == ["k", "t", "v", "u"] and got.count() == 61
        assert all(r.v == (want[r.t.day] if r.t else None) for r in got.collect())
        # left's rows are neither sorted nor dealt anew: they look up one row for each of their days
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Union" not in plan


def test_news_csv_has_files_of_bounded_size(spark, tmp_path):
    from panelforge.sources import feeds

    rows = [("a" if k % 9 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), f"title {k}", "x" * 1000) for k in range(400)]
    n = spark.createDataFrame(rows, "asset string, published_at timestamp, title string, body string")
    feeds.write_news_csv(n, str(tmp_path / "out"), part_bytes=20_000)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) >= 15 and max(f.stat().st_size for f in files) < 80_000
    told = [x for f in files for x in f.read_text().splitlines() if not x.startswith("asset,")]
    assert len(told) == 400 and [x.split(",")[2] for x in told] == [r[2] for r in sorted(rows)]
