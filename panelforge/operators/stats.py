"""Rank correlations and what is said about them; every rank and bootstrap has its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from .ranks import global_spearman
from .replicates import resampled_correlations


def average_rank(col: str, by: list[str]) -> Column:
    """1-based rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(col)) + (F.count("*").over(Window.partitionBy(*by, col)) - 1) / 2


def spearman(df: DataFrame, by: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """(by..., ic, n): Spearman correlation of the pairs without nulls; null under `least` pairs or for a constant. Without `by`, over all rows, ranked in parts."""
    if not by:
        return global_spearman(df, a, b, least)
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = pairs.select(*by, average_rank(a, by).alias("_a"), average_rank(b, by).alias("_b"))
    g = ranked.groupBy(*by).agg(F.covar_pop("_a", "_b").alias("_c"), F.count("*").alias("n"), F.var_pop("_a").alias("_va"), F.var_pop("_b").alias("_vb"))
    return g.select(*by, F.when((F.col("n") >= least) & (F.col("_va") > 0) & (F.col("_vb") > 0), F.col("_c") / F.sqrt(F.col("_va") * F.col("_vb"))).alias("ic"), "n")


def ic_report(df: DataFrame, score: str, y: str, event: str, segments: list[str]) -> DataFrame:
    """(segment..., scope, ic, n): rank correlation over all rows and over event rows of each segment."""
    every = spearman(df, segments, score, y).withColumn("scope", F.lit("all"))
    return every.unionByName(spearman(df.filter(event), segments, score, y).withColumn("scope", F.lit("event")))


def ic_baselines(df: DataFrame, by: list[str], model: str, baselines: list[str], y: str, event: str | None = None, least_events: int = 30) -> DataFrame:
    """(by..., ic_<col>..., gap): the model's correlation, the baselines' and its lead over the best of them and of a constant, 0.

    With `event`, a boolean column, a row more for each of `by`, by `scope` 'all' and 'event':
    the same over event rows. There baselines count only where more than `least_events` rows are;
    with fewer they and the lead are null.
    """
    if event:
        some = df.filter(event)
        n = some.groupBy(*by).agg(F.count("*").alias("_n"))
        told = ic_baselines(some, by, model, baselines, y)
        told = told.join(n, by) if by else told.join(F.broadcast(n))
        many = F.col("_n") > least_events
        told = told.withColumns({c: F.when(many, F.col(c)) for c in ["gap", *(f"ic_{b}" for b in baselines)]}).drop("_n")
        return ic_baselines(df, by, model, baselines, y).withColumn("scope", F.lit("all")).unionByName(told.withColumn("scope", F.lit("event")))
    out = None
    for c in [model, *baselines]:
        ic = spearman(df, by, c, y).select(*by, F.col("ic").alias(f"ic_{c}"))
        out = ic if out is None else out.join(ic, by, "full") if by else out.join(F.broadcast(ic))
    best = F.greatest(F.lit(0.0), *(F.col(f"ic_{c}") for c in baselines))
    return out.withColumn("gap", F.col(f"ic_{model}") - best)


def bootstrap_ic(df: DataFrame, by: list[str], unit: str, scores: list[str], y: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(by..., rep, ic_<score>..., n, n_units): rank correlations of resampled units: rows, whole dates or blocks.

    A replicate draws as many units as there are, with replacement, and takes all rows of each as
    often as it is drawn; without `by`, a date is drawn with all assets. All scores share the
    draws, so differences are paired. A constant replicate has no correlation.
    """
    return resampled_correlations(df, by, unit, scores, y, replicates, seed)


def evaluation_metrics(df: DataFrame, by: list[str], score: str, baseline: str, y: str, clean: str) -> DataFrame:
    """(by..., part, n, ic, baseline, gap, coverage) of all rows and of the clean ones: rank correlations of a score and of a baseline with y, what the score gains, and the share of scores that aren't 0."""
    both = df.withColumn("part", F.explode(F.array_compact(F.array(F.lit("full"), F.when(F.col(clean), F.lit("clean"))))))
    keys = [*by, "part"]
    own = spearman(both, keys, score, y)
    other = spearman(both, keys, baseline, y).select(*keys, F.col("ic").alias("baseline"))
    seen = both.groupBy(*keys).agg(F.avg((F.col(score) != 0).cast("double")).alias("coverage"))
    return own.join(other, keys).join(seen, keys).withColumn("gap", F.col("ic") - F.col("baseline"))


def bootstrap_summary(reps: DataFrame, by: list[str], col: str, least_units: int = 0, undefined: float | None = None) -> DataFrame:
    """(by..., lo, hi, mean, p_not_positive, n_reps, n, n_units, note): 2.5 and 97.5 percentiles, mean and the share of replicates at most 0.

    Replicates without a value are left out, or count as `undefined`. Under `least_units` units
    nothing is told but the note.
    """
    value = F.col(col) if undefined is None else F.coalesce(F.col(col), F.lit(undefined))
    few = F.col("n_units") < least_units
    g = reps.withColumn("_x", value).groupBy(*by).agg(
        F.percentile("_x", F.lit(0.025)).alias("lo"), F.percentile("_x", F.lit(0.975)).alias("hi"), F.avg("_x").alias("mean"),
        F.avg((F.col("_x") <= 0).cast("double")).alias("p_not_positive"), F.count("_x").alias("n_reps"), F.max("n").alias("n"), F.max("n_units").alias("n_units"),
    )
    told = {c: F.when(~few, F.col(c)) for c in ("lo", "hi", "mean", "p_not_positive")}
    return g.withColumns(told | {"note": F.when(few, F.concat(F.lit("fewer than "), F.lit(str(least_units)), F.lit(" units")))})


def ic_by_group(df: DataFrame, key: list[str], score: str, y: str, least: int = 10) -> DataFrame:
    """(key..., n, n_zero, ic, reason) of groups with `least` rows or more."""
    info = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col(score) == 0).alias("n_zero"), F.count_distinct(score).alias("_d"), F.count_distinct(y).alias("_dy")).filter(F.col("n") >= least)
    ic = spearman(df, key, score, y).drop("n")
    reason = F.when(F.col("_d") < 2, "constant score").when(F.col("_dy") < 2, "constant label")
    return info.join(ic, key, "left").select(*key, "n", "n_zero", "ic", reason.alias("reason"))


def split_valid(df: DataFrame, by: list[str], degraded: Column) -> DataFrame:
    """(by..., n, n_degraded, rate, note): over 5 % a caveat, over 15 % invalid."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(degraded).alias("n_degraded"), F.avg(F.coalesce(degraded, F.lit(False)).cast("double")).alias("rate"))
    return g.withColumn("note", F.when(F.col("rate") > 0.15, "invalid").when(F.col("rate") > 0.05, "caveat").otherwise("ok"))


def calibration_report(df: DataFrame, segments: list[str], score: str, y: str, degraded: Column) -> DataFrame:
    """Per segment: rank correlation, share degraded with its note, in one table."""
    return split_valid(df, segments, degraded).join(spearman(df.filter(~F.coalesce(degraded, F.lit(False))), segments, score, y).drop("n"), segments, "left")


def full_calibration(df: DataFrame, segment: str, score: str, y: str, y_beta: str, baseline: str, flags: str, degraded: Column, unit: str, replicates: int = 1000) -> DataFrame:
    """(part, n, ic, lo, hi, ic_beta, ic_baseline, gap, n_flagged, n_all, n_degraded, rate, note) of all rows and of each segment.

    Correlations, their intervals by resampled units, the lead over the baseline and the rows
    whose `flags` array isn't empty are of rows that aren't degraded and have y; degradation is
    of all rows. `part` is 'all' or the segment.
    """
    both = df.withColumn("part", F.explode(F.array(F.lit("all"), F.col(segment).cast("string"))))
    keys = ["part"]
    good = both.filter(~F.coalesce(degraded, F.lit(False)) & F.col(y).isNotNull())
    ic = lambda a, b, name: spearman(good, keys, a, b).select("part", F.col("ic").alias(name))
    interval = bootstrap_summary(bootstrap_ic(good, keys, unit, [score], y, replicates), keys, f"ic_{score}").select("part", "lo", "hi")
    told = good.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.size(flags) > 0).alias("n_flagged"))
    out = split_valid(both, keys, degraded).withColumnRenamed("n", "n_all")
    for more in (told, ic(score, y, "ic"), interval, ic(score, y_beta, "ic_beta"), ic(baseline, y, "ic_baseline")):
        out = out.join(more, "part", "left")
    out = out.withColumn("gap", F.col("ic") - F.col("ic_baseline"))
    return out.select("part", F.coalesce("n", F.lit(0)).alias("n"), "ic", "lo", "hi", "ic_beta", "ic_baseline", "gap", F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"), "n_all", "n_degraded", "rate", "note")


def paired_delta(df: DataFrame, by: list[str], a: str, b: str, y: str) -> DataFrame:
    """(by..., ic_a, ic_b, delta, share_close): both scores on the same rows, and how often they are within 0.2."""
    ia = spearman(df, by, a, y).select(*by, F.col("ic").alias("ic_a"))
    ib = spearman(df, by, b, y).select(*by, F.col("ic").alias("ic_b"))
    near = df.groupBy(*by).agg(F.avg((F.abs(F.col(a) - F.col(b)) < 0.2).cast("double")).alias("share_close"))
    return ia.join(ib, by).join(near, by).withColumn("delta", F.col("ic_a") - F.col("ic_b"))


def collinearity(df: DataFrame, score: str, features: list[str]) -> DataFrame:
    """(feature, r): Pearson correlation of the score with each feature that no row lacks; null for a constant."""
    args = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    long = df.selectExpr(f"`{score}` as _s", f"stack({len(features)}, {args}) as (feature, _v)")
    g = long.groupBy("feature").agg(F.covar_pop("_s", "_v").alias("_c"), F.count("*").alias("_n"), F.count("_v").alias("_nv"), (F.var_pop("_v") * F.var_pop("_s")).alias("_var"))
    return g.filter("_n = _nv").select("feature", F.when(F.col("_var") > 0, F.col("_c") / F.sqrt("_var")).alias("r"))


def count_segments(df: DataFrame, by: list[str], clean: str, least: int = 30) -> DataFrame:
    """(by..., n, n_clean, few): rows and clean rows; `few` where the clean ones are under `least`."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(clean).alias("n_clean")).withColumn("few", F.col("n_clean") < least)


def usage_cost(df: DataFrame, prices: DataFrame, strict: bool = True) -> DataFrame:
    """df with `cost` by the model's prices per million tokens in and out; with `strict` an unknown model raises when read."""
    j = df.join(F.broadcast(prices), "model", "left")
    unknown = F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("double") if strict else F.lit(None).cast("double")
    cost = F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")
    return j.withColumn("cost", F.when(F.col("price_in").isNull(), unknown).otherwise(cost)).drop("price_in", "price_out")


def usage_estimate(costs: DataFrame, n_events: int) -> DataFrame:
    """(model, n_events, cost, low, high): what that many events would cost at each model's mean cost, with two standard errors either way."""
    g = costs.groupBy("model").agg(F.avg("cost").alias("_m"), F.coalesce(F.stddev_samp("cost"), F.lit(0.0)).alias("_s"))
    spread = 2 * F.col("_s") * F.sqrt(F.lit(float(n_events)))
    return g.select("model", F.lit(n_events).alias("n_events"), (F.col("_m") * n_events).alias("cost"), (F.col("_m") * n_events - spread).alias("low"), (F.col("_m") * n_events + spread).alias("high"))


def usage_summary(df: DataFrame, by: list[str], fallback: Column) -> DataFrame:
    """Calls, costs, latency percentiles (linear interpolation) and share of fallbacks."""
    p = lambda q: F.percentile("latency", F.lit(q))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("cost").alias("total_cost"), F.avg("cost").alias("mean_cost"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.avg(fallback.cast("double")).alias("fallback_rate"))


def selection_funnel(df: DataFrame, day: str, event: Column, score_ok: Column, volume_ok: Column) -> DataFrame:
    """Per day, and in total where the day is null: rows, events, good scores, pool, and what the volume cut."""
    f = lambda *cs: F.count_if(_all(cs))
    return df.rollup(day).agg(F.count("*").alias("n"), f(event).alias("n_event"), f(event, score_ok).alias("n_score"), f(event, score_ok, volume_ok).alias("n_pool"), f(event, score_ok, ~F.coalesce(volume_ok, F.lit(False))).alias("cut_by_volume"))


def _all(cs) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & F.coalesce(c, F.lit(False))
    return out


def ic_sweep(df: DataFrame, strength: str, score: str, y: str) -> DataFrame:
    """(strength, ic, n, rising): correlations over signal strengths, and whether each is at least the one before."""
    ic = spearman(df, [strength], score, y)
    return ic.withColumn("rising", F.coalesce(F.col("ic") >= F.lag("ic").over(Window.orderBy(strength)), F.lit(True)))


def signal_sweep(panel: DataFrame, alphas: list[float], keys: list[str], z: str, seed: int = 42, event_share: float = 0.15) -> DataFrame:
    """panel events at each alpha with `signal` = clamp(alpha z + sqrt(1 - alpha^2) noise); noise by hashes."""
    u = hash_uniform(*keys, F.lit("event"), seed=seed)
    n1, n2 = (hash_uniform(*keys, F.lit(x), seed=seed) for x in ("n1", "n2"))
    noise = F.sqrt(-2 * F.log(F.greatest(n1, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * n2)
    events = panel.filter((u < event_share) & F.col(z).isNotNull())
    a = F.col("alpha")
    raised = events.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    return raised.withColumn("signal", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a * F.col(z) + F.sqrt(1 - a * a) * noise)))


def find_alphas(panel: DataFrame, targets: list[float], keys: list[str], z: str, y: str, seed: int = 42, event_share: float = 0.15, tolerance: float = 0.005, cuts: int = 16, rounds: int = 8) -> DataFrame:
    """(target, alpha, ic): the strength of a controlled signal whose rank correlation with y is the target, to `tolerance`.

    Each round tries `cuts` + 1 strengths within the bracket of every target that is still open,
    all in one aggregation; the bracket becomes the two neighbours between which the correlation
    first reaches the target. A target of 0 or less has strength 0; one that no strength reaches
    gets the nearest.
    """
    brackets = {t: (0.0, 1.0) for t in targets if t > 0}
    best: dict[float, tuple[float, float, float | None]] = {}

    def tried(alphas: set[float]) -> dict[float, float]:
        s = signal_sweep(panel, sorted(alphas), keys, z, seed, event_share)
        return {r["alpha"]: r["ic"] or 0.0 for r in spearman(s, ["alpha"], "signal", y).collect()}

    if any(t <= 0 for t in targets):
        none = tried({0.0}).get(0.0, 0.0)
        best |= {t: (abs(none - t), 0.0, none) for t in targets if t <= 0}
    for _ in range(rounds):
        if not brackets:
            break
        grids = {t: [lo + (hi - lo) * k / cuts for k in range(cuts + 1)] for t, (lo, hi) in brackets.items()}
        ics = tried({a for g in grids.values() for a in g})
        for t, g in grids.items():
            near = min((abs(ics.get(a, 0.0) - t), a, ics.get(a, 0.0)) for a in g)
            best[t] = min(best.get(t, near), near)
            over = next((k for k, a in enumerate(g) if ics.get(a, 0.0) >= t), cuts)
            brackets[t] = (g[max(over - 1, 0)], g[max(over, 1)])
            if best[t][0] < tolerance:
                del brackets[t]
    return panel.sparkSession.createDataFrame([(t, best[t][1], best[t][2]) for t in targets], "target double, alpha double, ic double")


def variant_report(df: DataFrame, variant: str, pred: str, y: str, event: str | None = None, baseline: str | None = None, importances: DataFrame | None = None) -> DataFrame:
    """(variant, ic, n, n_distinct): correlation and how many different predictions, at 6 places.

    With `event`, a boolean column, also ic_event over those rows; with `baseline` as well the
    gap, what ic_event gains over the baseline's correlation on the same rows. importances:
    (variant, importance), joined on.
    """
    d = df.groupBy(variant).agg(F.count_distinct(F.round(pred, 6)).alias("n_distinct"))
    out = spearman(df, [variant], pred, y).join(d, variant)
    if event:
        some = df.filter(event)
        out = out.join(spearman(some, [variant], pred, y).select(variant, F.col("ic").alias("ic_event")), variant, "left")
        if baseline:
            base = spearman(some, [variant], baseline, y).select(variant, F.col("ic").alias("_base"))
            out = out.join(base, variant, "left").withColumn("gap", F.col("ic_event") - F.col("_base")).drop("_base")
    return out if importances is None else out.join(importances.select(variant, "importance"), variant, "left")


def version_summary(df: DataFrame, by: list[str], score: str, lexical: str, y: str, clean: str, degraded: str, unit: str, replicates: int = 1000) -> DataFrame:
    """A row for each version: how many rows, correlations of all and of clean rows with their bootstrap intervals over `unit`, gaps over the lexical baseline, cost, share degraded, median latency, and the spread and zeros of scores that aren't degraded.

    df has `cost` and `latency`; `clean` and `degraded` are boolean columns.
    """
    keys = [*by, "part"]
    parts = df.withColumn("part", F.explode(F.array_compact(F.array(F.lit("full"), F.when(F.col(clean), F.lit("clean"))))))
    interval = bootstrap_summary(bootstrap_ic(parts, keys, unit, [score], y, replicates), keys, f"ic_{score}").select(*keys, "lo", "hi")
    m = evaluation_metrics(df, by, score, lexical, y, clean).join(interval, keys, "left")
    of = lambda part, col: F.max(F.when(F.col("part") == part, F.col(col)))
    wide = m.groupBy(*by).agg(*(of(part, c).alias(f"{c}_{part}") for part in ("full", "clean") for c in ("n", "ic", "lo", "hi", "gap")), of("clean", "baseline").alias("lexical_clean"))
    valid = F.when(~F.coalesce(F.col(degraded), F.lit(False)), F.col(score))
    told = df.groupBy(*by).agg(
        F.sum("cost").alias("cost"), F.avg(F.coalesce(F.col(degraded), F.lit(False)).cast("double")).alias("degraded_rate"), F.percentile("latency", F.lit(0.5)).alias("latency"),
        F.stddev_samp(valid).alias("dispersion"), F.count_if(valid == 0).alias("zeros"),
    )
    return told.join(wide, by, "left")


def sample_profile(df: DataFrame, by: list[str], score: str, y: str, crowd: int = 5) -> DataFrame:
    """(by..., n, crowded, mean, sd, lo, hi, zeros, y_mean, y_sd)."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.min(score).alias("lo"), F.max(score).alias("hi"), F.count_if(F.col(score) == 0).alias("zeros"), F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("y_sd"))
    return g.withColumn("crowded", F.col("n") > crowd)


def run_profile(trades: DataFrame, reasons: DataFrame) -> DataFrame:
    """(reason, n): trades of every listed reason, 0 if none."""
    n = trades.groupBy("reason").agg(F.count("*").alias("n"))
    return F.broadcast(reasons).join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def top_warnings(dq: DataFrame, n: int = 5) -> DataFrame:
    """(kind, n, first_d, first_asset): the n most frequent kinds of warnings with their first example; ties go to the smaller kind."""
    first = F.min(F.struct("d", "asset"))
    g = dq.groupBy("kind").agg(F.count("*").alias("n"), first.alias("_f"))
    return g.orderBy(F.desc("n"), "kind").limit(n).select("kind", "n", F.col("_f.d").alias("first_d"), F.col("_f.asset").alias("first_asset"))


def worst_discordance(df: DataFrame, by: list[str], a: str, b: str, n: int, tie: list[str]) -> DataFrame:
    """The n rows of each group whose ranks by a and b disagree most: least (pct_rank(a) - .5)(pct_rank(b) - .5)."""
    w = Window.partitionBy(*by)
    size = F.count("*").over(w)
    d = df.withColumn("discordance", (average_rank(a, by) / size - 0.5) * (average_rank(b, by) / size - 0.5))
    return d.withColumn("_rn", F.row_number().over(w.orderBy("discordance", *tie))).filter(F.col("_rn") <= n).drop("_rn")
