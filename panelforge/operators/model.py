"""Training on the panel: purged folds, gradient-boosted trees, walk-forward."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import event_weight
from .panel import impute_cross_section, rank_cross_section
from .stats import spearman


def fold_bounds(n: int, k: int) -> list[tuple[int, int, int]]:
    """(fold, first, last) ordinals of the test blocks 1..k out of k + 1 equal blocks; the remainder goes to the first block."""
    if n <= k + 1:
        return []
    size = n // (k + 1)
    first = n - size * k
    return [(i + 1, first + i * size, first + (i + 1) * size - 1) for i in range(k)]


def purged_folds(panel: DataFrame, n_dates: int, k: int = 5, ahead: int = 5, embargo: int = 5) -> DataFrame:
    """panel rows (with `ord`) per fold and side: test rows of the block, train rows whose label ends an embargo before it."""
    bounds = fold_bounds(n_dates, k)
    table = panel.sparkSession.createDataFrame(bounds, "fold int, first int, last int")
    j = panel.join(F.broadcast(table), (F.col("ord") + ahead + embargo <= F.col("first")) | F.col("ord").between(F.col("first"), F.col("last")))
    return j.withColumn("side", F.when(F.col("ord") >= F.col("first"), "test").otherwise("train")).drop("first", "last")


def embargoed(panel: DataFrame, first_day, ahead: int = 5, embargo: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, test) about the first test day: a training row's label, `ahead` ordinals on, ends an embargo before it."""
    first = panel.filter(F.col("d") >= F.lit(first_day)).agg(F.min("ord")).first()[0]
    if first is None:
        raise ValueError(f"no day from {first_day} on")
    return panel.filter(F.col("ord") + ahead + embargo <= first), panel.filter(F.col("ord") >= first)


def train_gbt(train: DataFrame, features: list[str], label: str = "y", trees: int = 30, depth: int = 3, rate: float = 0.05, sample: float = 0.8, seed: int = 42) -> GBTRegressionModel:
    """Boosted regression trees with event rows weighted five times."""
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(train.withColumn("_w", event_weight(F.col("has_event"))))
    return GBTRegressor(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=seed).fit(ready)


def predict(model: GBTRegressionModel, df: DataFrame, features: list[str], by: list[str] = ["d"], tie: str = "asset") -> DataFrame:  # noqa: B006
    """df with `y_pred` and its rank of the day; rows with a missing feature go."""
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)
    out = model.transform(ready).withColumnRenamed("prediction", "y_pred").drop("_x")
    return rank_cross_section(out, by, "y_pred", tie)


def staged_ic(model: GBTRegressionModel, test: DataFrame, features: list[str], by: list[str], label: str = "y") -> DataFrame:
    """(by..., stage, ic, n): rank correlation of the sum of the first 1, 2, ... trees."""
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(test)
    total = F.lit(0.0)
    staged = ready
    for i, (tree, w) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        staged = tree.setFeaturesCol("_x").setPredictionCol(f"_t{i}").transform(staged)
        total = total + w * F.col(f"_t{i}")
        staged = staged.withColumn(f"_s{i}", total)
    n = len(model.trees)
    long = staged.select(*by, label, F.posexplode(F.array(*(F.col(f"_s{i}") for i in range(n)))).alias("_k", "_p")).withColumn("stage", F.col("_k") + 1)
    return spearman(long, [*by, "stage"], "_p", label)


def cross_validated_stages(panel: DataFrame, n_dates: int, features: list[str], k: int = 5, ahead: int = 5, embargo: int = 5, trees: int = 30, least: int = 20, parallel: int = 4) -> DataFrame:
    """(fold, stage, ic, n): `staged_ic` on the test block of each purged, embargoed fold, of a model fitted on its training rows.

    The panel (with `ord`) should be a written table: each fold is a fit on it, `parallel` at a
    time. A fold with fewer than `least` training rows has no stages.
    """
    folds = purged_folds(panel, n_dates, k, ahead, embargo)
    sizes = {r["fold"]: r["count"] for r in folds.filter("side = 'train'").groupBy("fold").count().collect()}

    def one(fold: int) -> DataFrame:
        mine = folds.filter(F.col("fold") == fold)
        model = train_gbt(mine.filter("side = 'train'"), features, trees=trees)
        return staged_ic(model, mine.filter("side = 'test'"), features, ["fold"])

    with ThreadPool(max(1, parallel)) as pool:
        parts = pool.map(inheritable_thread_target(panel.sparkSession)(one), sorted(f for f, n in sizes.items() if n >= least))
    return reduce(DataFrame.unionByName, parts) if parts else panel.sparkSession.createDataFrame([], "fold int, stage int, ic double, n bigint")


def plateau(ics: DataFrame) -> int:
    """Trees to keep, from (fold, stage, ic): the fewest whose mean is within half a deviation of the best, or the best where that is under 0.3 of it."""
    rows = ics.groupBy("stage").agg(F.avg("ic").alias("m"), F.stddev_pop("ic").alias("s")).orderBy("stage").collect()
    best = max(rows, key=lambda r: (r["m"], -r["stage"]))
    first = next(r["stage"] for r in rows if r["m"] >= best["m"] - 0.5 * (best["s"] or 0.0))
    return best["stage"] if first < 0.3 * best["stage"] else first


def plateau_table(ics: DataFrame) -> DataFrame:
    """(stage, mean_ic, sd, chosen): each stage's mean and population deviation over folds, and whether the plateau rule takes it."""
    g = ics.groupBy("stage").agg(F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("sd"))
    return g.withColumn("chosen", F.col("stage") == plateau(ics))


def predict_universe(model: GBTRegressionModel, panel: DataFrame, features: list[str], news: DataFrame, train_end) -> DataFrame:
    """(asset, d, y_pred, score, has_event, rank, relative_volume, latest_news, sector): a scored cross-section for each day of the panel.

    Missing features are imputed by the day's median, else that of days up to `train_end`;
    relative_volume stays as measured, since filters read it. news: (asset, d, published_at);
    latest_news is null without an event.
    """
    raw = panel.withColumn("_raw", F.col("relative_volume"))
    scored = predict(model, impute_cross_section(raw, features, "d", train_end), features)
    latest = news.groupBy("asset", "d").agg(F.max("published_at").alias("_at"))
    j = scored.join(latest, ["asset", "d"], "left").withColumn("latest_news", F.when(F.col("has_event"), F.col("_at")))
    return j.select("asset", "d", "y_pred", "score", "has_event", "rank", F.col("_raw").alias("relative_volume"), "latest_news", "sector")


def walk_forward(panel: DataFrame, features: list[str], months: list[str] | None = None, ahead: int = 5, embargo: int = 5, least: int = 20, trees: int = 10, parallel: int = 4) -> DataFrame:
    """Predictions for each month from a model fitted on rows whose labels end an embargo before its first day.

    `months` (yyyy-MM) are all of the panel where none are named; those with fewer than `least`
    training rows have no prediction. The panel (with `ord`) should be a written table: one
    aggregation finds the months' bounds, then each fit and each prediction is a Spark job on
    it, `parallel` months at a time.
    """
    month = F.date_format("d", "yyyy-MM")
    days = panel.groupBy("ord", month.alias("month")).agg(F.count("*").alias("n")).collect()
    starts: dict[str, int] = {}
    for r in days:
        starts[r["month"]] = min(r["ord"], starts.get(r["month"], r["ord"]))
    asked = [m for m in sorted(starts) if months is None or m in months]
    asked = [m for m in asked if sum(r["n"] for r in days if r["ord"] + ahead + embargo <= starts[m]) >= least]

    def one(m: str) -> DataFrame:
        model = train_gbt(panel.filter(F.col("ord") + ahead + embargo <= starts[m]), features, trees=trees)
        return predict(model, panel.filter(month == m), features).withColumn("month", F.lit(m))

    with ThreadPool(max(1, parallel)) as pool:
        parts = pool.map(inheritable_thread_target(panel.sparkSession)(one), asked)
    empty = panel.limit(0).withColumns({"y_pred": F.lit(None).cast("double"), "rank": F.lit(None).cast("int"), "month": F.lit(None).cast("string")})
    return reduce(DataFrame.unionByName, parts) if parts else empty


def importance_signs(model: GBTRegressionModel, df: DataFrame, features: list[str], expected: dict[str, int]) -> DataFrame:
    """(feature, importance, sign, inverted): gain, and the sign of the prediction's change when the feature goes from one under to one over its median, the others at theirs."""
    spark = df.sparkSession
    med = df.agg(*(F.median(f).alias(f) for f in features)).first()
    probes = [(f, s, *(float(med[g] or 0.0) + (s if g == f else 0) for g in features)) for f in features for s in (-1, 1)]
    p = spark.createDataFrame(probes, ["feature", "step", *features])
    y = model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(p))
    gain = spark.createDataFrame([(f, float(g), expected.get(f, 0)) for f, g in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, importance double, expected int")
    s = y.groupBy("feature").agg(F.signum(F.sum(F.col("step") * F.col("prediction"))).cast("int").alias("sign"))
    return s.join(gain, "feature").select("feature", "importance", "sign", (F.col("sign") * F.col("expected") < 0).alias("inverted"))
