"""Boosted trees of all expanding windows at once.

A walk-forward asks for a model for each month, and each window holds the one before. The panel
is binned once and written as arrays in the order of days, in which every window is a prefix.
One pass over it tells the histograms that split all nodes of a level in all windows; the driver
holds those of `windows x nodes x features x bins` only, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalars import event_weight
from ..sources.shared import new_path
from .panel import rank_cross_section
from .replicates import counters


@dataclass
class Forests:
    """Trees of each window: features and bins by node, values by leaf."""

    months: list[str]
    cutoffs: list[int]
    edges: list[list[float]]
    rate: float
    depth: int
    seed: int
    sample: float
    start: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    bound: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def leaf(self, tree: int, window: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node after some levels, counted from the left."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        feature, bound = self.feature[tree][window], self.bound[tree][window]
        for level in range(levels):
            node = at + (1 << level) - 1
            at = 2 * at + (bins[rows, feature[node]] > bound[node])
        return at

    def predict(self, window: int, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start[window])
        for t, value in enumerate(self.value):
            out += self.rate * value[window][self.leaf(t, window, bins, self.depth)]
        return out


def binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The bin of each feature: how many of its edges lie under the value."""
    return np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def best_split(sums: np.ndarray, weights: np.ndarray) -> tuple[int, int, float, float] | None:
    """(feature, bin, left value, right value) of the greatest gain from (features, bins) sums; the first on a tie, None without gain."""
    left, lw = np.cumsum(sums, axis=1)[:, :-1], np.cumsum(weights, axis=1)[:, :-1]
    total, tw = sums[0].sum(), weights[0].sum()
    right, rw = total - left, tw - lw
    ok = (lw > 1e-9) & (rw > 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left**2 / lw + right**2 / rw - total**2 / max(tw, 1e-300), -1.0)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape) if gain.size else (0, 0)
    if not gain.size or gain[f, b] <= 1e-12:
        return None
    return int(f), int(b), float(left[f, b] / lw[f, b]), float(right[f, b] / rw[f, b])


_PIECE = "ords binary, bins binary, y binary, w binary, ids binary"


def _packed(names: list[str], edges: list[list[float]]):
    """Rows as arrays in the order of days."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            order = np.argsort(column("_ord"), kind="stable")
            bins = binned(np.stack([column(c) for c in names], axis=1).astype(float)[order], edges)
            held = (column("_ord")[order].astype(np.int32), bins, column("_y")[order].astype(float), column("_w")[order].astype(float), column("_id")[order].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], ["ords", "bins", "y", "w", "ids"])

    return run


def _histograms(forests: Forests, level: int, n_features: int, n_bins: int):
    """Sums of weighted residuals and of weights by window, node, feature and bin of a task's pieces."""
    tree = len(forests.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = 1 << level
        out = np.zeros((len(forests.cutoffs), 2, nodes, n_features, n_bins))
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                ords, bins, y, w, ids = (np.frombuffer(x, t) for x, t in zip(row, (np.int32, np.uint8, float, float, np.uint32), strict=True))
                bins = bins.reshape(len(ords), n_features)
                taken = counters(forests.seed, np.array([tree]), ids)[0] < forests.sample * 2**32
                for k, cut in enumerate(forests.cutoffs):
                    n = int(np.searchsorted(ords, cut, side="right"))
                    mine = np.flatnonzero(taken[:n])
                    if not len(mine):
                        continue
                    own = bins[mine]
                    miss = w[mine] * (y[mine] - forests.predict(k, own))
                    at = forests.leaf(tree, k, own, level) if level else np.zeros(len(mine), np.int64)
                    for f in range(n_features):
                        place = at * n_bins + own[:, f]
                        for s, x in enumerate((miss, w[mine])):
                            out[k, s, :, f] += np.bincount(place, weights=x, minlength=nodes * n_bins).reshape(nodes, n_bins)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], ["window", "held"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[k] = held.get(k, 0) + np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["window", "held"])


def fit_windows(panel: DataFrame, features: list[str], windows: list[tuple[str, int]], label: str = "y", id_cols: tuple[str, ...] = ("asset", "d"), trees: int = 30, depth: int = 3, rate: float = 0.05, sample: float = 0.8, bins: int = 32, seed: int = 42) -> Forests:
    """Boosted regression trees for each window (name, last training ordinal), all windows grown together.

    Bins are cut at quantiles of the first window, so no window's bins know later rows. Event
    rows weigh five times; each tree sees a `sample` of rows by a counter of their id. Rows
    without the label or a feature are left out.
    """
    spark = panel.sparkSession
    key = F.pmod(F.xxhash64(*id_cols), F.lit(1 << 32)).alias("_id")
    rows = panel.dropna(subset=[label, *features]).filter(F.col("ord") <= max(c for _, c in windows))
    rows = rows.select(F.col("ord").alias("_ord"), *(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("_y"), event_weight(F.col("has_event")).cast("double").alias("_w"), key)
    cut = rows.filter(F.col("_ord") <= min(c for _, c in windows)).agg(*(F.percentile_approx(c, F.array(*(F.lit(k / bins) for k in range(1, bins))), 10_000) for c in features)).first()
    edges = [sorted(set(e or [])) for e in cut]
    # what comes before the first tree is known from sums by day
    days = sorted((r["_ord"], r["s"], r["w"]) for r in rows.groupBy("_ord").agg(F.sum(F.col("_w") * F.col("_y")).alias("s"), F.sum("_w").alias("w")).collect())
    at = np.array([d for d, _, _ in days])
    s, w = (np.concatenate(([0.0], np.cumsum([d[k] for d in days]))) for k in (1, 2))
    upto = [int(np.searchsorted(at, c, side="right")) for _, c in windows]
    forests = Forests([m for m, _ in windows], [c for _, c in windows], edges, rate, depth, seed, sample, np.array([s[k] / w[k] if w[k] else 0.0 for k in upto]))
    path, n = new_path(spark, "binned"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # as many files as tasks at least: the rows are few beside the work on them
    rows.repartition(n, "_id").mapInArrow(_packed(features, edges), _PIECE).write.parquet(path)
    pieces = spark.read.schema(_PIECE).parquet(path)
    kind = "window int, held binary"
    for _ in range(trees):
        forests.feature.append(np.zeros((len(windows), (1 << depth) - 1), np.int64))
        forests.bound.append(np.full((len(windows), (1 << depth) - 1), 255))
        value = np.zeros((len(windows), 1 << depth))
        for level in range(depth):
            held = pieces.mapInArrow(_histograms(forests, level, len(features), bins), kind).repartition(min(n, len(windows)), "window").mapInArrow(_added, kind)
            parts = {r["window"]: np.frombuffer(bytes(r["held"])).reshape(2, 1 << level, len(features), bins) for r in held.collect()}
            for k, (sums, weights) in parts.items():
                for node in range(1 << level):
                    split, total, tw = best_split(sums[node], weights[node]), sums[node][0].sum(), weights[node][0].sum()
                    leaves = value[k].reshape(1 << level, -1)[node]
                    if split is None:
                        # the node stays one leaf: all rows go left, and both sides say the same
                        leaves[:] = total / tw if tw > 0 else 0.0
                    else:
                        forests.feature[-1][k, (1 << level) - 1 + node], forests.bound[-1][k, (1 << level) - 1 + node] = split[:2]
                        leaves[: len(leaves) // 2], leaves[len(leaves) // 2 :] = split[2:]
        forests.value.append(value)
    return forests


def predict_windows(panel: DataFrame, forests: Forests, features: list[str], day: str = "d", tie: str = "asset") -> DataFrame:
    """Rows of the windows' months with `y_pred` of their month's model, its rank of the day and `month`; rows without a feature go."""
    rows = panel.dropna(subset=features).withColumn("month", F.date_format(day, "yyyy-MM")).filter(F.col("month").isin(forests.months))
    places = [rows.columns.index(c) for c in features]
    month = rows.columns.index("month")
    window = {m: k for k, m in enumerate(forests.months)}
    held = panel.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for b in batches:
            bins = binned(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in places], axis=1).astype(float), f.edges)
            own = np.array([window[m] for m in b.column(month).to_pylist()], np.int64)
            out = np.zeros(b.num_rows)
            for k in np.unique(own):
                out[own == k] = f.predict(int(k), bins[own == k])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "y_pred"])

    told = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("y_pred", DoubleType())]))
    return rank_cross_section(told, [day], "y_pred", tie)


def walk_forward_windows(panel: DataFrame, features: list[str], ahead: int = 5, embargo: int = 5, least: int = 20, **fit) -> DataFrame:
    """Predictions for every month of the panel (with `ord`) from a model of the rows whose labels end an embargo before its first day.

    Months with fewer than `least` training rows have no prediction. The panel should be a
    written table. `fit`: what `fit_windows` takes.
    """
    month = F.date_format("d", "yyyy-MM")
    whole = F.count_if(F.col(fit.get("label", "y")).isNotNull())
    days = panel.groupBy("ord", month.alias("month")).agg(whole.alias("n")).collect()
    starts: dict[str, int] = {}
    for r in days:
        starts[r["month"]] = min(r["ord"], starts.get(r["month"], r["ord"]))
    cuts = {m: first - ahead - embargo for m, first in sorted(starts.items())}
    windows = [(m, c) for m, c in cuts.items() if sum(r["n"] for r in days if r["ord"] <= c) >= least]
    if not windows:
        return panel.limit(0).withColumns({"month": F.lit(None).cast("string"), "y_pred": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")})
    return predict_windows(panel, fit_windows(panel, features, windows, **fit), features)
