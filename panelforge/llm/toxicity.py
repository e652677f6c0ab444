"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts without a look at their label are the unlabelled
ones, which hold toxic texts too, at the class prior. Du Plessis' risk with Kiryo's
non-negative correction is minimised for a linear model over the presence of hashed features:
words, and the runs of three to six characters of each word with its two edges, so that a
misspelt or inflected word still has most features of the one that was learnt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, materialize, partitions
from .shingles import mix

#: Features are hashed to 2^LOG_FEATURES places.
LOG_FEATURES = 20
RUNS = (3, 4, 5, 6)
_WORD = re.compile(r"\w+")
_M = np.uint64(0x5851F42D4C957F2D)


def words_of(text: str | None) -> set[str]:
    """Different words of a whole text, in lower case: runs of letters, digits and underscores."""
    return set(_WORD.findall(text.lower())) if text else set()


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of the word) of every feature: each word itself, and its runs of characters; a blank stands for either edge."""
    # surrogates can't stand in texts of Spark
    a = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = np.flatnonzero(a == 32)
    gaps = np.cumsum(a == 32)
    shift = np.uint64(64 - LOG_FEATURES)
    inside = np.arange(len(a), dtype=np.uint64) - edge[gaps - 1].astype(np.uint64)
    at = [mix(np.add.reduceat(mix(a * _M + inside), edge)[:-1]) >> shift]
    owner = [np.arange(len(words))]
    h = a
    for k in range(2, max(RUNS) + 1):
        h = h[:-1] * _M + a[k - 1 :]
        if k in RUNS and len(h):
            # no edge inside of the run
            whole = np.flatnonzero(gaps[k - 2 : len(a) - 1] == gaps[: len(a) - k + 1])
            at.append(mix(h[whole] + np.uint64(k)) >> shift)
            owner.append(gaps[whole] - 1)
    return np.concatenate(at).astype(np.int32), np.concatenate(owner)


_NONE = np.zeros(0, np.int32)


class Features:
    """Feature places of whole texts; words met before are remembered, up to `memory` of them.

    With `wanted`, a flag for each place, only those are told.
    """

    def __init__(self, wanted: np.ndarray | None = None, memory: int = 100_000):
        self.wanted, self.memory = wanted, memory
        self._forget()

    def _forget(self) -> None:
        self.known: set[str] = set()
        self.found: dict[str, np.ndarray] = {}

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            places, owner = word_features(part)
            if self.wanted is not None:
                hit = self.wanted[places]
                places, owner = places[hit], owner[hit]
            order = np.argsort(owner, kind="stable")
            places, owner = places[order], owner[order]
            edge = np.flatnonzero(np.diff(owner, prepend=-1, append=len(part)))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                self.found[part[owner[x]]] = places[x:y]
        self.known.update(words)

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Sorted distinct places of each text's features."""
        for at in range(0, len(texts), 64):
            words = [words_of(t) for t in texts[at : at + 64]]
            if len(self.known) > self.memory:
                self._forget()
            new = set().union(*words) - self.known
            self._learn(list(new))
            for own in words:
                found = [self.found[w] for w in own if w in self.found]
                yield np.unique(np.concatenate(found)) if found else _NONE
            if any(len(w) > 1000 for w in new):  # words of that kind aren't kept
                self._forget()


@dataclass(frozen=True)
class ToxicityModel:
    places: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: list[str | None], features: Features) -> list[float]:
        """0 to 1 each; texts without a feature of the model get the bias alone. `features`: those `wanted` by this model."""
        # summed in the order of places, so that equal texts get equal scores
        z = np.array([self.weights[np.searchsorted(self.places, f)].sum() for f in features.of(texts)], np.float64) + self.bias
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()

    def features(self) -> Features:
        wanted = np.zeros(1 << LOG_FEATURES, bool)
        wanted[self.places] = True
        return Features(wanted)


def _blank(prior: float) -> ToxicityModel:
    """Scores everything near 0."""
    return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), -4.0, prior)


def _sums(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the runs of x that begin at start[:-1] and end before start[1:]."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    return total[start[1:]] - total[start[:-1]]


def nonnegative_pu(rows: list[np.ndarray], positive: np.ndarray, scale: np.ndarray, prior: float, rounds: int = 40, batches: int = 8, rate: float = 0.02, decay: float = 1e-6, begin: float = 0.3, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias minimising prior * R_p+ + max(0, R_u- - prior * R_p-), sigmoid loss, by Adam.

    rows: of each text the numbers of its features; a present feature has the value `scale` of
    its number. Each round goes through all rows in `batches` parts, dealt anew each round; a
    part has its share of either kind. Where the corrected negative risk of a part falls below
    -slack, the step goes up that risk instead. Weights begin at `begin` and are drawn back to
    it by `decay`.
    """
    rng, n, t = np.random.default_rng(0), len(scale), 0
    kinds = {p: np.flatnonzero(positive == p) for p in (True, False)}
    parts = max(1, min(batches, *map(len, kinds.values())))
    w = np.append(np.full(n, begin), -2.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for _ in range(rounds):
        dealt = {p: np.array_split(rng.permutation(k), parts) for p, k in kinds.items()}
        for part in range(parts):
            s, g = {}, {}
            t += 1
            value = w[:-1] * scale
            for p in (True, False):
                own = [rows[i] for i in dealt[p][part]]
                at, size = np.concatenate(own), np.array([len(r) for r in own])
                z = _sums(value[at], np.concatenate(([0], np.cumsum(size)))) + w[-1]
                s[p] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))  # loss of -1: s; loss of +1: 1 - s
                slope = s[p] * (1 - s[p]) / len(z)
                g[p] = np.append(np.bincount(at, np.repeat(slope, size), n) * scale, slope.sum())
            negative = s[False].mean() - prior * s[True].mean()
            step = -prior * g[True] + (g[False] - prior * g[True]) if negative >= -slack else -(g[False] - prior * g[True])
            step[:-1] += decay * (w[:-1] - begin)
            m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1] * scale, float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = 5000, max_unlabelled: int = 15000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most `max_positive` confirmed toxic rows and `max_unlabelled` other rows, chosen by a hash of the id.

    The class prior is counted over all labelled rows that may be learnt from. Every feature of
    those rows is counted. Its scale is the log ratio of its rates among positives and among
    unlabelled rows less the positives they hold, drawn to 0 by how far the two rates differ in
    standard errors: noise, which among n features reaches sqrt(2 ln n) errors, gets the scale
    0. A feature may speak for or against. Features with a scale, and the sampled rows' lists
    of those, reach the driver. Null labels and null ids teach nothing. Without any positive,
    or where no feature stands out, the model scores everything near 0.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    if prior <= 0:
        return _blank(0.0)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    by_hash = lambda df, n, y: df.select("doc_id", F.lit(y).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    free = texts.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = by_hash(known.filter("label = 1"), max_positive, True).unionByName(by_hash(free, max_unlabelled, False))
    # at most max_positive + max_unlabelled ids are broadcast
    rows = materialize(texts.join(F.broadcast(sample), "doc_id").select("y", "text").repartition(partitions(docs.sparkSession)))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return _blank(prior)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, seen = Features(memory=30_000), np.zeros((2, 1 << LOG_FEATURES), np.int32)
        for b in batches:
            for y, found in zip(b["y"].tolist(), features.of(b["text"].tolist()), strict=True):
                seen[int(y), found] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"at": at.astype(np.int32), "u": seen[0, at].astype(np.int64), "p": seen[1, at].astype(np.int64)})

    seen = materialize(rows.mapInPandas(counts, "at int, u bigint, p bigint").groupBy("at").agg(F.sum("u").alias("u"), F.sum("p").alias("p")))
    least = float(np.sqrt(2 * np.log(max(2, seen.filter("p > 0").count()))))
    a, b = (F.col("p") + 0.5) / (n_p + 1), F.greatest((F.col("u") + 0.5) / (n_u + 1) - prior * F.col("p") / n_p, F.lit(0.5 / (n_u + 1)))
    z = (F.col("p") / n_p - b) / F.sqrt(a * (1 - a) / n_p + b * (1 - b) / n_u + 1e-12)
    scaled = seen.select("at", (F.log(a / b) * F.greatest(1 - F.pow(least / F.greatest(F.abs(z), F.lit(1e-9)), 2), F.lit(0.0))).alias("scale"))
    chosen = scaled.filter("scale <> 0").toPandas().sort_values("at")
    places, scale = chosen["at"].to_numpy(np.int32), chosen["scale"].to_numpy(np.float64)
    if not len(places):
        return _blank(prior)
    wanted = np.zeros(1 << LOG_FEATURES, bool)
    wanted[places] = True
    number = np.uint16 if len(places) <= 1 << 16 else np.uint32

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(wanted)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "at": [np.searchsorted(places, f).astype(number).tobytes() for f in features.of(b["text"].tolist())]})

    # the order of rows must not depend on how tasks ended
    sparse = sorted((bool(r["y"]), bytes(r["at"])) for r in rows.mapInPandas(present, "y boolean, at binary").collect())
    w, bias = nonnegative_pu([np.frombuffer(x, number) for _, x in sparse], np.array([y for y, _ in sparse]), scale, prior)
    return ToxicityModel(places, w, bias, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from its whole text alone.

    Null and empty texts get the model's bias; repeated rows are scored each; a null id counts
    as not held out; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = model.features()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": model.scores(b["text"].tolist(), features)})

    doc_id = F.col(id_col)
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    rows, kind = as_text(rows, "doc_id")
    scored = rows.mapInPandas(run, "doc_id string, held_out boolean, score double")
    return scored.withColumns({"doc_id": F.col("doc_id").cast(kind), "predicted": (F.col("score") >= 0.5).cast("int")})


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, all their columns, as they are; null and empty texts stay where the bias does. No shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.features()
        for b in batches:
            # a part at a time: texts as Python strings take several times their room in Arrow
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield part.filter(pa.array([s < 0.5 for s in model.scores(part.column(place).to_pylist(), features)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
