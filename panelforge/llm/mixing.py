"""Mixing to target weights by soft membership, in DataFrame expressions alone.

A classifier fitted on a labelled table gives each document a posterior over domains. Projected
gradient steps on a least-squares objective then fit a nonnegative rate to each document, so
that the expected tokens of every domain, sum of rate * tokens * posterior, meet its target.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed

FEATURES = ("odd", "spread", "width", "fresh", "size")


def n_tokens(text: Column) -> Column:
    """Words between white space: the token measure that plain expressions can take."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("bigint")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, `_mix_t` (tokens) and `_mix_f` (an array with a number for each of FEATURES)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    d = docs.withColumn("_mix_w", words).withColumn("_mix_t", F.size("_mix_w").cast("bigint"))
    n, size = F.greatest(F.col("_mix_t"), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    odd = F.length(F.regexp_replace(text, "[\\p{L}\\s.,]+", "")) / size
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    found = F.array(F.log1p(100 * odd), F.log1p(n / lines), F.log(size / n), F.size(F.array_distinct("_mix_w")) / n, F.log1p(size.cast("double")))
    return d.withColumn("_mix_f", found).drop("_mix_w")


@dataclass
class Mixture:
    """A fitted classifier and the errors of all gradient steps: all that a rate depends on."""

    domains: list[str]
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]
    errors: list[list[float]] = field(default_factory=list)
    least: float = 0.0
    #: Share of the token budget by which each domain misses its target after all steps.
    residuals: dict[str, float] = field(default_factory=dict)
    #: Domains with a target that no labelled document has, or no document's tokens.
    unmet: list[str] = field(default_factory=list)

    def posterior(self, f: Column) -> Column:
        """Gaussian naive Bayes posteriors, in the order of `domains`."""
        logs = []
        for prior, mean, var in zip(self.priors, self.means, self.variances, strict=True):
            terms = [F.lit(math.log(prior))]
            for k, (m, v) in enumerate(zip(mean, var, strict=True)):
                terms.append(-(f[k] - m) * (f[k] - m) / (2 * v) - 0.5 * math.log(v))
            logs.append(sum(terms[1:], terms[0]))
        raised = F.array(*logs)
        powers = F.transform(raised, lambda x: F.exp(x - F.array_max(raised)))
        return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))

    def rate(self, p: Column) -> Column:
        """The rate after all steps: from 1, each step subtracts posterior . error and is projected on rates of `least` or more."""
        if not self.errors:
            return F.lit(1.0)
        steps = F.array(*(F.array(*map(F.lit, e)) for e in self.errors))
        dot = lambda e: F.aggregate(F.zip_with(p, e, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.aggregate(steps, F.lit(1.0), lambda r, e: F.greatest(F.lit(self.least), r - dot(e)))


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], steps: int = 60, tolerance: float = 1e-4, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> Mixture:
    """Fit classifier and rates over all documents.

    `labelled`: (doc_id, domain) of any part of the documents; null ids and domains and domains
    without a target teach nothing. `targets`: weight of each domain, made to sum to 1. The
    token budget is the least with which no domain has to shrink, so that mixing repeats rather
    than drops. Residuals are taken relative to each domain's expected tokens; with that scaling
    the step of 1 is the inverse of the objective's largest curvature. A step is one aggregation
    of one number a domain; steps end where targets are met or nothing moves. `least` is the
    smallest rate allowed, 0 or more: with 1 no document is dropped. Without labelled documents or tokens every rate is 1.

    `residuals` of the result tells by how much of the budget each domain misses its target, and
    `unmet` the domains that can't be met: those without a labelled document, whose weight goes
    to the others in proportion, and those without expected tokens, with which every rate is 1.
    """
    f = features(docs.select(F.col(id_col).alias("_mix_id"), F.col(text_col).alias("_mix_text")), "_mix_text").select("_mix_id", "_mix_t", "_mix_f")
    held = materialize(f)
    known = labelled.select(F.col(id_col).alias("_mix_id"), F.col("domain").cast("string").alias("_mix_domain")).filter(F.col("_mix_id").isNotNull() & F.col("_mix_domain").isin(list(targets)))
    stats = [x for k in range(len(FEATURES)) for x in (F.avg(F.col("_mix_f")[k]).alias(f"m{k}"), F.var_pop(F.col("_mix_f")[k]).alias(f"v{k}"))]
    rows = sorted(held.join(known, "_mix_id").groupBy("_mix_domain").agg(F.count("*").alias("n"), *stats).collect(), key=lambda r: r["_mix_domain"])
    if not rows:
        return Mixture(["all"], [1.0], [[0.0] * len(FEATURES)], [[1.0] * len(FEATURES)], least=least, unmet=sorted(targets))
    total = sum(r["n"] for r in rows)
    mix = Mixture([r["_mix_domain"] for r in rows], [r["n"] / total for r in rows], [[r[f"m{k}"] for k in range(len(FEATURES))] for r in rows], [[max(r[f"v{k}"], 1e-3) for k in range(len(FEATURES))] for r in rows], least=least)
    mix.unmet = sorted(set(targets) - set(mix.domains))
    kinds = range(len(rows))
    soft = materialize(held.select("_mix_t", mix.posterior(F.col("_mix_f")).alias("p")))

    def masses() -> list[float]:
        """Expected tokens of each domain at the present rates."""
        r = soft.select("_mix_t", "p", mix.rate(F.col("p")).alias("r")).agg(*(F.sum(F.col("_mix_t") * F.col("r") * F.col("p")[k]).alias(f"a{k}") for k in kinds)).first()
        return [r[f"a{k}"] or 0.0 for k in kinds]

    start = masses()
    weight = [targets[d] for d in mix.domains]
    weight = [w / sum(weight) for w in weight]
    if not all(start):
        mix.unmet = sorted({*mix.unmet, *(d for d, a in zip(mix.domains, start, strict=True) if not a)})
        return mix
    budget = max(a / w for a, w in zip(start, weight, strict=True) if w > 0)
    far = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True)) > tolerance * budget
    goal, now, last = [w * budget for w in weight], start, [math.inf] * len(start)
    while len(mix.errors) < steps and far(now, goal) and far(now, last):
        mix.errors.append([(a - g) / s for a, g, s in zip(now, goal, start, strict=True)])
        last, now = now, masses()
    mix.residuals = {d: (a - g) / budget for d, a, g in zip(mix.domains, now, goal, strict=True)}
    return mix


def document_rates(docs: DataFrame, mix: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate) of every row.

    `domain` is the likeliest one, the first in order of names on a tie; `posterior` has a
    number for each of `mix.domains`. Null texts count as empty and have 0 tokens; repeated
    rows get a rate each. No shuffle.
    """
    f = features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_mix_text")), "_mix_text")
    p = f.select("doc_id", F.col("_mix_t").alias("n_tokens"), mix.posterior(F.col("_mix_f")).alias("posterior"))
    names = F.array(*map(F.lit, mix.domains))
    domain = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    return p.select("doc_id", "n_tokens", domain.alias("domain"), "posterior", mix.rate(F.col("posterior")).alias("rate"))


def apply_rates(docs: DataFrame, mix: Mixture, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every row floor(rate) times, and once more by a hash of its id with the odds of the rest."""
    f = features(packed(docs, i=docs[f"`{id_col}`"], _mix_text=docs[f"`{text_col}`"]), "_mix_text")
    # a row number in a projection keeps the optimiser from copying its expressions into each use
    p = f.withColumns({"_mix_w": F.monotonically_increasing_id()}).withColumns({"_mix_p": mix.posterior(F.col("_mix_f")), "_mix_k": F.monotonically_increasing_id()})
    rate = p.withColumn("_mix_r", mix.rate(F.col("_mix_p")))
    u = (F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    copies = F.floor(F.col("_mix_r") + u).cast("int")
    repeated = rate.withColumn("_mix_n", copies).withColumn("_mix_n", F.explode(F.array_repeat(F.lit(0), F.col("_mix_n"))))
    return repeated.select("row.*")
