"""Exact top-k search by inner product, term at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Scores are told as 64-bit numbers; what lies beyond is told as the nearest of them.
LEAST, MOST = -(2**63), 2**63 - 1


def quantized(vector: Column) -> Column:
    """floor(256 * x) of every component as a double; null for a vector that is null or holds null or non-finite components."""

    def whole(x: Column) -> Column:
        y = F.lit(256.0) * x.cast("double")
        # from 2^53 on doubles are whole numbers
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, whole))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (vec_id, q) as blocks of at most `size` postings-ready rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vecs: list[np.ndarray] = []

        def out() -> pd.DataFrame:
            width = max(len(v) for v in vecs)
            dense = np.zeros((len(vecs), width))
            for k, v in enumerate(vecs):
                dense[k, : len(v)] = v
            return pd.DataFrame({f"{name}_ids": [np.array(ids, np.int64).tobytes()], f"{name}_terms": [np.ascontiguousarray(dense.T).tobytes()]})

        for b in batches:
            for i, v in zip(b["vec_id"].tolist(), b["q"], strict=True):
                ids.append(i)
                vecs.append(v)
                if len(ids) == size:
                    yield out()
                    ids, vecs = [], []
        if ids:
            yield out()

    return rows.mapInPandas(run, f"{name}_ids binary, {name}_terms binary")


def terms(blob: bytes, rows: int) -> np.ndarray:
    """A block's terms, one line each, as doubles."""
    return np.frombuffer(blob, np.float64).reshape(-1, rows)


def whole_numbers(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit numbers where no score can leave 64 bits, else as Python's own, which are exact at any size."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, min(len(queries), len(rows)))
    if max(bound, float(np.abs(queries).max(initial=0)), float(np.abs(rows).max(initial=0))) < 2.0**62:
        return queries.astype(np.int64), rows.astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    return exact(queries), exact(rows)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id, without the query's own id; by partition selection."""
    places = np.flatnonzero(ids != own)
    s = scores[places]
    if s.dtype == object:
        return np.array(sorted(places.tolist(), key=lambda p: (-scores[p], ids[p]))[:k], np.int64)
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        places = places[s >= least]
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def top_k_inner(queries: DataFrame, rows: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 512, row_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k highest integer inner products over all rows.

    Queries and rows are packed into blocks; every row block meets every query block in one
    task, where each query scatters its weighted terms over the block's postings into a dense
    array of scores, and a partition selection keeps k. A window then merges k rows a block and
    query. Nothing is broadcast, and a task holds two blocks.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids;
    shorter vectors count as padded by zeros. A query never meets rows of its own id. Where
    there are fewer rows all are returned; repeated rows are returned each. Blocks with
    components so large that a score could leave 64 bits are scored exactly by Python's
    numbers; such scores are told as the nearest 64-bit number, and compare as told. The query
    blocks are written once, so that no block of rows computes them anew.
    """
    spark = rows.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("bigint").alias("vec_id"), quantized(F.col(vector_col)).alias("q")).filter("vec_id is not null and q is not null")
    asked = materialize(_blocks(pick(queries).coalesce(max(1, partitions(spark) // 8)), query_block, "query"))
    held = _blocks(pick(rows), row_block, "row")
    # a stated query set meets all rows, block by block
    pairs = held.repartition(partitions(spark)).join(asked)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qt, ri, rt in zip(b["query_ids"], b["query_terms"], b["row_ids"], b["row_terms"], strict=True):
                q_ids, r_ids = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                q_terms, r_terms = whole_numbers(terms(qt, len(q_ids)), terms(rt, len(r_ids)))
                lists = []  # of each term: the rows that have it, and their weights
                for w in r_terms:
                    at = np.flatnonzero(w)
                    lists.append((slice(None), w) if 2 * len(at) > len(w) else (at, w[at]))
                found: list[pd.DataFrame] = []
                scores = np.empty(len(r_ids), q_terms.dtype)
                for j, own in enumerate(q_ids.tolist()):
                    scores[:] = 0
                    for t in np.flatnonzero(q_terms[: len(lists), j]):
                        at, w = lists[t]
                        scores[at] += q_terms[t, j] * w
                    if scores.dtype == object:
                        scores[:] = [min(max(x, LEAST), MOST) for x in scores]
                    top = best(scores, r_ids, own, k)
                    found.append(pd.DataFrame({"query_id": own, "vec_id": r_ids[top], "score": scores[top].astype(np.int64)}))
                yield pd.concat(found)

    near = pairs.mapInPandas(score, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
