"""Quality by perplexity under an interpolated modified Kneser-Ney model of token bigrams.

Tokens are those of a public byte-level vocabulary, so any text has a probability. The model has
the bigrams of all trusted text, grows with it and stays in a Spark table; what is kept for each
token alone (its probability, its weight as a context) is as long as the vocabulary and broadcast.

log P(text) is a sum: what each token costs when its bigram is unseen, and for every bigram that
the trusted text has a correction that doesn't depend on the document. So the bigrams of
documents meet the counts in one join, sharded by bigram, and are summed by document. The most
frequent bigrams, a list of fixed size, are broadcast instead; a shard that many documents ask
for all the same is met in several parts.

A trusted document is judged by what others hold: a bigram that only it has counts as unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_text, materialize, partitions
from .tokens import DEFAULT_TOKENIZER, encoder, load_tokenizer


#: Steps of a unit of log probability.
STEPS = 2000
#: Bits of the filter of trusted ids: 8 MB, whatever the corpus.
_BITS = 1 << 26
#: Bytes of text for each shard, and bytes of packs from which a shard is met in parts.
_SHARD, _PART = 32_000_000, 16_000_000


class Backoff(NamedTuple):
    """What the model keeps for each token, the boundary of texts being the last one."""

    p1: np.ndarray
    total: np.ndarray
    back: np.ndarray
    discounts: np.ndarray

    def costs(self) -> tuple[np.ndarray, np.ndarray]:
        """Steps that leaving each context and naming each token cost where their bigram is unseen."""
        return tuple(np.rint(-np.log(p) * STEPS).astype(np.int64) for p in (self.back, self.p1))

    def values(self, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The correction of that cost, in steps, for bigrams that the trusted text has n times."""
        seen = (n - self.discounts[np.minimum(n, 3)]) / self.total[v]
        return np.rint(-np.log1p(np.maximum(seen, 0) / (self.back[v] * self.p1[w])) * STEPS).astype(np.int64)


def vocabulary(path: str) -> int:
    """The number of ids; the next one stands for the boundary of texts."""
    return max(load_tokenizer(path).get_vocab().values()) + 1


def bigrams(text: str | None, path: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The text's tokens after a boundary and before one, as the first and the second of each bigram."""
    ids = np.frombuffer(encoder(path).encode(text), np.uint32).astype(np.int64)
    return np.concatenate(([size], ids)), np.concatenate((ids, [size]))


def _place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(_BITS))


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(z): the trusted documents' texts, compressed.

    A filter of fixed size holds a bit for each trusted id, so that few other texts cross the
    shuffle of the join that decides; where the filter is full, more do.
    """
    place = _place(F.col("doc_id"))
    bits = trusted.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    # at most 2^20 rows
    held = np.zeros(_BITS // 64, np.int64)
    rows = bits.toPandas()
    held[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    filled = docs.sparkSession.sparkContext.broadcast(held)

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            at = b["place"].to_numpy(np.int64)
            b = b[(filled.value[at >> 6] >> (at & 63) & 1).astype(bool)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "z": [pack.compress((t or "").encode()) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    small = docs.filter("doc_id is not null").select("doc_id", "text", place.alias("place")).mapInPandas(squeeze, f"doc_id {kind}, z binary")
    # a merge join at every size: the trusted ids grow with the corpus
    return small.join(trusted.hint("merge"), "doc_id", "left_semi").select("z")


def bigram_counts(texts: DataFrame, path: str) -> DataFrame:
    """(v, w, n): token bigrams of compressed texts, each task's summed first."""
    size = vocabulary(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        keys, counts, pending = [], [], 0

        def merge() -> None:
            nonlocal keys, counts, pending
            own, place = np.unique(np.concatenate(keys), return_inverse=True)
            keys, counts, pending = [own], [np.bincount(place, np.concatenate(counts)).astype(np.int64)], 0

        def table() -> pd.DataFrame:
            return pd.DataFrame({"v": (keys[0] >> 32).astype(np.int32), "w": (keys[0] & 0xFFFFFFFF).astype(np.int32), "n": counts[0]})

        for b in batches:
            for z in b["z"]:
                v, w = bigrams(unpack.decompress(z).decode(), path, size)
                keys.append(v << 32 | w)
                counts.append(np.ones(len(v), np.int64))
                pending += len(v)
                if pending > 1_000_000:
                    merge()
                    if len(keys[0]) > 2_000_000:
                        yield table()
                        keys, counts = [], []
        if keys:
            merge()
            yield table()

    return texts.mapInPandas(count, "v int, w int, n bigint").groupBy("v", "w").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Chen and Goodman's three discounts, from the counts of counts."""
    have = {r["n"]: r["k"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (have.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.01), float(i)) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _less(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def backoff(counts: DataFrame, size: int) -> Backoff:
    """What the model keeps for each of `size` tokens and the boundary; the driver gets two rows a token at most."""
    c1 = counts.groupBy("w").agg(F.count("*").alias("n"))
    d2, d1 = _discounts(counts), np.array([0.0, *_discounts(c1)])
    contexts = counts.groupBy("v").agg(F.sum("n").alias("total"), F.sum(_less(F.col("n"), d2)).alias("less")).toPandas()
    followed = c1.toPandas()
    types = np.zeros(size + 1, np.int64)
    types[followed["w"].to_numpy(np.int64)] = followed["n"].to_numpy(np.int64)
    p1 = np.full(size + 1, 1 / (size + 1))
    if types.sum():
        less = np.minimum(d1[np.minimum(types, 3)], types)
        p1 = (types - less) / types.sum() + p1 * less.sum() / types.sum()
    total, back = np.ones(size + 1), np.ones(size + 1)
    at = contexts["v"].to_numpy(np.int64)
    total[at] = contexts["total"].to_numpy(float)
    back[at] = contexts["less"].to_numpy(float) / total[at]
    return Backoff(p1, total, back, np.array([0.0, *d2]))


def _press(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


_SENT = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.string()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("cost", pa.int64()), ("by_others", pa.int64())]
    + [("bucket", pa.int32()), ("asked", pa.binary()), ("uids", pa.binary())]
)


def perplexity(docs: DataFrame, counts: DataFrame, kept: Backoff, path: str, hot: int = 1 << 17, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, perplexity_by_others) of every whole text, by byte.

    The `hot` most frequent bigrams of the model are looked up in place, all others are sent to
    its shards in packs; `hot` changes cost, never results. The packs are written to `scratch`,
    which the caller drops once the result is written.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(2 * partitions(spark), chars // _SHARD), 1 << 30)
    size = len(kept.p1) - 1
    model = spark.sparkContext.broadcast(kept)
    held = spark.sparkContext.broadcast(_sorted(counts.orderBy(F.desc("n"), "v", "w").limit(hot).toPandas(), kept))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (leave, name), (hot_keys, hot_values, hot_n) = model.value.costs(), held.value
        asked: list[tuple[np.ndarray, ...]] = []
        pending = 0

        def rows(**columns: list) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _SENT], schema=_SENT)

        def packs() -> pa.RecordBatch:
            keys, m, uid = (np.concatenate(x) for x in zip(*asked, strict=True))
            to = (keys >> 32) * 40503 + (keys & 0xFFFFFFFF)
            to %= buckets
            order = np.lexsort((keys, to))
            keys, m, uid, to = keys[order], m[order], uid[order], to[order]
            edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))
            bucket, pressed, uids = [], [], []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                own, place = np.unique(uid[a:z], return_inverse=True)
                bucket.append(int(to[a]))
                pressed.append(_press(np.diff(keys[a:z], prepend=0), place.astype(np.int64), m[a:z]))
                uids.append(_press(np.diff(own, prepend=0)))
            return rows(bucket=bucket, asked=pressed, uids=uids)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("uid", "doc_id", "lang", "text")]
            sizes, cost, by_others = [], [], []
            for uid, text in zip(cols[0], cols[3], strict=True):
                v, w = bigrams(text, path, size)
                keys, m = np.unique(v << 32 | w, return_counts=True)
                at = np.minimum(np.searchsorted(hot_keys, keys), max(len(hot_keys) - 1, 0))
                known = hot_keys[at] == keys if len(hot_keys) else np.zeros(len(keys), bool)
                value, others = m[known] * hot_values[at[known]], hot_n[at[known]] > m[known]
                base = int(leave[v].sum() + name[w].sum())
                sizes.append(len((text or "").encode()))
                cost.append(base + int(value.sum()))
                by_others.append(base + int(value[others].sum()))
                if not known.all():
                    asked.append((keys[~known], m[~known], np.full(int((~known).sum()), uid, np.int64)))
                    pending += len(asked[-1][0])
                if pending > 1_000_000:
                    yield packs()
                    asked, pending = [], 0
            yield rows(uid=cols[0], doc_id=cols[1], lang=cols[2], n_bytes=sizes, cost=cost, by_others=by_others)
        if asked:
            yield packs()

    def meet(packs: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        have, values, total = _sorted(shard, model.value)
        unpack, out = zstandard.ZstdDecompressor(), [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("uid", "cost", "by_others")})]
        for pressed, uids in zip(packs["asked"], packs["uids"], strict=True) if len(have) else ():
            k, place, m = np.frombuffer(unpack.decompress(pressed), np.int64).reshape(3, -1)
            k, uid = np.cumsum(k), np.cumsum(np.frombuffer(unpack.decompress(uids), np.int64))
            at = np.minimum(np.searchsorted(have, k), len(have) - 1)
            hit = np.flatnonzero(have[at] == k)
            value = m[hit] * values[at[hit]]
            out.append(pd.DataFrame({"uid": uid[place[hit]], "cost": value, "by_others": np.where(total[at[hit]] > m[hit], value, 0)}))
        return pd.concat(out).groupby("uid", as_index=False).sum()

    rows, kind = as_text(docs.select("doc_id", "lang", "text"), "doc_id")
    kinds = "uid bigint, doc_id string, lang string, n_bytes bigint, cost bigint, by_others bigint, bucket int, asked binary, uids binary"
    sent = scratch.keep(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(ask, kinds))
    packs = sent.filter("bucket is not null").select("bucket", "asked", "uids")
    parts = packs.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("asked")) / _PART).cast("int").alias("parts")).filter("parts > 1")
    of_part = packs.join(parts, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("asked"), F.coalesce("parts", F.lit(1))).cast("int"))
    shards = counts.withColumn("bucket", F.pmod(F.col("v").cast("bigint") * 40503 + F.col("w"), F.lit(buckets)).cast("int"))
    shards = shards.join(parts, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = of_part.groupBy("bucket", "part").cogroup(shards.select("bucket", "part", "v", "w", "n").groupBy("bucket", "part")).applyInPandas(meet, "uid bigint, cost bigint, by_others bigint")
    whole = sent.filter("bucket is null").select("uid", "doc_id", "lang", "n_bytes", "cost", "by_others").unionByName(met, allowMissingColumns=True)
    first = [F.max(c).alias(c) for c in ("doc_id", "lang", "n_bytes")]
    whole = whole.groupBy("uid").agg(*first, F.sum("cost").alias("cost"), F.sum("by_others").alias("by_others"))
    a_byte = lambda c: F.exp(F.col(c) / (F.col("n_bytes") + 1) / STEPS)
    return whole.select(F.col("doc_id").cast(kind).alias("doc_id"), "lang", "n_bytes", a_byte("cost").alias("perplexity"), a_byte("by_others").alias("perplexity_by_others"))


def _sorted(counts: pd.DataFrame, kept: Backoff) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams in order, their corrections and counts."""
    v, w, n = (counts[c].to_numpy(np.int64) for c in ("v", "w", "n"))
    keys = v << 32 | w
    order = np.argsort(keys)
    return keys[order], kept.values(v, w, n)[order], n[order]


def quality_filter(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, kept) of every row.

    Trusted text: documents whose label has quality 1. A document is kept where its perplexity
    is at most the `quantile` of trusted documents of its language, read from an exact histogram
    of log perplexity in steps of 0.001; a language without trusted text (null too) takes the
    quantile over all languages. Without any trusted text everything is kept. Null counts as
    empty text, which is one boundary; repeated rows are judged each. `tokenizer`: path of a
    byte-level BPE file, on every executor.
    """
    path = tokenizer or public_tokenizers.path(DEFAULT_TOKENIZER)
    rows = docs.select("doc_id", "text", "lang")
    trusted = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    scratch = Scratch(rows.sparkSession)
    counts = scratch.keep(bigram_counts(trusted_texts(rows, trusted), path))
    scored = perplexity(rows, counts, backoff(counts, vocabulary(path)), path, scratch=scratch)
    scored = scored.join(trusted.select("doc_id", F.lit(True).alias("own")), "doc_id", "left")
    scored = materialize(scored.select("doc_id", "lang", "n_bytes", F.when(F.col("own"), F.col("perplexity_by_others")).otherwise(F.col("perplexity")).alias("perplexity"), "own"))
    scratch.drop()
    # a few thousand bins a language, whatever the corpus
    hist = scored.filter("own").groupBy("lang", F.ceil(F.log("perplexity") * 1000).alias("bin")).agg(F.count("*").alias("n")).toPandas()

    def cut(h: pd.DataFrame) -> float | None:
        if h.empty:
            return None
        h = h.groupby("bin")["n"].sum().sort_index()
        return float(np.exp(h.index[np.searchsorted(h.cumsum().to_numpy(), quantile * h.sum())] / 1000))

    overall = cut(hist)
    limit = F.lit(overall).cast("double")
    for lang, h in hist[hist["lang"].notna()].groupby("lang"):
        limit = F.when(F.col("lang") == lang, F.lit(cut(h))).otherwise(limit)
    return scored.drop("own").withColumn("threshold", limit).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
