"""Exact dedup over cuckoo-filter shards.

A shard keeps a cuckoo filter of short fingerprints beside the digests themselves, laid in
buckets by fingerprint. A probe that the filter refuses is new for sure; a hit is verified
against the digests of its bucket. An insertion that finds no room after the allowed kicks
doubles the filter and fills it anew from the stored digests. Live digests can be deleted.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, partitions


class CuckooIndex:
    """Digest -> (smallest id, live rows), behind a cuckoo filter that grows."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 256):
        self.content: dict[int, dict[bytes, list[int]]] = {}
        self.size = self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]
        self.rng = random.Random(buckets)

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") | 1 << 16

    def _places(self, digest: bytes, fp: int) -> tuple[int, int]:
        a = int.from_bytes(digest[2:8], "little") & self.mask
        return a, self._other(a, fp)

    def _other(self, place: int, fp: int) -> int:
        return (place ^ (fp * 0x5BD1E995 >> 7)) & self.mask

    def might_hold(self, digest: bytes) -> bool:
        """The filter's answer: False is certain."""
        fp = self._print(digest)
        a, b = self._places(digest, fp)
        return fp in self.table[a] or fp in self.table[b]

    def find(self, digest: bytes) -> list[int] | None:
        """The live entry of a digest: a filter hit, verified against the bucketed content."""
        return self.content.get(self._print(digest), {}).get(digest) if self.might_hold(digest) else None

    def _place(self, digest: bytes) -> bool:
        fp = self._print(digest)
        a, b = self._places(digest, fp)
        for at in (a, b):
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(fp)
                return True
        at = self.rng.choice((a, b))
        for _ in range(self.KICKS):
            k = self.rng.randrange(self.SLOTS)
            fp, self.table[at][k] = self.table[at][k], fp
            at = self._other(at, fp)
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(fp)
                return True
        return False

    def _grow(self) -> None:
        """Double the filter until every stored digest has a place."""
        buckets, placed = self.mask + 1, False
        while not placed:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            placed = all(self._place(d) for held in self.content.values() for d in held)

    def insert(self, digest: bytes, doc_id: int | None, rows: int = 1) -> bool:
        """Add rows of a digest; True if it is new."""
        if (live := self.find(digest)) is not None:
            live[1] += rows
            if doc_id is not None and (live[0] is None or doc_id < live[0]):
                live[0] = doc_id
            return False
        self.content.setdefault(self._print(digest), {})[digest] = [doc_id, rows]
        self.size += 1
        if not self._place(digest):
            self._grow()
        return True

    def delete(self, digest: bytes, rows: int = 1) -> bool:
        """Take away rows of a live digest; the digest leaves with its last row. False if it isn't live."""
        if (live := self.find(digest)) is None:
            return False
        live[1] -= rows
        if live[1] <= 0:
            fp = self._print(digest)
            del self.content[fp][digest]
            a, b = self._places(digest, fp)
            self.table[a if fp in self.table[a] else b].remove(fp)
            self.size -= 1
        return True

    def entries(self) -> Iterator[tuple[bytes, int | None, int]]:
        for held in self.content.values():
            for digest, (doc_id, rows) in held.items():
                yield digest, doc_id, rows


def normalized(text: Column) -> Column:
    """Each run of blank, tab, newline, vertical tab, form feed or return as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _out(index: CuckooIndex, kind: str) -> Iterator[pd.DataFrame]:
    held = list(index.entries())
    for at in range(0, len(held), 50_000):
        d, i, n = zip(*held[at : at + 50_000], strict=True)
        yield pd.DataFrame({"digest": list(d), "doc_id": pd.array(i, "Int64") if kind == "bigint" else list(i), "n_rows": list(n)})


def _indexed(kind: str, most: int | None):
    """Entries (digest, doc_id, n_rows; negative rows delete), in any order, merged by one index.

    With `most`, the index is told and begun anew whenever it holds that many digests.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CuckooIndex()
        gone: list[tuple[bytes, int]] = []
        for b in batches:
            for digest, doc_id, rows in zip(b["digest"], b["doc_id"].astype(object).where(b["doc_id"].notna(), None), b["n_rows"].tolist(), strict=True):
                if rows > 0:
                    index.insert(digest, doc_id, rows)
                else:
                    gone.append((digest, -rows))
                if most and index.size >= most:
                    yield from _out(index, kind)
                    index = CuckooIndex()
        for digest, rows in gone:
            index.delete(digest, rows)
        yield from _out(index, kind)

    return run


#: Stands for a null number while entries are merged: above every other, so any other is kept.
NO_ID = 2**63 - 1
#: Digests that one index is meant to hold: some 50 MB of Python objects.
A_SHARD = 200_000


def digest_index(entries: DataFrame, shards: int | None = None) -> DataFrame:
    """Live digests of (digest, doc_id, n_rows) entries: smallest id and rows of each.

    Each task first merges what it reads in an index of its own, told whenever it holds
    `A_SHARD` digests, so a digest with a third of all rows leaves a few entries a task; then
    entries are dealt out by digest, to as many shards as their number asks for, and each
    shard's index merges them. Deletions (negative n_rows) go to the shards only, after their
    insertions. Ids are whole numbers or texts; a null id counts above every other.
    """
    kind = "bigint" if entries.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    # whole numbers beside nulls would come to pandas as floats
    known = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)) if kind == "bigint" else F.col("doc_id").cast("string")
    entries = entries.select("digest", known.alias("doc_id"), "n_rows")
    schema = f"digest binary, doc_id {kind}, n_rows bigint"
    n = shards or max(partitions(entries.sparkSession), -(-entries.count() // A_SHARD))
    local = entries.filter("n_rows > 0").mapInPandas(_indexed(kind, A_SHARD), schema)
    gone = entries.filter("n_rows < 0")
    index = local.unionByName(gone).repartition(n, "digest").mapInPandas(_indexed(kind, None), schema)
    return index.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))) if kind == "bigint" else index


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """An index after more documents came and others left; all three as (digest, doc_id, n_rows).

    A digest that keeps rows keeps its smallest id ever inserted. Deleting an unknown digest
    changes nothing.
    """
    cols = ["digest", "doc_id", "n_rows"]
    less = deleted.select("digest", "doc_id", (-F.abs("n_rows")).alias("n_rows"))
    return digest_index(reduce(DataFrame.unionByName, [index.select(cols), inserted.select(cols), less]))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when their normalised forms are (see `normalized`); null counts as empty.
    The row with the smallest doc_id of equal texts stays. A null doc_id stays only where its
    group has no other id. Ids may be texts, too, in the order of their bytes. Of rows that repeat both text and id all are marked kept, since
    nothing tells them apart. An empty table gives no rows; other columns are not read.
    """
    hashed = materialize(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalized(F.col(text_col)).cast("binary"), 256)).alias("digest")))
    index = materialize(digest_index(hashed.select("digest", "doc_id", F.lit(1).cast("bigint").alias("n_rows"))))
    kind = hashed.schema["doc_id"].dataType
    found = hashed.join(index.select("digest", F.col("doc_id").cast(kind).alias("keep_id"), F.col("n_rows").alias("group_size")), "digest")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that `exact_dedup` keeps, all their columns; of rows equal in id and text one."""
    kept = materialize(exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text")).distinct())
    held = packed(docs, i=docs[f"`{id_col}`"], t=F.sha2(normalized(docs[f"`{text_col}`"]).cast("binary"), 256))
    same = F.col("i").eqNullSafe(F.col("kept_id")) & (F.col("t") == F.col("kept_text"))
    return held.join(kept, same, "left_semi").dropDuplicates(["i", "t"]).select("row.*")


def digest_of(text: str | None) -> bytes:
    """The digest of one text, for callers that maintain an index."""
    import re

    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).digest()
