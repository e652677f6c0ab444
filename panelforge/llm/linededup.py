"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key, n): digests of lines and the documents that have them, bucketed and
sorted by digest. Each new batch is merge-anti-joined with the runs, whose buckets lie where the
join wants them: lines that a run already knows as frequent add nothing more; the rest become a
run of the lowest level. As soon as a level has `fanout` runs they are compacted to one of the
next, so a digest is rewritten once a level, however many batches come.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import Scratch, partitions, shared_folder

#: Blank, tab, newline, vertical tab, form feed, return.
SPACE = " \t\n\x0b\x0c\r"
_SPACE = SPACE.encode()
#: Frequent keys that each task holds at most (some 6 MB), the most frequent first; others are met in a join.
HELD = 1 << 16
#: Bits by which a task tells that a line is in no other frequent key.
BITS = 1 << 26


def line_keys(text: Column, shortest: int = 1) -> Column:
    """The different keys of a text's lines, as 128-bit digests; keys of fewer code points left out."""

    def key(line: Column) -> Column:
        return F.translate(F.btrim(line, F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), key)
    return F.transform(F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= shortest)), lambda k: F.unhex(F.md5(k.cast("binary"))))


class LineRuns:
    """Runs of (key, n) by level, in the shared folder."""

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 3, buckets: int | None = None):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = buckets or partitions(spark)
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.at, self.count = f"{shared_folder(spark)}/{self.name}", 0
        self.levels: list[list[str]] = [[]]

    def _write(self, run: DataFrame) -> str:
        name = f"{self.name}_{self.count}"
        self.count += 1
        run.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.at}/{name}").format("parquet").saveAsTable(name)
        return name

    def _remove(self, names: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        # read as files: a union of bucketed scans passes for bucketed by key, but a key's rows lie in several of its tasks
        every = reduce(DataFrame.unionByName, [self.spark.read.schema("key binary, n bigint").parquet(f"{self.at}/{x}") for x in names])
        return every.groupBy("key").agg(F.sum("n").alias("n"))

    def unknown(self, batch: DataFrame) -> DataFrame:
        """The batch's (key, n) that no run knows as frequent."""
        for name in self.runs():
            batch = batch.join(self.spark.table(name).filter(F.col("n") >= self.threshold).select("key"), "key", "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Add a batch's (key, n), keys once each: what `unknown` leaves of it is a run of the lowest level."""
        name = self._write(self.unknown(batch.select("key", "n")).repartition(self.buckets, "key"))
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(old).repartition(self.buckets, "key")))
            self.levels[level] = []
            self._remove(old)
            level += 1

    def frequent(self) -> DataFrame:
        """(key, n) of all keys of at least `threshold` documents; n counts documents until a run knew the key as frequent."""
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], "key binary, n bigint")
        return self._merged(names).filter(F.col("n") >= self.threshold)

    def drop(self) -> None:
        self._remove(self.runs())
        self.levels = [[]]


def _bits(keys: DataFrame) -> np.ndarray:
    """Which of BITS places some key has; at most 2048 rows of 4 KB come to the driver."""
    place = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("bigint").bitwiseAND(F.lit(BITS - 1)) + 1
    parts = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    held = np.zeros(BITS // 8, np.uint8)
    for r in parts.collect():
        held[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return held


def _asked(held, shortest: int):
    """Texts with the keys of their lines that aren't held and may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, bits = held.value
        for b in batches:
            out = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                keys = _digests(text or b"", shortest)
                out.append([d for d in dict.fromkeys(keys) if d and d not in frequent and bits[(p := int.from_bytes(d[:4], "big") & (BITS - 1)) >> 3] >> (p & 7) & 1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.binary()))], [*b.schema.names, "asked"])

    return run


def _digests(text: bytes, shortest: int) -> list[bytes | None]:
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_SPACE).lower()  # of bytes: A-Z alone
        long = len(key) >= 4 * shortest or len(key.decode()) >= shortest
        out.append(hashlib.md5(key, usedforsecurity=False).digest() if long else None)
    return out


def _kept(held, shortest: int):
    """Each text without its frequent lines: those held by all tasks and those told with the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value[0]
        for b in batches:
            kept, lines, dropped = [], [], []
            for text, told in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, more = text or b"", set(told or ())
                gone = [d in frequent or d in more for d in _digests(text, shortest)]
                kept.append(b"\n".join(x for x, g in zip(text.split(b"\n"), gone, strict=True) if not g) if any(gone) else text)
                lines.append(len(gone))
                dropped.append(sum(gone))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return run


def frequent_lines(docs: DataFrame, least: int = 10, shortest: int = 1, batches: int = 6, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n) of the lines of at least `least` documents, by `batches` batches over levelled runs, written in the shared folder."""
    spark = docs.sparkSession
    scratch, runs = Scratch(spark), LineRuns(spark, least, fanout)
    batch = F.pmod(F.xxhash64(F.col(id_col), F.char_length(text_col)), F.lit(batches)).cast("int")
    entries = docs.select(batch.alias("batch"), F.explode(line_keys(F.col(text_col), shortest)).alias("key"))
    told = scratch.keep(entries.groupBy("batch", "key").agg(F.count("*").alias("n")), "batch")
    for k in range(batches):
        runs.add(told.filter(F.col("batch") == k))
    out = Scratch(spark).keep(runs.frequent())
    runs.drop()
    scratch.drop()
    return out


def drop_frequent_lines(docs: DataFrame, least: int = 10, shortest: int = 1, batches: int = 6, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each document without the lines that at least `least` documents have.

    A text is split at newlines; a null or empty one is one empty line. A line's key is the line
    without blanks, tabs, newlines, vertical tabs, form feeds and returns at its ends, A-Z
    lower-cased; keys of fewer than `shortest` code points always stay. Every row is a document,
    repeated ones too. What stays is joined by newlines, the text of no lines is empty. An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    keys = frequent_lines(docs, least, shortest, batches, fanout, id_col, text_col)
    first = keys.orderBy(F.col("n").desc(), "key").limit(HELD)
    hot = frozenset(bytes(r["key"]) for r in first.select("key").collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    none, told = F.array().cast("array<binary>"), StructField("asked", ArrayType(BinaryType()))
    schema = StructType([*rows.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    if len(hot) < HELD:  # every frequent key is held
        held = spark.sparkContext.broadcast((hot, None))
        return rows.withColumn("asked", none).mapInArrow(_kept(held, shortest), schema)
    rest = keys.join(first.select("key"), "key", "left_anti")
    held = spark.sparkContext.broadcast((hot, _bits(rest)))
    asked = rows.mapInArrow(_asked(held, shortest), StructType([*rows.schema.fields, told]))
    ask = Scratch(spark).keep(asked.filter(F.size("asked") > 0).withColumn("uid", F.monotonically_increasing_id()))
    found = ask.select("uid", F.explode("asked").alias("key")).join(rest.select("key"), "key", "left_semi").groupBy("uid").agg(F.collect_list("key").alias("found"))
    met = ask.join(found, "uid", "left").select("doc_id", "text", F.col("found").alias("asked"))
    return asked.filter(F.size("asked") == 0).unionByName(met).mapInArrow(_kept(held, shortest), schema)
