"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset on a single machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="checkpoint-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder.

    Spark's cleaner removes it, once nothing refers to it, where
    spark.cleaner.referenceTracking.cleanCheckpoints is set; else it stays as long as the folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Scratch folders of this process that aren't dropped yet.
_HELD: dict[str, Scratch] = {}


@atexit.register
def _drop_held() -> None:
    for scratch in list(_HELD.values()):
        with contextlib.suppress(Exception):  # the session may have ended before
            scratch.drop()


class Scratch:
    """Tables written to the shared folder as Parquet, a fraction of a checkpoint's size.

    `drop` removes those no longer needed; a result that is read lazily keeps its tables until
    the driver's process ends, if its session still lives then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        _HELD[self.at] = self

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """df, written and read again; in a folder for each value of the columns `by`."""
        path = f"{self.at}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *numbers: int) -> None:
        """Remove tables by their number in the order of writing, or all."""
        if not numbers:
            _HELD.pop(self.at, None)
        jvm = self.spark.sparkContext._jvm
        for at in [f"{self.at}/{k}" for k in numbers] or [self.at]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """df's rows as one column `row`, beside columns made of them: no name of df's can clash with these. `row.*` gives them back."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), *(c.alias(name) for name, c in more.items()))


def as_text(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df with the column as text, and its type: a whole number with nulls would come to pandas as floats."""
    kind = df.schema[name].dataType.simpleString()
    return df.withColumn(name, df[name].cast("string")), kind
