"""Structured Streaming twins of the panel's time contracts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import normalize_title
from ..sources.shared import new_path


def stream_dedupe(df: DataFrame, by: list[str], title: str, ts: str, within: str = "24 hours") -> DataFrame:
    """The first row of each normalised title within the watermark."""
    return df.withColumn("title_norm", normalize_title(F.col(title))).withWatermark(ts, within).dropDuplicatesWithinWatermark([*by, "title_norm"])


def stream_daily(df: DataFrame, by: list[str], ts: str, value: str, late: str = "1 day") -> DataFrame:
    """Rows and sum of a value per day and key, once the watermark has passed the day."""
    g = df.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").cast("date").alias("d"), *by, "n", "total")


def stream_cooldown(df: DataFrame, limit: float = 0.10, bdays: int = 5, rows: int = 21) -> DataFrame:
    """(portfolio, d, blocked) of an equity stream (portfolio, d, equity): a fall of more than `limit` from the top of the last `rows` values blocks `bdays` days from Monday to Friday, as `cooldown_gate` has it.

    The state of a portfolio is its last values and one date; rows of a batch are taken in the order of d.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, until = state.get if state.exists else ([], "0001-01-01")
        last = list(last)
        pdf = pd.concat(list(batches)).sort_values("d")
        out = []
        for d, e in zip(pdf["d"], pdf["equity"], strict=True):
            last = [*last, float(e)][-rows:]
            fall = (max(last) - e) / max(last) if len(last) >= rows else 0.0
            if str(d)[:10] >= until and fall > limit:
                until = str(np.busday_offset(str(d)[:10], bdays, roll="backward"))
            out.append((key[0], d, str(d)[:10] < until))
        state.update((last, until))
        yield pd.DataFrame(out, columns=["portfolio", "d", "blocked"])

    kind = df.schema["portfolio"].dataType.simpleString()
    return df.groupBy("portfolio").applyInPandasWithState(step, f"portfolio {kind}, d date, blocked boolean", "last array<double>, until string", "append", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet in the shared folder, its state and progress beside it, and read that."""
    at = new_path(spark, name)
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")
