"""All registered queries of the panel engine, and its flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel, stats
from . import feed_queries, model_queries, news_queries, panel_queries, report_queries, stats_queries  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str, long: int = 60, skip: int = 5, beta_rows: int = 60, beta_least: int = 20) -> DataFrame:
    """Daily cross-sectional rank correlation of momentum with the beta-adjusted forward label."""
    r = panel_queries.returns(spark, sf_dir)
    p = panel.momentum(panel.rolling_beta(r, ["asset"], "d", "ret", "bench_ret", beta_rows, beta_least), ["asset"], "d", long, skip)
    y = panel.forward_label(panel.relative_volume(p, ["asset"], "d"), ["asset"], "d").filter("momentum is not null")
    return stats.spearman(y, ["d"], "momentum", "y").select("d", F.round("ic", 6).alias("ic"), "n")
