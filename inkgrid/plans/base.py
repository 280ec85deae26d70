"""Base tables of the queries: one row per region, as Spark frames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.session import table


def regions(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """page_id, region_seq, l, t, r, b, det and further columns of regions; repeated deliveries dropped."""
    r = table(spark, d, "regions")
    cols = ["page_id", "region_seq", F.col("bbox.l").alias("l"), F.col("bbox.t").alias("t"), F.col("bbox.r").alias("r"), F.col("bbox.b").alias("b"), F.col("detection_confidence").alias("det"), *more]
    return r.select(*cols).dropDuplicates(["page_id", "region_seq"])


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


#: The same in SQL.
R = "(select distinct on (page_id, region_seq) page_id, region_seq, region_id, bbox.l as l, bbox.t as t, bbox.r as r, bbox.b as b, detection_confidence as det, * exclude (page_id, region_seq, region_id) from regions)"


def with_regions(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}R as materialized {R}{''.join(', ' + c for c in ctes)} {body}"
