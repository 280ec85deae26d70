"""Running values over the pages of a volume, and the context carried from page to page.

A volume may hold a large part of all pages, so no window runs over a whole
volume: pages are split into blocks of consecutive numbers, blocks are
aggregated first, a window over the blocks (one row each) gives what comes
before, and windows within blocks do the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096  # page numbers


def _blocks(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    # nulls are one group of their own; the joins below need a value for it
    return df.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("-"))).withColumn("_block", F.floor(F.col(order) / size))


def running_sum(df: DataFrame, value: Column, key: str, order: str, out: str, size: int = BLOCK) -> DataFrame:
    """Rows with ``out``: the sum of the value over the earlier rows of the key (0 for the first)."""
    x = _blocks(df, key, order, size).withColumn("_v", value)
    w = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy("_key", "_block").agg(F.sum("_v").alias("_s")).select("_key", "_block", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_v").over(Window.partitionBy("_key", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("_within", within).join(before, ["_key", "_block"]).withColumn(out, F.col("_before") + F.col("_within")).drop("_key", "_block", "_v", "_within", "_before")


def latest_before(df: DataFrame, value: Column, key: str, order: str, out: str, size: int = BLOCK) -> DataFrame:
    """Rows with ``out``: the latest earlier value of the key that isn't null; the value must not fall along the order."""
    x = _blocks(df, key, order, size).withColumn("_v", value)
    w = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy("_key", "_block").agg(F.max("_v").alias("_m")).select("_key", "_block", F.max("_m").over(w).alias("_before"))
    within = F.max("_v").over(Window.partitionBy("_key", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("_within", within).join(before, ["_key", "_block"]).withColumn(out, F.coalesce("_within", "_before")).drop("_key", "_block", "_v", "_within", "_before")


def carry(pages: DataFrame, regions: DataFrame, start: int | None = None) -> DataFrame:
    """Pages with ``context_seq``: the number of the latest earlier page of the volume that has translations; ``start`` before there is one.

    The context is carried as the page's number, not as its text, so that a
    page with very many lines isn't copied to the pages after it; consumers
    join the lines they want. Volumes are independent; a null volume is one.
    """
    has = regions.where("translated_text <> ''").select("page_id").distinct().withColumn("_has", F.lit(True))
    x = pages.join(has, "page_id", "left")
    x = latest_before(x, F.when(F.col("_has"), F.col("page_seq")), "sub_dir", "page_seq", "context_seq")
    if start is not None:
        x = x.withColumn("context_seq", F.coalesce("context_seq", F.lit(start).cast("long")))
    return x.drop("_has")


def context_lines(carried: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, context_page_id, region_seq, translated_text): the lines of each page's context, by a join on the carried number."""
    src = carried.select(F.col("page_seq").alias("context_seq"), F.col("page_id").alias("context_page_id"), "sub_dir")
    lines = regions.where("translated_text <> ''").select(F.col("page_id").alias("context_page_id"), "region_seq", "translated_text")
    return carried.select("page_id", "context_seq", "sub_dir").join(src, ["context_seq", "sub_dir"]).join(lines, "context_page_id").select("page_id", "context_page_id", "region_seq", "translated_text")
