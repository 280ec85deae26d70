"""Listing and scanning page files and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffixes of page images.
SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path with its dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*SUFFIXES)


def is_member(path: Column) -> Column:
    """Archive members that are pages: no folders, hidden files or resource forks."""
    return ~path.endswith("/") & ~F.regexp_extract(path, r"([^/]*)$", 1).startswith(".") & ~path.startswith("__MACOSX") & is_image(path)


def number_by_name(files: DataFrame, out: str = "page_seq") -> DataFrame:
    """Number files 1, 2, … by lower-cased name, ties by ``seq``.

    A total order over all files without one task that sees them all: files
    are range-partitioned by name, counted per partition, and numbered within
    their partition from the count of those before.
    """
    x = files.withColumn("_k", F.lower("name"))
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = x.repartitionByRange(n, "_k", "seq").withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_k", "seq")))
    # the partition id is a function of the range bounds, which sampling may set anew: cut the lineage before the count
    from inkgrid.session import cut_lineage

    parts = cut_lineage(parts)
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return parts.join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p").withColumn(out, F.col("_b") + F.col("_i")).drop("_k", "_p", "_i", "_b")


def number_members(members: DataFrame, archive: str = "sub_dir", out: str = "n") -> DataFrame:
    """Number the members of each archive by lower-cased path, ties by ``seq``: the place among all members less that of the archive's first."""
    x = members.withColumn("name", F.concat_ws("\x01", F.col(archive), "member"))
    x = number_by_name(x, "_n")
    first = x.groupBy(archive).agg(F.min("_n").alias("_first"))
    return x.join(first, archive).withColumn(out, F.col("_n") - F.col("_first") + 1).drop("_n", "_first", "name")
