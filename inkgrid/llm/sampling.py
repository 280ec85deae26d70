"""Bounded samples that depend only on the rows.

A sample is the rows with the least hash of their key. Taking those by a sort
or a window alone sends as many rows a task as the sample has, which grows
with the number of tasks. So groups are counted first (without reading texts),
and only rows whose hash lies under a threshold that lets some four times the
sample through are sorted: what is shuffled is bounded whatever the size of
the table, and the sample is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OVER = 4  # times the sample that the threshold lets through


def least_hashed(rows: DataFrame, key: str, n: int, by: tuple[str, ...] = (), usable: str = "true", tie: str = "text") -> DataFrame:
    """At most ``n`` rows of each group ``by`` for which ``usable`` holds: those with the least hash of ``key``, ties by ``tie``.

    There must be few groups (their counts are seen by the driver); rows with
    a null group are left out. Where less than a fourth of a group's rows are
    usable, the sample may be smaller than ``n``.
    """
    space = 1 << 62
    hashed = F.shiftrightunsigned(F.xxhash64(key), 2)
    named = rows.where(" and ".join(f"{c} is not null" for c in by)) if by else rows
    group = F.concat_ws("\x01", *by) if by else F.lit("")
    counts = {r["g"]: r["count"] for r in named.groupBy(group.alias("g")).count().collect()} if by else {"": named.count()}
    if not counts:
        return rows.limit(0)
    limits = F.create_map(*[F.lit(x) for g, c in sorted(counts.items()) for x in (g, min(space, space * OVER * n // max(1, c)))])
    some = named.withColumn("_h", hashed).where(F.col("_h") < limits[group]).where(usable)
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_h", tie)  # OVER * n rows a group, or about as many
    return some.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_h", "_rank")
