"""Equi-joins whose key may hold a large share of all rows.

A key is hot if it holds more than one part in ``4 * parts`` of the rows, so
there are at most ``4 * parts`` hot keys, whatever the size of the table: the
table of hot keys may be broadcast. Rows of hot keys are dealt over ``parts``
salts on the left and repeated once a salt on the right; all other rows have
salt 0. Nothing is dropped, and nothing runs before the join itself does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """(key): keys with more than one part in ``4 * parts`` of the rows; the null key is none. Counted with a map-side combine."""
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = per.agg(F.sum("_n").alias("_total"))
    return per.crossJoin(F.broadcast(total)).where(F.col("_n") * (4 * parts) > F.col("_total")).select(key)  # one row: the total


def salted_join(left: DataFrame, right: DataFrame, key: str, counted: DataFrame, spread_by: Column, how: str = "left", parts: int | None = None) -> DataFrame:
    """``left.join(right, key, how)`` for ``how`` 'left' or 'inner', with hot keys of the left dealt over several tasks.

    ``counted`` has the left's keys (the table the left is made from, so that
    the keys are counted without computing the left); ``spread_by`` deals the
    rows of a hot key. The right has one row a key, or few.
    """
    n = parts or max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(hot_keys(counted, key, n).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(n)).cast("int")).otherwise(F.lit(0))
    a = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [key, "_salt"], how).drop("_salt")
