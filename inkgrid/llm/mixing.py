"""Mixing sources to target weights (problem 7).

Method: Pareto order sampling. A plan gives every size class of a source its
expected number of copies a document, capped at the source's ``max_repeats``;
the whole part is allocated outright and the rest is the inclusion
probability p. Documents of a source are ranked by the odds of a hashed
uniform number over the inclusion odds, u/(1-u) / (p/(1-p)), and the smallest
are taken until the size of the sample is reached. That size is fixed in
tokens: the target less what the whole copies hold. A source that stays
short of its target with all its copies at the cap can't reach it.

No source is ever ranked in one task: tokens are first summed in buckets of
the rank, the running sum over the buckets of a source finds the bucket of
the cut, and only that bucket's documents are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgrid.llm.bpe import token_counts
from inkgrid.session import cut_lineage

BUCKETS = 4096  # of the rank, by source


def size_class(tokens: Column) -> Column:
    """Class of a document's size: 0 for no tokens, else 1 + floor(log2), at most some 40 classes."""
    return F.when(tokens > 0, F.floor(F.log2(tokens.cast("double"))).cast("int") + 1).otherwise(F.lit(0))


def solve_copies(classes: list[tuple[int, int, int]], target: float, cap: int, lean: float = 0.0) -> dict[int, float]:
    """Expected copies by size class, min(cap, c * weight), with c such that they sum to ``target`` tokens (or the cap everywhere).

    ``classes`` has (class, documents, tokens). The weight is 1 + lean * class:
    each doubling of the size adds ``lean`` to it. The sum is piecewise linear
    in c, so c is found by passing its break points in order.
    """
    have = sorted(((1.0 + lean * k, k, t) for k, _n, t in classes if t > 0), reverse=True)
    if not have or target <= 0:
        return {k: 0.0 for k, _n, _t in classes}
    if cap * sum(t for _w, _k, t in have) <= target:
        return {k: float(cap) if t > 0 else 0.0 for k, _n, t in classes}
    full, rest = 0.0, sum(w * t for w, _k, t in have)
    c = 0.0
    for w, _k, t in have:  # the heaviest class reaches the cap first
        c = (target - full) / rest
        if c * w <= cap:
            break
        full += cap * t
        rest -= w * t
    return {k: min(float(cap), c * (1.0 + lean * k)) if t > 0 else 0.0 for k, _n, t in classes}


PLAN = "source string, target_share double, max_repeats int, total long, target_tokens double, reaches boolean, budget double, copies array<struct<cls:int,copies:double>>"
_COPIES = pa.list_(pa.struct([("cls", pa.int32()), ("copies", pa.float64())]))


def plan(counts: DataFrame, targets: DataFrame, lean: float = 0.0) -> DataFrame:
    """What the sampler does with each target source, a row a source.

    ``copies`` has the expected copies a document by size class, ``budget`` the
    tokens left to sample once whole copies are allocated, and ``reaches``
    tells whether the copies make up the target: they don't where all of them
    sit at the cap and hold less. The total counts all documents, those of
    sources without a target and of the null source too. Targets without
    documents have no copies; repeated target rows count once; a null
    ``max_repeats`` allows none. Lazy: the texts are read once, when it runs.
    """
    sizes = counts.groupBy("source", size_class(F.col("tokens")).alias("cls")).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    per = sizes.groupBy(F.col("source").alias("_s")).agg(F.collect_list(F.struct("cls", "docs", "tokens")).alias("classes"), F.sum("tokens").alias("tokens"))  # 40 classes at most
    t = targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats")).where("source is not null").distinct()
    j = per.join(t, F.col("_s") == F.col("source"), "full")
    j = j.withColumn("total", F.coalesce(F.sum("tokens").over(W.partitionBy()), F.lit(0)).cast("long")).where("source is not null")  # a row a source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            goal, reaches, budget, lists = [], [], [], []
            for r in b.to_pylist():
                classes = [(x["cls"], x["docs"], x["tokens"]) for x in r["classes"] or ()]
                want, cap = (r["target_share"] or 0.0) * r["total"], r["max_repeats"]
                copies = solve_copies(classes, want, cap, lean)
                capped = all(copies[k] >= cap for k, _n, n in classes if n > 0)
                goal.append(want)
                reaches.append(not (capped and cap * sum(n for _k, _n, n in classes) < want))
                budget.append(sum((copies[k] - math.floor(copies[k])) * n for k, _n, n in classes))
                lists.append([{"cls": k, "copies": x} for k, x in sorted(copies.items())])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("source", "target_share", "max_repeats", "total")), pa.array(goal, pa.float64()), pa.array(reaches, pa.bool_()), pa.array(budget, pa.float64()), pa.array(lists, _COPIES)],
                names=["source", "target_share", "max_repeats", "total", "target_tokens", "reaches", "budget", "copies"],
            )

    return j.select("source", "target_share", "max_repeats", "total", "classes").mapInArrow(run, PLAN)


def unreachable(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(source): target sources that stay short of their share in the sampler's plan."""
    return plan(token_counts(documents, path), targets).where(~F.col("reaches")).select("source")


def _uses(counts: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    rates = planned.select("source", F.explode("copies").alias("x")).select("source", "x.cls", "x.copies")
    # targets times some 40 size classes, and a row a target: bounded by the target table
    d = counts.withColumn("cls", size_class(F.col("tokens"))).join(F.broadcast(rates), ["source", "cls"])
    whole = F.floor("copies")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.col("copies") - whole
    rank = F.when(p > 0, u / (1 - u) / (p / (1 - p)))
    d = d.select("doc_id", "source", "tokens", whole.cast("long").alias("whole"), rank.alias("rank"))
    # rank / (1 + rank) spreads the ranks over (0, 1) and keeps their order
    d = d.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))
    per = d.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = per.withColumn("before", before).join(F.broadcast(planned.select("source", "budget")), "source").where(F.col("before") <= F.col("budget"))
    # the last bucket that the budget reaches into
    cut = reached.groupBy("source").agg(F.max(F.struct("bucket", (F.col("budget") - F.col("before")).alias("left"))).alias("m")).select("source", F.col("m.bucket").alias("at"), F.col("m.left").alias("left"))
    j = d.join(F.broadcast(cut), "source", "left")
    edge = F.coalesce(F.col("bucket") == F.col("at"), F.lit(False))
    # within it documents are taken while at least half of the next one fits, so a source misses its target by half a document at most
    run = F.sum("tokens").over(W.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    last = j.where(edge).withColumn("extra", (run - F.col("tokens") / 2 <= F.col("left")).cast("long"))
    rest = j.where(~edge).withColumn("extra", F.coalesce(F.col("bucket") < F.col("at"), F.lit(False)).cast("long"))
    return rest.unionByName(last).select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("uses"))


def mixture(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 7, lean: float = 0.0) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each document of a target source is used.

    Null, empty and blank-source documents are kept with 0 uses where they have
    no tokens; documents of sources without a target have no row. The result
    depends only on the rows and the seed, not on their order or partitions.
    """
    counts = cut_lineage(token_counts(documents, path))  # read four times: texts are encoded once
    return _uses(counts, cut_lineage(plan(counts, targets, lean)), seed)


def actual_shares(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 7, lean: float = 0.0) -> DataFrame:
    """(source, target_share, actual_share, tokens_used, docs_used, most_uses): ``actual_share`` is of the total tokens of all documents; targets without documents have zeros."""
    counts = cut_lineage(token_counts(documents, path))
    planned = cut_lineage(plan(counts, targets, lean))
    per = _uses(counts, planned, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.sum((F.col("uses") > 0).cast("long")).alias("docs_used"), F.max("uses").alias("most_uses"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return planned.select("source", "target_share", "total").join(per, "source", "left").select("source", "target_share", F.when(F.col("total") > 0, F.round(z("tokens_used") / F.col("total"), 6)).otherwise(F.lit(0.0)).alias("actual_share"), z("tokens_used").alias("tokens_used"), z("docs_used").alias("docs_used"), z("most_uses").alias("most_uses"))
