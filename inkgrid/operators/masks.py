"""Masks as runs: rows (page_id, region_seq, y, x0, x1), half-open, in page coordinates.

Areas, intersections and clips are joins and sums over runs; a mask is never
made of pixel rows. Empty and null runs are dropped; overlapping runs of one
mask line are joined first, so repeated rows don't count twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.geometry import Box
from inkgrid.operators.spatial import Sets, by_key

KEY = ("page_id", "region_seq")


def joined(runs: DataFrame) -> DataFrame:
    """Disjoint runs: those of one mask line that overlap or touch become one (gaps and islands)."""
    x = runs.select(*KEY, "y", "x0", "x1").where("x1 > x0 and y is not null and page_id is not null")
    w = Window.partitionBy(*KEY, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", F.coalesce((F.col("x0") > reach).cast("int"), F.lit(0)))
    x = x.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*KEY, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def area(runs: DataFrame) -> DataFrame:
    """(page_id, region_seq, area, l, t, r, b) of each mask."""
    return joined(runs).groupBy(*KEY).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("l"), F.min("y").alias("t"), F.max("x1").alias("r"), (F.max("y") + 1).alias("b"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of the masks of ``a`` within those of ``b`` of the same region."""
    q = joined(b).select(*KEY, "y", F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    j = joined(a).join(q, [*KEY, "y"]).where("x0 < u1 and u0 < x1")
    return j.select(*KEY, "y", F.greatest("x0", "u0").alias("x0"), F.least("x1", "u1").alias("x1"))


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    return joined(a.select(*KEY, "y", "x0", "x1").unionByName(b.select(*KEY, "y", "x0", "x1")))


def clip(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs in the coordinates of each region's box, cut to it."""
    j = joined(runs).join(boxes.select(*KEY, "l", "t", "r", "b"), list(KEY))
    x0, x1 = F.greatest("x0", "l") - F.col("l"), F.least("x1", "r") - F.col("l")
    return j.where("y >= t and y < b").select(*KEY, (F.col("y") - F.col("t")).alias("y"), x0.alias("x0"), x1.alias("x1")).where("x1 > x0")


def mask_iou(runs: DataFrame) -> DataFrame:
    """(page_id, a_seq, b_seq, iou) of masks of one page that share a pixel. Runs meet on (page, scan line)."""
    x = joined(runs)
    a = x.select("page_id", "y", F.col("region_seq").alias("a_seq"), F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    b = x.select("page_id", "y", F.col("region_seq").alias("b_seq"), F.col("x0").alias("v0"), F.col("x1").alias("v1"))
    inter = a.join(b, ["page_id", "y"]).where("a_seq < b_seq and u0 < v1 and v0 < u1").groupBy("page_id", "a_seq", "b_seq").agg(F.sum(F.least("u1", "v1") - F.greatest("u0", "v0")).alias("i"))
    s = x.groupBy(*KEY).agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))
    j = inter.join(s.select("page_id", F.col("region_seq").alias("a_seq"), F.col("n").alias("na")), ["page_id", "a_seq"])
    j = j.join(s.select("page_id", F.col("region_seq").alias("b_seq"), F.col("n").alias("nb")), ["page_id", "b_seq"])
    return j.select("page_id", "a_seq", "b_seq", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("iou"))


def merged_masks(runs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(page_id, region_seq, merged): masks joined through chains of IoU of at least the threshold, named by the lowest number."""
    from inkgrid.operators.spatial import components

    e = mask_iou(runs).where(F.col("iou") >= threshold).select("page_id", F.col("a_seq").alias("a"), F.col("b_seq").alias("b"))
    return components(e, runs.select(*KEY)).select(*KEY, F.col("component").alias("merged"))


def enclosed(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, region_seq, enclosed): whether a mask looks like a closed shape within its box.

    Not if it fills more than 0.92 of the box's scan lines that have runs,
    touches three edges along more than 0.35 of them, or spans 0.96 of the box
    both ways. The edge bands are as wide as a 24th of the shorter side, 1 to 6.
    """
    b = boxes.select(*KEY, "l", "t", "r", "b").where("r > l and b > t")
    m = clip(runs, b).join(b, list(KEY))
    B = Box.of()
    e = F.least(F.lit(6), F.greatest(F.lit(1), F.floor(F.least(B.w, B.h) / 24).cast("int")))
    x0, x1, y = F.col("x0"), F.col("x1"), F.col("y")
    g = m.groupBy(*KEY, "l", "t", "r", "b").agg(
        F.sum(x1 - x0).alias("n"),
        F.countDistinct("y").alias("lines"),
        F.sum(F.when(y < e, x1 - x0).otherwise(0)).alias("top"),
        F.sum(F.when(y >= B.h - e, x1 - x0).otherwise(0)).alias("bottom"),
        F.sum(F.greatest(F.lit(0), F.least(x1, e) - x0)).alias("left"),
        F.sum(F.greatest(F.lit(0), x1 - F.greatest(x0, B.w - e))).alias("right"),
        (F.max("x1") - F.min("x0")).alias("bw"),
        (F.max("y") + 1 - F.min("y")).alias("bh"),
    )
    over = lambda c, n: (20 * F.col(c) > 7 * n).cast("int")
    touched = over("top", e * B.w) + over("bottom", e * B.w) + over("left", e * F.col("lines")) + over("right", e * F.col("lines"))
    filled = 25 * F.col("n") > 23 * F.col("lines") * B.w
    spans = (25 * F.col("bw") >= 24 * B.w) & (25 * F.col("bh") >= 24 * B.h)
    return g.select(*KEY, (~filled & (touched < 3) & ~spans).alias("enclosed"))


def ink_anchor(ink: DataFrame, boxes: DataFrame, margin: int = 5) -> DataFrame:
    """(page_id, region_seq, l, t, r, b): the box around a region's ink runs, without a border of its layout box; the text box where there is no ink or no layout box.

    ``boxes`` has l, t, r, b and the layout box as ll, lt, lr, lb.
    """
    j = joined(ink).join(boxes.select(*KEY, "ll", "lt", "lr", "lb").where("ll is not null"), list(KEY))
    j = j.where((F.col("y") >= F.col("lt") + margin) & (F.col("y") < F.col("lb") - margin))
    j = j.select(*KEY, "y", F.greatest("x0", F.col("ll") + margin).alias("x0"), F.least("x1", F.col("lr") - margin).alias("x1")).where("x1 > x0")
    a = j.groupBy(*KEY).agg(F.min("x0").alias("al"), F.min("y").alias("at"), F.max("x1").alias("ar"), (F.max("y") + 1).alias("ab"))
    o = boxes.join(a, list(KEY), "left")
    return o.select(*KEY, *[F.coalesce(f"a{c}", c).alias(c) for c in "ltrb"])


def column_ranges(runs: DataFrame, boxes: DataFrame, size: int, step: int = 1) -> DataFrame:
    """(page_id, region_seq, x, y0, y1): per column of ``size`` pixels of a box, the stretches of scan lines the mask covers wholly, at least ``size`` tall.

    ``step`` is the distance of the scan lines that the runs have.
    """
    m = clip(runs, boxes)
    cols = m.withColumn("c", F.explode(F.when(F.floor(F.col("x1") / size) > F.ceil(F.col("x0") / size), F.sequence(F.ceil(F.col("x0") / size), F.floor(F.col("x1") / size) - 1)).otherwise(F.array().cast("array<bigint>"))))
    w = Window.partitionBy(*KEY, "c").orderBy("y")
    rows = cols.select(*KEY, "c", "y").distinct().withColumn("g", F.sum(F.coalesce((F.col("y") - F.lag("y").over(w) > step).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy(*KEY, "c", "g").agg(F.min("y").alias("y0"), (F.max("y") + step).alias("y1"))
    return g.where(F.col("y1") - F.col("y0") >= size).select(*KEY, (F.col("c") * size).cast("int").alias("x"), "y0", "y1")


def nearest_center(runs: DataFrame, centers: DataFrame) -> DataFrame:
    """(page_id, region_seq, center, area, l, t, r, b): each mask split among its centres (center, cx, cy) by distance, the lower number on ties.

    The run, not the pixel, is the unit of the join; within a run the nearest
    centres are found by numpy in one pass.
    """
    import pandas as pd

    c = centers.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("center", "cx", "cy"))).alias("cs"))  # a few a mask
    j = joined(runs).join(c, list(KEY)).select(*KEY, "y", "x0", "x1", "cs")

    def split(it):
        for pdf in it:
            out = []
            for p, s, y, x0, x1, cs in pdf.itertuples(index=False):
                xs = np.arange(x0, x1)
                d = np.stack([(xs - k["cx"]) ** 2 + (y - k["cy"]) ** 2 for k in cs])
                who = np.argmin(d, axis=0)
                edge = np.flatnonzero(np.diff(who)) + 1
                for a, b in zip([0, *edge], [*edge, len(xs)], strict=True):
                    out.append((p, s, int(cs[who[a]]["center"]), int(y), int(xs[a]), int(xs[b - 1]) + 1))
            yield pd.DataFrame(out, columns=["page_id", "region_seq", "center", "y", "x0", "x1"])

    r = j.mapInPandas(split, "page_id string, region_seq int, center int, y int, x0 int, x1 int")
    return r.groupBy(*KEY, "center").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("l"), F.min("y").alias("t"), F.max("x1").alias("r"), (F.max("y") + 1).alias("b"))


def label_runs(runs: DataFrame, step: int = 1) -> DataFrame:
    """(page_id, region_seq, component, l, t, r, b, area): 8-connected components of each mask; runs on neighbouring lines that touch, also by a corner, are one.

    A mask is a bounded group (a region's lines); its runs are swept line by line.
    """

    def label(page: str, seq: int, rows: list[tuple]) -> list[tuple]:
        rs = sorted(x[1:] for x in rows)  # y, x0, x1
        sets = Sets(len(rs))
        by_line: dict[int, list[int]] = {}
        for i, x in enumerate(rs):
            by_line.setdefault(x[0], []).append(i)
        for y, here in by_line.items():
            above, k = by_line.get(y - step, []), 0
            for i in here:
                while k < len(above) and rs[above[k]][2] < rs[i][1]:
                    k += 1
                m = k
                while m < len(above) and rs[above[m]][1] <= rs[i][2]:
                    sets.join(above[m], i)
                    m += 1
        out = []
        for n, g in enumerate(sets.groups()):
            out.append((page, seq, n, min(rs[i][1] for i in g), min(rs[i][0] for i in g), max(rs[i][2] for i in g), max(rs[i][0] for i in g) + 1, sum(rs[i][2] - rs[i][1] for i in g)))
        return out

    return by_key(joined(runs), "region_seq", label, "page_id string, region_seq int, component int, l int, t int, r int, b int, area int", ("region_seq", "y", "x0", "x1"))
