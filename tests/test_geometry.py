"""Literal cases and brute force for box geometry, joins and groupings."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import geometry as G
from inkgrid.functions.geometry import Box
from inkgrid.operators import spatial as S

COLS = "page_id string, region_seq int, l int, t int, r int, b int, det double, extra string"


def frame(spark, boxes, page="p"):
    return spark.createDataFrame([(page, i, *b, d, "x") for i, (b, d) in enumerate(boxes)], COLS)


def plain(*boxes):
    return [(b, 1.0) for b in boxes]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_expand_and_clip(spark):
    e = G.expand(Box(*map(F.lit, (20, 30, 50, 60))), 12, F.lit(100), F.lit(100))
    assert one(spark, F.array(e.l, e.t, e.r, e.b)) == [8, 18, 62, 72]
    e = G.expand(Box(*map(F.lit, (1, 2, 99, 98))), 12, F.lit(100), F.lit(100))
    assert one(spark, F.array(e.l, e.t, e.r, e.b)) == [0, 0, 100, 100]
    assert tuple(one(spark, G.clip(F.lit(0.5), F.lit(1.5), F.lit(9.5), F.lit(200.0), F.lit(100), F.lit(100)))) == (0, 2, 10, 100)
    assert one(spark, G.clip(F.lit(120.0), F.lit(1.0), F.lit(130.0), F.lit(9.0), F.lit(100), F.lit(100))) is None


def test_iou_of_empty_boxes_and_dilation(spark):
    z = Box(*map(F.lit, (5, 5, 5, 5)))
    assert one(spark, G.iou(z, z)) == 0.0
    assert one(spark, G.interval_overlap_ratio(F.lit(1), F.lit(1), F.lit(0), F.lit(4))) is None
    assert one(spark, G.geometric_dilation(Box(*map(F.lit, (0, 0, 100, 200))), F.lit(1200), F.lit(1800), 1)) == 7


@pytest.mark.parametrize("box,text,want", [((0, 0, 300, 60), "", True), ((0, 0, 50, 150), "", False), ((0, 0, 100, 100), "", False), ((0, 0, 40, 140), "Hello", True), ((0, 0, 40, 140), "縦書き", False)])
def test_direction(spark, box, text, want):
    assert one(spark, G.runs_horizontal(Box(*map(F.lit, box)), F.lit(text), F.lit(False))) is want


def test_side_by_side_of_a_long_strip(spark):
    z = lambda *a: tuple(one(spark, G.side_by_side(*map(F.lit, a))))
    assert z(900, 24_000_200, 900, 1200) == (900, 18_000_150, 18_001_050, 24_000_200)
    assert z(1600, 600, 900, 1200) == (3200, 900, 4100, 1200)


def test_reading_order(spark):
    got = S.reading_order(frame(spark, plain((50, 15, 150, 105), (100, 300, 250, 400), (200, 10, 300, 100)))).orderBy("rank").collect()
    assert [r["region_seq"] for r in got] == [2, 0, 1]


def test_annotations(spark):
    keep = lambda *b: sorted(r["region_seq"] for r in S.without_annotations(frame(spark, plain(*b))).collect())
    assert keep((100, 50, 200, 70), (100, 72, 200, 152)) == [1]
    assert keep((50, 50, 150, 150), (160, 50, 260, 150)) == [0, 1]
    assert keep((300, 50, 400, 70), (100, 72, 200, 152)) == [0, 1]


def test_render_bounds_fixture(spark):
    df = frame(spark, plain((50, 50, 120, 250), (120, 50, 180, 250))).select("page_id", "region_seq", "l", "t", "r", "b", F.lit(0).alias("ll"), F.lit(0).alias("lt"), F.lit(250).alias("lr"), F.lit(300).alias("lb"))
    got = [tuple(r)[2:] for r in S.render_bounds(df).orderBy("region_seq").collect()]
    assert got == [(0, 0, 120, 300), (120, 0, 250, 300)]


def test_padded_clusters(spark):
    pages = spark.createDataFrame([("p", 100, 100)], "page_id string, width int, height int")
    c = lambda m, *b: sorted(tuple(r)[1:] for r in S.padded_clusters(frame(spark, plain(*b)), pages, m).collect())
    assert c(10, (10, 10, 20, 20), (25, 25, 35, 35)) == [(0, 0, 45, 45, 2)]
    assert len(c(5, (10, 10, 20, 20), (80, 80, 90, 90))) == 2


def test_containment(spark):
    for thr in (1.0, 0.5):
        got = S.resolve_overlaps(frame(spark, plain((30, 40, 100, 120), (0, 0, 200, 300))), thr).collect()
        assert [tuple(r)[2:] for r in got] == [(0, 0, 200, 300)]


def boxes(seed, n=60, height=400):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        l, t = rnd.randint(0, 300), rnd.randint(0, height)  # noqa: E741
        out.append(((l, t, l + rnd.randint(1, 120), t + rnd.randint(1, 300 if rnd.random() < 0.1 else 60)), rnd.choice([0.5, 0.7, 0.9])))
    return out


def iou(a, b):
    return S._iou(a, b)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_groups_against_brute_force(spark, seed):
    bs = boxes(seed, 60, 1500)
    df = frame(spark, bs)
    raw = [b for b, _ in bs]
    gap = lambda a, b: (max(0, max(a[0], b[0]) - min(a[2], b[2])), max(0, max(a[1], b[1]) - min(a[3], b[3])))
    want = {(i, j) for i, j in itertools.combinations(range(len(raw)), 2) if max(gap(raw[i], raw[j])) <= 9}
    got = S.near_pairs(df, 9, size=64).select("a_region_seq", "b_region_seq").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    kept, order = [], sorted(range(len(raw)), key=lambda i: (-bs[i][1], i))
    for i in order:
        if all(iou(raw[i], raw[k]) < 0.3 for k in kept):
            kept.append(i)
    assert sorted(r["region_seq"] for r in S.non_maximum_suppression(df, 0.3).collect()) == sorted(kept)
    comp = list(range(len(raw)))
    for _ in comp:
        for i, j in want:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert {r["region_seq"]: r["cluster"] for r in S.clusters(df, 9, 9).collect()} == dict(enumerate(comp))
    edges = S.near_pairs(df, 9).select("page_id", F.col("a_region_seq").alias("a"), F.col("b_region_seq").alias("b"))
    assert {r["region_seq"]: r["component"] for r in S.components(edges, df).collect()} == dict(enumerate(comp))
    assert S.overlap_pairs(S.resolve_overlaps(df, 0.35)).count() == 0


def test_nulls_empty_and_repeats(spark):
    df = spark.createDataFrame([("p", 1, 0, 0, 9, 9, 0.5, "x"), ("p", 1, 0, 0, 9, 9, 0.5, "x"), (None, 2, 0, 0, 9, 9, 0.5, "x"), ("p", 3, None, 0, 9, 9, None, "x"), ("p", 4, 5, 5, 9, 9, None, None)], COLS)
    assert S.near_pairs(df, 0).count() == 1
    assert S.reading_order(df).count() == 2
    assert S.without_annotations(df).count() == 5
    e = df.where("false")
    assert S.near_pairs(e).count() == S.reading_order(e).count() == S.clusters(e, 1, 1).count() == S.resolve_overlaps(e.fillna(0)).count() == 0


def strip(spark, n):
    """One page with all rows: boxes that overlap each other's scan lines from top to bottom, without a gap."""
    i = F.col("id")
    return spark.range(n, numPartitions=8).select(F.lit("strip").alias("page_id"), i.cast("int").alias("region_seq"), (i % 7 * 100).cast("int").alias("l"), (i * 30).cast("int").alias("t"), (i % 7 * 100 + 90).cast("int").alias("r"), (i * 30 + 40).cast("int").alias("b"), (i % 10 / 10).alias("det"))


def test_hot_page(spark):
    """A page with most of the rows: the band join makes few pairs."""
    n = 4000
    df = strip(spark, n)
    assert S.near_pairs(df, 5).count() == 0
    assert S.reading_order(df).agg(F.max("rank")).first()[0] == n


def test_no_task_holds_a_hot_page(spark):
    """A page of 100,000 boxes in one strip: groups of a chunk's size, and results of all rows."""
    n = 100_000
    df = strip(spark, n)
    held = df.withColumn("_at", F.explode(S._bands(F.col("t"), F.col("b") + 1, S.CHUNK)))
    sizes = S.by_key(held, "_at", lambda page, _k, rows: [(page, len(rows))], "page_id string, n int", ("region_seq", "t"))
    got = sizes.agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert got[0] <= 200 and got[1] >= n * 30 // S.CHUNK and got[2] >= n
    order = S.reading_order(df).cache()
    assert order.count() == n and order.agg(F.countDistinct("rank"), F.max("rank")).first()[:] == (n, n)
    assert S.clusters(df, 4, 4).where("cluster <> region_seq").count() == 0
    assert S.non_maximum_suppression(df, 0.3).count() == n
    assert S.resolve_overlaps(df, 0.35).count() == n


def rows_by_one_sweep(boxes):
    """(seq -> rank) of the reading order, all boxes of a page in one loop."""
    state, placed = [], []
    items = sorted(((i, *b) for i, b in enumerate(boxes)), key=lambda x: x[2])
    for x, row in zip(items, S._sweep_rows(state, items), strict=True):
        placed.append((row, -x[3], -x[1], x[2], x[0]))
    return {x[4]: k for k, x in enumerate(sorted(placed), 1)}


@pytest.mark.parametrize("seed,size,lead", [(1, 64, 0), (2, 64, 32), (3, 128, 500), (4, 40, 7), (5, 4096, 2048)])
def test_chunked_order_is_that_of_one_sweep(spark, seed, size, lead):
    """Chunks much lower than the boxes are tall, so that rows stay open over several of them."""
    bs = [b for b, _ in boxes(seed, 120, 1200)]
    got = {r["region_seq"]: r["rank"] for r in S.reading_order(frame(spark, plain(*bs)), size, lead).collect()}
    assert got == rows_by_one_sweep(bs)


@pytest.mark.parametrize("size", [16, 100, 5000])
def test_groups_over_chunk_borders(spark, size):
    bs = [b for b, _ in boxes(8, 120, 1500)]
    link = S._within(3, 3)
    comp = list(range(len(bs)))
    for _ in comp:
        for i, j in itertools.combinations(range(len(bs)), 2):
            if link((i, *bs[i]), (j, *bs[j])):
                comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r["region_seq"]: r["grp"] >> 24 for r in S.linked_groups(frame(spark, plain(*bs)), link, 3, size=size).collect()}
    assert got == dict(enumerate(comp))


def test_components_of_a_long_path(spark):
    n = 300
    e = spark.range(n).select(F.lit("p").alias("page_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = S.components(e).agg(F.max("component"), F.count("*")).first()
    assert got[:] == (0, n + 1)
    assert S.components(e.where("false")).count() == 0


def test_salted_join_splits_a_hot_key(spark):
    from inkgrid.operators.skew import hot_keys, salted_join

    rows = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), F.lit("x").alias("_salt2"))
    side = rows.where("key is not null").select("key", F.upper("key").alias("up")).distinct()
    assert [r["key"] for r in hot_keys(rows, "key", 8).collect()] == ["hot"]
    for how in ("left", "inner"):
        got = {tuple(r) for r in salted_join(rows, side, "key", rows, F.col("id"), how, 8).select("id", "up").collect()}
        assert got == {tuple(r) for r in rows.join(side, "key", how).select("id", "up").collect()}
    assert salted_join(rows.where("false"), side, "key", rows.where("false"), F.col("id")).count() == 0
