"""Joins and groupings of boxes on pages.

Pages are no safe unit of work: one page may hold a tenth of all rows. Pair
operators therefore join on (page, horizontal band), where a box is listed in
every band it touches and a pair is reported in the first band both touch.
Groupings work on chunks of a page: links are found within chunks, groups that
a box on a border belongs to are joined as a graph of chunk groups. The
reading order is a sweep over chunks, each begun a little early; where a chunk
and the one before it don't agree on what is open between them, it is swept
again. No task holds more of a page than a chunk, or than one group of boxes
that depend on each other.

Input: columns page_id, region_seq, l, t, r, b (and what an operator names).
Keys that are null match nothing and rows with a null box are left out of
pair operators. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import geometry as G
from inkgrid.functions.geometry import Box

BAND = 256  # pixels
CHUNK = 4096  # pixels of a page that one task sweeps at a time
LEAD = 2048  # pixels above a chunk where its sweep begins
KEY = ("page_id", "region_seq")


def _bands(top: Column, bottom: Column, size: int) -> Column:
    lo = F.floor(top / size).cast("long")
    hi = F.floor((F.greatest(bottom, top + 1) - 1) / size).cast("long")
    return F.sequence(lo, F.greatest(lo, hi))


def boxes_only(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*KEY, "l", "t", "r", "b", *more).where("page_id is not null and l is not null and t is not null and r is not null and b is not null")


def near_pairs(boxes: DataFrame, margin: int = 0, ordered: bool = False, more: tuple[str, ...] = (), size: int = BAND) -> DataFrame:
    """Pairs of boxes of one page whose gaps along both axes are at most ``margin`` (touching counts).

    Columns are those of the boxes with prefixes ``a_`` and ``b_``; each
    unordered pair comes once (a before b by region_seq), or both ways round
    with ``ordered``.
    """
    x = boxes_only(boxes, *more).dropDuplicates(list(KEY))
    wide = x.withColumn("band", F.explode(_bands(F.col("t") - margin, F.col("b") + margin + 1, size)))
    a = wide.select(F.col("page_id"), "band", *[F.col(c).alias(f"a_{c}") for c in ("region_seq", "l", "t", "r", "b", *more)])
    b = wide.select(F.col("page_id"), "band", *[F.col(c).alias(f"b_{c}") for c in ("region_seq", "l", "t", "r", "b", *more)])
    first = lambda p: F.floor((F.col(f"{p}t") - margin) / size).cast("long")
    A, B = Box.of("a_"), Box.of("b_")
    order = F.col("a_region_seq") != F.col("b_region_seq") if ordered else F.col("a_region_seq") < F.col("b_region_seq")
    close = (A.l - B.r <= margin) & (B.l - A.r <= margin) & (A.t - B.b <= margin) & (B.t - A.b <= margin)
    j = a.join(b, ["page_id", "band"]).where(order & close & (F.col("band") == F.greatest(first("a_"), first("b_"))))
    return j.drop("band")


def overlap_pairs(boxes: DataFrame, ordered: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with positive-area overlap."""
    return near_pairs(boxes, 0, ordered, more).where(G.overlaps(Box.of("a_"), Box.of("b_")))


def best_match(texts: DataFrame, segments: DataFrame, runs: DataFrame | None = None, least: float = 0.1, size: int = BAND) -> DataFrame:
    """(page_id, region_seq, match_seq, iou): for each text box the segment whose mask covers its centre or whose IoU is at least ``least``; the largest IoU wins, then the lower segment number.

    Text boxes without a match keep a null match. ``runs`` are mask runs
    (page_id, region_seq, y, x0, x1) of the segments.
    """
    t = boxes_only(texts).select("page_id", *[F.col(c).alias(f"a_{c}") for c in ("region_seq", "l", "t", "r", "b")])
    s = boxes_only(segments).select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("region_seq", "l", "t", "r", "b")])
    A, B = Box.of("a_"), Box.of("b_")
    ta = t.withColumn("band", F.explode(_bands(A.t, A.b, size)))
    sb = s.withColumn("band", F.explode(_bands(B.t, B.b, size)))
    first = F.greatest(F.floor(A.t / size), F.floor(B.t / size)).cast("long")
    by_iou = ta.join(sb, ["page_id", "band"]).where(G.overlaps(A, B) & (F.col("band") == first)).withColumn("iou", G.iou(A, B)).where(F.col("iou") >= least)
    hits = by_iou.select("page_id", "a_region_seq", "b_region_seq", "iou")
    if runs is not None:
        centre = t.select("page_id", "a_region_seq", F.floor((A.t + A.b) / 2).cast("int").alias("y"), F.floor((A.l + A.r) / 2).cast("int").alias("x"), *[f"a_{c}" for c in "ltrb"])
        q = runs.select("page_id", F.col("region_seq").alias("b_region_seq"), "y", "x0", "x1")
        inside = centre.join(q, ["page_id", "y"]).where("x >= x0 and x < x1").join(s, ["page_id", "b_region_seq"])
        hits = hits.unionByName(inside.select("page_id", "a_region_seq", "b_region_seq", G.iou(A, B).alias("iou"))).distinct()
    best = hits.groupBy("page_id", "a_region_seq").agg(F.max(F.struct("iou", (-F.col("b_region_seq")).alias("n"))).alias("m"))
    best = best.select("page_id", F.col("a_region_seq").alias("region_seq"), (-F.col("m.n")).alias("match_seq"), F.col("m.iou").alias("iou"))
    return texts.select(*KEY).join(best, list(KEY), "left")


def unmatched(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """Segments that no text box was matched to."""
    return segments.select(*KEY).join(matches.select("page_id", F.col("match_seq").alias("region_seq")), list(KEY), "left_anti")


def skipped(all_regions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Regions that are no candidates, by key."""
    return all_regions.select(*KEY).distinct().join(candidates.select(*KEY), list(KEY), "left_anti")


def touches(left: DataFrame, right: DataFrame, size: int = BAND) -> DataFrame:
    """(page_id, region_seq, touched): whether each box of ``left`` overlaps any box of ``right``."""
    a = boxes_only(left).select("page_id", *[F.col(c).alias(f"a_{c}") for c in ("region_seq", "l", "t", "r", "b")])
    b = boxes_only(right).select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("region_seq", "l", "t", "r", "b")])
    A, B = Box.of("a_"), Box.of("b_")
    hit = (
        a.withColumn("band", F.explode(_bands(A.t, A.b, size)))
        .join(b.withColumn("band", F.explode(_bands(B.t, B.b, size))), ["page_id", "band"])
        .where(G.overlaps(A, B))
        .select("page_id", F.col("a_region_seq").alias("region_seq"))
        .distinct()
        .withColumn("touched", F.lit(True))
    )
    return left.select(*KEY).join(hit, list(KEY), "left").select(*KEY, F.coalesce("touched", F.lit(False)).alias("touched"))


def without_annotations(boxes: DataFrame, size: int = BAND) -> DataFrame:
    """Drop small boxes that sit right above a much taller one (reading aids).

    Box i goes if some j has h_i < 0.40 h_j, t_j within half of h_i of b_i, and
    an x overlap of at least half of w_i. The ratios are compared in integers.
    Only i is listed in the bands around its bottom; j is listed once, at its top.
    """
    x = boxes_only(boxes).dropDuplicates(list(KEY))
    A, B = Box.of("a_"), Box.of("b_")
    a = x.select("page_id", *[F.col(c).alias(f"a_{c}") for c in ("region_seq", "l", "t", "r", "b")]).where((A.w > 0) & (A.h > 0))
    b = x.select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("region_seq", "l", "t", "r", "b")]).where(B.h > 0)
    lo, hi = F.floor((2 * A.b - A.h) / (2 * size)).cast("long"), F.floor((2 * A.b + A.h) / (2 * size)).cast("long")
    gap2 = 2 * (B.t - A.b)
    near = (
        a.withColumn("band", F.explode(F.sequence(lo, hi)))
        .join(b.withColumn("band", F.floor(B.t / size).cast("long")), ["page_id", "band"])
        .where((F.col("a_region_seq") != F.col("b_region_seq")) & (5 * A.h < 2 * B.h) & (gap2 >= -A.h) & (gap2 <= A.h) & (2 * G.overlap_x(A, B) >= A.w))
        .select("page_id", F.col("a_region_seq").alias("region_seq"))
        .distinct()
    )
    return boxes.join(near, list(KEY), "left_anti")


def render_bounds(boxes: DataFrame, size: int = BAND) -> DataFrame:
    """(page_id, region_seq, l, t, r, b): the space each region may be set in, kept apart from all other regions of its page at midpoints.

    Input has layout columns ll, lt, lr, lb (null where there is none). A side
    starts at the layout box and is drawn in by every other region the two are
    separated from along that axis. Only regions near the box matter, but for
    one case: regions far above or below, with no x overlap, separate along x
    if the x gap is the smaller one. For those a profile of the page by left
    and by right edge (at most as many rows as the page is wide) tells whether
    one is far enough.
    """
    x = boxes_only(boxes, "ll", "lt", "lr", "lb").dropDuplicates(list(KEY))
    lim = lambda f, a, b: f(F.coalesce(F.col(b), F.col(a)), F.col(a))
    x = x.select(*KEY, "l", "t", "r", "b", lim(F.least, "l", "ll").alias("xl"), lim(F.least, "t", "lt").alias("xt"), lim(F.greatest, "r", "lr").alias("xr"), lim(F.greatest, "b", "lb").alias("xb"))
    # a region draws a side in only from within twice the space between box and limit
    up, down = 2 * (F.col("t") - F.col("xt")) + 1, 2 * (F.col("xb") - F.col("b")) + 1
    i = x.select("page_id", *[F.col(c).alias(f"a_{c}") for c in ("region_seq", "l", "t", "r", "b", "xl", "xt", "xr", "xb")], F.explode(_bands(F.col("t") - up, F.col("b") + down, size)).alias("band"), F.floor((F.col("t") - up) / size).cast("long").alias("a_first"))
    j = x.select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("region_seq", "l", "t", "r", "b")], F.explode(_bands(F.col("t"), F.col("b"), size)).alias("band"), F.floor(F.col("t") / size).cast("long").alias("b_first"))
    A, B = Box.of("a_"), Box.of("b_")
    p = i.join(j, ["page_id", "band"]).where((F.col("a_region_seq") != F.col("b_region_seq")) & (F.col("band") == F.greatest("a_first", "b_first")))
    vo, ho = G.overlap_y(A, B), G.overlap_x(A, B)
    gx, gy = G.interval_gap(A.l, A.r, B.l, B.r), G.interval_gap(A.t, A.b, B.t, B.b)
    both = (vo > 0) & (ho > 0)
    apart_x = ~both & ((vo > 0) | ((ho == 0) & (gx <= gy)))
    xs, ys = F.floor((F.greatest(A.l, B.l) + F.least(A.r, B.r)) / 2), F.floor((F.greatest(A.t, B.t) + F.least(A.b, B.b)) / 2)
    left_of, above = (A.l + A.r) < (B.l + B.r), (A.t + A.b) < (B.t + B.b)
    side_x, side_y = both & (vo >= ho), both & (vo < ho)
    r_cap = F.when(side_x & left_of, xs).when(apart_x & (A.r <= B.l), F.floor((A.r + B.l) / 2))
    l_cap = F.when(side_x & ~left_of, xs).when(apart_x & ~(A.r <= B.l) & (B.r <= A.l), F.floor((B.r + A.l) / 2))
    b_cap = F.when(side_y & above, ys).when(~both & ~apart_x & (A.b <= B.t), F.floor((A.b + B.t) / 2))
    t_cap = F.when(side_y & ~above, ys).when(~both & ~apart_x & ~(A.b <= B.t) & (B.b <= A.t), F.floor((B.b + A.t) / 2))
    near = p.groupBy("page_id", F.col("a_region_seq").alias("region_seq")).agg(F.min(r_cap).alias("r1"), F.max(l_cap).alias("l1"), F.min(b_cap).alias("b1"), F.max(t_cap).alias("t1"))
    # far regions: by left edge (and by right edge) of the page, the lowest top and the highest bottom
    left_edge = x.groupBy("page_id", F.col("l").alias("e")).agg(F.max("t").alias("mt"), F.min("b").alias("mb"))
    right_edge = x.groupBy("page_id", F.col("r").alias("e")).agg(F.max("t").alias("mt"), F.min("b").alias("mb"))
    far_y = F.greatest(F.col("mt") - F.col("b"), F.col("t") - F.col("mb"), F.lit(-1))
    right = x.where("xr > r").withColumn("e", F.explode(F.sequence(F.col("r"), 2 * F.col("xr") - F.col("r") + 1))).join(left_edge, ["page_id", "e"])
    right = right.where((F.col("e") - F.col("r") <= far_y)).groupBy(*KEY).agg(F.min(F.floor((F.col("r") + F.col("e")) / 2)).alias("r2"))
    left = x.where("xl < l").withColumn("e", F.explode(F.sequence(2 * F.col("xl") - F.col("l") - 1, F.col("l")))).join(right_edge, ["page_id", "e"])
    left = left.where((F.col("l") - F.col("e") <= far_y) & (F.col("e") > F.col("l") - 2 * (F.col("l") - F.col("xl")) - 2)).groupBy(*KEY).agg(F.max(F.floor((F.col("e") + F.col("l")) / 2)).alias("l2"))
    out = x.join(near, list(KEY), "left").join(right, list(KEY), "left").join(left, list(KEY), "left")
    return out.select(
        *KEY,
        F.least("l", F.greatest("xl", "l1", "l2")).cast("int").alias("l"),
        F.least("t", F.greatest("xt", "t1")).cast("int").alias("t"),
        F.greatest("r", F.least("xr", "r1", "r2")).cast("int").alias("r"),
        F.greatest("b", F.least("xb", "b1")).cast("int").alias("b"),
    )


# --- groups --------------------------------------------------------------------------------------


def by_key(rows: DataFrame, key: str, fn: Callable[[str, int, list[tuple]], list[tuple]], schema: str, columns: tuple[str, ...]) -> DataFrame:
    """Apply ``fn(page_id, key, rows)`` to the rows (tuples of ``columns``, by region_seq) of each page and key.

    Rows are shuffled by both and sorted; a task then runs through its groups
    one after another and holds one at a time.
    """
    x = rows.select("page_id", F.col(key).cast("long").alias("_key"), *columns)
    x = x.repartition("page_id", "_key").sortWithinPartitions("page_id", "_key", "region_seq")
    to = from_ddl(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != group:
                    if held:
                        out.extend(fn(*group, held))
                    group, held = row[:2], []
                held.append(row[2:])
            if len(out) > 10000:
                yield _record_batch(out, to)
                out = []
        if held:
            out.extend(fn(*group, held))
        if out:
            yield _record_batch(out, to)

    return x.mapInArrow(run, schema)


def linked_groups(boxes: DataFrame, link: Callable[[tuple, tuple], bool], reach: int = 0, more: tuple[str, ...] = (), size: int = CHUNK, grow: bool = False) -> DataFrame:
    """Rows page_id, region_seq, l, t, r, b, ``more`` and ``grp``: boxes of a page with one number for all that links join, directly or through others.

    ``link(a, b)`` is asked of tuples (region_seq, l, t, r, b, *more) of boxes
    whose y gap is at most ``reach``. A box is listed in every chunk it
    reaches; each chunk joins its own boxes; boxes in several chunks then join
    the groups of those, which takes a graph of the groups at borders only.
    ``grp >> 24`` is the lowest region_seq of the group. With ``grow``, groups
    of a chunk whose hulls overlap are joined too, until none do.
    """
    from inkgrid.session import cut_lineage

    cols = ("region_seq", "l", "t", "r", "b", *more)
    x = boxes_only(boxes, *more).dropDuplicates(list(KEY))
    x = x.withColumn("_chunks", _bands(F.col("t") - reach, F.col("b") + reach + 1, size))
    x = x.withColumn("_at", F.explode("_chunks")).withColumn("_many", F.size("_chunks")).withColumn("_home", F.col("_chunks")[0] == F.col("_at"))
    kinds = dict(x.dtypes)
    schema = "page_id string, " + ", ".join(f"{c} {'long' if kinds[c] == 'bigint' else kinds[c]}" for c in cols) + ", cid long, home boolean, many int, at long, alone boolean"

    def local(page: str, at: int, rows: list[tuple]) -> list[tuple]:
        sets = Sets(len(rows))
        for i, j in sweep([x[2] for x in rows], [x[4] for x in rows], reach):
            if link(rows[i], rows[j]):
                sets.join(i, j)
        while grow:
            groups = sets.groups()
            hulls = [[min(rows[k][1] for k in g), min(rows[k][2] for k in g), max(rows[k][3] for k in g), max(rows[k][4] for k in g)] for g in groups]
            met = [(i, j) for i, j in sweep([h[1] for h in hulls], [h[3] for h in hulls]) if max(hulls[i][0], hulls[j][0]) < min(hulls[i][2], hulls[j][2]) and max(hulls[i][1], hulls[j][1]) < min(hulls[i][3], hulls[j][3])]
            for i, j in met:
                sets.join(groups[i][0], groups[j][0])
            if not met:
                break
        held = Counter(sets.find(i) for i in range(len(rows)))
        return [(page, *x[: len(cols)], (rows[sets.find(i)][0] << 24) + (at & 0xFFFFFF), x[-2], x[-1], at, held[sets.find(i)] == 1) for i, x in enumerate(rows)]

    found = cut_lineage(by_key(x, "_at", local, schema, (*cols, "_home", "_many")))
    w = Window.partitionBy(*KEY).orderBy("at")  # a row a chunk that a box reaches
    border = found.where("many > 1").withColumn("linked", F.max(~F.col("alone")).over(Window.partitionBy(*KEY)))  # boxes without a link anywhere join nothing
    edges = border.where("linked").select("page_id", F.lag("cid").over(w).alias("a"), F.col("cid").alias("b")).where("a is not null").distinct()
    joined = components(edges).select("page_id", F.col("region_seq").alias("cid"), "component")
    return found.where("home").join(joined, ["page_id", "cid"], "left").select("page_id", *cols, F.coalesce("component", "cid").alias("grp"))


def from_ddl(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.strip().split() for c in schema.split(","))])


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def sweep(tops: list[int], bottoms: list[int], margin: int = 0) -> Iterable[tuple[int, int]]:
    """Pairs of indices whose y gap is at most ``margin``, found by a sweep from the top."""
    order = sorted(range(len(tops)), key=lambda i: tops[i])
    active: list[tuple[int, int]] = []
    for i in order:
        while active and active[0][0] < tops[i] - margin:
            heapq.heappop(active)
        for _, j in active:
            yield (i, j) if i < j else (j, i)
        heapq.heappush(active, (bottoms[i], i))


class Sets:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self, of: Iterable[int] | None = None) -> list[list[int]]:
        """Groups in the order of their first members."""
        out: dict[int, list[int]] = {}
        for i in range(len(self.up)) if of is None else of:
            out.setdefault(self.find(i), []).append(i)
        return list(out.values())


def _sweep_rows(open_rows: list[list[int]], boxes: list[tuple]) -> list[tuple[int, int]]:
    """The row of each box (seq, l, t, r, b), by the top and number of the box that opened it; ``open_rows`` [top, bottom, opener's top, number] is carried on."""
    out = []
    for seq, _l, t, _r, b in boxes:
        open_rows[:] = [x for x in open_rows if x[1] > t]
        h = max(1, b - t)
        for x in open_rows:
            lap = min(b, x[1]) - max(t, x[0])
            if lap > 0 and 5 * lap >= 2 * min(h, max(1, x[1] - x[0])):
                x[0], x[1] = min(x[0], t), max(x[1], b)
                break
        else:
            x = [t, b, t, seq]
            open_rows.append(x)
        out.append((x[2], x[3]))
    return out


_ROWS = "array<struct<t:int,b:int,ot:int,os:int>>"
_ROWS_ARROW = pa.list_(pa.struct([(c, pa.int32()) for c in ("t", "b", "ot", "os")]))
_SWEPT = f"page_id string, at long, region_seq int, l int, t int, r int, b int, ot int, os int, before {_ROWS}, after {_ROWS}"


def reading_order(boxes: DataFrame, size: int = CHUNK, lead: int = LEAD) -> DataFrame:
    """(page_id, region_seq, rank): rows from the top, within a row from the right.

    Boxes come by their top (ties by region_seq); each joins the first row whose
    growing extent it overlaps by at least 0.4 of the lesser height, or opens a
    row. Rows the sweep has passed can't take any more boxes and are dropped
    from the search. Each chunk of a page is swept by itself, begun ``lead``
    pixels above it; the rows it finds open at its top must be those that the
    chunk before leaves open. Chunks where they aren't are swept again from
    what was left open, until all agree: the result is that of one sweep.
    """
    from inkgrid.session import cut_lineage

    x = boxes_only(boxes).dropDuplicates(list(KEY)).withColumn("home", F.floor(F.col("t") / size).cast("long"))

    def swept(rows: DataFrame, begun: DataFrame | None) -> DataFrame:
        """Boxes with their rows, and for each chunk a line with the rows open before and after it."""
        if begun is None:
            wide = rows.withColumn("at", F.explode(F.sequence(F.col("home"), F.floor((F.col("t") + lead) / size).cast("long")))).withColumn("begun", F.lit(None).cast(_ROWS))
        else:
            wide = rows.withColumn("at", F.col("home")).join(begun, ["page_id", "at"])
        wide = wide.select("page_id", "at", "region_seq", "l", "t", "r", "b", "home", "begun").repartition("page_id", "at").sortWithinPartitions("page_id", "at", "t", "region_seq")

        def chunk(page: str, at: int, held: list[tuple], out: list[list]) -> None:
            early, own = [x for x in held if x[5] < at], [x for x in held if x[5] == at]
            if not own:
                return
            state = [[x[c] for c in ("t", "b", "ot", "os")] for x in held[0][6] or ()]
            _sweep_rows(state, [x[:5] for x in early])
            top, end = at * size, (at + 1) * size
            before = [dict(zip(("t", "b", "ot", "os"), x, strict=True)) for x in state if x[1] > top]
            for x, row in zip(own, _sweep_rows(state, [x[:5] for x in own]), strict=True):
                out.append([page, at, *x[:5], *row, None, None])
            out.append([page, at, *[None] * 7, before, [dict(zip(("t", "b", "ot", "os"), x, strict=True)) for x in state if x[1] > end]])

        types = [pa.string(), pa.int64(), *[pa.int32()] * 7, _ROWS_ARROW, _ROWS_ARROW]
        names = ["page_id", "at", "region_seq", "l", "t", "r", "b", "ot", "os", "before", "after"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, out = None, [], []
            make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[:2] != key:
                        if held:
                            chunk(*key, held, out)
                        key, held = row[:2], []
                    held.append(row[2:])
                if len(out) > 10000:
                    yield make()
                    out = []
            if held:
                chunk(*key, held, out)
            if out:
                yield make()

        return wide.mapInArrow(run, _SWEPT)

    done = cut_lineage(swept(x, None))
    w = Window.partitionBy("page_id").orderBy("at")  # a line a chunk
    while True:
        left = F.filter(F.coalesce(F.lag("after").over(w), F.array().cast(_ROWS)), lambda o: o["b"] > F.col("at") * size)
        lines = done.where("region_seq is null").select("page_id", "at", "before", left.alias("begun"))
        wrong = lines.where(F.col("before") != F.col("begun")).select("page_id", "at", "begun")
        if wrong.isEmpty():
            break
        wrong = cut_lineage(wrong)
        done = cut_lineage(done.join(wrong.select("page_id", "at"), ["page_id", "at"], "left_anti").unionByName(swept(x, wrong)))
    rows = done.where("region_seq is not null").withColumn("part", F.floor(F.col("ot") / size).cast("long"))
    sizes = rows.groupBy("page_id", "part").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("page_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = F.row_number().over(Window.partitionBy("page_id", "part").orderBy("ot", "os", F.col("r").desc(), F.col("l").desc(), "t", "region_seq"))
    return rows.withColumn("k", k).join(sizes.select("page_id", "part", above.alias("above")), ["page_id", "part"]).select(*KEY, (F.col("above") + F.col("k")).alias("rank"))


def non_maximum_suppression(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, region_seq): boxes kept when taken by falling confidence (column ``det``; ties by region_seq), each unless its IoU with a kept one reaches the threshold.

    A choice depends only on boxes that such overlaps lead to, so each group
    of them is handled by itself.
    """

    def keep(page: str, _grp: int, rows: list[tuple]) -> list[tuple]:
        near: dict[int, list[int]] = {}
        for i, j in sweep([x[2] for x in rows], [x[4] for x in rows]):
            if _iou(rows[i][1:5], rows[j][1:5]) >= threshold:
                near.setdefault(i, []).append(j)
                near.setdefault(j, []).append(i)
        gone, kept = set(), []
        for i in sorted(range(len(rows)), key=lambda i: (-rows[i][5], i)):
            if i not in gone:
                kept.append((page, rows[i][0]))
                gone.update(near.get(i, ()))
        return kept

    groups = linked_groups(boxes, lambda a, b: _iou(a[1:5], b[1:5]) >= threshold, more=("det",))
    return by_key(groups, "grp", keep, "page_id string, region_seq int", ("region_seq", "l", "t", "r", "b", "det"))


def _iou(a: tuple, b: tuple) -> float:
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def _within(gap_x: int, gap_y: int) -> Callable[[tuple, tuple], bool]:
    return lambda a, b: max(a[1], b[1]) - min(a[3], b[3]) <= gap_x and max(a[2], b[2]) - min(a[4], b[4]) <= gap_y


def clusters(boxes: DataFrame, gap_x: int, gap_y: int) -> DataFrame:
    """(page_id, region_seq, cluster): connected components of boxes whose gaps are at most gap_x and gap_y; a cluster is named by its lowest region_seq."""
    return linked_groups(boxes, _within(gap_x, gap_y), gap_y).select(*KEY, F.shiftright("grp", 24).cast("int").alias("cluster"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(page_id, region_seq, component) over edges (page_id, a, b): minimum labels along edges and pointer jumps, all as joins.

    For graphs too wide for a group. Every round takes the least label among
    the neighbours and then that label's own label, so labels travel twice as
    far each round; lineage is cut each round, and the rounds end when no label
    changes. Without ``nodes``, the nodes of the edges; isolated nodes are
    their own component.
    """
    from inkgrid.session import cut_lineage

    e = edges.select("page_id", F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y")
    e = cut_lineage(e.unionByName(e.select("page_id", F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    lab = e.groupBy("page_id", "x").agg(F.least("x", F.min("y")).alias("c"))
    changed = not e.isEmpty()
    if changed:
        lab = cut_lineage(lab)
    while changed:
        least = e.join(lab.select("page_id", F.col("x").alias("y"), F.col("c").alias("cy")), ["page_id", "y"]).groupBy("page_id", "x").agg(F.min("cy").alias("m"))
        step = lab.join(least, ["page_id", "x"]).select("page_id", "x", "c", F.least("c", "m").alias("n"))
        jump = step.join(lab.select("page_id", F.col("x").alias("n"), F.col("c").alias("nn")), ["page_id", "n"]).select("page_id", "x", "c", F.least("n", "nn").alias("n"))
        done = cut_lineage(jump)
        changed = not done.where("n < c").isEmpty()
        lab = done.select("page_id", "x", F.col("n").alias("c"))
    lab = lab.select("page_id", F.col("x").alias("region_seq"), F.col("c").alias("component"))
    if nodes is None:
        return lab
    return nodes.select(*KEY).distinct().join(lab, list(KEY), "left").select(*KEY, F.coalesce("component", "region_seq").alias("component"))


def merge_boxes(members: DataFrame, by: list[str]) -> DataFrame:
    """Union box and largest confidence of each group of rows l, t, r, b, det."""
    return members.groupBy(*by).agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.max("det").alias("det"), F.count("*").alias("members"))


def padded_clusters(boxes: DataFrame, pages: DataFrame, margin: int = 48) -> DataFrame:
    """(page_id, l, t, r, b, members): boxes padded by the margin and clipped to the page, merged while any two overlap, also the merged ones.

    Pages without a size clip at 0 only.
    """
    from inkgrid.session import cut_lineage

    size = pages.select("page_id", "width", "height").dropDuplicates(["page_id"])
    x = boxes_only(boxes).dropDuplicates(list(KEY)).join(size, "page_id", "left")
    e = G.expand(Box.of(), margin, F.coalesce("width", F.lit(2**30)), F.coalesce("height", F.lit(2**30)))
    x = x.select(*KEY, e.l.alias("l"), e.t.alias("t"), e.r.alias("r"), e.b.alias("b"))

    x = x.withColumn("members", F.lit(1).cast("long"))
    while True:  # merged boxes may overlap others that their parts didn't
        groups = cut_lineage(linked_groups(x, lambda a, b: max(a[1], b[1]) < min(a[3], b[3]) and max(a[2], b[2]) < min(a[4], b[4]), more=("members",), grow=True))
        merged = groups.groupBy("page_id", F.shiftright("grp", 24).cast("int").alias("region_seq"), "grp").agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.sum("members").alias("members"), F.count("*").alias("parts"))
        x = cut_lineage(merged)
        if x.where("parts > 1").isEmpty():
            return x.select("page_id", "l", "t", "r", "b", F.col("members").cast("int").alias("members"))


def long_strips(boxes: DataFrame, matches: DataFrame, aspect: float = 3.0, cross: float = 0.9, gap_ratio: float = 0.0) -> DataFrame:
    """(page_id, region_seq, strip): text boxes of one matched segment that continue each other along their long axis, named by the lowest region_seq.

    Both must be at least ``aspect`` times as long as wide on the same axis,
    overlap by ``cross`` across it, and lie no farther apart than ``gap_ratio``
    of the shorter.
    """
    m = matches.where("match_seq is not null").select(*KEY, "match_seq")
    x = boxes_only(boxes).dropDuplicates(list(KEY)).join(m, list(KEY))

    def along(a: tuple, b: tuple, k: int) -> bool:
        """k = 1: upright strips, 0: lying ones."""
        la, lb, wa, wb = a[k + 2] - a[k], b[k + 2] - b[k], a[3 - k] - a[1 - k], b[3 - k] - b[1 - k]
        if min(la, lb, wa, wb) <= 0 or la < aspect * wa or lb < aspect * wb:
            return False
        lap = max(0, min(a[3 - k], b[3 - k]) - max(a[1 - k], b[1 - k])) / min(wa, wb)
        gap = max(0, max(a[k], b[k]) - min(a[k + 2], b[k + 2]))
        return lap >= cross and gap <= min(la, lb) * gap_ratio

    def label(page: str, _match: int, rows: list[tuple]) -> list[tuple]:
        box = [x[1:] for x in rows]
        sets = Sets(len(box))
        reach = int(max((b[3] - b[1] for b in box), default=0) * gap_ratio)
        for i, j in sweep([b[1] for b in box], [b[3] for b in box], reach):
            if along(box[i], box[j], 1) or along(box[i], box[j], 0):
                sets.join(i, j)
        return [(page, x[0], rows[sets.find(i)][0]) for i, x in enumerate(rows)]

    return by_key(x, "match_seq", label, "page_id string, region_seq int, strip int", ("region_seq", "l", "t", "r", "b"))


def resolve_overlaps(boxes: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(page_id, region_seq, l, t, r, b): boxes without overlap.

    In order of region_seq, a box goes if a strictly larger remaining one covers
    at least ``threshold`` of it; boxes that cover each other by that much are
    merged (union box, row of the most confident member, column ``det``).
    Remaining overlaps are cut at midpoints, pair after pair.
    """

    area = lambda b: max(1, (b[2] - b[0]) * (b[3] - b[1]))
    lap = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))

    def covers(a: tuple, b: tuple) -> bool:
        shared = lap(a[1:5], b[1:5])
        return shared > 0 and shared / min(area(a[1:5]), area(b[1:5])) >= threshold

    def merged(page: str, _grp: int, rows: list[tuple]) -> list[tuple]:
        box = [x[1:5] for x in rows]
        size = [area(b) for b in box]
        shared: dict[int, dict[int, int]] = {}
        for i, j in sweep([b[1] for b in box], [b[3] for b in box]):
            if n := lap(box[i], box[j]):
                shared.setdefault(i, {})[j] = shared.setdefault(j, {})[i] = n
        sets, gone = Sets(len(box)), set()
        for i in range(len(box)):
            for j in sorted(shared.get(i, ())):
                if j in gone or shared[i][j] / size[i] < threshold:
                    continue
                if size[j] > size[i]:
                    gone.add(i)
                    break
                if shared[i][j] / size[j] >= threshold:
                    sets.join(i, j)
        out = []
        for g in sets.groups(i for i in range(len(box)) if i not in gone):
            base = max(g, key=lambda k: (rows[k][5], -k))
            out.append((page, rows[base][0], min(box[k][0] for k in g), min(box[k][1] for k in g), max(box[k][2] for k in g), max(box[k][3] for k in g), rows[g[0]][0]))
        return out

    def apart(page: str, _grp: int, rows: list[tuple]) -> list[tuple]:
        out = [list(x[:5]) for x in sorted(rows, key=lambda x: x[5])]
        for i, j in sorted(set(sweep([o[2] for o in out], [o[4] for o in out]))):
            _separate(out[i], out[j])
        return [(page, *o) for o in out]

    # what a box does depends on those that cover it or that it covers; then on those that it overlaps
    groups = linked_groups(boxes, covers, more=("det",))
    kept = by_key(groups, "grp", merged, "page_id string, region_seq int, l int, t int, r int, b int, first int", ("region_seq", "l", "t", "r", "b", "det"))
    groups = linked_groups(kept, lambda a, b: lap(a[1:5], b[1:5]) > 0, more=("first",))
    return by_key(groups, "grp", apart, "page_id string, region_seq int, l int, t int, r int, b int", ("region_seq", "l", "t", "r", "b", "first"))


def _separate(p: list[int], q: list[int]) -> None:
    """Cut two overlapping boxes [seq, l, t, r, b] apart at the middle of their overlap, across its shorter side."""
    lap = [min(p[k + 2], q[k + 2]) - max(p[k], q[k]) for k in (1, 2)]
    if min(lap) <= 0:
        return
    k = 1 if lap[1] >= lap[0] else 2
    mid = (max(p[k], q[k]) + min(p[k + 2], q[k + 2])) // 2
    first, second = (p, q) if p[k] + p[k + 2] <= q[k] + q[k + 2] else (q, p)
    first[k + 2], second[k] = min(first[k + 2], mid), max(second[k], mid)


def axis_splits(items: DataFrame, by: list[str], start: str, end: str, total: str, least_gap: int, least_size: int) -> DataFrame:
    """(by..., point): where a box may be split along an axis: at gaps of at least ``least_gap`` between its items, into parts of at least ``least_size``.

    Gaps and islands: running maximum of the ends before, minimum of the starts
    after; a fold then drops points too close to the last one taken.
    """
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.lead(start).over(w)  # rows are sorted by start
    g = items.select(*by, start, end, F.col(total).alias("_total"), before.alias("_before"), after.alias("_after")).where(F.col("_after") - F.col("_before") >= least_gap)
    pts = g.groupBy(*by).agg(F.array_sort(F.collect_set(F.floor((F.col("_before") + F.col("_after")) / 2).cast("int"))).alias("p"), F.max("_total").alias("n"))
    zero = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))
    fold = F.aggregate("p", zero, lambda a, p: F.when((p - a["last"] >= least_size) & (F.col("n") - p >= least_size), F.struct(p.alias("last"), F.concat(a["out"], F.array(p)).alias("out"))).otherwise(a))
    return pts.select(*by, F.explode(fold["out"]).alias("point"))


def rank_in_bands(boxes: DataFrame, band: Column, right: Column) -> DataFrame:
    """(page_id, region_seq, rank): order by (band, right, region_seq) on each page, ranked within bands and offset by the bands above."""
    x = boxes.select(*KEY, band.alias("_band"), right.alias("_right"))
    k = F.row_number().over(Window.partitionBy("page_id", "_band").orderBy("_right", "region_seq"))
    sizes = x.groupBy("page_id", "_band").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("page_id").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("k", k).join(sizes.select("page_id", "_band", above.alias("before")), ["page_id", "_band"]).select(*KEY, (F.col("before") + F.col("k")).alias("rank"))
