"""Queries over small images: pixel aggregates in SQL, kernels as Arrow maps.

The tables hold no pictures. For the aggregates the rows of ``embeddings``
serve as 8 by 8 ones, with a contrast that grows with the label (0 is white
paper). For the kernels each row is drawn as a speech bubble on grey ground
(``picture``): the label sets whether it has text, one block of it or two, and
how clean its paper is; the vector sets the glyphs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkgrid.operators import kernels as K
from inkgrid.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def pixels(s, d):
    """(roi, y, x, v): one row a pixel of the small images."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("roi"), "label", F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.round(F.col("e").cast("double"), 5) + 0.5) * 255).cast("int")))
    v = (255 - F.floor((255 - v) * F.col("label") / 9)).cast("int")
    return e.select("roi", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("v"))


_PX = "P as (select vec_id as roi, (i-1)//8 as y, (i-1)%8 as x, (255-floor((255-greatest(0,least(255,floor((round(e::double,5)+0.5)*255)::int)))*label/9))::int as v from (select vec_id, label, generate_subscripts(embedding,1) as i, unnest(embedding) as e from embeddings))"
_MID = "(x between 2 and 5 and y between 2 and 5)"


@query("F9_flat_background", f"with {_PX} select roi, n>=16 and ((m>=235 and s<=10) or s<=3.5) as flat, med from (select roi, count(*) as n, avg(v) as m, stddev_pop(v) as s, quantile_cont(v,0.5) as med from P where not {_MID} group by 1)")
def f9(s, d):
    """The middle of the image stands for the text; the rest is background."""
    g = pixels(s, d).where("not (x between 2 and 5 and y between 2 and 5)").groupBy("roi").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.percentile("v", F.lit(0.5)).alias("med"))
    return g.select("roi", ((F.col("n") >= 16) & (((F.col("m") >= 235) & (F.col("s") <= 10)) | (F.col("s") <= 3.5))).alias("flat"), "med")


_INK = f"A as (select roi, quantile_cont(v,0.8) filter (where {_MID}) as p80, quantile_cont(v,0.5) filter (where not {_MID}) as ring from P group by 1), B as (select roi, p80>=140 or ring>=130 as light from A), C as (select P.roi, light, count(*) filter (where {_MID} and case when light then v<=130 else v>=150 end) as n, quantile_cont(v,0.5) filter (where {_MID} and case when light then v<=130 else v>=150 end) as med from P join B using (roi) group by 1,2)"


@query("G13_ink_color", f"with {_PX}, {_INK} select roi, light, case when n>=4 then case when light then 0 else 255 end else case when light then 0 else 255 end end as ink, n from C")
def g13(s, d):
    """Polarity by the 80th percentile inside and the median around; one grey has no saturation, so its ink is black or white."""
    mid = (F.col("x").between(2, 5)) & (F.col("y").between(2, 5))
    p = pixels(s, d)
    a = p.groupBy("roi").agg(F.percentile(F.when(mid, F.col("v")), F.lit(0.8)).alias("p80"), F.percentile(F.when(~mid, F.col("v")), F.lit(0.5)).alias("ring"))
    b = p.join(a.select("roi", ((F.col("p80") >= 140) | (F.col("ring") >= 130)).alias("light")), "roi")
    ink = mid & F.when(F.col("light"), F.col("v") <= 130).otherwise(F.col("v") >= 150)
    return b.groupBy("roi", "light").agg(F.count(F.when(ink, 1)).alias("n")).select("roi", "light", F.when(F.col("light"), 0).otherwise(255).alias("ink"), "n")


_CORNER = "(x<3 or x>=5) and (y<3 or y>=5)"


@query("G11_background_samples", f"with {_PX}, S as (select roi, count(*) filter (where v>=160 and {_CORNER}) as corner, count(*) filter (where v>=160 and not {_MID}) as ring from P group by 1) select roi, case when corner>=16 then 'corners' when ring>=16 then 'outside' else 'all' end as tier, corner, ring from S")
def g11(s, d):
    """Bright pixels are allowed ones: those of the corners if there are enough, else those outside the text, else all."""
    ok = F.col("v") >= 160
    g = pixels(s, d).groupBy("roi").agg(F.count(F.when(ok & F.expr(_CORNER), 1)).alias("corner"), F.count(F.when(ok & F.expr("not (x between 2 and 5 and y between 2 and 5)"), 1)).alias("ring"))
    return g.select("roi", F.when(F.col("corner") >= 16, "corners").when(F.col("ring") >= 16, "outside").otherwise("all").alias("tier"), "corner", "ring")


@query("G12_background_color", f"with {_PX} select roi, case when count(*) filter (where v>=160)>=16 and count(*) filter (where v>=160)>=0.5*count(*) then quantile_cont(v,0.5) filter (where v>=160) else quantile_cont(v,0.5) end as color from P group by 1")
def g12(s, d):
    w = F.count(F.when(F.col("v") >= 160, 1))
    g = pixels(s, d).groupBy("roi").agg(w.alias("w"), F.count("*").alias("n"), F.percentile(F.when(F.col("v") >= 160, F.col("v")), F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.5)).alias("b"))
    return g.select("roi", F.when((F.col("w") >= 16) & (F.col("w") >= 0.5 * F.col("n")), F.col("a")).otherwise(F.col("b")).alias("color"))


@query("I7_ink_box", f"with {_PX} select roi, min(x) as l, min(y) as t, max(x)+1 as r, max(y)+1 as b from P where v<=100 and x between 1 and 6 and y between 1 and 6 group by 1")
def i7(s, d):
    p = pixels(s, d).where("v <= 100 and x between 1 and 6 and y between 1 and 6")
    return p.groupBy("roi").agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("b"))


# --- kernels -------------------------------------------------------------------------------------


SIDE, MIDDLE, RADIUS = 96, 48, 44
TEXT = (24, 20, 72, 76)  # the box of the text


def picture(vector: list[float], label: int) -> tuple[np.ndarray, np.ndarray]:
    """(rgb, mask of the bubble): a white disc with a dark outline on grey ground; with text unless the label is 0, in two blocks if it is even, on spotted paper from 7 on."""
    y, x = np.mgrid[:SIDE, :SIDE]
    far = np.hypot(x - MIDDLE, y - MIDDLE)
    g = np.full((SIDE, SIDE), 120, np.uint8)
    g[far <= RADIUS] = 0
    inside = far < RADIUS - 2
    g[inside] = 255
    v = np.array(vector).reshape(8, 8)
    if label >= 7:
        g[inside] = 235 - (np.kron(v > 0, np.ones((12, 12), bool))[inside] * 40).astype(np.uint8)
    for top in () if label == 0 else (22, 62) if label % 2 == 0 else (42,):
        block = np.kron(v[:3, :] > -0.02, np.ones((4, 4), bool))
        g[top : top + 12, 32:64][block] = 10
    return np.stack([g, np.minimum(g, 252) + 3, g], axis=2), inside


def images(s, d, fn: Callable[[np.ndarray, np.ndarray], tuple], schema: str, kinds: list[tuple[str, pa.DataType]]):
    """(roi, fn(rgb, bubble mask)…): each picture through a kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fn(*picture(e, k)) for e, k in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("roi"), *(pa.array([r[k] for r in rows], t) for k, (_n, t) in enumerate(kinds))], names=["roi", *(n for n, _t in kinds)])

    return table(s, d, "embeddings").select(F.col("vec_id").alias("roi"), "embedding", "label").mapInArrow(run, f"roi long, {schema}")


def _ink(g: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return mask & (g <= 128)


def _cut(a: np.ndarray) -> np.ndarray:
    l, t, r, b = TEXT  # noqa: E741
    return a[t:b, l:r]


def _kernel(name: str, schema: str, kinds: list[tuple[str, pa.DataType]], sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda s, d: images(s, d, fn, schema, kinds)
        if sql:
            ORACLES[name] = sql
        return fn

    return add


_I, _B, _F = pa.int32(), pa.bool_(), pa.float64()
_BOX = [("l", _I), ("t", _I), ("r", _I), ("b", _I)]

# what the pictures are drawn to show, told from the rows: glyph cells set (their first three lines), blocks of text
_DRAWN = "D as (select vec_id as roi, label, len(list_filter(embedding[1:24], lambda e: e::double>-0.02)) as cells, case when label=0 then 0 when label%2=0 then 2 else 1 end as blocks from embeddings)"


@_kernel("F5_region_has_text", "text boolean", [("text", _B)], f"with {_DRAWN} select roi, blocks>0 and cells>0 as text from D")
def f5(rgb, mask):
    """Strokes in the text box, as drawn: none where the label is 0."""
    return (K.has_text(_cut(K.grey(rgb)), _cut(mask)),)


@_kernel("F7_plain_white", "white boolean, closed boolean", [("white", _B), ("closed", _B)], "select vec_id as roi, label<7 as white, true as closed from embeddings")
def f7(rgb, mask):
    """White paper below label 7; the disc is a closed shape."""
    return K.plain_white(K.grey(rgb), mask), K.closed_shape(mask)


@_kernel("G14_strong_ink", "r int, g int, b int", [("r", _I), ("g", _I), ("b", _I)])
def g14(rgb, mask):
    return K.strong_ink(rgb, mask, K.background_color(rgb, mask, K.background_samples(rgb, mask, TEXT)))


@_kernel("G18_inscribed_rectangle", "x int, y int, w int, h int", [("x", _I), ("y", _I), ("w", _I), ("h", _I)])
def g18(rgb, mask):
    return K.largest_rectangle(mask & ~_ink(K.grey(rgb), mask)) or (None,) * 4


@_kernel("G16_image_components", "n int, largest int", [("n", _I), ("largest", _I)])
def g16(rgb, mask):
    c = K.components(_ink(K.grey(rgb), mask))
    return len(c), max((x[4] for x in c), default=0)


@_kernel("P22_glyph_dilation", "px int", [("px", _I)])
def p22(rgb, mask):
    return (K.glyph_dilation(_ink(K.grey(rgb), mask), (1200, 1800)),)


@_kernel("I3_segmentation_mask", "before int, after int", [("before", _I), ("after", _I)])
def i3(rgb, mask):
    return int(mask.sum()), int(K.thinned_mask(mask, (0, 0), TEXT).sum())


@_kernel("I4_crop", "size int, dark int", [("size", _I), ("dark", _I)], f"with {_DRAWN} select roi, 2688 as size, (16*cells*blocks)::int as dark from D")
def i4(rgb, mask):
    """The text box with all but the bubble made white: what is dark is the glyphs, 16 pixels a cell."""
    out = K.crop(rgb, TEXT, _cut(mask))
    return int(out.shape[0] * out.shape[1]), int((K.grey(out) <= 128).sum())


@_kernel("I5_split_regions", "parts int, l int, t int, r int, b int", [("parts", _I), *_BOX])
def i5(rgb, mask):
    p = K.split_by_ink(_cut(K.grey(rgb)))
    return len(p), *p[0]


@_kernel("I8_inner_bubble", "area int", [("area", _I)])
def i8(rgb, mask):
    m = K.inner_bubble(K.grey(rgb), (MIDDLE, MIDDLE), white=200, close=13)
    return (None if m is None else int(m.sum()),)


@_kernel("I9_fill_holes", "before int, after int", [("before", _I), ("after", _I)], f"with {_DRAWN}, M as (select count(*) as n from range(96) a(y), range(96) b(x) where sqrt((x-48)*(x-48)+(y-48)*(y-48))<42) select roi, (n-16*cells*blocks)::int as before, n::int as after from D, M")
def i9(rgb, mask):
    """The paper without its glyphs; filled, the whole disc again."""
    m = mask & ~_ink(K.grey(rgb), mask)
    return int(m.sum()), int(K.fill_holes(m).sum())


@_kernel("I10_erase", "dark int, changed int", [("dark", _I), ("changed", _I)])
def i10(rgb, mask):
    out = K.erase(rgb, mask, TEXT)
    return int((K.grey(out)[mask] <= 60).sum()), int((out != rgb).any(axis=2).sum())


@_kernel("I11_glyph_mask", "n int", [("n", _I)])
def i11(rgb, mask):
    g = K.grey(rgb)
    paper = g[mask & (g > 128)]
    return (int(K.glyph_mask(g, mask, TEXT, float(np.median(paper)), float(paper.std())).sum()),)


@_kernel("I12_flat_route", "flat boolean", [("flat", _B)], "select vec_id as roi, label<7 as flat from embeddings")
def i12(rgb, mask):
    """White paper beside the text is flat, spotted paper isn't."""
    text = np.zeros(mask.shape, bool)
    l, t, r, b = TEXT  # noqa: E741
    text[t:b, l:r] = True
    return (K.flat_background(rgb, text, mask) is not None,)


@_kernel("I13_restore_skipped", "changed int", [("changed", _I)])
def i13(rgb, mask):
    out = K.paste_back(np.full_like(rgb, 255), rgb, TEXT, True)
    return (int((out != 255).any(axis=2).sum()),)


@_kernel("K3_debug_overlay", "changed int", [("changed", _I)])
def k3(rgb, mask):
    out = K.draw_boxes(rgb, [(_ink(K.grey(rgb), mask), (0, 0), (255, 0, 0), 64)], [(TEXT, (0, 0, 255))])
    return (int((out != rgb).any(axis=2).sum()),)


@_kernel("L9_lobes", "n int, x int, y int, radius double", [("n", _I), ("x", _I), ("y", _I), ("radius", _F)])
def l9(rgb, mask):
    p = K.lobes(mask)
    return (len(p), p[0][0], p[0][1], round(p[0][2], 4)) if p else (0, None, None, None)
