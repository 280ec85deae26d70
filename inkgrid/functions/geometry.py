"""Box geometry as Column expressions. A box is four integer columns l, t, r, b (half-open); ``Box`` names them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    l: Column  # noqa: E741
    t: Column
    r: Column
    b: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        """Columns l, t, r, b with a prefix, or the fields of a struct column given as 'name.'."""
        return Box(*(F.col(f"{prefix}{x}") for x in "ltrb"))

    @property
    def w(self) -> Column:
        return self.r - self.l

    @property
    def h(self) -> Column:
        return self.b - self.t

    def struct(self) -> Column:
        return F.struct(self.l.alias("l"), self.t.alias("t"), self.r.alias("r"), self.b.alias("b"))


def area(a: Box) -> Column:
    return a.w.cast("long") * a.h


def overlap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0), F.least(a.r, b.r) - F.greatest(a.l, b.l))


def overlap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0), F.least(a.b, b.b) - F.greatest(a.t, b.t))


def intersection(a: Box, b: Box) -> Column:
    return overlap_x(a, b).cast("long") * overlap_y(a, b)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlaps(a: Box, b: Box) -> Column:
    """Positive-area overlap."""
    return (a.l < b.r) & (b.l < a.r) & (a.t < b.b) & (b.t < a.b)


def interval_gap(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    return F.greatest(F.lit(0), F.greatest(s0, s1) - F.least(e0, e1))


def interval_overlap_ratio(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    """Overlap over the shorter interval; null where that is empty."""
    return F.try_divide(F.greatest(F.lit(0), F.least(e0, e1) - F.greatest(s0, s1)).cast("double"), F.least(e0 - s0, e1 - s1).cast("double"))


def gap_2d(a: Box, b: Box) -> tuple[Column, Column, Column]:
    """Gaps along x and y, and their Euclidean length."""
    gx, gy = interval_gap(a.l, a.r, b.l, b.r), interval_gap(a.t, a.b, b.t, b.b)
    return gx, gy, F.hypot(gx.cast("double"), gy.cast("double"))


def clip(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:  # noqa: E741
    """Real-valued box to integers (half to even) within the page; null if nothing is left."""
    lo = lambda c, m: F.greatest(F.lit(0), F.least(F.bround(c, 0).cast("int"), m))
    x = Box(lo(l, width), lo(t, height), lo(r, width), lo(b, height))
    return F.when((x.r > x.l) & (x.b > x.t), x.struct())


def expand(a: Box, pad: int, width: Column, height: Column) -> Box:
    """Padded by ``pad`` and clipped to the page."""
    return Box(F.greatest(F.lit(0), a.l - pad), F.greatest(F.lit(0), a.t - pad), F.least(width, a.r + pad), F.least(height, a.b + pad))


def within_roi(a: Box, roi: Box) -> Box:
    """Absolute box in the coordinates of a region of interest: starts not before it, ends not after it."""
    return Box(F.greatest(F.lit(0), a.l - roi.l), F.greatest(F.lit(0), a.t - roi.t), F.least(roi.w, a.r - roi.l), F.least(roi.h, a.b - roi.t))


def band_key(cx: Column, cy: Column, band: float) -> tuple[Column, Column]:
    """Reading order of centres: band from the top (half to even), then from the right."""
    return F.bround(cy / F.lit(float(band)), 0), -cx


def stroke(r: Column, g: Column, b: Column, size: Column) -> tuple[Column, Column]:
    """(width, is white): outline of text of a colour and size."""
    return F.greatest(F.lit(2), F.least(F.lit(5), F.floor(size / 14).cast("int"))), luma(r, g, b) < 128


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def neutral_ink(r: Column, g: Column, b: Column, background: Column, dark: int = 128, limit: int = 25) -> Column:
    """Nearly grey ink lighter than a dark background snaps to white, darker than a light one to black; other ink stays."""
    grey = F.greatest(r, g, b) - F.least(r, g, b) < limit
    y = luma(r, g, b)
    snap = F.when(grey & (background < dark) & (y > background), F.lit(255)).when(grey & (background >= dark) & (y < background), F.lit(0))
    return F.struct(*[F.coalesce(snap, c).cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])


def geometric_dilation(a: Box, width: Column, height: Column, base: int) -> Column:
    """Dilation in pixels where no glyph could be measured: from the page's scale and the box's shorter side."""
    scale = F.greatest(F.lit(0.6), F.least(F.lit(2.5), F.greatest(width, height) / F.lit(1600.0)))
    est = F.greatest(F.lit(12), F.least(F.lit(64), F.least(a.w, a.h)))
    px = F.bround(F.lit(0.10) * est * scale, 0) + max(0, base - 1)
    return F.greatest(F.lit(2), F.least(F.lit(24), px)).cast("int")


def runs_horizontal(a: Box, text: Column, has_mask: Column, threshold: float = 1.3) -> Column:
    """Whether a region of a vertical page is set horizontally: by the script of its text, its mask and its aspect."""
    cjk = text.rlike("[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]")
    alpha = text.rlike("[a-zA-Z\\x{c0}-\\x{24f}\\x{400}-\\x{4ff}]")
    bw, bh = F.greatest(F.lit(1), a.w), F.greatest(F.lit(1), a.h)
    wide = F.when(cjk, bw >= bh * F.lit(max(2.0, threshold))).otherwise(bw >= bh * F.lit(threshold))
    return F.when(alpha & ~cjk, F.lit(True)).when(has_mask, F.lit(False)).otherwise(wide)


def side_by_side(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Sizes of two images scaled to the larger height and set side by side: (w1, w2, width, height).

    Products are doubles: a width times the height of a long strip passes the range of int.
    """
    h = F.greatest(h1, h2)
    a = F.greatest(F.lit(1), F.bround(w1 * h.cast("double") / h1, 0).cast("int"))
    b = F.greatest(F.lit(1), F.bround(w2 * h.cast("double") / h2, 0).cast("int"))
    return F.struct(a.alias("w1"), b.alias("w2"), (a + b).alias("width"), h.alias("height"))
