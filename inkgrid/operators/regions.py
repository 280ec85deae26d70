"""Regions of page images: parts by ink, emptiness, crops, erasing, polygons, places of text.

An image and its boxes meet in batches of at most ``BATCH`` boxes of a page, so
a page with very many boxes is worked on by several tasks, each with its own
copy of the image; no task holds all boxes of a page.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.operators import kernels as K
from inkgrid.operators import layout as L
from inkgrid.operators import spatial
from inkgrid.sources.images import UnreadableImage, decode, encode

BATCH = 64  # boxes of a page in one task's hands
PARTS = 1024  # numbers set aside for the parts of one box
MARGIN = 8  # pixels of ground kept around the ink of a part; the test for strokes leaves out the outer four


def on_images(images: DataFrame, boxes: DataFrame, fn: Callable[[np.ndarray, list[dict]], list[dict]], schema: str, *more: str) -> DataFrame:
    """Rows of ``fn(rgb, boxes)``, called for each page and batch of its boxes (dicts of region_seq, l, t, r, b, ``more``).

    ``images`` has page_id and content. Pages without a readable image and
    images without boxes give no row; ``fn`` returns dicts of the schema
    without page_id.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    x = spatial.boxes_only(boxes, *more).dropDuplicates(list(spatial.KEY)).withColumn("_batch", F.floor(F.col("region_seq") / BATCH))
    grouped = x.groupBy("page_id", "_batch").agg(F.array_sort(F.collect_list(F.struct("region_seq", "l", "t", "r", "b", *more))).alias("boxes"))  # BATCH rows at most
    j = grouped.join(images.select("page_id", "content").where("content is not null").dropDuplicates(["page_id"]), "page_id")
    arrow = to_arrow_schema(StructType.fromDDL(f"page_id string, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, held, content in zip(b.column("page_id").to_pylist(), b.column("boxes").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rgb = decode(content)
                except UnreadableImage:
                    continue  # such pages are reported where they are loaded
                out = [{"page_id": page, **r} for r in fn(rgb, held)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return j.select("page_id", "boxes", "content").mapInArrow(run, f"page_id string, {schema}")


def _inside(box: dict, rgb: np.ndarray) -> tuple[int, int, int, int] | None:
    h, w = rgb.shape[:2]
    l, t, r, b = max(0, box["l"]), max(0, box["t"]), min(w, box["r"]), min(h, box["b"])  # noqa: E741
    return (l, t, r, b) if l < r and t < b else None


def sizes(images: DataFrame) -> DataFrame:
    """(page_id, width, height, error) of image bytes; unreadable ones have an error and no size, null content neither."""
    schema = "page_id string, width int, height int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, content in zip(b.column("page_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    shape = decode(content).shape if content is not None else (None, None)
                    rows.append((page, shape[1], shape[0], None))
                except UnreadableImage as e:
                    rows.append((page, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["page_id", "width", "height", "error"])

    return images.select("page_id", "content").mapInArrow(run, schema)


def split_parts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, region_seq, l, t, r, b, det): the parts of each box whose ink lies far apart, with a little ground around it; a box of one part as it is.

    Part k of box n gets the number n * PARTS + k; more parts than that fail
    the query.
    """

    def fn(rgb: np.ndarray, held: list[dict]) -> list[dict]:
        out = []
        for x in held:
            at = _inside(x, rgb)
            if at is None:
                continue
            l, t, r, b = at  # noqa: E741
            parts = K.split_by_ink(K.grey(rgb[t:b, l:r]))
            if len(parts) > PARTS:
                raise ValueError(f"box {x['region_seq']} falls into {len(parts)} parts")
            wide = [(max(0, p[0] - MARGIN), max(0, p[1] - MARGIN), min(r - l, p[2] + MARGIN), min(b - t, p[3] + MARGIN)) for p in parts]
            parts = wide if len(parts) > 1 else [(0, 0, r - l, b - t)]
            out += [{"region_seq": x["region_seq"] * PARTS + k, "l": l + p[0], "t": t + p[1], "r": l + p[2], "b": t + p[3], "det": x["det"]} for k, p in enumerate(parts)]
        return out

    return on_images(images, boxes, fn, "region_seq int, l int, t int, r int, b int, det double", "det")


def prepare_regions(images: DataFrame, boxes: DataFrame, overlap: float = 0.35) -> DataFrame:
    """(page_id, region_seq, l, t, r, b, crop): what recognition reads of the detector's boxes.

    Boxes are split by their ink, overlaps resolved, regions without strokes
    dropped; ``crop`` has the PNG bytes of each region.
    """

    def fn(rgb: np.ndarray, held: list[dict]) -> list[dict]:
        out = []
        for x in held:
            at = _inside(x, rgb)
            if at is None:
                continue
            l, t, r, b = at  # noqa: E741
            if K.has_text(K.grey(rgb[t:b, l:r])):
                out.append({"region_seq": x["region_seq"], "l": l, "t": t, "r": r, "b": b, "crop": encode(K.crop(rgb, at))})
        return out

    parts = split_parts(images, boxes)
    return on_images(images, spatial.resolve_overlaps(parts, overlap), fn, "region_seq int, l int, t int, r int, b int, crop binary")


def erased(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, region_seq, l, t, r, b, patch, color): the boxes with their text erased, as PNG patches, and the median colour left.

    Patches of a page are independent of each other; ``put_back`` sets them
    into the page.
    """

    def fn(rgb: np.ndarray, held: list[dict]) -> list[dict]:
        out = []
        for x in held:
            at = _inside(x, rgb)
            if at is None:
                continue
            l, t, r, b = at  # noqa: E741
            h, w = rgb.shape[:2]
            pad = 8
            L0, T0, R0, B0 = max(0, l - pad), max(0, t - pad), min(w, r + pad), min(h, b + pad)
            near = rgb[T0:B0, L0:R0]
            done = K.erase(near, np.ones(near.shape[:2], bool), (l - L0, t - T0, r - L0, b - T0))
            patch = done[t - T0 : b - T0, l - L0 : r - L0]
            out.append({"region_seq": x["region_seq"], "l": l, "t": t, "r": r, "b": b, "patch": encode(patch), "color": [int(v) for v in np.median(patch.reshape(-1, 3), axis=0)]})
        return out

    return on_images(images, boxes, fn, "region_seq int, l int, t int, r int, b int, patch binary, color array<int>")


def put_back(images: DataFrame, patches: DataFrame) -> DataFrame:
    """(page_id, content): each page's image (PNG) with its patches set in, in order of region_seq; pages without patches as they are.

    A page is one image, so its patches meet in one task; they are no larger
    together than the boxes of the page.
    """
    p = patches.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_seq", "l", "t", "patch"))).alias("patches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for content, held in zip(b.column("content").to_pylist(), b.column("patches").to_pylist(), strict=True):
                if content is None or not held:
                    out.append(content)
                    continue
                try:
                    rgb = decode(content).copy()
                except UnreadableImage:
                    out.append(content)
                    continue
                for x in held:
                    patch = decode(x["patch"])
                    rgb[x["t"] : x["t"] + patch.shape[0], x["l"] : x["l"] + patch.shape[1]] = patch
                out.append(encode(rgb))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(out, pa.binary())], names=["page_id", "content"])

    return images.select("page_id", "content").join(p, "page_id", "left").select("page_id", "content", "patches").mapInArrow(run, "page_id string, content binary")


# --- polygons ----------------------------------------------------------------------------------


def polygon_runs(polygons: DataFrame) -> DataFrame:
    """(page_id, region_seq, y, x0, x1): the runs of pixels whose centres lie inside a polygon ``points`` (array<struct<x,y>>), x1 exclusive.

    Even-odd filling; the centre of pixel (x, y) is (x + 0.5, y + 0.5), an
    edge holds its upper end. Each scan line is a row of its own, so a large
    polygon spreads over tasks, and all of it is done by column expressions.
    Null points and polygons of fewer than three points have no run.
    """
    pts = F.col("points")
    ys = F.transform(pts, lambda p: p["y"])
    lines = polygons.where(F.size(pts) >= 3).select("page_id", "region_seq", "points", F.explode(F.sequence(F.floor(F.array_min(ys)).cast("int"), F.floor(F.array_max(ys)).cast("int"))).alias("y"))
    c = F.col("y") + F.lit(0.5)
    edges = F.arrays_zip(pts.alias("p"), F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1)).alias("q"))
    met = F.filter(edges, lambda e: (F.least(e["p"]["y"], e["q"]["y"]) <= c) & (c < F.greatest(e["p"]["y"], e["q"]["y"])))
    xs = F.array_sort(F.transform(met, lambda e: e["p"]["x"] + (c - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / (e["q"]["y"] - e["p"]["y"])))
    cut = lines.select("page_id", "region_seq", "y", xs.alias("xs"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("xs") - 2, F.lit(0))), lambda k: (k % 2 == 0) & (k + 1 < F.size("xs"))), lambda k: F.struct(F.ceil(F.col("xs")[k] - 0.5).cast("int").alias("x0"), F.ceil(F.col("xs")[k + 1] - 0.5).cast("int").alias("x1")))
    return cut.select("page_id", "region_seq", "y", F.explode(pairs).alias("s")).select("page_id", "region_seq", "y", "s.x0", "s.x1").where("x0 < x1")


def polygon_boxes(polygons: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """(page_id, region_seq, l, t, r, b): bounding boxes of polygons, rounded (ties to even) and clipped to the page; polygons off the page have none."""
    side = lambda f, c: F.bround(f(F.transform("points", lambda p: p[c])), 0).cast("int")
    x = polygons.where(F.size("points") >= 3).select(
        "page_id",
        "region_seq",
        F.greatest(F.lit(0), side(F.array_min, "x")).alias("l"),
        F.greatest(F.lit(0), side(F.array_min, "y")).alias("t"),
        F.least(F.col(width), side(F.array_max, "x")).alias("r"),
        F.least(F.col(height), side(F.array_max, "y")).alias("b"),
    )
    return x.where("l < r and t < b")


# --- places of text ------------------------------------------------------------------------------

PLACES = "mode string, size int, items array<struct<text:string,x:double,y:double>>"


def place(text: str, box: tuple[int, int, int, int], horizontal: bool, runs: list[tuple[int, int, int]], padding: int = 4, least: int = 12, preferred: int = 56, largest: int = 72) -> tuple[str, int | None, list[dict]]:
    """(mode, font size, lines or columns with their places) of a text in its box (page coordinates).

    'horizontal': lines, centred. Upright text takes the mask's largest
    inscribed rectangle where that has 0.70 of the mask ('rectangle'), else the
    mask's columns ('mask'). 'fallback' is what fits nowhere: the smallest
    size, wrapped or in one column a sentence. ``runs`` (y, x0, x1) are the
    mask's; without any the box is the mask. 'none' for texts without a letter
    to set.
    """
    l, t, r, b = box  # noqa: E741
    w, h = max(1, r - l), max(1, b - t)
    if not text.strip():
        return "none", None, []
    if horizontal:
        aw, ah = max(1, w - 2 * padding), max(1, h - 2 * padding)
        got = L.best_layout(text, aw, ah, False, min(largest, max(preferred, ah)), preferred, least, positive=True)
        if got:
            y, items = t + padding + (ah - got.height) / 2, []
            for line in got.lines:
                items.append({"text": line.text, "x": l + padding + (aw - L.width_of(line.text, got.size)) / 2, "y": y})
                y += got.size + got.spacing + (got.gap if line.paragraph else 0.0)
            return "horizontal", got.size, items
        lines = L.wrap(text, aw, least)
        return "fallback", least, [{"text": x, "x": float(l + padding), "y": t + padding + 1.25 * least * k} for k, x in enumerate(lines)]
    mask = np.zeros((h, w), bool)
    for y, x0, x1 in runs:
        if t <= y < b:
            mask[y - t, max(0, x0 - l) : max(0, x1 - l)] = True
    bare = not mask.any()
    if bare:
        mask[:] = True
    found = (0, 0, w, h) if bare else K.largest_rectangle(mask)
    if found and found[2] * found[3] >= 0.70 * mask.sum():
        x, y, rw, rh = found
        got = L.best_layout(text, max(1, rw - 2 * padding), max(1, rh - 2 * padding), True, largest, preferred, least, positive=True)
        if got:
            at = L.column_places([len(c.text) for c in got.lines], got.size, l + x + padding, t + y + padding, rw - 2 * padding, rh - 2 * padding)
            return "rectangle", got.size, [{"text": c.text, "x": px, "y": py} for c, (px, py) in zip(got.lines, at, strict=True)]
    parts = L.sentences(text)
    left_of = np.zeros((h, w + 1), np.min_scalar_type(w))
    np.cumsum(mask, axis=1, out=left_of[:, 1:])  # set pixels of each line before a column
    for size in range(min(largest, preferred), least - 1, -2):
        ranges: dict[int, list[tuple[int, int]]] = {}
        xs = np.arange(w - size, -1, -math.ceil(1.15 * size))
        cols = left_of[:, xs + size] - left_of[:, xs] == size
        for k in np.flatnonzero(cols.sum(axis=0) >= size).tolist():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], cols[:, k].view(np.int8), [0]])))
            if spans := [(int(a), int(z)) for a, z in zip(edge[::2], edge[1::2], strict=True) if z - a >= size]:
                ranges[int(xs[k])] = spans
        if placed := L.in_mask(text, ranges, size, parts):
            return "mask", size, [{"text": c, "x": float(l + x), "y": float(t + y)} for c, x, y in placed]
    columns = parts or [text]
    at = L.column_places([len(c) for c in columns], least, l + padding, t + padding, w - 2 * padding, h - 2 * padding)
    return "fallback", least, [{"text": c, "x": px, "y": py} for c, (px, py) in zip(columns, at, strict=True)]


def places(regions: DataFrame, bounds: DataFrame, runs: DataFrame) -> DataFrame:
    """(page_id, region_seq, mode, size, items) of every text of ``regions`` (text, horizontal) within its render bounds.

    ``runs`` are layout mask runs (page_id, region_seq, y, x0, x1); a region's
    runs are bounded by its height. Texts that are null have no row.
    """
    key = ["page_id", "region_seq"]
    m = runs.groupBy(*key).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("runs"))
    j = regions.where("text is not null").select(*key, "text", "horizontal").join(bounds.select(*key, "l", "t", "r", "b"), key).join(m, key, "left")
    kinds = [("mode", pa.string()), ("size", pa.int32()), ("items", pa.list_(pa.struct([("text", pa.string()), ("x", pa.float64()), ("y", pa.float64())])))]

    def f(text, horizontal, l, t, r, b, held):  # noqa: E741
        return place(text, (l, t, r, b), horizontal, [(x["y"], x["x0"], x["x1"]) for x in held or ()])

    return L._map(j, ["text", "horizontal", "l", "t", "r", "b", "runs"], f, PLACES, kinds)
