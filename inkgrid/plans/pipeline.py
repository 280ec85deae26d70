"""The page pipeline: ``run`` from recognised regions, ``translate_images`` from page images to erased images and the places of their text.

Candidates, translation and erasing are branches of one plan, joined again by
page. ``postprocess`` makes regions of the rows of two detectors.

Model stages are plug-ins with the shape of ``mapInArrow``; the module has
deterministic stubs, never a made-up model result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import geometry as G
from inkgrid.functions import scoring
from inkgrid.functions.geometry import Box
from inkgrid.functions.text import vertical
from inkgrid.operators import spatial
from inkgrid.session import cut_lineage


def join_branches(translated: DataFrame, inpainted: DataFrame) -> DataFrame:
    """Branches of the same pages, joined by the page's key (never by position)."""
    return translated.join(inpainted, "page_id")


def zip_strict(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows (…, i, a, b) of two arrays paired by position; arrays of different lengths fail the query."""
    x = df.withColumn("_a", a).withColumn("_b", b)
    ok = F.assert_true(F.size("_a") == F.size("_b"), F.lit("arrays to be paired differ in length"))
    x = x.withColumn("_z", F.when(ok.isNull(), F.arrays_zip("_a", "_b")))
    keep = [c for c in df.columns if c not in ("i", "a", "b")]
    return x.select(*keep, F.posexplode("_z").alias("i", "_p")).select(*keep, "i", F.col("_p._a").alias("a"), F.col("_p._b").alias("b"))


def postprocess(texts: DataFrame, segments: DataFrame, runs: DataFrame | None = None, nms_iou: float = 0.5, match_iou: float = 0.1, overlap: float = 0.35) -> DataFrame:
    """Regions of detector rows: suppress doubles, match text boxes to segments, join strips, add unmatched segments, resolve overlaps, drop annotations.

    Input columns page_id, region_seq, l, t, r, b, det; numbers of text boxes
    and of segments are their own, so added segments get numbers after the
    largest text box of their page.
    """
    key = ["page_id", "region_seq"]
    t = cut_lineage(spatial.boxes_only(texts, "det").join(spatial.non_maximum_suppression(texts, nms_iou), key))
    m = cut_lineage(spatial.best_match(t, segments, runs, match_iou))
    strips = spatial.long_strips(t, m)
    named = t.join(strips, key, "left").withColumn("g", F.coalesce("strip", "region_seq"))
    conf = m.join(segments.select("page_id", F.col("region_seq").alias("match_seq"), F.col("det").alias("seg_det")), ["page_id", "match_seq"], "left").select(*key, "seg_det")
    named = named.join(conf, key, "left").withColumn("det", F.greatest("det", F.coalesce("seg_det", "det")))
    merged = spatial.merge_boxes(named, ["page_id", "g"]).select("page_id", F.col("g").cast("int").alias("region_seq"), "l", "t", "r", "b", "det")
    base = t.groupBy("page_id").agg((F.max("region_seq") + 1).alias("n"))
    extra = segments.join(spatial.unmatched(segments, m), key).join(base, "page_id", "left")
    extra = extra.select("page_id", (F.coalesce("n", F.lit(0)) + F.col("region_seq")).cast("int").alias("region_seq"), "l", "t", "r", "b", "det")
    boxes = cut_lineage(merged.unionByName(extra))
    return spatial.without_annotations(spatial.resolve_overlaps(boxes, overlap))


def candidates(regions: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): regions whose quality isn't known to be below ``least``, and the others, by key."""
    q = scoring.quality(F.col("confidence"), F.col("character_confidences"), F.col("source_text"))
    x = regions.withColumn("score", q)
    return x.where(scoring.passes(F.col("score"), least)), x.where(~scoring.passes(F.col("score"), least))


#: stage name -> builder of a plug-in; filled by ``register``.
STAGES: dict[str, dict[str, Callable[..., Callable[[DataFrame], DataFrame]]]] = {"detector": {}, "recognizer": {}, "translator": {}, "inpainter": {}, "eraser": {}}


def register(stage: str, name: str):
    """Register a plug-in under a configuration name."""

    def add(build):
        STAGES[stage][name] = build
        return build

    return add


def build(stage: str, name: str, **options):
    """The plug-in of a stage by its configured name; an unknown name is an error that lists the known ones."""
    if name not in STAGES[stage]:
        raise ValueError(f"unknown {stage} {name!r}; known: {', '.join(sorted(STAGES[stage])) or 'none'}")
    return STAGES[stage][name](**options)


@register("eraser", "none")
def _keep():
    """Images stay as they are."""
    return None


@register("eraser", "erase")
def _erase():
    """Solid fill on an even ground, diffusion otherwise."""
    from inkgrid.operators.regions import erased

    return erased


@register("inpainter", "none")
def _identity():
    """Nothing is erased."""
    return lambda df: df


def run(pages: DataFrame, regions: DataFrame, translator: Callable[[DataFrame], DataFrame], inpainter: Callable[[DataFrame], DataFrame], least: float = 0.75) -> DataFrame:
    """(page_id, page_seq, regions, translated, skipped, error): the pipeline over recognised regions.

    The regions are written once before the plan branches (else recognition
    would run twice); pages with an error keep it and take no part; the result
    has every page once.
    """
    good = pages.where("error is null").select("page_id", "page_seq")
    r = cut_lineage(regions.join(good.select("page_id"), "page_id", "left_semi"))
    kept, skipped = candidates(r, least)
    done = translator(kept)
    erased = inpainter(kept).groupBy("page_id").agg(F.count("*").alias("regions"))
    said = kept.select("page_id", "region_seq").join(done.select("page_id", "region_seq", "translated_text"), ["page_id", "region_seq"], "left")
    said = said.groupBy("page_id").agg(F.sum(F.col("translated_text").isNotNull().cast("long")).alias("translated"))
    left = skipped.groupBy("page_id").agg(F.count("*").alias("skipped"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = pages.select("page_id", "page_seq", "error").join(join_branches(said, erased), "page_id", "left").join(left, "page_id", "left")
    return out.select("page_id", "page_seq", z("regions"), z("translated"), z("skipped"), "error")


def translate_images(pages: DataFrame, detector: Callable[[DataFrame], DataFrame], recognizer: Callable[[DataFrame], DataFrame], translator: Callable[[DataFrame], DataFrame], eraser: Callable[[DataFrame, DataFrame], DataFrame] | None = None, least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(pages, texts) of page images (page_id, content and what else the pages have).

    Of each page the image with the text of its translated regions erased
    (``eraser`` makes patches of images and boxes; none leaves them), its size, and an error (stage, kind, message) where the image or one of its
    regions failed; failed pages keep their original image and have no texts.
    Of each translated region its text and where it is set (mode, size, items).
    Regions are written once before the plan branches.
    """
    from inkgrid.operators import regions as R

    key = ["page_id", "region_seq"]
    sized = cut_lineage(R.sizes(pages.dropDuplicates(["page_id"])))
    bad = sized.where("error is not null").select("page_id", F.struct(F.lit("load").alias("stage"), F.lit("UnreadableImage").alias("kind"), F.col("error").alias("message")).alias("failed"))
    good = pages.select("page_id", "content").join(sized.where("width is not null").select("page_id", "width", "height"), "page_id")
    prepared = cut_lineage(R.prepare_regions(good, detector(good)))
    read = cut_lineage(recognizer(prepared))
    if "error" in read.columns:
        bad = bad.unionByName(read.where("error is not null").groupBy("page_id").agg(F.min("error").alias("failed")))
        read = read.where("error is null")
    r = prepared.drop("crop").join(read.select(*key, F.col("text").alias("source_text"), "confidence"), key).where("source_text <> ''").join(bad.select("page_id"), "page_id", "left_anti")
    kept, _skipped = candidates(r.withColumn("character_confidences", F.lit(None).cast("array<double>")), least)
    kept = cut_lineage(kept)
    said = translator(kept).select(*key, F.col("translated_text").alias("text"))
    boxes = kept.select(*key, "l", "t", "r", "b")
    bounds = spatial.render_bounds(boxes.select("*", *[F.lit(None).cast("int").alias(f"l{c}") for c in "ltrb"]))
    flat = G.runs_horizontal(Box.of(), F.col("text"), F.lit(False))
    none = boxes.where("false").select(*key, F.lit(0).alias("y"), F.lit(0).alias("x0"), F.lit(0).alias("x1"))
    set_as = F.when(F.col("horizontal"), F.col("text")).otherwise(vertical(F.col("text")))
    texts = R.places(boxes.join(said, key).withColumn("horizontal", flat).withColumn("text", set_as), bounds, none)
    images = R.put_back(good, eraser(good, boxes)) if eraser else good
    out = pages.drop("content").join(sized.select("page_id", "width", "height"), "page_id", "left").join(bad, "page_id", "left")
    done = images.select("page_id", F.col("content").alias("new"))
    out = out.join(pages.select("page_id", "content"), "page_id").join(done, "page_id", "left").withColumn("content", F.when(F.col("failed").isNull(), F.coalesce("new", "content")).otherwise(F.col("content")))
    return out.drop("new"), texts
