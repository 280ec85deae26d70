"""Queries over whole stages: sources, translator, pipeline, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrid.operators import translate as X
from inkgrid.plans import pipeline
from inkgrid.plans.base import regions, with_regions
from inkgrid.plans.queries_text import _Q, _tidy
from inkgrid.session import cut_lineage, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_DRAWN = {"a.png": (60, 40, []), "B.png": (200, 200, [(10, 10, 24, 24), (140, 140, 154, 154)]), "c.png": (200, 300, [(x, y, x + 15, y + 15) for x in (10, 28) for y in (10, 100, 200)]), "Vol/1.png": (300, 300, [(200, 10, 280, 50), (10, 150, 90, 190)]), "Vol/2.png": (200, 200, [(10, 10, 24, 24), (40, 10, 54, 24)])}


def drawn(s):
    """A folder of page images with black rectangles, some of them in an archive, in the session's shared folder; as ``load_pages`` reads it."""
    import os

    import numpy as np

    from inkgrid.sources import archives, images
    from inkgrid.streaming.runs import folder

    path = folder(s, "pages").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    inner = {}
    for name, (w, h, rects) in _DRAWN.items():
        rgb = np.full((h, w, 3), 255, np.uint8)
        for l, t, r, b in rects:  # noqa: E741
            rgb[t : b + 1, l : r + 1] = 0
        if "/" in name:
            inner[name.partition("/")[2]] = images.encode(rgb)
        else:
            with open(f"{path}/{name}", "wb") as f:
                f.write(images.encode(rgb))
    with open(f"{path}/Vol.zip", "wb") as f:
        f.write(archives.build_archive(inner | {"__MACOSX/3.png": b"x", "notes.txt": b"x"}))
    with open(f"{path}/readme.txt", "w") as f:
        f.write("no page")
    return archives.load_pages(s, path).withColumn("page_id", F.col("name"))


@query("S1_list_pages", "select * from (values ('a.png',1,''),('B.png',2,''),('c.png',3,''),('Vol/1.png',4,'Vol'),('Vol/2.png',5,'Vol')) t(name, page_seq, sub_dir)")
def s1(s, d):
    """Page images of a folder and of the archives in it, in order of their lower-cased names."""
    return drawn(s).select("name", F.col("page_seq").cast("int").alias("page_seq"), "sub_dir")


@query("I6_prepare_regions", "select * from (values ('B.png',2),('c.png',3),('Vol/1.png',2),('Vol/2.png',1)) t(page_id, regions)")
def i6(s, d):
    """Pages split by their ink, overlaps resolved, empty ones dropped, cropped."""
    from inkgrid.operators import regions as R

    p = cut_lineage(drawn(s).select("page_id", "content"))
    boxes = pipeline.build("detector", "ink")(R.sizes(p))
    return R.prepare_regions(p, boxes).groupBy("page_id").agg(F.count("*").cast("int").alias("regions"))


@query("O2_part_order", "select * from (values ('a.png',0,0,0),('B.png',0,2,2),('B.png',1,132,132),('c.png',0,2,2),('c.png',1,2,92),('c.png',2,2,192),('Vol/1.png',0,192,2),('Vol/1.png',1,2,142),('Vol/2.png',0,0,0)) t(page_id, region_seq, l, t)")
def o2(s, d):
    """Parts of a page's ink, numbered from the top and within a row from the right."""
    from inkgrid.operators import regions as R

    p = cut_lineage(drawn(s).select("page_id", "content"))
    return R.split_parts(p, pipeline.build("detector", "ink")(R.sizes(p))).select("page_id", "region_seq", "l", "t")


@query("K1_save_output", "select * from (values ('a.png',60,40),('B.png',200,200),('c.png',200,300),('Vol/1.png',300,300),('Vol/2.png',200,200)) t(page_id, width, height)")
def k1(s, d):
    """Pages written as files and read again: every file has its page."""
    from inkgrid.operators import regions as R
    from inkgrid.sources import archives, sinks
    from inkgrid.streaming.runs import folder

    out = folder(s, "saved").removeprefix("file:")
    p = cut_lineage(drawn(s).select("page_id", F.concat(F.lit(f"{out}/"), F.regexp_replace("page_id", "/", "__")).alias("path"), "content"))
    sinks.write_files(sinks.as_format(p, "png"))
    back = archives.read_images(s, out).select(F.regexp_replace("name", "__", "/").alias("page_id"), "content")
    return R.sizes(back).select("page_id", "width", "height")


@query("C3_translate_images", "select * from (values ('a.png',60,40,0,false),('B.png',200,200,2,false),('c.png',200,300,3,false),('Vol/1.png',300,300,2,false),('Vol/2.png',200,200,1,false)) t(page_id, width, height, texts, dark)")
def c3(s, d):
    """From page images to erased images and placed texts: detection, recognition, translation, erasing, layout."""
    from inkgrid.operators import regions as R
    from inkgrid.sources.images import decode

    done, texts = pipeline.translate_images(drawn(s), *(pipeline.build(*x) for x in (("detector", "ink"), ("recognizer", "number"), ("translator", "stub"), ("eraser", "erase"))))
    n = texts.where("mode <> 'none'").groupBy("page_id").agg(F.count("*").cast("int").alias("texts"))

    def darkest(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([bool(decode(c).min() < 128) for c in b.column("content").to_pylist()])], names=["page_id", "dark"])

    dark = done.select("page_id", "content").mapInArrow(darkest, "page_id string, dark boolean")
    return done.select("page_id", "width", "height").join(n, "page_id", "left").join(dark, "page_id").select("page_id", "width", "height", F.coalesce("texts", F.lit(0)).alias("texts"), "dark")


@query("M2_polygon_fill", with_regions("select page_id, region_seq, min(y)::int as first, count(*)::int as runs, sum(x1-x0)::bigint as px from (select page_id, region_seq, l, t, r, b, y, ceil(cx-hw-0.5)::int as x0, ceil(cx+hw-0.5)::int as x1 from (select page_id, region_seq, l, t, r, b, y, (l+r)/2.0 as cx, (r-l)/2.0*(1-abs(y+0.5-(t+b)/2.0)/((b-t)/2.0)) as hw from R, lateral (select unnest(range(t, b)) as y) u where r>l and b>t) q) z where x0<x1 group by 1,2"))
def m2(s, d):
    """Each box's inscribed diamond, filled: its first line, runs and pixels."""
    from inkgrid.operators import regions as R

    x = regions(s, d).where("r > l and b > t")
    pt = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    cx, cy = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    poly = x.select("page_id", "region_seq", F.array(pt(cx, F.col("t")), pt(F.col("r"), cy), pt(cx, F.col("b")), pt(F.col("l"), cy)).alias("points"))
    return R.polygon_runs(poly).groupBy("page_id", "region_seq").agg(F.min("y").alias("first"), F.count("*").cast("int").alias("runs"), F.sum(F.col("x1") - F.col("x0")).alias("px"))


@query("L12_places")
def l12(s, d):
    """Where each translation is set: the mode chosen, the size and the places of its lines or columns."""
    from inkgrid.functions import geometry as G
    from inkgrid.functions.geometry import Box
    from inkgrid.functions.text import vertical
    from inkgrid.operators import regions as R
    from inkgrid.operators import spatial

    x = cut_lineage(regions(s, d, "layout_bbox", "translated_text").where("translated_text <> ''"))
    bounds = spatial.render_bounds(x.select("page_id", "region_seq", "l", "t", "r", "b", *[F.col(f"layout_bbox.{c}").alias(f"l{c}") for c in "ltrb"]))
    m = table(s, d, "mask_runs").where("kind = 'layout'").select("page_id", "region_seq", "y", "x0", "x1").distinct()
    texts = x.withColumn("horizontal", G.runs_horizontal(Box.of(), F.col("translated_text"), F.col("layout_bbox").isNotNull()))
    texts = texts.withColumn("text", F.when(F.col("horizontal"), F.col("translated_text")).otherwise(vertical(F.col("translated_text"))))
    return R.places(texts, bounds, m).select("page_id", "region_seq", "mode", "size", F.size("items").alias("n"), F.round(F.try_element_at("items", F.lit(1))["x"], 3).alias("x"), F.round(F.try_element_at("items", F.lit(1))["y"], 3).alias("y"))


@query("S5_image_paths", "select page_id, name, row_number() over (order by lower(name), page_seq) as n from pages where lower(regexp_extract(name,'[^/]+(\\.[^./]+)$',1)) in ('.png','.jpg','.jpeg','.webp') and member is null")
def s5(s, d):
    from inkgrid.sources.files import is_image, number_by_name

    x = table(s, d, "pages").where(F.col("member").isNull() & is_image(F.col("name")))
    return number_by_name(x.select("page_id", "name", F.col("page_seq").alias("seq")), "n").select("page_id", "name", "n")


_SAN = "regexp_replace(replace(source_text, chr(10), ' '), '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g')"


@query("T8_translate_stub", with_regions(f"select page_id, region_seq, {_tidy("'T:' || " + _SAN)} as translated_text from R where source_text<>''"))
def t8(s, d):
    """All texts through the ladder with the stand-in model."""
    return pipeline.build("translator", "stub")(regions(s, d, "source_text"))


@query("M4_recognize_stub", with_regions("select page_id, region_seq, regexp_replace(source_text, '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g') as text, confidence from R"))
def m4(s, d):
    x = regions(s, d, "source_text", "confidence").select("page_id", "region_seq", "source_text", "confidence")
    return pipeline.build("recognizer", "stub")(x)


@query("M1_detect_stub", with_regions("select page_id, region_seq, l, t, r, b, det from R"))
def m1(s, d):
    return pipeline.build("detector", "stub")(regions(s, d))


@query("I14_identity", with_regions("select page_id, region_seq from R"))
def i14(s, d):
    return pipeline.build("inpainter", "none")(regions(s, d)).select("page_id", "region_seq")


@query("C1_postprocess")
def c1(s, d):
    from inkgrid.plans.queries_spatial import _runs, _segments, _texts

    return pipeline.postprocess(_texts(s, d), _segments(s, d), _runs(s, d))


@query("C4_pipeline", with_regions("select p.page_id, p.page_seq, count(*) filter (where Q.page_id is not null and (score is null or score>=0.75)) as regions, count(*) filter (where (score is null or score>=0.75) and (R.translated_text is not null or R.source_text<>'')) as translated, count(*) filter (where score<0.75) as skipped, any_value(p.error.stage) as failed from pages p left join R on R.page_id=p.page_id and p.error is null left join Q on Q.page_id=R.page_id and Q.region_seq=R.region_seq group by 1,2", _Q))
def c4(s, d):
    """Every page once, with what each branch did; failed pages keep their error."""
    x = regions(s, d, "source_text", "translated_text", "confidence", "character_confidences")
    out = pipeline.run(table(s, d, "pages"), x, pipeline.build("translator", "stub"), pipeline.build("inpainter", "none"))
    return out.select("page_id", "page_seq", "regions", "translated", "skipped", F.col("error.stage").alias("failed"))


_HAS = "H as (select page_id, count(*) as lines from R where translated_text is not null and translated_text<>'' group by 1)"


@query("W1_context_stream", with_regions("select p.page_id, p.page_seq, last_value(case when H.page_id is not null then p.page_seq end ignore nulls) over (partition by p.sub_dir order by p.page_seq rows between unbounded preceding and 1 preceding) as context_seq from pages p left join H using (page_id)", _HAS))
def w1s(s, d):
    """The carried context by a stateful stream, in several batches of pages."""
    from inkgrid.streaming import runs as S

    has = regions(s, d, "translated_text").where("translated_text <> ''").select("page_id").distinct().withColumn("has", F.lit(True))
    p = S.in_files(table(s, d, "pages").select("page_id", "page_seq", "sub_dir"), "page_seq")
    x = p.join(has, "page_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return S.run_to_table(S.carry_context(x), s, "context").select("page_id", "page_seq", "context_seq")


@query("stream_first_deliveries", "select distinct region_id, page_id, region_seq from regions")
def sfd(s, d):
    """Each region once, over several batches; deliveries here come up to a month late, so that is how long state is kept."""
    from inkgrid.streaming import runs as S

    x = S.in_files(table(s, d, "regions").select("region_id", "page_id", "region_seq", "received_at"), "received_at")
    return S.run_to_table(S.first_deliveries(x, "31 days").select("region_id", "page_id", "region_seq"), s, "deliveries")
