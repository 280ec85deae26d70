"""Outputs: paths, page offsets of a scroll view, failure counts, image and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.operators.context import running_sum


def output_path(root: str, sub_dir: Column, member: Column, stem: Column, fmt: str) -> Column:
    """Path of a page's output. Equal stems of one folder can't collide: an archive member's path is part of the name."""
    if fmt not in ("png", "jpg", "jpeg", "parquet"):
        raise ValueError(f"unknown output format {fmt!r}")
    inner = F.when(member.isNotNull(), F.concat(F.replace(member, F.lit("/"), F.lit("_")), F.lit("__"))).otherwise(F.lit(""))
    return F.concat(F.lit(f"{root}/"), sub_dir, F.lit("/"), inner, stem, F.lit(f"_translated.{fmt}"))


def viewer_offsets(pages: DataFrame, viewport_width: int, gap: int = 10) -> DataFrame:
    """Pages of each volume with scaled height ``h`` and running offset ``y``; pages without a size are left out."""
    x = pages.where("width is not null and height is not null")
    h = F.greatest(F.lit(1), F.bround(F.col("height") * F.least(F.lit(1.0), F.lit(float(viewport_width)) / F.col("width")), 0).cast("int"))
    x = running_sum(x.withColumn("h", h), F.col("h") + gap, "sub_dir", "page_seq", "y")
    return x.withColumn("y", F.col("y").cast("long"))


def visible(offsets: DataFrame, scroll_y: int, viewport_height: int) -> DataFrame:
    """Pages within one viewport above and below the visible one."""
    return offsets.where((F.col("y") + F.col("h") >= scroll_y - viewport_height) & (F.col("y") <= scroll_y + 2 * viewport_height))


def failure_counts(pages: DataFrame) -> DataFrame:
    """(stage, pages): pages by the stage that failed, 'ok' for those without an error."""
    return pages.groupBy(F.coalesce("error.stage", F.lit("ok")).alias("stage")).agg(F.count("*").alias("pages"))


def dead_letters(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, failed) pages by their error column."""
    return pages.where("error is null"), pages.where("error is not null")


def write_tables(df: DataFrame, path: str) -> None:
    """Parquet by volume; a write that is repeated replaces what was there."""
    df.write.mode("overwrite").partitionBy("sub_dir").parquet(path)


def write_files(df: DataFrame, path_col: str = "path", content_col: str = "content") -> None:
    """Write bytes to files on a folder that all workers mount, a partition at a time; existing files are replaced, so a retried task gives the same result. Null contents are left out."""
    import os

    def put(rows):
        for r in rows:
            if r[content_col] is None:
                continue
            os.makedirs(os.path.dirname(r[path_col]) or ".", exist_ok=True)
            tmp = f"{r[path_col]}.part"
            with open(tmp, "wb") as f:
                f.write(r[content_col])
            os.replace(tmp, r[path_col])

    df.select(path_col, content_col).foreachPartition(put)


def overlay(regions: DataFrame) -> DataFrame:
    """Boxes a debug view draws: text box, layout box and inpaint box of each region, with their colours."""
    box = lambda c, col, kind: F.struct(F.lit(kind).alias("kind"), F.lit(col).alias("color"), F.col(f"{c}.l").alias("l"), F.col(f"{c}.t").alias("t"), F.col(f"{c}.r").alias("r"), F.col(f"{c}.b").alias("b"))
    rows = F.array(box("bbox", "blue", "text"), box("layout_bbox", "green", "layout"), box("inpaint_bbox", "red", "inpaint"))
    return regions.select("page_id", "region_seq", F.explode(rows).alias("x")).select("page_id", "region_seq", "x.*").where("l is not null")


def as_format(images: DataFrame, fmt: str, quality: int = 95) -> DataFrame:
    """Rows (page_id, path, content) with ``content`` (PNG bytes) in the wanted format; JPEG needs an image library in the workers."""
    if fmt == "png":
        return images
    if fmt not in ("jpg", "jpeg"):
        raise ValueError(f"unknown image format {fmt!r}")

    def run(batches):
        import io

        import pyarrow as pa
        from PIL import Image

        for b in batches:
            out = []
            for content in b.column("content").to_pylist():
                buf = io.BytesIO()
                Image.open(io.BytesIO(content)).convert("RGB").save(buf, "JPEG", quality=quality)
                out.append(buf.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("path"), pa.array(out, pa.binary())], names=["page_id", "path", "content"])

    return images.where("content is not null").select("page_id", "path", "content").mapInArrow(run, "page_id string, path string, content binary")


def debug_images(images: DataFrame, texts: DataFrame, fmt: str) -> DataFrame:
    """Images with a small box drawn at the place of each line of text; pages without text as they are."""
    at = texts.select("page_id", F.explode("items").alias("i"), "size").select("page_id", F.struct(F.col("i.x").cast("int").alias("x"), F.col("i.y").cast("int").alias("y"), "size").alias("s"))
    marks = at.groupBy("page_id").agg(F.collect_list("s").alias("marks"))

    def run(batches):
        import pyarrow as pa

        from inkgrid.operators.kernels import draw_boxes
        from inkgrid.sources.images import decode, encode

        for b in batches:
            out = []
            for content, marks in zip(b.column("content").to_pylist(), b.column("marks").to_pylist(), strict=True):
                rgb = decode(content)
                h, w = rgb.shape[:2]
                boxes = [((max(0, m["x"]), max(0, m["y"]), min(w, m["x"] + m["size"]), min(h, m["y"] + m["size"])), (0, 0, 255)) for m in marks or ()]
                out.append(encode(draw_boxes(rgb, [], [x for x in boxes if x[0][2] - x[0][0] >= 4 and x[0][3] - x[0][1] >= 4])))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("path"), pa.array(out, pa.binary())], names=["page_id", "path", "content"])

    x = images.where("content is not null").join(marks, "page_id", "left").select("page_id", "path", "content", "marks")
    return as_format(x.mapInArrow(run, "page_id string, path string, content binary"), fmt)
