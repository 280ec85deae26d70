"""python -m inkgrid --file PATH | --dir PATH: translate page images and write pages, texts and images by volume.

Exit code 1 if there is no page, the set-up fails or a page failed; pages that
fail don't stop the others.
"""

from __future__ import annotations

import argparse
import logging
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkgrid")
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("--file")
    g.add_argument("--dir")
    p.add_argument("--debug", action="store_true", help="log each region and write images with its box drawn in")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.debug else logging.WARNING, format="%(levelname)s: %(message)s")

    from pyspark.sql import functions as F

    from inkgrid.config import SettingError, Settings
    from inkgrid.operators import chat_model, translate  # noqa: F401  (they register their plug-ins)
    from inkgrid.plans import pipeline
    from inkgrid.session import cut_lineage, get_spark
    from inkgrid.sources import archives, sinks

    try:
        settings = Settings.load()
        spark = get_spark()
        pages = archives.load_pages(spark, a.file or a.dir)
        named = {"url": settings.model_url, "model": settings.model_name, "source": settings.source_language, "target": settings.target_language} if settings.translator == "chat" else {}
        stages = [pipeline.build(s, n, **o) for s, n, o in (("detector", settings.detector, {}), ("recognizer", settings.recognizer, {}), ("translator", settings.translator, named), ("eraser", settings.inpainter, {}))]
    except (SettingError, FileNotFoundError, ValueError) as e:
        logging.error("set-up failed: %s", e)
        return 1
    pages = cut_lineage(pages.withColumn("page_id", F.concat_ws("/", F.when(F.col("sub_dir") != "", F.col("sub_dir")), F.coalesce("member", "name"))))
    if pages.isEmpty():
        logging.error("no pages in %s", a.file or a.dir)
        return 1
    done, texts = pipeline.translate_images(pages, *stages, least=settings.min_quality)
    done, texts = cut_lineage(done), cut_lineage(texts)
    sinks.write_tables(done.drop("content"), f"{settings.output_dir}/pages")
    sinks.write_tables(texts.join(done.select("page_id", "sub_dir"), "page_id"), f"{settings.output_dir}/texts")
    if settings.output_format != "parquet":
        path = sinks.output_path(settings.output_dir, F.col("sub_dir"), F.col("member"), F.col("stem"), settings.output_format)
        images = done.where("failed is null").select("page_id", path.alias("path"), "content")
        sinks.write_files(sinks.as_format(images, settings.output_format))
        if a.debug:
            sinks.write_files(sinks.debug_images(images.withColumn("path", F.regexp_replace("path", r"\.(\w+)$", "_debug.$1")), texts, settings.output_format))
    for r in sinks.failure_counts(done.withColumn("error", F.col("failed"))).collect():  # a row a stage
        if r["stage"] != "ok":
            logging.error("%d pages failed in stage %s", r["pages"], r["stage"])
    return 0 if done.where("failed is not null").isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main())
