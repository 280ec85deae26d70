"""Incremental runs with Structured Streaming.

Pages and regions arrive as files. A run takes what is there
(``availableNow``) or goes on; ``maxFilesPerTrigger`` takes the place of
bounded queues, ``query.stop()`` that of a cancel flag, and an error column
with a dead-letter output that of per-page isolation. Checkpoints lie in the
session's shared folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkgrid.session import scratch


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for checkpoints or results, under ``spark.checkpoint.dir`` where that is set; a temporary one on a single machine, removed when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = scratch("streams")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A table's files as a stream; new files are picked up, ``files_per_trigger`` at a time."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a single file is named by a pattern, a folder of files by itself
    path = f"{sf_dir}/{name}.parquet" if os.path.isdir(f"{sf_dir}/{name}.parquet") else f"{sf_dir}/{name}*.parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def in_files(df: DataFrame, by: str, n: int = 4) -> DataFrame:
    """A table as a stream of ``n`` batches in order of a column (nulls last), by way of files in the session's shared folder."""
    spark = df.sparkSession
    out = folder(spark, "files")
    key = F.col(by).cast("double")
    cuts = sorted(set(df.select(key.alias("k")).where("k is not null").approxQuantile("k", [i / n for i in range(1, n)], 0.01)))
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        here = (key > lo if lo is not None else F.lit(True)) & (key <= hi if hi is not None else F.lit(True))
        part = df.where(F.coalesce(here, F.lit(False)) if hi is not None else here | F.col(by).isNull())
        part.coalesce(1).write.mode("append").parquet(out)  # one after the other: a file source goes by their times
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(out)


def stream_images(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Page images of a folder as they appear."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def first_deliveries(regions: DataFrame, delay: str = "14 days") -> DataFrame:
    """Regions once each: a later delivery within the delay is dropped; state older than the delay is let go."""
    return regions.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["region_id"])


def carry_context(pages: DataFrame) -> DataFrame:
    """(page_id, page_seq, sub_dir, context_seq): context carried through a stream of pages (with a flag ``has``) per volume.

    The state of a volume is one number, the latest page that had
    translations. Within a batch pages go by page_seq; a page that comes after
    later ones sees the context of the pages before it in the stream.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values("page_seq", kind="stable")
        seen = []
        for seq, has in zip(rows["page_seq"].tolist(), rows["has"].tolist(), strict=True):
            seen.append(last)
            last = seq if has else last
        if last is not None:
            state.update((last,))
        out = rows[["page_id", "page_seq", "sub_dir"]].copy()
        out["context_seq"] = pd.array(seen, dtype="Int64")
        yield out

    return pages.groupBy("sub_dir").applyInPandasWithState(step, "page_id string, page_seq long, sub_dir string, context_seq long", "last long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream over all that is there now, in append mode, and read back what it wrote."""
    out, ckpt = folder(spark, f"{name}-out"), folder(spark, f"{name}-ckpt")
    q = df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_until(df: DataFrame, spark: SparkSession, name: str, cancelled: Callable[[], bool], every: float = 0.2) -> tuple[str, DataFrame]:
    """('done' | 'cancelled', what was written): run a stream over all that is there, and stop it once ``cancelled()`` says so.

    A batch that is under way is given up and leaves nothing behind; those
    before it are whole. A later run with the same checkpoint would go on there.
    """
    out, ckpt = folder(spark, f"{name}-out"), folder(spark, f"{name}-ckpt")
    q = df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    state = "done"
    while not q.awaitTermination(every):
        if cancelled():
            q.stop()
            state = "cancelled"
            break
    os.makedirs(out.removeprefix("file:"), exist_ok=True)
    return state, spark.read.schema(df.schema).parquet(out)


def run_isolated(df: DataFrame, spark: SparkSession, stage: Callable[[DataFrame], DataFrame], out: str, dead: str, ckpt: str | None = None):
    """Run a stage batch by batch; rows with an error go to ``dead``, the others through the stage to ``out``.

    Each batch is written under its number, so a batch that is run again
    after a failure replaces its own output. An error raised by the stage
    (a lost connection) fails the query.
    """

    def batch(b: DataFrame, number: int) -> None:
        b.persist()
        try:
            stage(b.where("error is null")).write.mode("overwrite").parquet(f"{out}/batch={number}")
            b.where("error is not null").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            b.unpersist()

    q = df.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt or folder(spark, "isolated")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def page_progress(pages: DataFrame) -> DataFrame:
    """(window, stage, pages): pages by load time and outcome in windows of a day; windows close a week after their end."""
    w = pages.withWatermark("loaded_at", "7 days").groupBy(F.window("loaded_at", "1 day"), F.coalesce("error.stage", F.lit("ok")).alias("stage"))
    return w.agg(F.count("*").alias("pages")).select(F.col("window.start").alias("day"), "stage", "pages")
