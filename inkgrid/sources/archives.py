"""Scans of page files and ZIP archives.

Folders are read with Spark's ``binaryFile`` source (pixels stay unread until
a plan uses them); archives with a Python data source that makes one
partition an archive and yields one row a member. An unreadable archive gives
no rows and is reported in the source's log, so one bad file doesn't stop a
scan.
"""

from __future__ import annotations

import io
import logging
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkgrid.sources.files import SUFFIXES, is_image, number_by_name

log = logging.getLogger(__name__)


def wanted_member(name: str) -> bool:
    """Members that are pages: no folders, hidden files or resource forks, and an image suffix."""
    base = name.rsplit("/", 1)[-1]
    return bool(base) and not base.startswith(".") and not name.startswith("__MACOSX") and os.path.splitext(base)[1].lower() in SUFFIXES


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class ZipPages(DataSource):
    """``spark.read.format("zip_pages").option("path", …)``: rows (archive, member, size, content) of one archive, or of all archives of a folder."""

    @classmethod
    def name(cls) -> str:
        return "zip_pages"

    def schema(self) -> str:
        return "archive string, member string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"], str(self.options.get("content", "true")).lower() == "true")


class ZipReader(DataSourceReader):
    def __init__(self, path: str, content: bool) -> None:
        self.path, self.content = path, content

    def partitions(self) -> list[InputPartition]:
        p = self.path.removeprefix("file:")
        if os.path.isdir(p):
            return [Archive(os.path.join(p, n)) for n in sorted(os.listdir(p)) if n.lower().endswith(".zip")]
        if not os.path.exists(p):
            raise FileNotFoundError(p)
        return [Archive(p)]

    def read(self, partition: Archive) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(partition.path) as z:
                for i in sorted((i for i in z.infolist() if not i.is_dir() and wanted_member(i.filename)), key=lambda i: i.filename.lower()):
                    yield partition.path, i.filename, i.file_size, z.read(i) if self.content else None
        except (zipfile.BadZipFile, OSError) as e:
            log.warning("archive %s can't be read: %s", partition.path, e)


def read_archives(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Members of the archives at a path; with ``content=False`` only the directory of each archive is read."""
    spark.dataSource.register(ZipPages)
    return spark.read.format("zip_pages").option("path", path).option("content", str(content).lower()).load()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, content) of the images right in a folder, archives left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), "content").where(is_image(F.col("name")))


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_seq, name, stem, sub_dir, member, size, content) of an image, an archive or a folder of both, numbered by lower-cased name.

    A missing path is an error; a folder without pages gives no rows.
    """
    p = path.removeprefix("file:")
    if not os.path.exists(p):
        raise FileNotFoundError(p)
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.[^./]*)?$", 1)
    images = read_images(spark, path).select("name", stem(F.col("name")).alias("stem"), F.lit("").alias("sub_dir"), F.lit(None).cast("string").alias("member"), "size", "content")
    parts = []
    if os.path.isdir(p):
        if any(n.lower().endswith(SUFFIXES) for n in os.listdir(p)):
            parts.append(images)
        zips = any(n.lower().endswith(".zip") for n in os.listdir(p))
    else:
        zips = p.lower().endswith(".zip")
        if not zips:
            parts.append(images)
    if zips:
        z = read_archives(spark, p)
        arc = stem(F.col("archive"))
        parts.append(z.select(F.concat(arc, F.lit("/"), F.regexp_extract("member", r"([^/]+)$", 1)).alias("name"), stem(F.col("member")).alias("stem"), arc.alias("sub_dir"), "member", "size", "content"))
    if not parts:
        return spark.createDataFrame([], "name string, stem string, sub_dir string, member string, size bigint, content binary, page_seq bigint")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return number_by_name(out.withColumn("seq", F.xxhash64("name", "member"))).drop("seq")


def build_archive(members: dict[str, bytes]) -> bytes:
    """A ZIP archive of the given members (for tests and samples)."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, c in members.items():
            z.writestr(n, c)
    return buf.getvalue()
