import os

import pytest
from pyspark.sql import functions as F

from inkgrid.operators import context, detect, masks as M, translate as X
from inkgrid.plans import pipeline
from inkgrid.sources import archives, files, sinks
from inkgrid.streaming import runs


def test_archives_and_folders(spark, tmp_path):
    (tmp_path / "Vol.zip").write_bytes(archives.build_archive({"001.jpg": b"a", "sub/002.PNG": b"bb", "__MACOSX/003.jpg": b"x", ".hidden.png": b"x", "notes.txt": b"x", "d/": b""}))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "b.webp").write_bytes(b"ccc")
    (tmp_path / "A.jpeg").write_bytes(b"d")
    (tmp_path / "readme.md").write_bytes(b"e")
    got = archives.load_pages(spark, str(tmp_path)).orderBy("page_seq").collect()
    assert [(r["page_seq"], r["name"], r["member"]) for r in got] == [(1, "A.jpeg", None), (2, "b.webp", None), (3, "Vol/001.jpg", "001.jpg"), (4, "Vol/002.PNG", "sub/002.PNG")]
    assert bytes(got[3]["content"]) == b"bb" and got[2]["sub_dir"] == "Vol"
    assert archives.read_archives(spark, str(tmp_path / "Vol.zip"), content=False).where("content is null").count() == 2
    with pytest.raises(FileNotFoundError):
        archives.load_pages(spark, str(tmp_path / "none"))
    os.mkdir(tmp_path / "empty")
    assert archives.load_pages(spark, str(tmp_path / "empty")).count() == 0


def test_numbering_is_total_and_stable(spark):
    df = spark.range(500).select(F.concat(F.lit("P"), F.col("id") % 50).alias("name"), (-F.col("id")).alias("seq")).repartition(7)
    got = [(r["n"], r["name"], r["seq"]) for r in files.number_by_name(df, "n").orderBy("n").collect()]
    assert [g[0] for g in got] == list(range(1, 501)) and got == sorted(got, key=lambda g: (g[1].lower(), g[2]))


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("v", "x/a.png", "a"), ("v", None, "a")], "sub_dir string, member string, stem string")
    paths = [r[0] for r in df.select(sinks.output_path("out", F.col("sub_dir"), F.col("member"), F.col("stem"), "jpg")).collect()]
    assert paths == ["out/v/x_a.png__a_translated.jpg", "out/v/a_translated.jpg"]
    with pytest.raises(ValueError):
        sinks.output_path("o", F.lit("a"), F.lit("b"), F.lit("c"), "gif")
    files_df = spark.createDataFrame([(str(tmp_path / "o" / "x.jpg"), bytearray(b"1")), (str(tmp_path / "o" / "y.jpg"), None)], "path string, content binary")
    sinks.write_files(files_df)
    assert os.listdir(tmp_path / "o") == ["x.jpg"]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id string, page_seq long, sub_dir string, error struct<stage:string,kind:string,message:string>")


def regions(spark, rows):
    return spark.createDataFrame(rows, "page_id string, region_seq int, source_text string, translated_text string, confidence double, character_confidences array<double>, l int, t int, r int, b int")


def test_context(spark):
    p = pages(spark, [(f"p{i}", i, "v", None) for i in range(4)] + [("q", 9, "w", None)])
    r = regions(spark, [("p0", 0, "s", "a", None, None, 0, 0, 1, 1), ("p2", 0, "s", "c", None, None, 0, 0, 1, 1), ("p3", 0, "s", "", None, None, 0, 0, 1, 1)])
    got = {x["page_id"]: x["context_seq"] for x in context.carry(p, r).collect()}
    assert got == {"p0": None, "p1": 0, "p2": 0, "p3": 2, "q": None}
    assert {x["page_id"]: x["context_seq"] for x in context.carry(p, r, -1).collect()}["p0"] == -1
    lines = {(x["page_id"], x["translated_text"]) for x in context.context_lines(context.carry(p, r), r).collect()}
    assert lines == {("p1", "a"), ("p2", "a"), ("p3", "c")}


def test_context_stream_in_several_batches(spark, tmp_path):
    rows = [("p0", 0, "v", True), ("p1", 1, "v", False), ("p2", 2, "v", True), ("p3", 3, "v", False), ("q0", 0, "w", False)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "page_id string, page_seq long, sub_dir string, has boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    s = spark.readStream.schema("page_id string, page_seq long, sub_dir string, has boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = {r["page_id"]: r["context_seq"] for r in runs.run_to_table(runs.carry_context(s), spark, "t").collect()}
    assert got == {"p0": None, "p1": 0, "p2": 0, "p3": 2, "q0": None}


def test_isolated_run(spark, tmp_path):
    pages(spark, [("a", 0, "v", None), ("b", 1, "v", ("OCR", "load", "bad")), ("c", 2, "v", None)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    runs.run_isolated(s, spark, lambda df: df.select("page_id"), str(tmp_path / "out"), str(tmp_path / "dead"))
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("page_id").collect()} == {"a", "c"}
    assert spark.read.parquet(str(tmp_path / "dead")).select("page_id").collect()[0][0] == "b"

    def lost(_df):
        raise X.ConnectionLost("gone")

    with pytest.raises(Exception, match="gone"):
        runs.run_isolated(s, spark, lost, str(tmp_path / "o2"), str(tmp_path / "d2"))


def test_pipeline(spark):
    p = pages(spark, [("a", 0, "v", None), ("b", 1, "v", ("OCR", "load", "bad")), ("c", 2, "v", None)])
    r = regions(spark, [("a", 0, "good", None, 0.95, None, 0, 0, 9, 9), ("a", 1, "weak", None, 0.10, None, 20, 0, 29, 9), ("a", 2, "kept", "done", None, None, 40, 0, 49, 9), ("b", 0, "lost", None, 0.9, None, 0, 0, 9, 9)])
    out = {x["page_id"]: x for x in pipeline.run(p, r, pipeline.build("translator", "stub"), pipeline.build("inpainter", "none"), 0.5).collect()}
    assert (out["a"]["regions"], out["a"]["translated"], out["a"]["skipped"]) == (2, 2, 1)
    assert out["b"]["error"]["stage"] == "OCR" and out["b"]["regions"] == 0 and out["c"]["regions"] == 0
    with pytest.raises(ValueError, match="known: none"):
        pipeline.build("inpainter", "magic")


def test_postprocess_of_a_strip(spark):
    cols = "page_id string, region_seq int, l int, t int, r int, b int, det double"
    t = spark.createDataFrame([("p", 0, 0, 0, 10, 100, 0.9), ("p", 1, 0, 105, 10, 205, 0.8)], cols)
    s = spark.createDataFrame([("p", 0, 0, 0, 10, 205, 0.7)], cols)
    got = sorted(tuple(r)[2:] for r in pipeline.postprocess(t, s).select("page_id", "region_seq", "l", "t", "r", "b").collect())
    assert got == [(0, 0, 10, 100), (0, 105, 10, 205)]


def test_zip_strict(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2])], "x array<string>, y array<int>")
    assert [(r["i"], r["a"], r["b"]) for r in pipeline.zip_strict(df, F.col("x"), F.col("y")).collect()] == [(0, "a", 1), (1, "b", 2)]
    bad = spark.createDataFrame([(["a"], [1, 2])], "x array<string>, y array<int>")
    with pytest.raises(Exception, match="differ in length"):
        pipeline.zip_strict(bad, F.col("x"), F.col("y")).collect()


def test_detector_classes(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.2)], "class_id int, det double")
    assert detect.of_class(df, {0: "Text", 1: "frame"}, "text").count() == 1
    with pytest.raises(ValueError):
        detect.of_class(df, {0: "frame"}, "text")


def test_masks_join_overlapping_runs(spark):
    r = spark.createDataFrame([("p", 1, 0, 0, 5), ("p", 1, 0, 3, 8), ("p", 1, 0, 3, 8), ("p", 1, 1, 2, 2), ("p", 1, 2, 4, 6), (None, 1, 0, 0, 9)], "page_id string, region_seq int, y int, x0 int, x1 int")
    assert [(x["area"], x["l"], x["t"], x["r"], x["b"]) for x in M.area(r).collect()] == [(10, 0, 0, 8, 3)]
    assert M.area(r.where("false")).count() == 0


def test_lineage_needs_a_shared_folder_on_a_cluster(spark):
    from inkgrid.session import cut_lineage

    assert cut_lineage(spark.range(3)).count() == 3


def test_deliveries_over_several_batches(spark):
    """A repeat in a later batch within the delay is dropped; state older than the delay is let go, and so is a row that late."""
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1)
    rows = [(i, t + timedelta(days=i)) for i in range(40)] + [(5, t + timedelta(days=7)), (39, t + timedelta(days=39, hours=3))]
    s = runs.in_files(spark.createDataFrame(rows, "region_id long, received_at timestamp"), "received_at", 5)
    got = sorted(r["region_id"] for r in runs.run_to_table(runs.first_deliveries(s, "10 days"), spark, "t").collect())
    assert got == list(range(40))


def test_cancelled_stream_leaves_whole_batches(spark):
    rows = spark.range(40).select("id", F.col("id").cast("string").alias("s"))
    state, out = runs.run_until(runs.in_files(rows, "id", 4), spark, "t", lambda: False)
    assert state == "done" and out.count() == 40
    state, out = runs.run_until(runs.in_files(rows, "id", 4), spark, "t", lambda: True, 0.01)
    assert state == "cancelled" and out.count() % 10 == 0 and out.count() < 40
