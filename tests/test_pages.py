"""Page images end to end: archives, parts by ink, crops, erasing, output files, command line."""

import json
import os
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.operators import chat_model, kernels as K, layout as L, regions as R, translate as X
from inkgrid.plans import pipeline
from inkgrid.sources import archives, images as I


def page(w, h, *rects, ground=255):
    """A white page with black rectangles; their end pixels belong to them."""
    rgb = np.full((h, w, 3), ground, np.uint8)
    for l, t, r, b in rects:  # noqa: E741
        rgb[t : b + 1, l : r + 1] = 0
    return rgb


def squares(xs, ys, size):
    return [(x, y, x + size, y + size) for x in xs for y in ys]


PAGES = {
    "two corners": (page(200, 200, (10, 10, 24, 24), (140, 140, 154, 154)), 2),
    "near": (page(200, 200, (10, 10, 24, 24), (40, 10, 54, 24)), 1),
    "far": (page(200, 200, (10, 10, 24, 24), (120, 10, 134, 24)), 2),
    "three rows": (page(200, 300, *[(x, y, x + 15, y + 15) for x in (10, 28) for y in (10, 100, 200)]), 3),
    "diagonal": (page(300, 300, (200, 10, 280, 50), (10, 150, 90, 190)), 2),
    "upright gap": (page(300, 500, *[(140, y, 168, y + 28) for y in (30, 70, 110, 280, 320, 360)]), 2),
    "two columns apart": (page(400, 300, *[(x, y, x + 28, y + 28) for x in (50, 240) for y in range(50, 211, 40)]), 2),
}


@pytest.mark.parametrize("name", PAGES)
def test_parts_by_ink(name):
    rgb, parts = PAGES[name]
    assert len(K.split_by_ink(K.grey(rgb))) == parts


def test_png_round_trip_and_filters():
    rnd = np.random.default_rng(1)
    for shape in ((1, 1, 3), (7, 5, 3), (40, 33, 3)):
        rgb = rnd.integers(0, 256, shape, dtype=np.uint8)
        assert (I.decode(I.encode(rgb)) == rgb).all()
    # each line with another filter, made by hand
    import struct
    import zlib

    rgb = rnd.integers(0, 256, (5, 6, 3), dtype=np.uint8).astype(int)
    raw = b""
    for y in range(5):
        line, up = rgb[y].reshape(-1), rgb[y - 1].reshape(-1) if y else np.zeros(18, int)
        left, corner = np.concatenate([np.zeros(3, int), line[:-3]]), np.concatenate([np.zeros(3, int), up[:-3]])
        base = left + up - corner
        paeth = np.where((abs(base - left) <= abs(base - up)) & (abs(base - left) <= abs(base - corner)), left, np.where(abs(base - up) <= abs(base - corner), up, corner))
        guess = (0 * line, left, up, (left + up) // 2, paeth)[y]
        raw += bytes([y]) + ((line - guess) & 255).astype(np.uint8).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (I.decode(data) == rgb).all()
    for bad in (b"", b"no image", data[:40], b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(I.UnreadableImage):
            I.decode(bad)


def frame(spark, pages):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None, "x") for k, v in pages.items()], "page_id string, content binary, error string")


def whole(pages):
    return [(k, 0, 0, 0, v.shape[1], v.shape[0], 1.0) for k, v in pages.items()]


BOX = "page_id string, region_seq int, l int, t int, r int, b int, det double"


def test_prepare_regions(spark):
    shown = {k: v for k, (v, _n) in PAGES.items()} | {"blank": page(60, 60)}
    df = frame(spark, {k: I.encode(v) for k, v in shown.items()} | {"broken": b"x", "none": None})
    boxes = spark.createDataFrame([*whole(shown), ("broken", 0, 0, 0, 9, 9, 1.0), ("none", 0, 0, 0, 9, 9, 1.0), ("far", 1, 500, 500, 600, 600, 1.0), ("far", 2, None, 0, 1, 1, 1.0)], BOX)
    got = R.prepare_regions(df, boxes).collect()
    n = {}
    for r in got:
        n[r["page_id"]] = n.get(r["page_id"], 0) + 1
        crop = I.decode(bytes(r["crop"]))
        assert crop.shape[:2] == (r["b"] - r["t"], r["r"] - r["l"]) and (crop == shown[r["page_id"]][r["t"] : r["b"], r["l"] : r["r"]]).all()
    parts = R.split_parts(df, boxes).groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in parts} == {k: c for k, (_v, c) in PAGES.items()} | {"blank": 1}
    assert n == {k: c for k, (_v, c) in PAGES.items()}
    assert R.prepare_regions(df.where("false"), boxes).count() == R.prepare_regions(df, boxes.where("false")).count() == 0
    sizes = {r["page_id"]: (r["width"], r["height"], r["error"] is None) for r in R.sizes(df).collect()}
    assert sizes["blank"] == (60, 60, True) and sizes["broken"] == (None, None, False) and sizes["none"] == (None, None, True)


def test_erase_and_put_back(spark):
    cream = np.full((60, 60, 3), (210, 200, 190), np.uint8)
    cream[25:35, 25:35] = 20
    df = frame(spark, {"c": I.encode(cream), "z": b"broken"})
    boxes = spark.createDataFrame([("c", 0, 20, 20, 40, 40, 1.0), ("z", 0, 0, 0, 5, 5, 1.0)], BOX)
    patches = R.erased(df, boxes)
    assert all(abs(a - b) <= 2 for a, b in zip(patches.first()["color"], (210, 200, 190), strict=True))
    got = {r["page_id"]: bytes(r["content"]) for r in R.put_back(df, patches).collect()}
    after = I.decode(got["c"])
    assert got["z"] == b"broken" and abs(after.astype(int) - (210, 200, 190)).max() <= 3


def test_polygon_runs_against_pixel_centres(spark):
    rnd = np.random.default_rng(4)
    polys = [[(float(x), float(y)) for x, y in rnd.uniform(0, 30, (n, 2))] for n in (3, 4, 5, 7)] + [[(0.0, 0.0), (10.0, 0.0), (10.0, 8.0), (0.0, 8.0)]]
    rows = [("p", i, [{"x": x, "y": y} for x, y in p], 25, 20) for i, p in enumerate(polys)] + [("p", 90, None, 25, 20), ("p", 91, [{"x": 1.0, "y": 1.0}], 25, 20)]
    df = spark.createDataFrame(rows, "page_id string, region_seq int, points array<struct<x:double,y:double>>, width int, height int")
    got = {i: set() for i in range(len(polys))}
    for r in R.polygon_runs(df).collect():
        got[r["region_seq"]] |= {(x, r["y"]) for x in range(r["x0"], r["x1"])}

    def inside(p, x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
            if min(ay, by) <= y < max(ay, by) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                hit = not hit
        return hit

    for i, p in enumerate(polys):
        assert got[i] == {(x, y) for x in range(31) for y in range(31) if inside(p, x + 0.5, y + 0.5)}
    box = {r["region_seq"]: (r["l"], r["t"], r["r"], r["b"]) for r in R.polygon_boxes(df).collect()}
    assert box[4] == (0, 0, 10, 8) and set(box) <= set(range(5))
    assert R.polygon_runs(df.where("false")).count() == 0


def test_largest_rectangle_of_blocks():
    """The first of the largest in order of their last lines; equal lines and columns are searched once (121,806 calls before, 69 after)."""
    rnd = np.random.default_rng(3)
    for _ in range(60):
        mask = np.repeat(np.repeat(rnd.random((rnd.integers(1, 5), rnd.integers(1, 5))) < 0.7, 2, axis=0), 2, axis=1)
        h, w = mask.shape
        every = [((b - t) * (r - l), (l, t, r - l, b - t)) for b in range(1, h + 1) for t in range(b) for l in range(w) for r in range(l + 1, w + 1) if mask[t:b, l:r].all()]
        got = K.largest_rectangle(mask)
        if not every:
            assert got is None
            continue
        most = max(a for a, _ in every)
        assert (most, got) in every and got[1] + got[3] == min(x[1] + x[3] for a, x in every if a == most)
    mask, calls = np.ones((300, 200), bool), []
    mask[:40, :50] = False
    sys.setprofile(lambda _frame, event, _arg: calls.append(event) if "call" in event else None)
    try:
        got = K.largest_rectangle(mask)
    finally:
        sys.setprofile(None)
    assert got == (0, 40, 200, 260) and len(calls) < 2000


def test_places():
    mode, size, items = R.place("Hello there, captain.", (0, 0, 300, 80), True, [])
    assert mode == "horizontal" and all(0 <= i["x"] and i["y"] + size <= 80 for i in items) and "".join(i["text"] for i in items).split() == ["Hello", "there,", "captain."]
    mode, size, items = R.place("船長は古い水車小屋へ行った。", (100, 50, 260, 350), False, [])
    assert mode == "rectangle" and "".join(i["text"] for i in items) == "船長は古い水車小屋へ行った。" and all(100 <= i["x"] <= 260 - size for i in items)
    disc = [(y, int(80 - (80**2 - (y - 80) ** 2) ** 0.5), int(80 + (80**2 - (y - 80) ** 2) ** 0.5)) for y in range(160) if abs(y - 80) < 80]
    ell = [(y, 0, 160) for y in range(40)] + [(y, 120, 160) for y in range(40, 240)]
    assert R.place("船長は行った。", (0, 0, 160, 160), False, disc)[0] in ("rectangle", "mask")
    mode, _size, items = R.place("船長は行った。", (0, 0, 160, 240), False, ell)
    assert mode == "mask" and "".join(i["text"] for i in items) == "船長は行った。"
    assert R.place("とても長い文章。" * 40, (0, 0, 20, 20), False, [])[0] == "fallback" and R.place("  ", (0, 0, 9, 9), True, [])[0] == "none"
    assert R.place("word " * 300, (0, 0, 30, 20), True, [])[0] == "fallback"


@pytest.mark.parametrize("chars,caps", [("船長は古い水車小屋", [4, 4, 4]), ("abc def。ghij", [5, 6, 4]), ("「船長」、行く。", [3, 3, 3]), ("あいうえおか", [6]), ("あいうえ", [3, 3]), ("word船長word", [4, 4, 4, 4])])
def test_by_capacity_against_all_ways(chars, caps):
    import itertools

    n, k = len(chars), len(caps)
    best = None
    for cuts in itertools.combinations(range(1, n), k - 1):
        at = [0, *cuts, n]
        if any(b - a > c for a, b, c in zip(at, at[1:], caps, strict=False)):
            continue
        words = sum(L.latin(chars[q - 1]) and L.latin(chars[q]) for q in cuts)
        rules = sum(not L.may_break(chars, q) for q in cuts)
        cost = (words, rules, round(sum((b - a - n / k) ** 2 for a, b in zip(at, at[1:], strict=False)), 6), cuts)
        best = min(best or cost, cost)
    got = L.by_capacity(chars, caps)
    if best is None or (k > 1 and n <= 4):
        assert got is None
    else:
        assert got == [chars[a:b] for a, b in zip([0, *best[3]], [*best[3], n], strict=True)]


# --- a chat server --------------------------------------------------------------------------------


@pytest.fixture
def server():
    """A server on this machine whose answers are set by the test."""
    state = {"answers": [], "seen": []}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            state["seen"].append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            code, body = state["answers"].pop(0) if state["answers"] else (200, json.dumps({"message": {"content": "fine"}}))
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}/chat", state
    s.shutdown()


def test_chat_model(server):
    url, state = server
    ask = chat_model.asker(url, "m", "sys", "ja", "en", timeout=5)
    state["answers"] = [(200, json.dumps({"message": {"content": "```\n[1] One\n[2] Two\n```"}}))]
    assert X.translate(["a", "b"], "ctx", ask) == ["One", "Two"]
    sent = state["seen"][0]
    assert sent["options"] == {"temperature": 0.3, "top_p": 0.8, "num_ctx": 4096, "num_predict": 256} and sent["messages"][0] == {"role": "system", "content": "sys"} and "ctx" in sent["messages"][1]["content"]
    for code, body, kind in [(503, "", X.ConnectionLost), (502, "", X.ConnectionLost), (500, "x", chat_model.BadAnswer), (200, " ", chat_model.BadAnswer), (200, "{}", chat_model.BadAnswer), (200, "no json", chat_model.BadAnswer), (200, json.dumps({"message": {"content": "```\n```"}}), chat_model.BadAnswer)]:
        state["answers"] = [(code, body)]
        with pytest.raises(kind):
            ask("a", "", ["\n"], 64)
    assert state["seen"][-1]["options"]["stop"] == ["\n"]
    with pytest.raises(X.ConnectionLost):
        chat_model.asker("http://127.0.0.1:9/none", "m", "s", "ja", "en", 2)("a", "", None, 64)
    assert chat_model.filled(" {{source_language}} to {{target_language}} {{context}}", "ja", "en") == "ja to en"


def test_chat_stage_in_workers(spark, server):
    url, _state = server
    df = spark.createDataFrame([("p", i, f"t{i}") for i in range(3)], "page_id string, region_seq int, source_text string")
    got = {r["region_seq"]: r["translated_text"] for r in pipeline.build("translator", "chat", url=url, model="m", source="ja", target="en")(df).collect()}
    assert got == {0: "fine", 1: "fine", 2: "fine"}


def test_failures_stay_with_their_rows(spark):
    def load():
        def model(rows):
            if any(r["region_seq"] == 3 for r in rows):
                raise ValueError("three")
            return [{"page_id": r["page_id"], "region_seq": r["region_seq"], "text": "ok"} for r in rows]

        return model

    df = spark.createDataFrame([("p", i) for i in range(6)], "page_id string, region_seq int").coalesce(1)
    got = {r["region_seq"]: (r["text"], r["error"] and tuple(r["error"])) for r in X.model_stage(load, "page_id string, region_seq int, text string", 4, stage="ocr")(df).collect()}
    assert got == {i: ("ok", None) if i != 3 else (None, ("ocr", "ValueError", "three")) for i in range(6)}
    with pytest.raises(Exception, match="three"):
        X.model_stage(load, "page_id string, region_seq int, text string", 4)(df).collect()


# --- the command line -------------------------------------------------------------------------------


def test_command_line_end_to_end(spark, tmp_path, monkeypatch):
    from inkgrid.__main__ import main

    src, out = tmp_path / "in", tmp_path / "out"
    os.mkdir(src)
    two = PAGES["two corners"][0].copy()
    (src / "Vol.zip").write_bytes(archives.build_archive({"001.png": I.encode(two), "002.png": I.encode(PAGES["three rows"][0]), "bad.png": b"no image"}))
    (src / "cover.png").write_bytes(I.encode(page(50, 50)))
    for k, v in {"SOURCE_LANGUAGE": "ja", "TARGET_LANGUAGE": "en", "OUTPUT_DIR": str(out), "OUTPUT_FORMAT": "png", "INPAINTER": "erase"}.items():
        monkeypatch.setenv(f"INKGRID_{k}", v)
    assert main(["--dir", str(src), "--debug"]) == 1  # one page can't be read
    pages = {r["page_id"]: r["failed"] for r in spark.read.parquet(str(out / "pages")).collect()}
    assert {k for k, v in pages.items() if v} == {"Vol/bad.png"} and len(pages) == 4 and pages["Vol/bad.png"]["stage"] == "load"
    texts = spark.read.parquet(str(out / "texts")).groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in texts} == {"Vol/001.png": 2, "Vol/002.png": 3}
    files = sorted(os.listdir(out / "Vol"))
    assert [f for f in files if "debug" not in f] == ["001.png__001_translated.png", "002.png__002_translated.png"] and len(files) == 4
    after = I.decode((out / "Vol" / "001.png__001_translated.png").read_bytes())
    assert after.min() > 200 and two.min() == 0  # the ink is gone
    monkeypatch.setenv("INKGRID_OUTPUT_DIR", str(tmp_path / "again"))
    assert main(["--file", str(src / "cover.png")]) == 0
    assert main(["--dir", str(tmp_path / "none")]) == 1
    monkeypatch.setenv("INKGRID_DETECTOR", "nobody")
    assert main(["--file", str(src / "cover.png")]) == 1
    monkeypatch.delenv("INKGRID_SOURCE_LANGUAGE")
    assert main(["--file", str(src / "cover.png")]) == 1


def test_jpeg_needs_a_library(spark):
    from inkgrid.sources import sinks

    df = spark.createDataFrame([("p", "/x", bytearray(b"1"))], "page_id string, path string, content binary")
    assert sinks.as_format(df, "png").count() == 1
    with pytest.raises(ValueError):
        sinks.as_format(df, "gif")
