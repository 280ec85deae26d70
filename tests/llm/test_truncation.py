import pytest

from inkgrid.llm import repetition, truncation as T

LIM = T.Limits({"crowd": [("chars", "ellipsis", 20)], "bytes": [("bytes", "open", 24)]})
BANDS = repetition.Bands()
SENT = "港で誰かの声が聞こえる。"


@pytest.mark.parametrize(
    "text,source,feed,cut",
    [
        ("I can hear someone in the har", SENT, "any", True),
        ("I can hear someone in the h�", SENT, "any", True),
        ("I can hear someone.", SENT, "any", False),
        ("I can hear someone... ", "港で誰かの声が聞こえる……", "any", False),
        ("I can hear someon...", SENT, "crowd", True),
        ("Wait, I only wanted to—", "待って、私はただ――", "any", False),
        ("In the harbor, last night", "昨夜港で", "any", False),
        ("RUMBLE", "バタン！", "any", False),
        ("Mune!", "ムネ！", "any", False),
        ("", SENT, "any", False),
        ("...", SENT, "any", False),
        ("She said \"come here.", SENT, "any", True),
        ("He went (to the old mill", SENT, "any", True),
        ("Who is there? I can", "昨夜港で", "any", True),
        ("ฉันได้ยินเสียงใครบางคน", SENT, "any", False),
        ("Look at <b", SENT, "any", True),
        ("no " * 40, SENT, "any", False),
        ("Ich höre jemanden &am", SENT, "any", True),
    ],
)
def test_cases(text, source, feed, cut):
    assert T.is_cut(text, source, feed, LIM, BANDS) is cut


def test_stack():
    assert not T.unclosed("„Gut“, sagte er. “Good” «bien» (ok)")
    assert T.unclosed("“Good (ok)") and T.unclosed("«a") and not T.unclosed("it's")


ROWS = "region_id long, source string, source_text string, translated_text string, cut string, ends string"


def test_feed_limits_are_found_and_shares_reported(spark):
    rows = []
    for i in range(200):
        full = "I can hear someone in the harbor and " + "x" * (i % 37) + " the captain knows it."
        rows.append((i, "limited", SENT, full[:45] if i % 3 == 0 else full, "c", "e"))
        rows.append((1000 + i, "free", SENT, full, "c", "e"))
    rows += [(5000, None, SENT, "I can hear", "c", "e"), (5000, None, SENT, "I can hear", "c", "e"), (5001, "free", None, None, None, None), (None, "free", None, "whole.", None, None)]
    df = spark.createDataFrame(rows, ROWS)
    lim = {tuple(r) for r in T.field_limits(df).collect()}
    assert ("limited", "chars", "open", 45) in lim and not any(x[0] == "free" for x in lim)
    got = {r[0] for r in T.cut_regions(df).collect()}
    assert got == {i for i in range(0, 200, 3)} | {5000}
    shares = {r["source"]: (r["translations"], r["cut"], r["share"]) for r in T.feed_shares(df).collect()}
    assert shares["limited"] == (200, 67, 0.335) and shares["free"][1] == 0 and shares[None] == (1, 1, 1.0)
    assert T.cut_regions(df.where("false")).count() == 0 and T.feed_shares(df.where("false")).count() == 0


CAPTION, OTHER = "昨夜港で", "嵐の前に橋のそばで"


def test_whole_captions_make_no_limit(spark):
    rows = [(i, "few", CAPTION, "In the forest, this morning", "c", "e") for i in range(8)] + [(8, "few", SENT, "I can hear someone.", "c", "e")]
    # different captions of one length, different trailing speech of one length
    rows += [(100 + i, "many", CAPTION, f"In the forest, day number {i:03d}", "c", "e") for i in range(30)]
    rows += [(200 + i, "trails", "港で誰かの声が……", f"I can hear someone {i:03d}...", "c", "e") for i in range(30)]
    rows += [(300, "trails", SENT, "I can hear someone 999...", "c", "e")]
    # a sentence cut the same way again and again is one text
    rows += [(400 + i, "again", SENT, "ฉันได้ยินเสียงใครบางคนที่ท่าเรือน", "c", "e") for i in range(8)]
    df = spark.createDataFrame(rows, ROWS)
    assert T.field_limits(df).count() == 0
    assert T.cut_regions(df).count() == 0
    assert all(r["cut"] == 0 for r in T.feed_shares(df).collect())


def test_a_caption_at_a_true_limit_is_whole():
    lim = T.Limits({"bytes": [("bytes", "open", 27)]})
    assert not T.is_cut("At the bridge, last night", OTHER, "bytes", lim, BANDS)
    assert T.is_cut("I can hear someone in the h", SENT, "bytes", lim, BANDS)
    assert T.is_cut("I can hear someone in the h", "", "bytes", lim, BANDS)
    assert T.is_cut("ฉันได้ยินเ"[:9], SENT, "bytes", lim, BANDS)
    assert T.is_cut("Who is there? I can hear a", OTHER, "bytes", lim, BANDS)


def test_limits_are_a_matter_of_rate_and_significance(spark):
    """Four texts at one length of a small feed are a limit, two aren't; of a large feed a length with few texts is none, however empty its neighbours are not."""
    cut = lambda n, i: f"I can hear someone in the harbor {i:04d} and the".ljust(n, "x")[:n]
    small = [(i, "small", SENT, cut(46, i), "c", "e") for i in range(4)] + [(9, "pair", SENT, cut(46, 9), "c", "e"), (10, "pair", SENT, cut(46, 10), "c", "e")]
    even = [(1000 + 40 * i + k, "even", SENT, cut(40 + i, k), "c", "e") for i in range(30) for k in range(40)]  # 40 texts at every length
    more = [(9000 + k, "even", SENT, cut(52, 5000 + k), "c", "e") for k in range(60)]  # 100 at one: not eight times the rate
    df = spark.createDataFrame(small + even + more, ROWS)
    lim = {(r["source"], r["measure"], r["size"]) for r in T.field_limits(df).collect()}
    assert {x for x in lim if x[0] != "even"} == {("small", "chars", 46), ("small", "bytes", 46)}
    assert not [x for x in lim if x[0] == "even"]
