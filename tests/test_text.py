import bisect
import random
import sys

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import scoring as Q
from inkgrid.functions import text as T
from inkgrid.operators import layout as L
from inkgrid.operators import translate as X


def val(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("a,b", [("...AAA", "AAA"), ("……AAA？", "AAA？"), ("⋯⋯AAA？", "AAA？"), ("——AAA", "AAA"), ("……", "……"), ("...", "..."), ("", ""), ("あ い　う B", "あいう B"), ("a....b--c~~", "a…b—c~")])
def test_tidy(spark, a, b):
    assert val(spark, T.tidy_reply(F.lit(a))) == b and X.tidy(a) == b


@pytest.mark.parametrize("a,b", [("...「AAA」", "﹁AAA﹂"), ("AーB", "A︱B"), ("A|B", "A︱B"), ("A｜B", "A︱B"), ("A—B", "A︱B"), ("A―！", "A︱！")])
def test_vertical(spark, a, b):
    assert val(spark, T.vertical(F.lit(a))) == b


@pytest.mark.parametrize(
    "conf,chars,text,want",
    [
        (0.52, [0.95, 0.20, 0.90, 0.35], None, 0.408618),
        (0.92, [0.90, 0.94, 0.91, 0.93], None, 0.918735),
        (0.75, None, None, 0.75),
        (0.78, [0.5520579218864441, 0.6995126008987427, 0.9391855597496033, 0.6556254029273987, 0.9956251978874207, 0.9514972567558289], "AAAAA、", 0.610574),
        (0.8954, [0.9973722696304321, 0.9996356964111328, 0.9998389482498169, 0.9999175071716309, 0.9998641014099121, 0.5170303583145142], "AAAAA：", 0.947284),
        (0.6913, [0.6913] * 4, "．．．．", 0.6913),
        (None, [0.5], "A", None),
    ],
)
def test_quality(spark, conf, chars, text, want):
    df = spark.createDataFrame([(conf, chars, text)], "c double, a array<double>, t string")
    got = df.select(Q.quality(F.col("c"), F.col("a"), F.col("t"))).first()[0]
    assert got == (None if want is None else pytest.approx(want, abs=1e-6))


def test_null_score_passes(spark):
    df = spark.createDataFrame([(0.42,), (0.90,), (0.96,), (None,)], "s double")
    assert df.where(Q.passes(F.col("s"), 0.75)).count() == 3


def test_confidences(spark):
    assert val(spark, Q.sentence_confidence(F.array(F.lit(0.81), F.lit(0.25)))) == pytest.approx(0.45)
    assert val(spark, Q.sentence_confidence(F.array().cast("array<double>"))) == 0.0
    assert val(spark, Q.until_end(F.array(*map(F.lit, (4, 2, 7))))) == [4]
    assert val(spark, Q.until_end(F.array(*map(F.lit, (4, 0))))) == [4]


def test_indexed_output(spark):
    f = lambda s, n: val(spark, T.indexed_output(F.lit(s), F.lit(n)))
    assert f("[1] OUT_A\n[3] OUT_C", 3) == ["OUT_A", None, "OUT_C"]
    assert f("head\n1. a\nmore\nassistant\n2: b\n9. lost\n2. c", 2) == ["a more", "c"]
    assert X.numbered("head\n1. a\nmore\nassistant\n2: b\n9. lost\n2. c", 2) == ["a more", "c"]
    assert f("", 0) == []


def test_fence(spark):
    f = lambda s: val(spark, T.strip_fence(F.lit(s)))
    assert f("```json\na\nb\n```") == "a\nb" and f("```x```") == "x" and f(" y ") == "y"


SEG = [
    ("AAA！BBB，CCC。\nDDD。", [("AAA！", 2), ("BBB，", 3), ("CCC。", 1), ("DDD。", 2)]),
    ("「AAA！」BBB。", [("「AAA！」", 2), ("BBB。", 2)]),
    ("「AAA！BBB」CCC。", [("「AAA！BBB」CCC。", 2)]),
    ("（「AAA！」）BBB。", [("（「AAA！」）", 2), ("BBB。", 2)]),
    ("AAA~ BBB♥ CCC★ DDD", [("AAA~ ", 4), ("BBB♥ ", 4), ("CCC★ ", 4), ("DDD", 5)]),
    ("AAAAA...BBBBBB", [("AAAAA...", 2), ("BBBBBB", 5)]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text,want", SEG)
def test_segments(text, want):
    assert L.segments(text) == want


@pytest.mark.parametrize("text,want", [("AAA~ BBB。", ["AAA~ BBB。"]), ("AAA~ BBB~ CCC~", ["AAA~", "BBB~", "CCC~"]), ("AAA，BBB", ["AAA，", "BBB"]), ("AAA 3.14 BBB.", ["AAA 3.14 BBB."]), ("WORD1's AAA! WORD2 don't BBB.", ["WORD1's AAA!", "WORD2 don't BBB."])])
def test_sentences(text, want):
    assert L.sentences(text) == want


def test_layout_scores_and_splits():
    assert L.mask_score(22, 30, [6, 6], 2, 0) == pytest.approx(0.933333, abs=1e-6)
    assert L.mask_score(26, 30, [6, 3, 3], 2, 1) == pytest.approx(-9.183333, abs=1e-6)
    assert L.mask_score(30, 30, [6, 1], 1, 1) == pytest.approx(-9.566667, abs=1e-6)
    assert L.mask_score(26, 30, [7], 1, 0) == pytest.approx(0.866667, abs=1e-6)
    cut = L.by_capacity("甲" * 14 + "，" + "乙" * 5 + "WORD" + "丙" * 4, [8] * 6)
    assert "".join(cut) == "甲" * 14 + "，" + "乙" * 5 + "WORD" + "丙" * 4 and any("WORD" in c for c in cut)
    parts = L.balanced_chunks("「" + "A" * 23 + "！", 60, lambda s: 20.0 * len(s), True)
    assert all(p[0] not in L.NOT_FIRST for p in parts[1:]) and all(p[-1] not in L.NOT_LAST for p in parts[:-1])


def test_best_layout_fits_and_keeps_the_text():
    got = L.best_layout("Run, they are waiting! Is it still alive?", 160, 120, False)
    assert "".join(x.text for x in got.lines).replace(" ", "") == "Run,theyarewaiting!Isitstillalive?" and got.width <= 160 and got.height <= 120
    assert L.best_layout("", 10, 10, True) is None
    assert [x.text for x in L.best_layout("第 3 話", 60, 200, True).lines] == ["第3話"]


def plain_layout(text, width, height, vertical):
    """(lines, size, score) by laying the text out at every size, character counts measured anew each time."""
    bare = "".join(text.split())
    segs = L.segments(bare if len(bare) <= 4 and L._TITLE.search(text) else text)

    def at(size, para, by_sentence):
        measure = (lambda s: L.height_of(s, size)) if vertical else (lambda s: L.width_of(s, size))
        limit, fine, lines, cur, last = height if vertical else width, [], [], "", L.WORD
        for s, k in segs:
            *parts, end = L.balanced_chunks(s, limit, measure, vertical)
            fine += [(p, L.CHAR) for p in parts] + [(end, k)]
        for s, k in fine:
            if cur and measure(cur + s) > limit:
                lines.append((cur, last))
                cur = ""
            cur, last = cur + s, k
            if k == L.PARAGRAPH or (by_sentence and k == L.SENTENCE):
                lines.append((cur, k))
                cur = ""
        lines += [(cur, last)] if cur else []
        sizes, n = [measure(s) for s, _ in lines], len(lines)
        gap = min(0.4 * size, max(0.0, width - n * size) / (n + 1))
        w, h = (n * size + (n - 1) * gap, max(sizes)) if vertical else (max(sizes), 1.25 * size * n + size * para * sum(k == L.PARAGRAPH for _, k in lines[:-1]))
        broken = sum(k not in (L.PARAGRAPH, L.SENTENCE) for _, k in lines)
        return [s for s, _ in lines], size, L.score_of(sizes, [len(s) for s, _ in lines], broken, lines[-1][1] == L.PARAGRAPH, size, w, h, width, height, vertical)

    def best(size, para=0.0):
        got = at(size, para, True)
        return got if got[2] > L.FITS else at(size, para, False)

    limit = min(72, max(56, height if vertical else width))
    top = max(12, 11 + bisect.bisect_left(range(12, limit + 1), True, key=lambda z: best(z)[2] <= L.FITS))
    found = max((best(z) for z in range(max(12, int(0.7 * top)), top + 1)), key=lambda x: (x[2], x[1]))
    spaced = best(found[1], 0.4)
    return spaced if spaced[2] > L.FITS else found


def calls_of(f, *a):
    """Function calls it takes, in Python and C."""
    n = 0

    def count(_frame, event, _arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f(*a)
    finally:
        sys.setprofile(None)
    return n


SPOKEN = ["Run, they are waiting! Is it still alive? The old mill by the river has been empty for years.", "船長は古い水車小屋へ行った。だれもいない、と彼は言った「もう遅い」。", '"Nobody came back from there," she said.\nThen: 3.14, don\'t stop...\nWhy?', "RUMBLE", "..."]


@pytest.mark.parametrize("vertical", [False, True])
def test_best_layout_is_that_of_a_plain_search(vertical):
    rnd = random.Random(5)
    drawn = ["".join(rnd.choice("ab Cd é一二の.!，?「」(\"'-。\n") for _ in range(rnd.choice([2, 5, 20, 90]))) for _ in range(150)]
    for text in [*SPOKEN, *(x for x in drawn if x.strip())]:
        for width, height in ((160, 120), (44, 300), (rnd.randrange(1, 400), rnd.randrange(1, 400))):
            got = L.best_layout(text, width, height, vertical)
            assert ([x.text for x in got.lines], got.size, got.score) == plain_layout(text, width, height, vertical), (text, width, height)


def test_horizontal_layout_takes_few_steps():
    """Lines end where a search in sums says; no text is measured piece by piece at each size (6,081 calls before, 519 after)."""
    assert sum(calls_of(L.best_layout, x, 160, 120, False) for x in SPOKEN) / len(SPOKEN) < 1000


def test_vertical_layout_takes_few_steps():
    """As in horizontal setting (8,398 calls before)."""
    assert sum(calls_of(L.best_layout, x, 160, 120, True) for x in SPOKEN) / len(SPOKEN) < 1000


def test_positive_layouts_only():
    """What scores 0 or less is left out, and nothing else; spaced paragraphs are scored as spaced."""
    for text in [*SPOKEN, *("one two. three\n" * n for n in range(1, 12)), "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3]:
        for width in range(10, 200, 19):
            for height in (13, 40, 120, 600):
                for vertical in (False, True):
                    got = L.best_layout(text, width, height, vertical)
                    assert L.best_layout(text, width, height, vertical, positive=True) == (got if got.score > 0 else None)


def test_cut_words(spark):
    from inkgrid.plans.queries_layout import cut_words

    f = lambda *lines: val(spark, cut_words(F.array(*map(F.lit, lines))))
    assert f("a wor", "d here") == 1 and f("wor", "d here") == 0 and f("a word ", "here") == 0 and f("a word", "。") == 0 and f("、a", "b c", "d") == 2
    assert f("one") == 0 and val(spark, cut_words(F.array().cast("array<string>"))) == 0


def test_long_quotations_take_few_steps():
    """A quotation is one segment, cut into chunks at each size (79,901 calls before, 1,246 after)."""
    assert calls_of(L.best_layout, "“" + "Nobody came back from there, not even you. " * 6 + "”", 160, 200, False) < 4000


class Model:
    def __init__(self, *replies):
        self.replies, self.calls = list(replies), []

    def __call__(self, text, context, stop, tokens):
        self.calls.append((text, context, stop, tokens))
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r


def test_ladder():
    m = Model("LINE_1\nLINE_2？")
    assert X.translate(["SRC_1", "SRC_2？"], "ctx", m) == ["LINE_1", "LINE_2？"] and m.calls[0][1] == "ctx"
    m = Model("MISMATCH", "FB_1", "FB_2")
    assert X.translate(["SRC_1", "SRC_2"], ["a", " ", "b"], m) == ["FB_1", "FB_2"]
    assert [c[1:3] for c in m.calls] == [("a\nb", None), ("", ["\n"]), ("", ["\n"])]
    assert X.translate([], None, Model()) == []
    assert X.translate(["A", "B", "C"], None, Model("[1] X\n[2] Y\n[3] Z")) == ["X", "Y", "Z"]
    m = Model("[1] X\n[3] Z", "Y")
    assert X.translate(["A", "B", "C"], None, m) == ["X", "Y", "Z"] and len(m.calls) == 2
    with pytest.raises(X.ConnectionLost):
        X.translate(["A", "B"], None, Model(X.ConnectionLost()))
    assert X.translate(["A", "B"], None, Model(ValueError(), "X", ValueError())) == ["X", "B"]
    assert X.translate(["A"], None, Model(ValueError())) == ["A"]
