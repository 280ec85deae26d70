import random

import pytest

from inkgrid.llm import langid, pairs as P
from tests.llm.test_language import SEED

FOLD = P.Folder()


@pytest.mark.parametrize(
    "reply,refusal",
    [
        ("I'm sorry, but I can't translate this line.", True),
        ("As an automated assistant, I must decline to render this passage.", True),
        ("I'm sorry, Lumo, I can't help you carry the lantern.", False),
        ("Leider kann ich diesen Text nicht übersetzen.", True),
        ("Tut mir leid, ich kann dir nicht helfen, die Karte zu tragen.", False),
        ("Malheureusement, je dois refuser cette traduction.", True),
        ("Désolé, je ne peux pas t'aider à porter la lettre.", False),
        ("Como asistente, no puedo traducir este texto.", True),
        ("К сожалению, я вынужден отказаться от перевода.", True),
        ("Извини, я не могу помочь тебе нести зонт.", False),
        ("申し訳ありませんが、この文章は翻訳できません。", True),
        ("ごめん、手紙を運ぶのは手伝えない。", False),
        ("很抱歉，我无法翻译这段文字。", True),
        ("对不起，我没法帮你搬雨伞。", False),
        ("죄송하지만 이 문장은 번역할 수 없습니다.", True),
        ("ขออภัย ฉันไม่สามารถแปลข้อความนี้ได้", True),
    ],
)
def test_refusals(reply, refusal):
    assert P.is_refusal(reply) is refusal


@pytest.mark.parametrize("reply,copy", [("港で誰かの声が聞こえる。", True), ("[6] 港で誰かの声が聞こえる。", True), ("「港で誰かの声が 聞こえる。」", True), ("6. 港で誰かの声が聞こえる。 ", True), ("港で誰かの声が聞こえた。", False), ("I can hear someone.", False), ("", False)])
def test_copies(reply, copy):
    assert P.is_copy("港で誰かの声が聞こえる。", reply, FOLD) is copy


def test_fragments_short_texts_and_slack():
    a = "We found the lantern behind the school three days ago, and nobody has opened this door for 57 years."
    near = a.replace("lantern", "letter")
    assert not P.is_copy(a, near, FOLD) and P.is_copy(a, near, FOLD, slack=16)
    assert not P.is_copy(a, "We found the lantern", FOLD, 16) and not P.is_copy("We found the lantern", a, FOLD, 16)
    assert not P.is_copy(a, "Nobody found the door behind the lantern, and this school has opened for three years.", FOLD, 16)
    assert P.is_copy("OK!", "OK!", FOLD) and P.is_copy("力", "力", FOLD) and P.is_copy("a", "a", FOLD)
    assert not P.is_copy("ペム!", "Pemu!", FOLD) and not P.is_copy("THUD", "BANG", FOLD) and not P.is_copy("a", "b", FOLD) and not P.is_copy("", "a", FOLD)


@pytest.mark.parametrize("n", [1, 3, 8, 40, 400, 200000])
def test_dictionary_agrees_with_comparison(n):
    rnd = random.Random(n)
    for _ in range(3 if n > 1000 else 200):
        t = "".join(rnd.choice("abcdefghij klmnop港で誰かの声が") for _ in range(n)) + "x"
        assert P.is_copy(t, t, FOLD)
        i = rnd.randrange(len(t))
        for other in (t[:i] + "q" + t[i + 1 :], t[:i] + "誠" + t[i:], t[:i] + t[i + 1 :], t + t):
            assert P.is_copy(t, other, FOLD) is (FOLD(t) == FOLD(other)), (t, other)


def test_defects(spark):
    bank = langid.fit_models({k: v * 3 for k, v in SEED.items()})
    bank.margin = 4.0
    b = spark.sparkContext.broadcast(bank)
    src = "港で誰かの声が聞こえる。"
    rows = [
        (1, "p", src, "I can hear someone in the harbour.", None),
        (2, "p", src, "[3]", "empty"),
        (3, "p", src, "I'm sorry, but I can't translate this line.", "refusal"),
        (4, "p", src, src, "copy"),
        (5, "p", src, "Ich höre jemanden im Hafen.", "other_language"),
        (6, "p", src, "We found the lantern behind the", "truncated"),
        (7, "p", src, None, None),
        (8, "p", "……", "", None),
        (9, None, src, "", "empty"),
        (10, "elsewhere", src, "Ich höre jemanden im Hafen.", None),
        (11, "p", src, "We found the lantern behind the school. 港で誰かの声が聞こえる。", None),
    ]
    df = spark.createDataFrame([(i, p, "f", s, t, "d") for i, p, s, t, _ in rows + rows[:4]], "region_id long, page_id string, source string, source_text string, translated_text string, defect string")
    pages = spark.createDataFrame([("p", "v")], "page_id string, sub_dir string")
    vols = spark.createDataFrame([("v", "ja", "en")], "sub_dir string, source_lang string, target_lang string")
    got = {r["region_id"]: r["defect"] for r in P.defects(df, pages, vols, b).collect()}
    assert got == {i: d for i, *_x, d in rows if d}
    assert P.defects(df.where("false"), pages, vols, b).count() == 0
