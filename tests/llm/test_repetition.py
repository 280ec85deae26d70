import base64
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgrid.llm import repetition as R

BANDS = R.Bands()
CASES = [
    ("Is Lumo still alive? " * 4, True),
    ("1. Don't touch it! 2. don't touch it? 3. DON'T TOUCH IT 4. Don't touch it.", True),
    ("no " * 30, True),
    ("hahahahahahahahahahahahahahahahahaha", True),
    ("船長は明日鍵を渡す。船長は明日鍵を渡す。船長は明日鍵を渡す。船長は明日鍵を渡す。", True),
    ("The captain will give the map to Lumo tomorrow. Why did you hide it? The captain will give the map to Lumo tomorrow.", False),
    ("The rain has not stopped since we met at the old mill near the harbor.", False),
    ("hahaha", False),
    ("", False),
    ("……" * 30, False),
]


@pytest.mark.parametrize("text,case", CASES)
def test_cases(text, case):
    assert R.is_repetitive(text, BANDS) is case


def brute_share(text):
    """Longest-match parse over words or letters, quadratic."""
    words = [w for w in "".join(c.casefold() if c.isalpha() else " " for c in text).split()]
    n = sum(map(len, words))
    seen = covered = 0
    for k in range(len(words)):
        if any(words[j : j + 6] == words[k : k + 6] and j + 6 <= k for j in range(k)) and k + 6 <= len(words):
            seen = max(seen, k + 6)
        if k < seen:
            covered += len(words[k])
    return covered / n if n else 0.0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_share_is_near_brute_force_for_repeated_sentences(seed):
    rnd = random.Random(seed)
    vocab = ["lamp", "harbor", "captain", "silver", "umbrella", "forest", "under", "quickly", "seven", "mountain", "letter", "hidden"]
    sents = [" ".join(rnd.sample(vocab, 6)) + "." for _ in range(3)]
    text = " ".join(rnd.choice(sents) for _ in range(rnd.randint(2, 9)))
    assert abs(R.repeated_share(text) - brute_share(text)) < 0.12


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefghij ", min_size=20, max_size=60), st.integers(3, 8))
def test_the_band_loses_no_case(unit, times):
    text = (unit.strip() + ". ") * times
    if len(text) >= R.MIN_CHARS and R.repeated_share(text) > R.SHARE:
        assert BANDS.band(text)[0] in ("repetitive", "doubtful")


def test_bands():
    rnd = random.Random(1)
    noise = "".join(chr(rnd.randint(0x4E00, 0x9F00)) for _ in range(3000))
    assert BANDS.band("the same again " * 500)[0] == "repetitive"
    assert BANDS.band(noise)[0] == "incompressible"
    assert BANDS.band(base64.b64encode(rnd.randbytes(300)).decode())[0] == "incompressible"
    mixed = noise + "loop" * 700  # the whole hardly compresses, one chunk does: half of it is no case
    assert BANDS.band(mixed)[0] == "doubtful"
    assert not R.is_repetitive(mixed, BANDS)
    assert R.is_repetitive(noise[:2000] + "loop" * 4000, BANDS)


def test_limits_fall_with_length():
    for f in (R.sure_limit, R.doubt_limit, R.incompressible_limit):
        assert [f(n) for n in (300, 600, 6000)] == sorted((f(n) for n in (300, 600, 6000)), reverse=True)
    assert all(R.sure_limit(n) < R.doubt_limit(n) for n in (1, 30, 300, 10**6))


def test_short_sentences_that_recur_are_cases():
    """Sentences of a few words, not beside their twins, more than half of the text."""
    t = "Open the door! Who is it? Open the door! Not now. Open the door! Is she in? Open the door! Soon. Open the door!"
    assert R.repeated_share(t) > R.SHARE and R.is_repetitive(t, BANDS)
    t = "開けてください！誰だ？開けてください！だめ。開けてください！どこ？開けてください！今行く。開けてください！"
    assert R.repeated_share(t) > R.SHARE and R.is_repetitive(t, BANDS)


def test_share_is_linear_on_a_text_said_twice_without_its_end():
    rnd = random.Random(3)

    def seconds(n):
        x = ["".join(rnd.choices("abcdefghijklmnop", k=9)) for _ in range(n)]
        text = " ".join(x + x[:-1])
        began = time.process_time()
        assert R.repeated_share(text) > 0.49
        return time.process_time() - began

    assert seconds(40000) < 12 * max(seconds(8000), 0.05)


def test_operator(spark):
    rows = [(1, "x", "no " * 30), (1, "x", "no " * 30), (2, None, None), (3, "", "fine"), (None, "hey " * 20, None)]
    df = spark.createDataFrame([(*r, "b", 1.0) for r in rows], "region_id long, source_text string, translated_text string, band string, share double")
    got = {tuple(r) for r in R.repetitive(df).collect()}
    assert got == {(1, "translated_text"), (None, "source_text")}
    sh = {(r["region_id"], r["field"]): r["share"] for r in R.shares(df).collect()}
    assert sh[(3, "source_text")] == 0.0 and sh[(1, "translated_text")] > 0.9 and (2, "source_text") not in sh
    assert R.repetitive(df.where("false")).count() == 0


TWICE = [
    # outside the repetitive band: a sentence among others is said twice
    ("库凯亚托塔正在最后的屋顶上寻找白色面具。你为什么要在学校后面藏起咖啡馆的招牌？莫罗亚索泽还活着吗？库凯亚托塔正在最后的屋顶上寻找白色面具。", 19 / 65),
    ("Is Rimi still alive? Peyaze is looking for the map in the harbor. I can hear someone in the forest. Is Rimi still alive?", 16 / 93),
    ("森で誰かの声が聞こえる。クユケバモはまだ生きているのか？白い仮面をなくしたら、家に帰れなくなる。森で誰かの声が聞こえる……", 11 / 55),
    ("The rain has not stopped since we met at the old mill near the harbor.", 0.0),
    # a cry said twice counts by its letters
    ("Mune! The rain has not stopped since we met at the old mill. Mune!", 4 / 50),
]


@pytest.mark.parametrize("text,share", TWICE)
def test_shares_are_measured_in_every_band(spark, text, share):
    assert BANDS.band(text)[0] != "repetitive"
    df = spark.createDataFrame([(1, text, None)], "region_id long, source_text string, translated_text string")
    assert [(r["region_id"], r["field"], r["share"]) for r in R.shares(df).collect()] == [(1, "source_text", pytest.approx(share, abs=1e-6))]
    assert R.repetitive(df).count() == 0


def test_very_long_text():
    assert R.is_repetitive("All work and no play. " * 20000, BANDS)
