import itertools

import pytest

from inkgrid.llm import lookalike as L

SAME = [
    ("ｶﾞｷﾞ", "ガギ"), ("café", "café"), ("ѕtор", "stop"), ("ﬁn", "fin"), ("a​b", "ab"), ("Ａ！", "A!"),
    ("a b", "a b"), ("⼝車", "口車"), ("나", "나"), ("ё", "ë"), ("力モ", "カモ"), ("end ", "end"),
    ("γes", "yes"), ("гed", "red"), ("Ӏot", "lot"), ("ѵat", "vat"), ("օոe", "one"), ("ᎪᏢ", "AP"), ("xⅤ", "xV"), ("xⅲ", "xiii"), ("a‑b", "a‐b"), ("𝐀𝓫𝟗", "Ab9"), ("ﾡ", "ᄀ"), ("ㄱ", "ᄀ"), ("ǆ", "dž"), ("ĳs", "ijs"),
]
OTHER = [("が", "か"), ("A", "a"), ("é", "e"), ("x²", "x2"), ("①a", "1a"), ("…a", "...a"), ("a\nb", "a b"), ("c\n", "c"), ("a!", "a?"), ("b", "d")]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "k", 1) for i, t in enumerate(texts)], "region_id long, source_text string, translated_text string, key string, m int")


@pytest.mark.parametrize("a,b", SAME)
def test_same(spark, a, b):
    got = L.lookalike_pairs(frame(spark, [a, b])).collect()
    assert [tuple(r) for r in got] == [("source_text", 0, 1)]


def test_visible_differences_stay(spark):
    texts = list(itertools.chain(*OTHER))
    assert L.lookalike_pairs(frame(spark, texts)).count() == 0


def test_copies_are_not_paired_but_meet_other_spellings(spark):
    got = {tuple(r) for r in L.lookalike_pairs(frame(spark, ["stop it", "stop it", "ѕtop it", "stop it"])).collect()}
    assert got == {("source_text", 0, 2), ("source_text", 1, 2), ("source_text", 2, 3)}


def test_nulls_empty_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "ab"), (1, None, "ab"), (2, "", "a​b"), (None, "x", "ab"), (3, "12", "12")], "region_id long, source_text string, translated_text string")
    assert {tuple(r) for r in L.lookalike_pairs(df).collect()} == {("translated_text", 1, 2)}
    assert L.lookalike_pairs(df.where("false")).count() == 0


def test_canonical_form_is_one_member_and_joins_back(spark):
    df = frame(spark, ["stop", "ѕtор", "ｓｔｏｐ", "go", None, "9"])
    got = {r["region_id"]: r["canonical"] for r in L.canonical_forms(df).collect()}
    assert got == {0: "stop", 1: "stop", 2: "stop", 3: "go"}


def test_against_brute_force(spark, data):
    import unicodedata

    from inkgrid.llm.pairs import Folder
    from inkgrid.session import table

    r = table(spark, data, "regions").select("region_id", "source_text", "translated_text").distinct()
    src, dst, many = L.mapping()
    tab = dict(zip(map(ord, src), dst, strict=True)) | {ord(c): None for c in L.INVISIBLE} | {ord(k): v for k, v in many}
    assert not set(src) & set(L.INVISIBLE) and len(src) == len(dst) == len(set(src))
    key = lambda t: unicodedata.normalize("NFC", t.translate(tab)).strip(" ")
    want = set()
    rows = r.collect()
    for f in ("source_text", "translated_text"):
        by = {}
        for x in rows:
            if x[f] and any(c.isalpha() for c in x[f]):
                by.setdefault(key(x[f]), []).append((x["region_id"], x[f]))
        for g in by.values():
            want |= {(f, a, b) for (a, s), (b, t) in itertools.combinations(sorted(g), 2) if s != t}
    assert {tuple(x) for x in L.lookalike_pairs(r).collect()} == want
    assert Folder()("「ѕtop 」") == "stop"


def test_long_text(spark):
    a = "word " * 30000
    assert L.lookalike_pairs(frame(spark, [a + "x", a + "х"])).count() == 1


def test_the_map_is_settled():
    """What a character becomes isn't itself mapped again, but for narrow voicing marks."""
    src, dst, many = L.mapping()
    again = {d for d in dst if d in src} | {c for _s, to in many for c in to if c in src}
    assert again <= set("  "), again


def test_hot_value_gets_its_form(spark):
    """A value of a third of all rows, in two spellings, beside many others."""
    texts = ["ѕtop" if i % 9 == 0 else "stop" if i % 3 == 0 else f"word {i:x}" for i in range(900)]
    got = {r["region_id"]: r["canonical"] for r in L.canonical_forms(frame(spark, texts)).collect()}
    assert got == {i: "stop" if i % 3 == 0 else t for i, t in enumerate(texts)}
