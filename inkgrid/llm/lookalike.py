"""One form for texts that look alike (problem 2).

Method: characters of one shape are mapped to one of them in SQL
(``translate``/``replace``), the mapped values are grouped under the
accent-sensitive ``UNICODE`` collation (which takes composed and decomposed
letters, and invisible characters, as equal), the smallest member of each
class is its canonical form, and it is joined back to the rows.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.operators.skew import salted_join
from inkgrid.session import cut_lineage

# Letters drawn like a Latin letter.
CYRILLIC = "аеорсухіјѕԁһԛԝӏгѵАВЕКМНОРСТУХІЈЅԚԜҮԌӀѴ"
CYRILLIC_AS = "aeopcyxijsdhqwlrvABEKMHOPCTYXIJSQWYGlV"
GREEK = "οανικρυγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳϹ"
GREEK_AS = "oaviкpuyABEZHIKMNOPTYXcjC".replace("к", "k")
ARMENIAN = "օոսհցզՕՍՏ"
ARMENIAN_AS = "onuhgqOUS"
CHEROKEE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏚᏙᏞᏟᏢᏦᏧᏴᎩ"
CHEROKEE_AS = "DRTiAJEWMHYGZbRWSVLCPKdBy"
LATIN = "ıɑɡ"
LATIN_AS = "iag"
# Kana and ideographs of one shape, and hiragana drawn like katakana.
HAN = "工力口夕二八卜一へべぺ〇"
HAN_AS = "エカロタニハトーヘベペ○"
# Characters that leave no mark.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁪⁫⁬⁭⁮⁯︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
# Blanks other than the plain one and the line breaks.
BLANKS = "\t               　"


def _letters() -> dict[str, str]:
    return dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + LATIN + HAN, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + LATIN_AS + HAN_AS, strict=True))


#: Compatibility characters that show what they decompose to: radicals, Roman numerals, jamo,
#: digraph letters and ligature signs. Others (raised, circled, squared, fractions) show a difference.
_SAME = ((0x2E80, 0x2FE0), (0x2160, 0x2180), (0x3131, 0x318F), (0x0132, 0x0134), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0xFB00, 0xFB18))


@functools.cache
def mapping() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, what each becomes, replacements of one character by several).

    By rule over all planes: wide, narrow, font and non-breaking forms, and the
    compatibility characters of ``_SAME``, become what they decompose to;
    letters with accents on a look-alike base become the accented Latin letter;
    signs for several letters are spelled out. Raised, circled and squared
    forms are left as they are.
    """
    base = _letters()
    one, many = dict(base), []
    for cp in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000)]:
        ch = chr(cp)
        if ch in one or ch in BLANKS:
            continue
        d = unicodedata.decomposition(ch)
        if d.startswith("<"):
            tag, *parts = d.split()
            if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>") or (tag == "<compat>" and any(a <= cp < b for a, b in _SAME)):
                to = "".join(chr(int(x, 16)) for x in parts)
                if 0xFFA0 <= cp < 0xFFDD:  # narrow jamo are compatibility jamo first
                    to = unicodedata.normalize("NFKD", to)
                to = "".join(base.get(c, c) for c in to)
                if len(to) == 1:
                    one[ch] = unicodedata.normalize("NFKD", to) if 0xFF9E <= cp <= 0xFF9F else to
                else:
                    many.append((ch, unicodedata.normalize("NFC", to)))
        elif d:
            full = unicodedata.normalize("NFD", ch)
            head = base.get(full[0])
            if head:
                to = unicodedata.normalize("NFC", head + full[1:])
                if len(to) == 1:
                    one[ch] = to
            elif len(full) == 1 and full in base:
                one[ch] = base[full]
    for old, new in (("｡", "。"), ("､", "、")):
        one.setdefault(old, new)
    one |= dict.fromkeys(BLANKS, " ")
    keys = sorted(one)
    return "".join(keys), "".join(one[k] for k in keys), tuple(many)


def mapped(text: Column) -> Column:
    """Text with look-alikes mapped, blanks made plain and outer blanks dropped (line breaks stay: they show); runs in the JVM."""
    src, dst, many = mapping()
    # translate() drops the characters of its second argument that have no partner in the third
    odd = F.translate(text, src + INVISIBLE, dst)
    spelled = odd
    for sign, letters in many:
        spelled = F.replace(spelled, F.lit(sign), F.lit(letters))
    odd = F.when(odd.rlike("[" + "".join(sign for sign, _ in many) + "]"), spelled).otherwise(odd)
    return F.regexp_replace(F.when(text.rlike(r"[^\x0a\x20-\x7e]"), odd).otherwise(text), r"^ +| +$", "")


def texts_of(regions: DataFrame) -> DataFrame:
    """(region_id, field, text): all texts with a letter, of both fields."""
    pair = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("source_text", "translated_text")])
    return regions.select("region_id", F.explode(pair).alias("x")).select("region_id", "x.field", "x.text").where(F.col("text").rlike(r"\p{L}"))


def _key(*cols: str) -> Column:
    """128 bits of strings: two 64-bit hashes with different seeds, so that equal keys mean equal strings at any number of rows."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def canonical_of(texts: DataFrame) -> DataFrame:
    """(k, canonical, cls, spellings, n): of each mapped value, by its key, the canonical member of its class.

    ``texts`` has field, text, m (the mapped text) and k (the key of field and
    m). Classes are the groups of mapped values that are equal under the
    accent-sensitive UNICODE collation; the canonical member is the smallest
    text by code points. ``spellings`` tells whether the class has several,
    ``n`` counts the mapped value's rows. Equal strings are pre-aggregated, so
    a text that makes up a third of all rows is shuffled once a task; a text
    that is its own mapped value is shuffled as one string, not two.
    """
    differs = F.when(F.col("text") != F.col("m"), F.col("text"))
    per = texts.groupBy("field", "m").agg(F.min(differs).alias("lo"), F.max(differs).alias("hi"), F.max(F.col("text") == F.col("m")).alias("own"), F.count("*").alias("n"))
    plain = F.when(F.col("own"), F.col("m"))
    w = Window.partitionBy("field", F.collate(F.col("m"), "UNICODE"))
    lo, hi = F.min(F.least("lo", plain)).over(w), F.max(F.greatest("hi", plain)).over(w)
    return per.select("field", "m", "n", lo.alias("canonical"), (lo != hi).alias("spellings")).select(_key("field", "m").alias("k"), "canonical", _key("field", "canonical").alias("cls"), "spellings", "n")


def _keyed(regions: DataFrame) -> DataFrame:
    return texts_of(regions).withColumn("m", mapped(F.col("text"))).withColumn("k", _key("field", "m"))


def canonical_forms(regions: DataFrame) -> DataFrame:
    """(region_id, field, canonical): the canonical form of every text with a letter.

    Texts that look the same get the same form; it is one of them. Texts
    without a letter, null and empty texts have no row; repeats count once, a
    region delivered with different texts has a row for each. Rows meet their
    form by key, without their text, and repeats are dropped where they meet.
    Forms of values that hold more than one part in 4 times the shuffle
    partitions of the rows (so there are fewer of them than that) are
    broadcast, and their rows are dealt over all tasks.
    """
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = _keyed(regions)
    forms = cut_lineage(canonical_of(t).select("k", "canonical", "n"))
    total = forms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    hot = forms.crossJoin(F.broadcast(total)).where(F.col("n") * (4 * parts) > F.col("total"))  # one row: the total
    hot = hot.select("k", F.xxhash64("k").alias("often"), F.col("canonical").alias("form"))
    rows = t.select("region_id", "field", "k").join(F.broadcast(hot.select("k", "often")), "k", "left")
    # rows of a hot value look for a key that no value has
    seek = F.when(F.col("often").isNotNull(), F.struct(F.xxhash64("region_id", "field").alias("a"), F.lit(None).cast("long").alias("b"))).otherwise(F.col("k"))
    rows = rows.select("region_id", (F.col("field") == "source_text").alias("first"), "often", seek.alias("seek"))
    j = rows.join(forms.select(F.col("k").alias("seek"), "canonical"), "seek", "left").dropDuplicates(["seek", "often", "region_id", "first"])
    j = j.join(F.broadcast(hot.select("often", "form")), "often", "left")
    return j.select("region_id", F.when(F.col("first"), "source_text").otherwise("translated_text").alias("field"), F.coalesce("form", "canonical").alias("canonical"))


def spelled_members(regions: DataFrame) -> DataFrame:
    """(field, cls, region_id, spelling): rows of the classes that have several spellings; classes and spellings as 128-bit keys."""
    t = _keyed(regions)
    spelled = canonical_of(t).where("spellings").select("k", "cls")
    rows = t.select("region_id", "field", "k", _key("text").alias("spelling"))
    return rows.join(spelled, "k").select("field", "cls", "region_id", "spelling").distinct()


def lookalike_pairs(regions: DataFrame) -> DataFrame:
    """(field, region_id_a, region_id_b), a < b: regions whose texts look the same and are different strings.

    Only classes with several spellings are joined, a class with a large share
    of these rows by several tasks. Within such a class rows meet rows of
    *other* spellings only: copies of one spelling are never paired. Null and
    letterless texts have no row; repeats count once. Pairs within a class grow
    as its square; ``canonical_forms`` has the same classes as membership.
    """
    m = cut_lineage(spelled_members(regions))
    a = m.select("field", "cls", F.col("region_id").alias("region_id_a"), F.col("spelling").alias("sa"))
    b = m.select("cls", F.col("region_id").alias("region_id_b"), F.col("spelling").alias("sb"))
    j = salted_join(a, b, "cls", m, F.col("region_id_a"), "inner")
    return j.where("region_id_a < region_id_b and sa <> sb").select("field", "region_id_a", "region_id_b").distinct()
