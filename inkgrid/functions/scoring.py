"""Recognition quality and layout scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgrid.functions.text import is_punctuation, let


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Mean of a non-empty array."""
    return _sum(a) / F.size(a)


def deviation(a: Column, m: Column) -> Column:
    """Population standard deviation of a non-empty array with mean m."""
    return F.sqrt(_sum(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))


def quality(confidence: Column, char_conf: Column, text: Column) -> Column:
    """Quality of a recognised text.

    Null where the sentence confidence is null; the sentence confidence where
    there are none by character, or none left when those of punctuation are
    dropped (only if text and confidences have one length). Otherwise half
    sentence and half mean confidence, less a quarter of the share below 0.70
    and 0.08 of the standard deviation.
    """
    n = F.length(text)
    chars = F.split(text, "")
    kept = F.filter(F.arrays_zip(char_conf.alias("c"), chars.alias("t")), lambda z: ~is_punctuation(z["t"]))
    used = F.when(text.isNotNull() & (n == F.size(char_conf)), F.transform(kept, lambda z: z["c"])).otherwise(char_conf)
    low = lambda u: F.size(F.filter(u, lambda x: x < 0.70)) / F.size(u)
    spread = lambda u: let(mean(u), lambda m: 0.5 * m - 0.80 * deviation(u, m) * 0.1)
    score = let(used, lambda u: F.when(F.size(u) > 0, 0.5 * confidence + spread(u) - 0.25 * low(u)).otherwise(confidence))
    return F.when(confidence.isNull(), None).when(char_conf.isNull() | (F.size(char_conf) == 0), confidence).otherwise(score)


def passes(score: Column, least: float) -> Column:
    """Null scores pass: unknown isn't bad."""
    return score.isNull() | (score >= least)


def sentence_confidence(a: Column) -> Column:
    """Geometric mean; 0 if there is none or one isn't positive."""
    return F.when((F.size(a) > 0) & F.forall(a, lambda x: x > 0), F.exp(mean(F.transform(a, lambda x: F.ln(x))))).otherwise(F.lit(0.0))


def strip_with_confidences(text: Column, conf: Column) -> Column:
    """(text, conf): the text stripped, its confidences cut alike; null confidences where the lengths differ."""
    lead = F.length(text) - F.length(F.regexp_replace(text, r"^[\s\x{a0}\x{3000}]+", ""))
    bare = F.regexp_replace(text, r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", "")
    cut = F.when(F.length(text) == F.size(conf), F.slice(conf, lead + 1, F.length(bare)))
    return F.struct(bare.alias("text"), cut.alias("conf"))


def chosen_probability(logits: Column, token: Column) -> Column:
    """Softmax probability of one position of an array of logits (0-based), stable for large values."""
    top = F.array_max(logits)
    return F.exp(F.element_at(logits, (token + 1).cast("int")) - top) / _sum(F.transform(logits, lambda x: F.exp(x - top)))


def until_end(ids: Column, pad: int = 0, end: int = 2) -> Column:
    """Token ids before the first end or padding token."""
    stops = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(pad, end), i)), lambda i: i.isNotNull())
    return F.when(F.size(stops) > 0, F.slice(ids, 1, F.element_at(stops, 1))).otherwise(ids)


def longest_run(ids: Column) -> Column:
    """Length of the longest run of one token: the guard against loops forbids a twelfth repeat."""
    zero = F.struct(F.lit(-1).cast("long").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("m"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(a["v"] == x, a["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.cast("long").alias("v"), n.alias("n"), F.greatest(a["m"], n).alias("m"))

    return F.aggregate(F.coalesce(ids, F.array().cast("array<int>")), zero, step)["m"]


# --- layout ---------------------------------------------------------------------------------------


def _overflow(w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.greatest(F.lit(0.0), w - width) + F.greatest(F.lit(0.0), h - height)


def _ragged(sizes: Column, share: float, ends: Column) -> Column:
    """Points lost by uneven lines and by a stray last one (``share`` of the mean, unless a paragraph ends there)."""
    mu = mean(sizes)
    stray = F.when((F.element_at(sizes, -1) < share * mu) & ~F.element_at(ends, -1)["paragraph"], 40.0).otherwise(0.0)
    return F.when(F.size(sizes) > 1, 30.0 * deviation(sizes, mu) / F.greatest(F.lit(1.0), mu) + stray).otherwise(0.0)


def _common(size: Column, ends: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Points for the size and the filled share of the box, less 75 for each line that ends neither a sentence nor a paragraph."""
    broken = F.size(F.filter(ends, lambda e: ~e["sentence"] & ~e["paragraph"]))
    fill = F.least(F.lit(1.0), w * h / F.greatest(F.lit(1.0), width * height))
    return 25.0 * size + 40.0 * fill - 75.0 * broken


def horizontal_score(size: Column, widths: Column, ends: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Score of lines of the given widths set horizontally; ``ends`` has for each line whether a sentence and whether a paragraph ends with it."""
    over = _overflow(w, h, width, height)
    return F.when((w > width) | (h > height), -100000.0 - 100.0 * over).otherwise(_common(size, ends, w, h, width, height) - _ragged(widths, 0.35, ends))


def vertical_score(size: Column, heights: Column, counts: Column, ends: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Score of columns; short phrases may not be spread over columns, and columns of one character cost 300."""
    n = F.size(counts)
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    bad = (n >= 2) & ((F.array_max(counts) <= 1) | (total <= 3))
    single = F.when((n >= 2) & (F.array_min(counts) == 1), 300.0).otherwise(0.0)
    aspect = F.abs(w / F.greatest(F.lit(1.0), h) - width / F.greatest(F.lit(1.0), height))
    fine = _common(size, ends, w, h, width, height) - _ragged(heights, 0.30, ends) - single - 15.0 * aspect
    return F.when((w > width) | (h > height), -100000.0 - 100.0 * _overflow(w, h, width, height)).when(bad, -100000.0).otherwise(fine)


def vertical_mask_score(size: Column, largest: Column, counts: Column, sentences: Column, split_words: Column) -> Column:
    """Score of columns of characters in a mask: size, few breaks beyond the sentences, no split words, no stray last column, even lengths; -1 without columns."""
    n = F.size(counts)
    hi, lo, last = F.array_max(counts), F.array_min(counts), F.element_at(counts, -1)
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    extra = F.greatest(F.lit(0), n - sentences)
    stray = F.when((last == 1) & (hi >= 3), 0.45).when((last == 2) & (hi >= 5), 0.25).otherwise(0.0)
    score = size / F.greatest(F.lit(1), largest) - 0.15 * extra - F.when(extra > 0, 10.0 * split_words).otherwise(0.0)
    return F.when(n == 0, -1.0).when((n > 1) & ((hi <= 1) | (total <= 3)), -1000.0).when(n > 1, score - stray + 0.20 * lo / F.greatest(F.lit(1), hi)).otherwise(score)
