"""Texts cut off by field limits (problem 3).

Method: a structural completeness check. A stack automaton reads the text and
tells whether it ends inside a quotation, bracket, markup tag, escape or
multi-byte sequence, and how its last sentence ends. Ends without a
terminator are judged by the baseline of their feed: lengths at which
unterminated (or dotted) texts pile up far above their neighbours are the
feed's field limits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm import repetition

# Marks that end a sentence, marks that end broken-off speech, closers and their openers.
TERMINATORS = ".!?。！？．｡‼⁇⁈⁉।"
DASHES = "—―–─"
PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "」": "「", "』": "『", "”": "“", "»": "«", "》": "《", "】": "【", "〉": "〈"}
OPENERS = {v: k for k, v in PAIRS.items()} | {"„": "“"}
_BLANK_END = re.compile("[\\s­​-‏⁠﻿　]+$")
_ELLIPSIS = re.compile(r"(\.{2,}|…+|⋯+|．{2,}|‥+)$")
_BROKEN = re.compile(r"(�+|[\ud800-\udfff]|&#?\w{0,8}|\\u[0-9a-fA-F]{0,3}|%[0-9a-fA-F]|<[/a-zA-Z][^<>]{0,200})$")
_INNER = re.compile(r"[.!?。！？．](?=[\s\"”»」』]*\S)")
_LETTER = re.compile(r"[^\W\d_]")
_THAI = re.compile("[฀-๿]")


@dataclass
class End:
    """How a text ends: 'broken', 'ellipsis', 'dash', 'stop', 'closed' or 'open'; whether something is left unclosed; Thai letters last."""

    kind: str
    unclosed: bool
    thai: bool


def unclosed(text: str) -> bool:
    """True if the automaton ends with an opener on its stack."""
    stack: list[str] = []
    straight = False
    for c in text:
        if c in OPENERS:
            stack.append(c)
        elif c in PAIRS:
            # a German quotation opens with the low mark and closes with the mark that opens an English one
            if stack and (stack[-1] == PAIRS[c] or (c == "”" and stack[-1] == "„")):
                stack.pop()
        elif c == '"':
            straight = not straight
        if c == "“" and len(stack) > 1 and stack[-2] == "„":
            del stack[-2:]
    return straight or bool(stack)


_NO_STACK = re.compile("[" + re.escape("".join(OPENERS)) + '"]')


def end_of(text: str) -> End:
    t = _BLANK_END.sub("", text)
    open_ = bool(_NO_STACK.search(t)) and unclosed(t)
    last = t[-1:]
    thai = bool(last and _THAI.match(last))
    if _BROKEN.search(t):
        return End("broken", open_, thai)
    if _ELLIPSIS.search(t):
        return End("ellipsis", open_, thai)
    if last in TERMINATORS and last:
        return End("stop", open_, thai)
    if last in DASHES and last:
        return End("dash", open_, thai)
    if last in PAIRS or last in "\"'’♪♥★":
        return End("closed", open_, thai)
    return End("open", open_, thai)


@dataclass
class Limits:
    """Field limits by feed: (measure 'chars' or 'bytes', how texts end there, length)."""

    by_feed: dict[str, list[tuple[str, str, int]]] = field(default_factory=dict)

    def at(self, feed: str | None, kind: str, text: str) -> bool:
        """A text of this end lies at one of its feed's limits.

        A blank at the cut may have been stripped since, and a limit in bytes
        drops the character it splits.
        """
        for measure, ends, size in self.by_feed.get(feed or "", ()):
            if ends != kind:
                continue
            if measure == "chars" and len(text) in (size, size - 1):
                return True
            if measure == "bytes" and size - 3 <= len(text.encode()) <= size:
                return True
        return False


def is_caption(text: str) -> bool:
    """A text with a letter and without any end mark. Thai, which has none, doesn't tell."""
    e = end_of(text)
    return e.kind == "open" and not e.thai and _INNER.search(text) is None and _LETTER.search(text) is not None


def length_profile(regions: DataFrame) -> DataFrame:
    """(source, ends, measure, size, n): how many different unterminated or dotted translations of each feed have each length.

    A text that a feed repeats counts once. Ends that are the source's own
    don't count: unterminated translations of captions (``is_caption``) and
    dotted ones of speech that trails away. A pre-aggregated count over all
    rows; it has one row per feed and length.
    """
    t = F.col("translated_text")
    s = F.regexp_replace(F.coalesce("source_text", F.lit("")), "[\\s­​-‏⁠﻿　]+$", "")
    caption = s.rlike(r"[\p{L}\p{M}\p{N},;:、，]$") & s.rlike(r"\p{L}") & ~s.rlike("[.!?。！？．]|[฀-๿]$")
    bare = F.regexp_replace(t, "[\\s­​-‏⁠﻿　]+$", "")
    trails = s.rlike(r"(\.{2,}|…|⋯|．{2,}|‥)$")
    ends = F.when(bare.rlike(r"(\.{2,}|…)$"), F.when(~trails, "ellipsis")).when(bare.rlike(r"[\p{L}\p{M}\p{N},;:、，]$") & ~caption, "open")
    long = regions.select("source", ends.alias("ends"), t.alias("text"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes")).where("ends is not null and chars >= 20 and source is not null").distinct()
    both = long.select("source", "ends", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("measure", "size"))
    return both.groupBy("source", "ends", "measure", "size").agg(F.count("*").alias("n"))


def field_limits(regions: DataFrame, factor: float = 8.0, alpha: float = 1e-4, width: int = 12) -> DataFrame:
    """(source, measure, ends, size): lengths at which different texts pile up.

    A length is a limit if it has ``factor`` times the mean of the ``width``
    lengths on either side, and if chance makes that unlikely: the Chernoff
    bound of the Poisson tail, times the number of lengths tested for the feed,
    is below ``alpha``. Both scale with the feed: a small one needs few texts
    at a length where it else has none, a large one needs no more than its rate.
    """
    from pyspark.sql import Window as W

    p = length_profile(regions)
    all_lengths = W.partitionBy("source", "ends", "measure")
    w = all_lengths.orderBy("size").rangeBetween(-width, width)
    around = (F.sum("n").over(w) - F.col("n")) / F.lit(2.0 * width)
    x = p.withColumn("mean", F.greatest(around, F.lit(0.5 / width))).withColumn("tests", F.count("*").over(all_lengths))
    log_p = F.col("n") - F.col("mean") - F.col("n") * F.log(F.col("n") / F.col("mean"))
    return x.where((F.col("n") >= factor * F.col("mean")) & (log_p + F.log("tests") < F.log(F.lit(alpha)))).select("source", "measure", "ends", "size")


def limits_of(regions: DataFrame) -> Limits:
    """The feeds' limits on the driver: a few rows a feed, whatever the number of texts."""
    out = Limits()
    for r in field_limits(regions).collect():
        out.by_feed.setdefault(r["source"], []).append((r["measure"], r["ends"], r["size"]))
    return out


def n_sentences(text: str) -> int:
    return len(_INNER.findall(text)) + 1


def is_cut(text: str, source_text: str | None, feed: str | None, limits: Limits, bands: repetition.Bands) -> bool:
    """Whether a translation was cut.

    The source text tells what the end should be: a caption, name or cry
    without an end mark has a source without one (or a very short source),
    and is whole even at the length of a field limit.
    """
    if not _LETTER.search(text):
        return False
    e = end_of(text)
    if e.kind in ("stop", "dash") and not e.unclosed:
        return False
    s = source_text or ""
    if e.kind == "broken":
        cut = True
    elif e.kind == "ellipsis":
        cut = e.unclosed or limits.at(feed, "ellipsis", text)
        if cut and not e.unclosed and _ELLIPSIS.search(_BLANK_END.sub("", s)):
            cut = n_sentences(text) < n_sentences(s)
    elif e.unclosed:
        cut = True
    elif e.kind == "closed":
        cut = False
    elif limits.at(feed, "open", text) and not is_caption(s):
        cut = True
    elif e.thai:
        cut = False  # Thai sentences have no end mark
    elif _INNER.search(text):
        cut = True
    else:
        se = end_of(s)
        letters = len(_LETTER.findall(s))
        cut = letters > 8 and (se.kind in ("stop", "ellipsis", "dash") or (se.kind == "closed" and _INNER.search(s) is not None)) and not repetition.is_repetitive(s, bands)
    return cut and not repetition.is_repetitive(text, bands)


VERDICTS = "region_id long, source string, cut boolean"


def judge(regions: DataFrame, limits: Limits) -> DataFrame:
    """(region_id, source, cut) of every delivered translation; null translations have no row."""
    shared = regions.sparkSession.sparkContext.broadcast(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, lim = repetition.Bands(), shared.value
        for b in batches:
            cut = [is_cut(t, s, f, lim, bands) for t, s, f in zip(*(b.column(c).to_pylist() for c in ("translated_text", "source_text", "source")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("region_id"), b.column("source"), pa.array(cut, pa.bool_())], names=["region_id", "source", "cut"])

    return regions.where("translated_text is not null").select("region_id", "source", "source_text", "translated_text").mapInArrow(run, VERDICTS)


def cut_regions(regions: DataFrame) -> DataFrame:
    """(region_id): regions whose translation was cut. Repeated deliveries count once; null and letterless translations are no cases."""
    return judge(regions, limits_of(regions)).where("cut").select("region_id").distinct()


def feed_shares(regions: DataFrame) -> DataFrame:
    """(source, translations, cut, share): how often each feed cuts; a null feed has its own row."""
    d = judge(regions, limits_of(regions)).distinct()
    return d.groupBy("source").agg(F.count("*").alias("translations"), F.sum(F.col("cut").cast("long")).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("translations"), 6))
