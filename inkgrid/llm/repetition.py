"""Repetition inside single texts (problem 4).

Method: compression bands. The normalised text (case, punctuation, spacing and
numbers removed) is compressed with zstandard as a whole and in fixed chunks.
Limits that depend on the length decide: up to the lower limit the text is
repetitive, above the upper one it is not. Only a text between the two, or one
of whose chunks alone is repetitive, is doubtful, and an exact measure of the
repeated share settles it. Raw texts that hardly compress at all are
incompressible.

The exact measure is also the answer where shares are asked for; it is taken
of every text, in whatever band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CHARS = 30  # shorter texts are never cases
SHARE = 0.5  # a case repeats more than this
CHUNK = 2048  # bytes of a fixed chunk
_NOISE = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"[a-zß-ɏЀ-ԯ가-힣]")
_TOKEN = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile("[.!?…。！？．｡।\n]+|(?<=[฀-๿])\\s+(?=[฀-๿])")


def normal(text: str) -> str:
    """Letters only, case folded."""
    return _NOISE.sub("", text).casefold()


def sure_limit(n_bytes: int) -> float:
    """Ratio up to which a text of so many bytes is repetitive.

    A text half of which repeats compresses to half of what its distinct half
    takes, plus a constant for the frame, the entropy tables and the matches
    that weighs the more the shorter the text is. Under some 90 bytes the
    constant outweighs the text and only a clear repetition is sure.
    """
    return min(0.62, 0.30 + 28.0 / max(n_bytes, 1))


def doubt_limit(n_bytes: int) -> float:
    """Ratio above which a text of so many bytes is not repetitive."""
    n = max(n_bytes, 1)
    return min(0.36 + 40.0 / n, 0.60 + 16.0 / n)


def incompressible_limit(n_bytes: int) -> float:
    """Ratio from which a raw text is incompressible; below 256 bytes none can be told from ordinary text."""
    return 0.70 + 50.0 / n_bytes if n_bytes >= 256 else float("inf")


class Bands:
    """Compressor of one Python worker."""

    def __init__(self) -> None:
        params = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=0, write_checksum=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.c = zstandard.ZstdCompressor(compression_params=params)

    def ratio(self, data: bytes) -> float:
        return len(self.c.compress(data)) / len(data)

    def band(self, text: str) -> tuple[str, float, float]:
        """('repetitive' | 'doubtful' | 'ordinary' | 'incompressible', ratio of the whole, least ratio of a chunk).

        Texts under 30 characters and letterless ones are ordinary, unless
        they are incompressible.
        """
        data, raw = normal(text).encode("utf-8", "replace"), text.encode("utf-8", "replace")
        n, whole = len(data), 1.0
        least = whole
        if data:
            whole = least = self.ratio(data)
            if n > CHUNK:
                # the last chunk takes the remainder, so that none is short
                cuts = list(range(0, n - CHUNK, CHUNK)) or [0]
                least = min(self.ratio(data[c : (c + CHUNK if k + 1 < len(cuts) else n)]) for k, c in enumerate(cuts))
            if len(text) >= MIN_CHARS:
                if whole <= sure_limit(n):
                    return "repetitive", whole, least
                if whole <= doubt_limit(n) or least <= sure_limit(min(n, CHUNK)):
                    return "doubtful", whole, least
        if len(raw) >= 256 and self.ratio(raw) >= incompressible_limit(len(raw)):
            return "incompressible", whole, least
        return "ordinary", whole, least


def repeated_share(text: str) -> float:
    """Share of the letters that repeat content that came earlier in the text.

    Three kinds of content count. A tandem run: units that equal those one
    period before, for at least one whole period (words said over and over, a
    drawn-out cry, a looping fragment). A recurring passage: at least six
    words (or twelve letters where words aren't spaced) that occurred before.
    A whole sentence, line or cry of any length that was said before. Shorter
    recurrences inside sentences (a name, 'in the') are ordinary language.
    """
    sents = [_TOKEN.findall(x) for x in _SENTENCE_END.split(text.casefold())]
    words = [w for x in sents for w in x]
    if not words:
        return 0.0
    letters = "".join(words)
    spaced = sum(map(len, (w for w in words if _SPACED.match(w)))) * 2 > len(letters)
    n = len(letters)
    covered = bytearray(n)
    _tandem(letters, covered)
    if spaced and len(words) > 1:
        _passages(words, 6, covered, [len(w) for w in words])
        _tandem_words(words, covered)
    else:
        _passages(letters, 12, covered, None)
    _sentences(sents, covered)
    return sum(covered) / n


_RUN = re.compile(r"(.{1,24}?)\1+", re.DOTALL)


def _tandem(s: str, covered: bytearray) -> None:
    """Mark letters of tandem runs with periods up to 24 letters."""
    n = len(s)
    for m in _RUN.finditer(s):
        p, i, end = len(m.group(1)), m.start(), m.end()
        while end < n and s[end] == s[end - p]:
            end += 1
        # 'll' or 'noon' are no cries
        if end - i - p >= (4 if p == 1 else 3 * p if p < 4 else p):
            covered[i + p : end] = b"\x01" * (end - i - p)


def _tandem_words(words: list[str], covered: bytearray) -> None:
    """Mark words of tandem runs with any period; the last word of a run may be cut."""
    n = len(words)
    at = [0]
    for w in words:
        at.append(at[-1] + len(w))
    where: dict[str, int] = {}
    tried: dict[int, int] = {}  # how far words were found equal to those a period before, for runs short of a period
    run_end = 0
    for i, w in enumerate(words):
        j = where.get(w)
        where[w] = i
        if j is None or i < run_end:
            continue
        p = i - j
        if i < tried.get(p, 0):
            continue  # part of a run that began earlier and was too short
        k = i
        while k < n and words[k] == words[k - p]:
            k += 1
        if k - i < p or (p == 1 and k - i < 2):
            tried[p] = k
            continue
        if k < n and words[k - p].startswith(words[k]):
            k += 1
        covered[at[i] : at[k]] = b"\x01" * (at[k] - at[i])
        run_end = k


def _passages(seq: str | list[str], least: int, covered: bytearray, lens: list[int] | None) -> None:
    """Mark passages of at least ``least`` units that occurred wholly before, without overlap."""
    n = len(seq)
    at = list(range(n + 1))
    if lens is not None:
        at = [0]
        for x in lens:
            at.append(at[-1] + x)
    seen: dict = {}
    for i in range(n - least + 1):
        key = seq[i : i + least] if lens is None else tuple(seq[i : i + least])
        j = seen.setdefault(key, i)
        if j + least <= i:
            covered[at[i] : at[i + least]] = b"\x01" * (at[i + least] - at[i])


def _sentences(sents: list[list[str]], covered: bytearray) -> None:
    """Mark whole sentences, lines and cries that were said before."""
    seen: set[str] = set()
    i = 0
    for words in sents:
        key = "".join(words)
        if key and key in seen:
            covered[i : i + len(key)] = b"\x01" * len(key)
        seen.add(key)
        i += len(key)


MEASURES = "region_id long, field string, band string, ratio double, chunk_ratio double, share double"


def _texts(regions: DataFrame) -> DataFrame:
    pair = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("source_text", "translated_text")])
    return regions.select("region_id", F.explode(pair).alias("x")).select("region_id", "x.field", "x.text")


def measure(texts: DataFrame, every: bool = True) -> DataFrame:
    """(region_id, field, band, ratio, chunk_ratio, share) of rows (region_id, field, text).

    Without ``every``, ``share`` is null (not measured) but for doubtful texts.
    Null texts have no row; empty and letterless texts are ordinary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for b in batches:
            coded = b.column("text").dictionary_encode()
            got = []
            for t in coded.dictionary.to_pylist():
                band, whole, least = bands.band(t)
                got.append((band, round(whole, 6), round(least, 6), round(repeated_share(t), 6) if every or band == "doubtful" else None))
            rows = [got[i] for i in coded.indices.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("region_id"), b.column("field"), *(pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()), (3, pa.float64())))],
                names=["region_id", "field", "band", "ratio", "chunk_ratio", "share"],
            )

    return texts.where("text is not null").select("region_id", "field", "text").mapInArrow(run, MEASURES)


def repetitive(regions: DataFrame) -> DataFrame:
    """(region_id, field): texts of at least 30 characters that the bands find repetitive, or find doubtful and whose repeated share is more than half."""
    long_enough = _texts(regions).where(F.length("text") >= MIN_CHARS)
    case = (F.col("band") == "repetitive") | ((F.col("band") == "doubtful") & (F.col("share") > SHARE))
    return measure(long_enough, every=False).where(case).select("region_id", "field").distinct()


def shares(regions: DataFrame) -> DataFrame:
    """(region_id, field, band, share): the band and the share of repeated content of every text, of any length."""
    return measure(_texts(regions)).select("region_id", "field", "band", "share").distinct()


def is_repetitive(text: str, bands: Bands) -> bool:
    if len(text) < MIN_CHARS:
        return False
    band = bands.band(text)[0]
    return band == "repetitive" or (band == "doubtful" and repeated_share(text) > SHARE)
