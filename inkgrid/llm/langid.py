"""Language labels for whole texts and for single-language stretches (problem 1).

Method: one interpolated Kneser-Ney character model per language. The n-grams
of the models of one script lie in one sorted 64-bit hash array per order, with
a row of log-probabilities (a column per language) beside it, so that a batch
of texts is scored by one search per order. The language with the lowest
length-normalised cross-entropy (nats a character) is chosen. Two calibrated
limits reject it: the cross-entropy of its own language's held-out texts, so
that a language that no model knows is none of the nine, and the lead over the
runner-up, so that what fits two languages is unsure.

The models are fitted on a bounded sample of labelled rows (``per_label`` rows
of each label and column, the rows with the smallest hash of their key).
Labels may be wrong, so fitting runs twice: the first models relabel the
sample, rows that contradict their label are dropped, and the second models
are fitted on the rest.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm.sampling import least_hashed

LANGS = ("en", "de", "fr", "es", "ru", "ja", "zh", "ko", "th")

# ISO 639-2/3 codes of the nine languages beside their two-letter codes.
CODE3 = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru",
    "jpn": "ja", "zho": "zh", "chi": "zh", "cmn": "zh", "kor": "ko", "tha": "th",
}

ORDER = 4
FLOOR = np.float32(np.log(1e-6))
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SCRIPT_OF = {"en": 1, "de": 1, "fr": 1, "es": 1, "ru": 2, "ko": 3, "ja": 4, "zh": 4, "th": 5}


def normal_code(label: Column) -> Column:
    """Two-letter code named by a label in any spelling, null where it names none of the nine."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    three = F.create_map(*[F.lit(x) for kv in CODE3.items() for x in kv])
    return F.when(head.isin(*LANGS), head).otherwise(three[F.when(head.isin(*CODE3), head)])


# --- characters ------------------------------------------------------------------------------


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each BMP code point: folded code, script (0 none, 1 Latin, 2 Cyrillic, 3 Hangul, 4 Han and kana, 5 Thai), is letter."""
    import unicodedata

    fold = np.arange(65536, dtype=np.uint32)
    script = np.zeros(65536, np.int8)
    letter = np.zeros(65536, bool)
    for cp in range(65536):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cs":
            fold[cp] = 32
            continue
        k = unicodedata.normalize("NFKC", ch).lower()
        if len(k) == 1:
            fold[cp] = ord(k)
        if cat[0] in "ZC" and cat != "Cs":
            fold[cp] = 32
        elif cat[0] == "N" and unicodedata.digit(ch, None) is not None:
            fold[cp] = 48
        letter[cp] = cat[0] == "L" or (cat[0] == "M" and 0x0E00 <= cp < 0x0E80)
        if letter[cp]:
            c = int(fold[cp])
            if c < 0x250 or 0x1E00 <= c < 0x1F00 or 0xFB00 <= cp < 0xFB07:
                script[cp] = 1
            elif 0x400 <= c < 0x530:
                script[cp] = 2
            elif 0x1100 <= c < 0x1200 or 0x3130 <= c < 0x3190 or 0xAC00 <= c < 0xD7B0:
                script[cp] = 3
            elif 0x3040 <= c < 0x3100 or 0x31F0 <= c < 0x3200 or 0x3400 <= c < 0xA000 or 0xF900 <= c < 0xFB00:
                script[cp] = 4
            elif 0x0E00 <= c < 0x0E80:
                script[cp] = 5
    return fold, script, letter


_CACHE: dict = {}


def char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "t" not in _CACHE:
        _CACHE["t"] = _tables()
    return _CACHE["t"]


_INVISIBLE = "\u00ad\u200b-\u200f\u2060\ufeff"
_ODD = re.compile("[\u0300-\u036f\u0370-\u03ff\u1100-\u11ff\ufb00-\ufb06\uff9e\uff9f" + _INVISIBLE + "]")
_HIDDEN = re.compile("[" + _INVISIBLE + "]")
#: Cyrillic and Greek letters of Latin shape, for Latin text with strangers in it.
_STRANGE = dict(zip(map(ord, "аеорсухіјѕԁһАВЕКМНОРСТУХІЈЅοανιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"), "aeopcyxijsdhABEKMHOPCTYXIJSoaviABEZHIKMNOPTYX", strict=True))
_NATIVE = {ord(v): chr(k) for k, v in _STRANGE.items() if 0x400 <= k < 0x530 and v in "aeopcyxABEKMHOPCTYX"}
_WORDS = re.compile(r"[^\W\d_]+")


def _settle(m: re.Match) -> str:
    """A word of Latin and Cyrillic letters mixed is written in the script that most of its letters need."""
    w = m.group()
    cyr = sum("\u0400" <= c < "\u0530" for c in w)
    lat = sum(c < "\u0250" for c in w)
    if cyr and lat:
        hard = sum("\u0400" <= c < "\u0530" and ord(c) not in _STRANGE for c in w)
        return w.translate(_NATIVE if hard else _STRANGE)
    return w


def plain(text: str) -> str:
    """Text as the models read it: composed, without invisible characters and look-alikes."""
    if text.isascii() or not (_ODD.search(text) or _mixed(text)):
        return text
    import unicodedata

    t = unicodedata.normalize("NFKC", text)
    t = _HIDDEN.sub("", t)
    t = t.translate({k: v for k, v in _STRANGE.items() if 0x370 <= k < 0x400})
    return _WORDS.sub(_settle, t) if _mixed(t) else t


_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0400-\u052f]|[\u0400-\u052f][A-Za-z\u00c0-\u024f]")


def _mixed(text: str) -> bool:
    return _MIXED.search(text) is not None


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each led by a line break, and the start of each text."""
    joined = "\n" + "\n".join(texts) + "\n"
    a = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = 1 + np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    return np.minimum(a, 65535), starts


# --- model -----------------------------------------------------------------------------------


@dataclass
class Models:
    """The models of the languages of one script: sorted hashes, log-probability rows and back-off rows by order."""

    langs: tuple[str, ...]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]

    def __post_init__(self) -> None:
        # a directory over the leading bits of each sorted array, with about two slots a hash
        self.bits = [max(4, len(g).bit_length() + 1) for g in self.grams]
        self.slots = [np.searchsorted(g >> np.uint64(64 - k), np.arange((1 << k) + 1, dtype=np.uint64)).astype(np.int32) for g, k in zip(self.grams, self.bits, strict=True)]

    def row(self, n: int, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the sorted array, or -1."""
        g, slots = self.grams[n], self.slots[n]
        p = (h >> np.uint64(64 - self.bits[n])).astype(np.int32)
        i, stop = slots[p], slots[p + 1]
        out = np.full(len(h), -1, np.int32)
        k = np.flatnonzero(i < stop)
        while len(k):
            at = i[k]
            hit = g[at] == h[k]
            out[k[hit]] = at[hit]
            rest = ~hit & (at + 1 < stop[k])
            k = k[rest]
            i[k] += 1
        return out

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Natural-log probability of each position under each language, float32 [positions, languages]."""
        hs = hashes(codes)
        at = self.row(0, hs[0])
        s = np.where((at >= 0)[:, None], self.logp[0][at], FLOOR)
        for n in range(1, ORDER):
            prev = np.concatenate([[np.int32(-1)], at[:-1]])
            live = np.flatnonzero(prev >= 0)  # without the context there is no longer n-gram and nothing to pay
            at = np.full(len(codes), -1, np.int32)
            got = self.row(n, hs[n][live])
            at[live] = got
            seen = got >= 0
            hit, miss = live[seen], live[~seen]
            s[miss] += self.back[n - 1][prev[miss]]
            s[hit] = self.logp[n][got[seen]]
        return s


@dataclass
class Bank:
    """Models by script; the lead in nats below which a choice is unsure; for each language the cross-entropy (nats a character) above which a sentence isn't written in it."""

    families: dict[int, Models]
    margin: float = 6.0
    limits: np.ndarray = field(default_factory=lambda: np.full(len(LANGS), np.inf))

    def save(self, path: str) -> None:
        """Write to a file; ``Bank.load`` reads it, so that several queries share one fit."""
        with open(path, "wb") as f:
            pickle.dump(self, f)

    @staticmethod
    def load(path: str) -> Bank:
        """Read what ``save`` wrote (a trusted file of one's own)."""
        with open(path, "rb") as f:
            return pickle.load(f)


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each position, for n = 1..ORDER (windows at the very start wrap into a pad)."""
    c = codes.astype(np.uint64) + np.uint64(1)
    c = (c ^ (c << np.uint64(21))) * _MULT
    out, h = [c], c
    with np.errstate(over="ignore"):
        for n in range(1, ORDER):
            prev = np.concatenate([[np.uint64(7 + n)], h[:-1]])
            h = (prev * np.uint64(0xD6E8FEB86659FD93) + c) ^ (prev >> np.uint64(29))
            out.append(h)
    return out


def _groups(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, the place of one of each, counts): as ``np.unique`` does, with the faster unstable sort."""
    order = np.argsort(a)
    s = a[order]
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[edge], order[edge], np.diff(np.append(edge, len(s)))


def _one(codes: np.ndarray) -> tuple[list[dict], list[np.ndarray]]:
    """Counts of one language: by order, the distinct n-grams with suffix, context and count."""
    hs = hashes(codes)
    out = []
    for n in range(ORDER):
        u, first, cnt = _groups(hs[n])
        ctx = hs[n - 1][np.maximum(first - 1, 0)] if n else np.zeros(len(u), np.uint64)
        suf = hs[n - 1][first] if n else np.zeros(len(u), np.uint64)
        out.append({"u": u, "ctx": ctx, "suf": suf, "cnt": cnt})
    for n in range(ORDER - 1):  # continuation counts: distinct left neighbours
        s, k = np.unique(out[n + 1]["suf"], return_counts=True)
        i = np.searchsorted(s, out[n]["u"])
        i[i == len(s)] = 0
        out[n]["cnt"] = np.where(s[i] == out[n]["u"], k[i], 1)
    return out


def fit_models(texts: dict[str, list[str]]) -> Bank:
    """Kneser-Ney models of all languages, those of one script over the union of their n-grams."""
    scripts = sorted(set(_SCRIPT_OF.values()))
    return Bank({k: _fit_family(tuple(x for x in LANGS if _SCRIPT_OF[x] == k), texts) for k in scripts})


def _fit_family(langs: tuple[str, ...], texts: dict[str, list[str]]) -> Models:
    fold = char_tables()[0]
    counts, alphabets = [], 1
    for lang in langs:
        codes, _ = codes_of([plain(t) for t in texts.get(lang, [])] or [""])
        counts.append(_one(fold[codes]))
        alphabets = max(alphabets, len(counts[-1][0]["u"]))
    grams, logp, back = [], [], []
    for n in range(ORDER):
        union, first, _ = _groups(np.concatenate([c[n]["u"] for c in counts]))
        ctx = np.concatenate([c[n]["ctx"] for c in counts])[first]
        suf = np.concatenate([c[n]["suf"] for c in counts])[first]
        lp = np.empty((len(union), len(langs)), np.float32)
        for j, c in enumerate(counts):
            d = c[n]
            i = np.searchsorted(d["u"], union)
            i[i == len(d["u"])] = 0
            seen = d["u"][i] == union
            cnt = np.where(seen, d["cnt"][i], 0).astype(np.float64)
            ones, twos = (d["cnt"] == 1).sum(), (d["cnt"] == 2).sum()
            disc = min(0.95, max(0.1, ones / max(1.0, ones + 2.0 * twos)))
            if n == 0:
                total = d["cnt"].sum()
                lower = 1.0 / (4 * alphabets)
                lam = disc * len(d["u"]) / total
                lp[:, j] = np.log(np.maximum(np.maximum(cnt - disc, 0) / total + lam * lower, 1e-6))
                continue
            keys, inv = np.unique(d["ctx"], return_inverse=True)
            tot = np.bincount(inv, d["cnt"])
            lam = disc * np.bincount(inv) / tot
            k = np.searchsorted(keys, ctx)
            k[k == len(keys)] = 0
            known = keys[k] == ctx
            low = np.searchsorted(grams[n - 1], suf)
            lower = np.exp(logp[n - 1][low, j].astype(np.float64))
            p = np.where(known, np.maximum(cnt - disc, 0) / tot[k] * seen + lam[k] * lower, lower)
            lp[:, j] = np.log(np.maximum(p, 1e-12))
            b = back[n - 1]
            at = np.searchsorted(grams[n - 1], keys)
            ok = (at < len(grams[n - 1])) & (grams[n - 1][np.minimum(at, len(grams[n - 1]) - 1)] == keys)
            b[at[ok], j] = np.log(np.maximum(lam[ok], 1e-6))
        grams.append(union)
        logp.append(lp)
        back.append(np.zeros_like(lp))
    return Models(langs, grams, logp, back)


# --- decisions -------------------------------------------------------------------------------

_END = frozenset(".!?。！？…\n/|()（）[]「」『』«»“”„\"‼⁉")


def _end_table() -> np.ndarray:
    if "e" not in _CACHE:
        t = np.zeros(65536, bool)
        t[[ord(c) for c in _END]] = True
        _CACHE["e"] = t
    return _CACHE["e"]


CLEAR = 0.5  # nats a character: with such a lead a sentence of unheard-of words is still in its language
VARIED = 8  # different letters that a sentence has at least
CRY = 4  # different letters below which a loop ('no no no') tells no language


@dataclass
class Decided:
    """Stretches of a batch of texts (arrays by stretch) and the language of each whole text (arrays by text; -1 none)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    size: np.ndarray  # characters, with the break before
    lang: np.ndarray
    entropy: np.ndarray  # nats a character in the chosen language
    lead: np.ndarray  # nats over the runner-up; infinite where no other language writes the script
    sure: np.ndarray
    foreign: np.ndarray  # a sentence that no model accepts
    whole: np.ndarray
    whole_sure: np.ndarray
    single: np.ndarray  # all sure stretches of the text have one language
    unknown: np.ndarray  # the text has foreign sentences and no sure one


def _said_before(codes: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Positions whose last eight characters ended an earlier position of the same stretch."""
    h = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for step in (1, 2, 4):  # hashes of windows of 2, 4 and 8
            h = h * _MULT + (np.concatenate([np.arange(step, dtype=np.uint64), h[:-step]]) ^ (h >> np.uint64(31)))
        h = (h + stretch.astype(np.uint64)) * _MULT
    # hash and position in one number, so that a plain sort puts equal windows side by side in their order
    bits = np.uint64(max(1, len(h)).bit_length())
    v = np.sort(((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64))
    near = (v[1:] >> bits) == (v[:-1] >> bits)
    place = (np.uint64(1) << bits) - np.uint64(1)
    late, early = (v[1:][near] & place).astype(np.int64), (v[:-1][near] & place).astype(np.int64)
    same = (stretch[late] == stretch[early]) & (early >= 7)
    for j in range(8):  # equal hashes are looked at
        same &= codes[late - j] == codes[np.maximum(early - j, 0)]
    out = np.zeros(len(h), bool)
    out[late[same]] = True
    return out


def decide(bank: Bank, texts: list[str]) -> Decided:
    """Cut texts into stretches and give each its language.

    A stretch is cut at sentence marks, brackets, line breaks and changes of
    script. One that is long enough to be a sentence (three words, or five
    letters where words aren't spaced) is foreign if its cross-entropy is over
    the limit of its best language without a clear lead, and sure if not and
    its lead reaches the margin. Positions are those of ``plain(text)`` where that differs from the
    text.
    """
    fold, script, letter = char_tables()
    texts = [plain(t) for t in texts]
    raw, starts = codes_of(texts)
    folded = fold[raw]
    sc, le = script[raw], letter[raw]
    # the script in force at each position: that of the last letter before it
    pos = np.where(sc > 0, np.arange(len(sc)), 0)
    carried = sc[np.maximum.accumulate(pos)]
    end = _end_table()[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = (end[:-1] & ~end[1:]) | ((carried[1:] != carried[:-1]) & (carried[1:] > 0))
    cut[starts] = True
    b = np.flatnonzero(cut)
    stop = np.append(b[1:], len(raw))
    size = stop - b + 1
    letters = np.add.reduceat(le.astype(np.int32), b)
    spaces = np.add.reduceat(((folded == 32) & np.concatenate([[False], le[:-1]])).astype(np.int32), b)
    kind = np.maximum.reduceat(np.where(le, sc, 0), b)
    text_of = np.searchsorted(starts, b, side="right") - 1
    n = len(texts)
    lang = np.full(len(b), -1)
    lead = np.zeros(len(b))
    looped = np.zeros(len(b), bool)
    entropy = np.full((len(b), len(LANGS)), np.inf)
    for family, m in bank.families.items():
        k = np.flatnonzero(kind == family)
        if not len(k):
            continue
        cols = np.array([LANGS.index(x) for x in m.langs])
        # the stretches of this script in a row, each led by a line break
        first = np.cumsum(size[k]) - size[k]
        at = np.repeat(b[k] - 1 - first, size[k]) + np.arange(size[k].sum())
        codes = folded[at]
        codes[first] = 10
        scored = m.score(codes)
        again = _said_before(codes, np.repeat(np.arange(len(k)), size[k]))
        scored[again] = 0  # a loop is no more evidence than its unit
        looped[k] = 2 * np.add.reduceat(again.astype(np.int32), first) > size[k]
        h = -np.add.reduceat(scored, first, axis=0) / size[k][:, None]
        entropy[k[:, None], cols] = h
        lang[k] = cols[np.argmin(h, axis=1)]
        if len(cols) == 1:
            lead[k] = np.inf
        else:
            two = np.partition(h, 1, axis=1)
            lead[k] = (two[:, 1] - two[:, 0]) * size[k]
    best = entropy.min(axis=1, initial=np.inf)
    own = np.where(kind >= 3, letters >= 5, (spaces >= 2) & (letters >= 9)) & (lang >= 0)
    foreign = own & (best > bank.limits[lang]) & (np.isinf(lead) | (lead < CLEAR * size))
    cry = np.zeros(len(b), bool)
    for k in np.flatnonzero(foreign | looped):  # such stretches are few
        varied = len(np.unique(folded[b[k] : stop[k]][le[b[k] : stop[k]]]))
        foreign[k] &= varied >= VARIED  # a cry said over and over is no sentence
        cry[k] = looped[k] and varied < CRY and np.isfinite(lead[k])
    sure = own & ~foreign & ~cry & (lead >= bank.margin)
    # whole texts: stretches weigh by their length; other scripts pay four nats a letter
    nats = np.where(np.isfinite(entropy), entropy * size[:, None], np.where(kind > 0, np.where(np.isfinite(best), best * size, 0) + 4.0 * letters, 0.0)[:, None])
    edge = np.searchsorted(text_of, np.arange(n))
    total = np.add.reduceat(nats, edge, axis=0)
    n_letters = np.add.reduceat(letters, edge)
    two = np.partition(total, 1, axis=1)
    whole = np.where(n_letters > 0, np.argmin(total, axis=1), -1)
    hi = np.maximum.reduceat(np.where(sure, lang, -1), edge)
    lo = np.minimum.reduceat(np.where(sure, lang, 99), edge)
    single = (hi == lo) & (hi >= 0)
    unknown = (hi < 0) & np.maximum.reduceat(foreign.astype(np.int8), edge).astype(bool)
    whole = np.where(single & (whole >= 0), hi, np.where(unknown, -1, whole))
    # a text without a sentence of its own (a cry, a name) is sure only by a wide lead over enough letters,
    # or where all its letters are of a script that only one of the languages writes
    alone = np.minimum.reduceat(np.where(kind > 0, kind, 9), edge) == np.maximum.reduceat(kind, edge)
    cries = np.maximum.reduceat(cry.astype(np.int8), edge).astype(bool)
    whole_sure = (hi >= 0) | ((two[:, 1] - two[:, 0] >= 2.5 * bank.margin) & (n_letters >= 10) & ~cries) | (alone & np.minimum.reduceat(np.isinf(lead) | (kind == 0), edge))
    base = starts[text_of]
    lens = np.fromiter((len(t) for t in texts), np.int64, n)
    return Decided(text_of, b - base, np.minimum(stop - base, lens[text_of]), size, lang, best, lead, sure, foreign, whole, whole_sure, single | (hi < 0), unknown)


#: What a sentence is labelled that no model accepts.
NONE = "und"


def joined_stretches(bank: Bank, d: Decided, n: int) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, language, confidence) of each text's stretches; unsure ones take the language before them, neighbours of one language are joined.

    The confidence is the odds of the choice against the runner-up, or against
    the limit of its language if that is nearer (over it, what the lead exceeds
    a clear one by); 0.5 where unsure. Foreign sentences are ``und``, with the
    odds of the limit against them.
    """
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(n)]
    near: dict[int, int] = {}
    for k in np.flatnonzero(d.sure)[::-1]:
        near[int(d.text[k])] = int(d.lang[k])  # ends as the first sure language of each text
    for k in np.flatnonzero(d.lang >= 0):
        i = int(d.text[k])
        below = float(bank.limits[d.lang[k]] - d.entropy[k]) * int(d.size[k])
        if d.foreign[k]:
            lang, odds = NONE, -below
        else:
            if d.sure[k]:
                near[i] = int(d.lang[k])
            lang = LANGS[near.get(i, int(d.whole[i]))] if i in near or d.whole[i] >= 0 else NONE
            clear = float(d.lead[k]) - CLEAR * int(d.size[k])
            odds = (min(float(d.lead[k]), below) if below > 0 else clear) if d.sure[k] else 0.0
        conf = float(1 / (1 + np.exp(-min(50.0, max(-50.0, odds)))))
        parts = out[i]
        if parts and parts[-1][2] == lang:
            s, _, _, c = parts[-1]
            parts[-1] = (s, int(d.end[k]), lang, max(c, conf))
        else:
            parts.append((int(d.start[k]), int(d.end[k]), lang, conf))
    return out


def languages(d: Decided, i: int) -> list[str]:
    """Languages truly present in text ``i``."""
    if d.single[i]:
        return [LANGS[d.whole[i]]] if d.whole[i] >= 0 else []
    k = (d.text == i) & d.sure
    return sorted({LANGS[x] for x in d.lang[k]})


# --- fitting on a sample -----------------------------------------------------------------------

MAX_CHARS = 4000  # longer texts are no training rows (they are labelled like any other)


def training_sample(documents: DataFrame | None, regions: DataFrame | None, per_label: int = 1200, max_chars: int = MAX_CHARS) -> DataFrame:
    """(lang, text): at most ``3 * per_label`` rows a language of at most ``max_chars`` characters, whatever the size of the tables. Each table is read once, and its labels once more to count them."""
    parts, usable = [], f"length(text) between 1 and {int(max_chars)}"
    if documents is not None:
        d = documents.select(normal_code(F.col("lang")).alias("lang"), "text", F.col("doc_id").alias("k"))
        parts.append(least_hashed(d, "k", per_label, ("lang",), usable).select("lang", "text"))
    if regions is not None:
        both = F.array(*[F.struct(F.lit(t).alias("field"), normal_code(F.col(c)).alias("lang"), F.col(t).alias("text")) for t, c in (("source_text", "source_lang"), ("translated_text", "translated_lang"))])
        r = regions.select(F.col("region_id").alias("k"), F.explode(both).alias("x")).select("k", "x.field", "x.lang", "x.text")
        parts.append(least_hashed(r, "k", per_label, ("field", "lang"), usable).select("lang", "text"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fit_on(sample: DataFrame) -> Bank:
    """Fit, relabel, fit again, calibrate. The sample is bounded (see ``training_sample``), so it fits the driver."""
    rows = sorted({(r["lang"], r["text"]) for r in sample.collect()})
    return fit_rows(rows)


_KANA = re.compile("[ぁ-ヺ]")
SHORT = 20  # characters; shorter unsure rows are kept with the label they have
FOLDS = 4  # that the training rows are cleaned in


def fit_rows(rows: list[tuple[str, str]]) -> Bank:
    def group(rs: list[tuple[str, str]]) -> dict[str, list[str]]:
        g: dict[str, list[str]] = {}
        for lang, t in rs:
            g.setdefault(lang, []).append(t)
        return g

    # a row that is written in kana to a fourth isn't Chinese, whatever it is labelled
    rows = [r for r in rows if r[0] != "zh" or 4 * len(_KANA.findall(r[1])) <= len(r[1])]
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    kept = [r for k, r in enumerate(rows) if k % 5]

    def agrees(m: Bank, rs: list[tuple[str, str]]) -> list[tuple[str, str]]:
        if not rs:
            return []
        d = decide(m, [t for _, t in rs])
        one = {x: i for i, x in enumerate(LANGS)}
        return [r for i, r in enumerate(rs) if (d.single[i] and d.whole[i] == one[r[0]]) or (not d.whole_sure[i] and len(r[1]) < SHORT)]

    # rows are judged by models that haven't seen them, nor texts that begin alike: else a few texts
    # of one kind under a wrong label vouch for each other
    kept.sort(key=lambda r: (r[1], r[0]))
    folds = [kept[len(kept) * i // FOLDS : len(kept) * (i + 1) // FOLDS] for i in range(FOLDS)]
    lone = {x for x in LANGS if sum(y == _SCRIPT_OF[x] for y in _SCRIPT_OF.values()) == 1}

    def without(i: int) -> Bank:
        """Models of all folds but one; of languages alone in their script, whose choice needs no model, a few texts will do."""
        texts = group([r for j, f in enumerate(folds) if j != i for r in f])
        return fit_models({x: t[:20] if x in lone else t for x, t in texts.items()})

    clean = group([r for i, fold in enumerate(folds) for r in agrees(without(i), fold)])
    # where a third of a language's rows would go, the sample is too small for that: its labels stand
    # at first, and the rows are judged by models that have seen them
    thin = [x for x, texts in group(kept).items() if 3 * len(clean.get(x, [])) < 2 * len(texts)]
    kept = [(x, t) for x, texts in group(kept).items() for t in (texts if x in thin else clean[x])]
    m = fit_models(group(kept))
    if thin:
        kept = agrees(m, kept)
        m = fit_models(group(kept))
    clean = agrees(m, held)
    margin, limits = calibrate(m, clean)
    m = fit_models(group(kept + clean))
    m.margin, m.limits = margin, limits
    return m


def calibrate(m: Bank, held: list[tuple[str, str]], error: float = 0.002, room: float = 1.6, least: int = 20) -> tuple[float, np.ndarray]:
    """The margin and the limits from held-out texts.

    The margin is the smallest lead at which at most ``error`` of the stretches
    with at least that lead get a wrong language, within 3 to 12 nats. The
    limit of a language is ``room`` times the cross-entropy that 99 % of its
    held-out sentences stay below; with fewer than ``least`` sentences it
    rejects nothing.
    """
    limits = np.full(len(LANGS), np.inf)
    if not held:
        return 6.0, limits
    d = decide(m, [t for _, t in held])
    k = np.flatnonzero(d.lang >= 0)
    truth = np.array([LANGS.index(x) for x, _ in held])[d.text[k]]
    # a stretch in another script than its text's label is no error of the models
    same = np.array([_SCRIPT_OF[x] for x in LANGS])
    k, truth = k[same[truth] == same[d.lang[k]]], truth[same[truth] == same[d.lang[k]]]
    for i in range(len(LANGS)):
        h = d.entropy[k[(truth == i) & d.sure[k] & (d.lang[k] == i)]]
        if len(h) >= least:
            limits[i] = room * np.quantile(h, 0.99)
    two = np.isfinite(d.lead[k])  # scripts with a choice
    k, truth = k[two], truth[two]
    o = np.argsort(-d.lead[k])
    bad = np.cumsum(d.lang[k][o] != truth[o]) / np.arange(1, len(o) + 1)
    ok = np.flatnonzero(bad <= error)
    return (float(min(12.0, max(3.0, d.lead[k][o][ok[-1]]))) if len(ok) else 12.0), limits


def models_for(spark: SparkSession, documents: DataFrame | None, regions: DataFrame | None, per_label: int = 1200):
    """Fitted models as a Spark broadcast (a few tens of MB at most: the sample is bounded)."""
    return spark.sparkContext.broadcast(fit_on(training_sample(documents, regions, per_label)))


# --- operators -------------------------------------------------------------------------------

SEGMENTS = "region_id long, field string, start_pos int, end_pos int, lang string, confidence double"
VERDICTS = "region_id long, field string, langs array<string>, sure boolean, label string"


def _long(regions: DataFrame) -> DataFrame:
    """One row per text: region_id, field, text, label (two-letter code or null)."""
    pair = F.array(
        F.struct(F.lit("source_text").alias("field"), F.col("source_text").alias("text"), normal_code(F.col("source_lang")).alias("label")),
        F.struct(F.lit("translated_text").alias("field"), F.col("translated_text").alias("text"), normal_code(F.col("translated_lang")).alias("label")),
    )
    return regions.select("region_id", F.explode(pair).alias("x")).select("region_id", "x.field", "x.text", "x.label").where(F.col("text").rlike(r"\p{L}"))


def segment_languages(regions: DataFrame, models) -> DataFrame:
    """Each single-language stretch of each text: language (``und`` for sentences in none of the nine), confidence and code-point range of the plain form.

    Null and letterless texts have no row; repeated deliveries count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models.value
        for batch in batches:
            ids, fields, texts = (batch.column(c).to_pylist() for c in ("region_id", "field", "text"))
            rows: list[list] = [[], [], [], [], [], []]
            if texts:
                for i, f, parts in zip(ids, fields, joined_stretches(m, decide(m, texts), len(texts)), strict=True):
                    for start, end, lang, conf in parts:
                        for col, v in zip(rows, (i, f, start, end, lang, round(conf, 6)), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.string()), pa.array(rows[5], pa.float64())],
                names=["region_id", "field", "start_pos", "end_pos", "lang", "confidence"],
            )

    return _long(regions).select("region_id", "field", "text").mapInArrow(run, SEGMENTS).distinct()


def _verdicts(regions: DataFrame, models) -> DataFrame:
    """Texts that are cases, or whose language the models reject; texts surely in their label's language are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models.value
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("text").dictionary_encode()  # a text that comes again in the batch is scored once
            d = decide(m, coded.dictionary.to_pylist())
            at = coded.indices.to_numpy()
            whole, single, whole_sure = d.whole[at], d.single[at], d.whole_sure[at]
            named = batch.column("label").to_pandas().map({x: i for i, x in enumerate(LANGS)}).fillna(-1).to_numpy()
            keep = np.flatnonzero((whole >= 0) & ~(single & whole_sure & (whole == named)))
            langs = [languages(d, i) for i in at[keep]]
            part = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [part.column("region_id"), part.column("field"), pa.array(langs, pa.list_(pa.string())), pa.array(whole_sure[keep]), part.column("label")],
                names=["region_id", "field", "langs", "sure", "label"],
            )

    return _long(regions).mapInArrow(run, VERDICTS)


def wrong_labels(regions: DataFrame, models) -> DataFrame:
    """(region_id, field, lang): texts without a right label and texts of several languages, a row per language present.

    Where the models leave a text unsure (a lone name or cry that fits several
    languages) its label stands if it names a language of the text's script;
    a text without such a label gets the models' best guess. A text whose
    sentences no model accepts is in none of the nine languages and has no row.
    Null labels and texts and repeated rows are allowed; null texts have no
    row. Nothing but the texts and their labels is looked at, and nothing is
    shuffled but the rows found.
    """
    scripts = F.create_map(*[F.lit(x) for kv in _SCRIPT_OF.items() for x in kv])
    stands = ~F.col("sure") & F.coalesce(scripts[F.col("label")] == scripts[F.element_at("langs", 1)], F.lit(False))
    v = _verdicts(regions, models).where(~stands)
    return v.select("region_id", "field", F.explode("langs").alias("lang")).distinct()
