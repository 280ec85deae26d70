"""Sentence boundaries in nine languages (problem 8).

Method: a semi-Markov dynamic program over each paragraph. The states are the
places where a sentence could end (every run of end marks with its closing
quotes, every blank in Thai, the end of the paragraph); it selects whole spans
between them so that the sum of the spans' scores is largest. A span's score
joins its length, its opening words, its closing words with the end mark, and
whether it begins or ends within a quotation. Lengths, opening and closing
words are fitted on all documents: log-probabilities of span lengths by
script, and log-odds of words that open sentences, or stand before a full
stop that ends none.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that never end a sentence by themselves (lower case, without the last dot).
ABBREVIATIONS = frozenset(
    # English
    "dr mr mrs ms prof st rev gen sgt capt lt col vol vols no nos p pp ch fig ed eds vs v cf ca approx e.g i.e "
    # German
    "hr fr frau s bd nr z u o d.h u.a z.b bzw ggf abs str geb u.ä vgl "
    # French
    "m mm mme mlle env ex p.ex cf t chap "
    # Spanish
    "sr sra srta dra d dña pág págs núm aprox ej p.ej art cap fig "
    # Russian
    "г гг т тт стр см ок им ул рис табл гл до др напр тыс млн "
    # Korean, Japanese and Chinese use dr, mr, p and no; Thai
    "ดร น ซม กม กก พ.ศ ค.ศ จ อ ต".split()
)
# Abbreviations that can close a sentence, if a capital follows.
CLOSING_ABBREVIATIONS = frozenset("a.m p.m etc usw н.э т.д т.п др inc ltd".split())
# Words before a German ordinal.
BEFORE_ORDINAL = frozenset("am vom zum bis den dem der des im beim ab seit".split())
# Verbs of speech after a quotation, where the speaker comes first.
SPEECH = re.compile(
    r"\b(said|says|asked|asks|whispered|shouted|replied|answered|cried|called|muttered|murmured|yelled|thought|added|wrote|explained|told|exclaimed|"
    r"sagte|fragte|rief|flüsterte|antwortete|dachte|dit|demanda|cria|murmura|répondit|dijo|preguntó|gritó|susurró|respondió|"
    r"сказал|сказала|спросил|спросила|говорит|спрашивает|крикнул|крикнула|ответил|ответила|прошептал|прошептала)\b",
    re.IGNORECASE,
)
SPEECH_HAN = re.compile(r"(说|問|问|喊|叫|答|想|道|嘀咕|低语|回答|表示)(着|了)?$")
SPEECH_HANGUL = re.compile(r"(물었|말했|외쳤|속삭였|대답했|중얼거렸|소리쳤|생각했)")
TAG_JA = ("と", "って", "とは", "との")
TAG_KO = ("라고", "이라고", "하고", "라며", "이라며", "하며", "라는", "이라는", "고 ", "며 ", "라면서")

_BREAK = re.compile(r"\r?\n(?:[^\S\n]*\r?\n)+\s*|[ \f]\s*")
_QUOTES = re.compile(r"[\"“”„«»「」『』（）()《》〈〉【】\[\]]")
_SCAN = re.compile(r"(\.\s\.\s\.|[.!?。！？｡．…‼⁇⁈⁉]+)|([\"“”„«»「」『』（）()《》〈〉【】\[\]])|((?<=[฀-๿])[^\S\n]+(?=\S)|(?<=\S)[^\S\n]+(?=[฀-๿])|(?<=[฀-๿])\s*\n\s*(?=\S))")
# the same where no Thai letter is near: one class to look for
_SCAN_PLAIN = re.compile(r"[.!?。！？｡．…‼⁇⁈⁉\"“”„«»「」『』（）()《》〈〉【】\[\]](?:(?<=\.)\s\.\s\.|(?<=[.!?。！？｡．…‼⁇⁈⁉])[.!?。！？｡．…‼⁇⁈⁉]+)?")
_MARKS = frozenset(".!?。！？｡．…‼⁇⁈⁉")
_THAI = re.compile("[฀-๿]")
_OPEN = {"«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "〈": "〉", "【": "】", "[": "]", "“": "”", "„": "“"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_WORD_BEFORE = re.compile(r"(?<![^\W_])(?:[^\W\d_]\.[  ]?){0,3}[^\W\d_]+$")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]")
_NUMBER_BEFORE = re.compile(r"(\w*)\s*\b(\d{1,2})$")
_HAN = re.compile("[぀-ヿ㐀-鿿]+")
_THAI_LETTER = re.compile("[ก-ฮ]+")
_SPACED = re.compile("[A-Za-zÀ-ɏЀ-ӿ가-힣]+")
_CLAUSE = re.compile("[.!?…。！？\"“”„«»「」『』\n]")
SURE = 6.0  # score of an end that only a quotation around it can undo: it outweighs two spans of the least likely length
_REACH = 32  # characters before a mark that hold its last words; no abbreviation is longer
_ANY_BREAK = re.compile(r"[.!?。！？…]")


class Place:
    """A place where a sentence can end: end of the text up to and with its marks, start of what follows, score of its closing words, whether it lies within a quotation, unmatched quotation marks so far."""

    __slots__ = ("end", "score", "next", "inside", "lone")

    def __init__(self, end: int, nxt: int, score: float, inside: bool = False, lone: int = 0) -> None:
        self.end, self.next, self.score, self.inside, self.lone = end, nxt, score, inside, lone


LONG = 400  # characters; from here on a span pays TAIL a character
TAIL = 0.002
_BINS = (2, 4, 6, 8, 12, 16, 24, 32)  # characters


def _lengths(short: dict[int, float]) -> list[float]:
    """Score of each length below LONG: that of the first bin above it, 0 beyond the last."""
    out = [0.0] * LONG
    for n in range(LONG):
        out[n] = next((short.get(b, 0.0) for b in _BINS if n < b), 0.0)
    return out


@dataclass
class Model:
    """Scores of span lengths by script ('spaced', 'han', 'thai'), of opening words and of words before a full stop."""

    lengths: dict[str, list[float]] = field(
        default_factory=lambda: {
            "spaced": _lengths({2: -3.0, 4: -3.0, 6: -2.6, 8: -2.4, 12: -1.0}),
            "han": _lengths({2: -3.0, 4: -1.5}),
            "thai": _lengths({2: -3.0, 4: -1.0}),
        }
    )
    opens: dict[str, float] = field(default_factory=dict)
    closes: dict[str, float] = field(default_factory=dict)


def script_of(text: str, start: int, stop: int) -> str:
    """The script of a paragraph by the majority of its letters."""
    piece = text[start:stop]
    if piece.isascii():
        return "spaced"
    han, thai = (sum(map(len, x.findall(piece))) for x in (_HAN, _THAI_LETTER))
    if not han and not thai:
        return "spaced"
    rest = sum(map(len, _SPACED.findall(piece)))
    return "thai" if thai > max(han, rest) else "han" if 2 * han > rest else "spaced"


def _skip(text: str, i: int, stop: int) -> int:
    while i < stop and text[i].isspace():
        i += 1
    return i


def _first_word(text: str, i: int, stop: int) -> int:
    """Index of the first letter, digit or quotation mark from i: symbols before it say nothing."""
    while i < stop and not (text[i].isalnum() or text[i] in "\"“„«「『（(《¿¡—–-,;:"):
        i += 1
    return i


def _is_han_or_kana(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿"


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _after_quote(text: str, i: int, gap: bool, stop: int) -> float:
    """Score of an end at a closed quotation whose next character (blanks skipped) is at i: does a speaker tag follow?"""
    c = text[i]
    if c in ",;:，、；：.。":
        return -8.0
    if c in "—–-":
        k = _skip(text, i + 1, stop)
        return -8.0 if k < stop and text[k].islower() else 2.0
    if c.islower():
        return -8.0
    if "가" <= c <= "힣":
        rest = text[i : i + 6]
        if rest.startswith(TAG_KO):
            return -8.0
        m = _CLAUSE.search(text, i, stop)
        clause = text[i : m.start() if m else stop]
        return -4.0 if not gap and SPEECH_HANGUL.search(clause) else 3.0
    if _is_han_or_kana(c):
        if text.startswith(TAG_JA, i) and not gap:
            return -8.0
        m = _CLAUSE.search(text, i, stop)
        if not gap and SPEECH_HAN.search(text[i : m.start() if m else stop][-8:]):
            return -8.0
        return 3.0
    if c.isupper():
        m = re.compile(r"[.!?…\"“„«]").search(text, i, min(stop, i + 90))
        clause = text[i : m.start()] if m else text[i : min(stop, i + 90)]
        words = clause.split()
        if len(words) <= 8 and len(words) >= 2 and SPEECH.search(" ".join(words[1:4])):
            return -8.0
    return 3.0


def _at_mark(text: str, start: int, a: int, b: int, end: int, nxt: int, stop: int, quoted: str, model: Model) -> float:
    """Score of ending at the marks text[a:b], with closers up to ``end`` and the next unit from ``nxt``."""
    marks = text[a:b]
    if nxt >= stop:
        return 4.0
    gap = nxt > end
    w = _first_word(text, nxt, stop)
    symbol = w > nxt
    c = text[w] if w < stop else " "
    if quoted in "》〉" and quoted and not gap:
        return -8.0  # a title within the sentence
    if quoted:
        q = _after_quote(text, w if symbol and w < stop else nxt, gap, stop)
        if q < 0:
            return q
    elif c in ",;:，、；：" and not symbol:
        return -8.0
    before = text[max(start, a - _REACH) : a]
    prev = before[-1:]
    dots = len(marks) >= 2 and not marks.strip(".．… ") or marks.strip("…") == ""
    if dots and not quoted:
        # a pause: the word before is said again, or what came so far is no sentence
        m = re.search(r"([^\W\d_]+)[\s ]*$", before)
        word = m.group(1).casefold() if m else ""
        if word and text[w : w + len(word)].casefold() == word and len(word) <= 12:
            return -8.0
        if c.islower():
            return -8.0
        head = len(_LETTERS.findall(before[-8:]))
        if word and _is_han_or_kana(before[-1:]):
            run = re.search(r"[぀-ヿ㐀-鿿]+$", before)
            if run and len(run.group()) <= 4 and not gap:
                return -6.0
        return 1.5 if head >= 3 else -1.0
    if marks[0] in "。！？｡‼⁇⁈⁉．" or (_is_han_or_kana(before[-1:]) and marks[0] in "!?"):
        if not quoted and not gap and text.startswith(TAG_JA, nxt) and marks[0] in "！？!?" and not text.startswith(("とても", "とう", "ところ", "とき", "とに", "とり", "とく", "とお", "とげ", "とび", "とも"), nxt):
            return -6.0  # a cry quoted without marks
        return SURE
    if marks[0] in "!?":
        if c.islower():
            return -8.0
        if c in "—–" and not quoted:
            k = _skip(text, w + 1, stop)
            return -8.0 if k < stop and text[k].islower() else SURE
        if not gap:
            return 4.0 if (c.isupper() or not c.isascii() or c in "\"(") else -6.0
        return SURE
    # a single full stop
    if marks.startswith("..") and c.islower():
        return -8.0
    word = raw = ""
    if not quoted and (prev.isalpha() or not prev.isascii()):
        k = before.rfind(" ")
        tail = before[k + 1 :]
        if k > 2 and tail.isalpha() and before[k - 1] != ".":
            raw, word = tail, tail.casefold()  # a plain word after a blank, no initials before it
        elif m := _WORD_BEFORE.search(before):
            raw = m.group()
            word = re.sub(r"[\s ]", "", raw).casefold()
    fitted = model.closes.get(word, 0.0) if word else 0.0
    if not gap and not quoted:
        if not (c.isupper() or (c.isalpha() and not c.isascii() and not c.islower())) or symbol:
            return -8.0
        if word in ABBREVIATIONS or not (prev.isalpha() or prev.isdigit() or prev in ")\"”»"):
            return -8.0
        if len(word) < 2 or prev.isupper():
            return -8.0  # initials, acronyms
        if len(word) == 2 and w + 1 < stop and text[w + 1] == ".":
            return -8.0  # abbreviations written together
        return 4.0 + fitted
    if c.islower():
        return -8.0
    if word:
        last = word.rpartition(".")[2]
        if word in CLOSING_ABBREVIATIONS:
            return 1.75 + fitted if not c.isdigit() else -3.0
        if word in ABBREVIATIONS or (last in ABBREVIATIONS and "." in word):
            return -8.0
        if last in ABBREVIATIONS and (len(last) > 1 or c.isdigit() or not c.isupper()):
            return -8.0
        if len(last) == 1 and (raw[-1].isupper() or "." in word):
            return -8.0 if not _is_han_or_kana(raw[-1]) else SURE
        if last in ABBREVIATIONS:
            return -8.0
    n = _NUMBER_BEFORE.search(before) if prev.isdigit() and not quoted else None
    if n and n.group(1).casefold() in BEFORE_ORDINAL and c.isupper():
        return -6.0
    return SURE + fitted


def _pairs(text: str, start: int, stop: int) -> tuple[set[int], set[int], set[int]]:
    """Positions of openers and closers that belong together in text[start:stop], and of closers without an opener.

    Openers that are never closed (a stray mark, a quotation cut off) open
    nothing. Straight quotes open and close by turns, or by the blanks beside
    them where their number is odd.
    """
    even = text.count('"', start, stop) % 2 == 0
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()  # openers on the stack
    openers, closers, lone = set(), set(), set()
    for m in _QUOTES.finditer(text, start, stop):
        i, ch = m.start(), m.group()
        if ch == '"':
            inside = held['"'] > 0
            closing = inside if even else inside and not (i + 1 < stop and text[i + 1].isalnum() and (i == start or text[i - 1].isspace()))
            opener = '"'
        elif ch in "“”" and held["„"]:
            closing, opener = True, "„"
        else:
            # the mark that closes a German quotation opens an English or Chinese one
            closing, opener = ch in _CLOSE and ch != "“", _CLOSE.get(ch, ch)
        if not closing:
            stack.append((ch, i))
            held[ch] += 1
            continue
        if not held[opener]:
            lone.add(i)
            continue
        while True:  # what was opened within and never closed opens nothing
            o, at = stack.pop()
            held[o] -= 1
            if o == opener:
                break
        openers.add(at)
        closers.add(i)
    return openers, closers, lone


def _places(text: str, start: int, stop: int, model: Model) -> list[Place]:
    """Candidate ends of the paragraph text[start:stop] (trimmed), the last at its end.

    Every run of marks is one, also within a quotation or bracket, with the
    score of what stands before and after it.
    """
    out: list[Place] = []
    openers, closers, lone = _pairs(text, start, stop)
    depth, stray = 0, 0
    mark: tuple[int, int] | None = None  # the run of marks that closers may follow
    end, quoted = -1, ""

    def settle() -> None:
        nonlocal mark, quoted
        if mark is not None:
            nxt = _skip(text, end, stop)
            # within a quotation the balance decides, whatever the words
            score = _at_mark(text, start, mark[0], mark[1], end, nxt, stop, quoted, model) if depth == 0 else 0.0
            out.append(Place(end, nxt, score, depth > 0, stray))
        mark, quoted = None, ""

    plain = _THAI.search(text, start, stop) is None
    for m in (_SCAN_PLAIN if plain else _SCAN).finditer(text, start, stop):
        i = m.start()
        ch = text[i]
        if ch in _MARKS:
            if mark is not None and i == end and not quoted:
                mark, end = (mark[0], m.end()), m.end()
                continue
            settle()
            mark, end = (i, m.end()), m.end()
        elif plain or m.group(2):
            if i in closers or i in lone:
                near = mark is not None and (i == end or (ch == "»" and not text[end:i].strip()))
                if not near:
                    settle()
                if i in closers:
                    depth -= 1
                else:
                    stray += 1
                if near:
                    end, quoted = i + 1, ch
            else:
                settle()
                if i in openers:
                    depth += 1
                else:
                    stray += 1
        elif depth == 0:
            settle()
            left, right = text[i - 1], text[m.end()]
            if (_thai(left) or left in "\"”)") and _blank_ends_thai(text, start, i, m.end(), stop):
                out.append(Place(i, m.end(), 4.0, False, stray))
            elif _thai(left) and not _thai(right) and "\n" not in m.group() and right.isupper() and _sentence_like(text, m.end(), stop):
                out.append(Place(i, m.end(), 3.0, False, stray))
    depth = 0
    settle()
    if not out or out[-1].end < stop:
        out.append(Place(stop, stop, 4.0, False, stray))
    return out


def _sentence_like(text: str, i: int, stop: int) -> bool:
    """Several spaced words without Thai follow: another language begins, not a single Latin word."""
    piece = text[i : min(stop, i + 40)]
    return len(piece.split()) >= 4 and not any(_thai(c) for c in piece)


def _blank_ends_thai(text: str, start: int, a: int, b: int, stop: int) -> bool:
    """In Thai a blank ends a sentence unless it touches a number, a Latin word or an abbreviation. A title ('Dr.') opens the next sentence."""
    left, right = text[a - 1], text[b]
    if "\n" in text[a:b] and not _thai(left):
        return False
    if left == "." or left.isdigit() or left.isascii() and left.isalpha():
        return False
    if not (_thai(right) or right in "\"“(«「"):
        return False
    if right.isdigit():
        return False
    word = re.compile(r"\S{1,6}").match(text, b)
    if word and "." in word.group():
        return word.group().split(".")[0] in ("ดร", "ผศ", "รศ", "ศ", "นพ")
    return True


def _open_score(text: str, i: int, stop: int, model: Model) -> float:
    """Score of the opening words of a span."""
    k = _first_word(text, i, stop)
    if k >= stop:
        return -4.0
    c = text[k]
    if c.islower():
        return -2.0
    if c in ",;:":
        return -6.0
    if model.opens and c.isupper() and (m := _WORD.match(text, k, stop)):
        return 0.5 + model.opens.get(m.group(), 0.0)
    return 0.5


UNBALANCED = 8.0  # what a span pays for each of its ends that lies within a quotation


def _has_letters(text: str, i: int, end: int) -> bool:
    """Looks at as many characters as lie before the first letter or digit."""
    while i < end:
        if text[i].isalnum():
            return True
        i += 1
    return False


def paragraph_ends(text: str, start: int, stop: int, model: Model, script: str | None = None) -> list[int]:
    """Sentence ends in the paragraph text[start:stop], which begins and ends with a non-blank; ``script`` is that of the paragraph, if known.

    best[j] is the largest sum of span scores up to place j. Spans of LONG
    characters and more pay in proportion to their length, so the best start
    of those is kept as a running maximum and only the starts within LONG
    characters are tried one by one: the program is exact, and linear in the
    length of the paragraph.
    """
    places = _places(text, start, stop, model)
    n = len(places)
    if n == 1:
        return [places[0].end]
    starts = [start, *(p.next for p in places[:-1])]
    opens = [0.0, *(_open_score(text, s, stop, model) - UNBALANCED * p.inside for s, p in zip(starts[1:], places, strict=False))]
    for i, (s, p) in enumerate(zip(starts, places, strict=True)):
        if not _has_letters(text, s, p.end):
            opens[i] -= 8.0  # a span of marks alone, if it ends at the next place
    lone = [0, *(p.lone for p in places)]
    strays = lone[-1] > 0
    length = model.lengths[script or script_of(text, start, stop)]
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    lead, lead_at, near = -1e18, 0, 0
    for j in range(1, n + 1):
        p = places[j - 1]
        end = p.end
        while near < j and end - starts[near] >= LONG:
            v = best[near] + opens[near] + TAIL * starts[near]
            if v >= lead:
                lead, lead_at = v, near
            near += 1
        top, at = lead - TAIL * (end - LONG), lead_at
        for i in range(near, j):
            v = best[i] + opens[i] + length[end - starts[i]]
            if strays and (lone[j] - lone[i]) & 1:
                v -= 0.5
            if v >= top:
                top, at = v, i
        best[j] = top + p.score - UNBALANCED * p.inside
        back[j] = at
    out, j = [], n
    while j:
        out.append(places[j - 1].end)
        j = back[j]
    out.reverse()
    return out


def greedy_ends(text: str, start: int, stop: int, model: Model) -> list[int]:
    """What each place by itself would decide, for comparison: its closing and the next opening words, without the spans."""
    places = _places(text, start, stop, model)
    return [p.end for p in places[:-1] if not p.inside and p.score + _open_score(text, p.next, stop, model) > 0] + [places[-1].end]


DEFAULT = Model()


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Trimmed ranges between empty lines."""
    at = 0
    broken = text.count("\n") > 1 or "\f" in text or "\u2029" in text
    bounds = ([(m.start(), m.end()) for m in _BREAK.finditer(text)] if broken else []) + [(len(text), len(text))]
    for a, b in bounds:
        i, k = at, a
        while i < k and text[i].isspace():
            i += 1
        while k > i and (text[k - 1].isspace() or unicodedata.category(text[k - 1]) == "Cc"):
            k -= 1
        if i < k:
            yield i, k
        at = b


def sentence_ends(text: str | None, model: Model = DEFAULT) -> list[int]:
    """End positions (code points, end mark and closing quote included) of the sentences of a text; none for null and blank texts."""
    if not text or text.isspace():
        return []
    return [e for i, k in paragraphs(text) for e in paragraph_ends(text, i, k, model)]


# --- fitting -----------------------------------------------------------------------------------

LEAST = 5  # uses that give a word odds
HELD = 50000  # words that a task counts before it hands them on
_DOT_WORD = re.compile(r"(?<![^\W_])([^\W\d_]++(?:\.[^\W\d_]++)*)\.(?=\s*(\S?))")
_CAPITAL = re.compile(r"(?<![^\W_])[A-ZÀ-ÞЀ-Я][^\W\d_]*")
_BIN = [str(next((b for b in _BINS if n < b), LONG)) for n in range(_BINS[-1] + 1)]  # of a length, longer ones as the last
Counts = defaultdict[tuple[str, str], list[int]]  # (kind, word) -> uses for, uses against; the kind of a length bin is its script


def _count(t: str, out: Counts) -> None:
    """Adds the spans and words of a text, cut by the default model."""
    for i, k in paragraphs(t):
        script, at = script_of(t, i, k), i
        capitals = _CAPITAL.search(t, i, k) is not None
        for e in paragraph_ends(t, i, k, DEFAULT, script):
            at = _skip(t, at, e)
            out[script, _BIN[min(e - at, _BINS[-1])]][0] += 1
            words = _CAPITAL.findall(t, at, e) if capitals else None
            if words:
                out["opens", words[0]][not t.startswith(words[0], _first_word(t, at, e))] += 1
                for word in words[1:]:
                    out["opens", word][1] += 1
            at = e
        if t.find(".", i, k) < 0:
            continue
        for m in _DOT_WORD.finditer(t, i, k):
            nxt = m.group(2) if m.end() < k else ""
            out["closes", m.group(1).casefold()][bool(nxt) and (nxt.islower() or nxt.isdigit() or nxt in ",;:")] += 1


def partial_counts(texts: Iterable[str | None], held: int = HELD) -> Iterator[Counts]:
    """Counts of the texts in parts that add up to them, none with many more than ``held`` words."""
    out: Counts = defaultdict(lambda: [0, 0])
    for t in texts:
        if t and not t.isspace():
            _count(t, out)
        if len(out) >= held:
            yield out
            out = defaultdict(lambda: [0, 0])
    if out:
        yield out


def model_of(counts: Iterable[tuple[str, str, int, int]]) -> Model:
    """Model of (kind, word, uses for, uses against), each kind and word once.

    Lengths: smoothed log-probability of a span's length bin by script, against
    that of the most frequent bin, mixed with the default's; spans longer than
    the bins pay nothing.
    Opening words: log-odds of a capitalised word to open a span rather than
    stand within one. Closing words: log-odds of a word before a full stop to
    close a paragraph or stand before a capital rather than before a small
    letter, a digit or a comma. Odds of words seen fewer than five times are 0,
    and so are those of words that always close.
    """
    bins: dict[str, Counter[int]] = {k: Counter() for k in DEFAULT.lengths}
    out = Model()
    odds = lambda a, b, most: max(-most, min(most, 0.5 * math.log((a + 0.5) / (b + 0.5))))
    for kind, word, a, b in counts:
        if kind in bins:
            bins[kind][int(word)] = a
        elif a + b >= LEAST and (kind == "opens" or b):
            (out.opens if kind == "opens" else out.closes)[word] = odds(a, b, 1.0)
    for script, seen in bins.items():
        total = sum(seen.values())
        if total >= 100:
            top = math.log((max(seen.values()) + 1) / (total + 10))
            # a log-linear mix with the default, since a corpus of one kind hardly knows short spans
            known = DEFAULT.lengths[script]
            out.lengths[script] = _lengths({b: 0.5 * (known[b - 1] + max(-3.0, min(0.0, math.log((seen[b] + 1) / (total + 10)) - top))) for b in _BINS})
    return out


def fit_texts(texts: list[str]) -> Model:
    """The model of texts: ``model_of`` the counts of all of them."""
    return model_of((kind, word, a, b) for part in partial_counts(texts, 1 << 62) for (kind, word), (a, b) in part.items())


def fit(documents: DataFrame) -> Model:
    """The model of all documents, of whatever length; runs a job. Counts are added up by Spark; the driver sees the length bins and the words that have odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in partial_counts(t for b in batches for t in b.column("text").to_pylist()):
            kinds, words = zip(*part, strict=True)
            a, b = zip(*part.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "word", "a", "b"])

    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, word string, a long, b long")
    sums = parts.groupBy("kind", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return model_of(sums.where(f"kind not in ('opens', 'closes') or (a + b >= {LEAST} and (kind = 'opens' or b > 0))").collect())


# --- operators ---------------------------------------------------------------------------------


def sentence_table(documents: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """(doc_id, end_pos): the end of every sentence of every document. Null, empty and blank texts have no row; repeated rows count once."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            ids, ends = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                e = sentence_ends(t, own)
                ends.extend(e)
                ids.extend([i] * len(e))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int32())], names=["doc_id", "end_pos"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, end_pos int").distinct()


def sentence_units(documents: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """(doc_id, n, start_pos, end_pos, sentence): the sentences themselves, numbered from 1; start_pos is the count of code points before the sentence."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                at = 0
                for n, e in enumerate(sentence_ends(t, own), 1):
                    at = _skip(t, at, e)
                    rows.append((i, n, at, e, t[at:e]))
                    at = e
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "n", "start_pos", "end_pos", "sentence"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n int, start_pos int, end_pos int, sentence string")
