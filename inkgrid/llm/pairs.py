"""Broken prompt and response pairs (problem 5).

Method: each response is compressed with its prompt as a raw zstandard
dictionary, and the prompt with the response; a pair of which neither adds
a byte to the other is a copy. Refusals come from dictionaries of refusal
phrases in nine languages, the language of the whole response from the
character models of ``langid``, truncation from the terminal context judged
in ``truncation``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm import langid, lookalike, repetition, truncation
from inkgrid.operators.skew import salted_join

_LETTER = re.compile(r"[^\W\d_]")

# Refusal dictionaries. A refusal declines a task (a request, a text, its
# translation) within a sentence, or speaks of itself as an assistant; 'I'm sorry, I can't
# help you carry the lamp' is a character's own apology and names no task.
REFUSALS: dict[str, dict] = {
    "en": {
        "decline": ["can't", "cannot", "can not", "unable to", "not able to", "won't", "must decline to", "have to decline to", "not possible for me to", "not comfortable"],
        "task": ["translat", "render this", "this request", "this content", "this line", "this text", "this passage", "this message", "that request", "that text", "that content", "assist with", "fulfil"],
        "self": ["goes against my guidelines", "is against my guidelines", "goes against my polic", "is against my polic", "goes against my programming", "is against my programming", "as an ai", "as an automated assistant", "as a language model", "as an assistant"],
        "stops": ".!?", "gap": 40,
    },
    "de": {
        "decline": ["kann", "darf", "muss", "konnte", "möchte"],
        "task": ["übersetz", "anfrage", "ablehnen", "diesem inhalt"],
        "self": ["als sprachassistent", "als ki", "als sprachmodell", "als assistent", "gegen meine richtlinien"],
        "stops": ".!?", "gap": 60,
    },
    "fr": {
        "decline": ["ne peux pas", "ne suis pas en mesure", "dois refuser", "ne m'est pas possible", "suis dans l'impossibilité"],
        "task": ["tradui", "traduction", "demande", "ce contenu", "ce texte"],
        "self": ["en tant qu'assistant", "en tant qu'ia", "en tant que modèle", "contraire à mes règles", "contraire à mes directives"],
        "stops": ".!?", "gap": 60,
    },
    "es": {
        "decline": ["no puedo", "no me es posible", "debo rechazar", "debo rehusar", "tengo que rechazar", "no soy capaz"],
        "task": ["traduc", "solicitud", "este texto", "este contenido", "petición"],
        "self": ["como asistente", "como ia", "como modelo", "contra mis normas", "contra mis directrices", "contra mis reglas"],
        "stops": ".!?", "gap": 60,
    },
    "ru": {
        "decline": ["не могу", "не в состоянии", "вынужден", "не имею возможности"],
        "task": ["перев", "запрос", "этот текст", "этим содерж", "отказ"],
        "self": ["как помощник", "как ассистент", "как ии", "как языковая модель", "нарушает мои правила"],
        "stops": ".!?", "gap": 60,
    },
    "ja": {
        "task": ["翻訳", "ご依頼", "リクエスト", "この文章"],
        "decline": ["できません", "できかねます", "控えさせて", "お応えできません", "お断り", "いたしかねます"],
        "self": ["アシスタントとして", "aiとして", "言語モデルとして"],
        "stops": "。", "gap": 20, "task_first": True,
    },
    "zh": {
        "decline": ["无法", "不能", "不便", "必须拒绝", "拒绝"],
        "task": ["翻译", "译文", "请求", "这段文字", "此内容", "协助"],
        "self": ["作为助手", "作为人工智能", "作为ai", "作为一个ai", "作为语言模型"],
        "stops": "。", "gap": 16,
    },
    "ko": {
        "task": ["번역", "요청", "문장", "내용"],
        "decline": ["수 없습니다", "할 수 없", "드릴 수 없", "어렵습니다", "거절"],
        "self": ["ai로서", "인공지능으로서", "어시스턴트로서", "도우미로서"],
        "stops": ".", "gap": 24, "task_first": True,
    },
    "th": {
        "decline": ["ไม่สามารถ", "ขอปฏิเสธ", "ไม่อาจ"],
        "task": ["แปล", "คำขอ", "ข้อความนี้", "เนื้อหา"],
        "self": ["ในฐานะผู้ช่วย", "ในฐานะปัญญาประดิษฐ์", "ในฐานะโมเดล"],
        "stops": ".", "gap": 40,
    },
}


def _pattern(x: dict) -> str:
    any_of = lambda words: "(?:" + "|".join(map(re.escape, words)) + ")"
    first, second = ("task", "decline") if x.get("task_first") else ("decline", "task")
    # 'as an ai' isn't the head of 'as an aim'; scripts without blanks have no such end
    end = r"(?![a-zа-яé]{0,1}\w)" if x["stops"] == ".!?" else ""
    return f"{any_of(x[first])}[^{re.escape(x['stops'])}]{{0,{x['gap']}}}{any_of(x[second])}|{any_of(w for w in x['self'] if w.endswith('polic'))}|{any_of(w for w in x['self'] if not w.endswith('polic'))}{end}".replace("|(?:)|", "|")


_REFUSAL = re.compile("|".join(f"(?:{_pattern(x)})" for x in REFUSALS.values()))
#: Every refusal has one of these, by the way the pattern is made.
_NAMED = tuple(dict.fromkeys(w for x in REFUSALS.values() for w in [*x["task"], *x["self"]]))


def _finder():
    """Whether a text has one of the words, by one pass of an automaton of them all."""
    try:
        import ahocorasick
    except ImportError:  # the same, more slowly
        return lambda low: any(w in low for w in _NAMED)
    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in _NAMED:
        a.add_word(w)
    a.make_automaton()
    return lambda low: next(a.iter(low), None) is not None


_names = _finder()


def is_refusal(reply: str) -> bool:
    low = reply.casefold().replace("’", "'")
    return _names(low) and _REFUSAL.search(low) is not None


# --- copies ----------------------------------------------------------------------------------

_INDEX = re.compile(r"^\s*(?:[\[(（【]\s*\d{1,4}\s*[\])）】]|\d{1,4}\s*[.):：．、])\s*")
_QUOTED = re.compile("^[\\s\"'“”„«»「」『』‘’]+|[\\s\"'“”„«»「」『』‘’]+$")
_BLANKS = re.compile(r"\s+")


class Folder:
    """Text without what the eye can't tell apart: look-alikes mapped, accents composed, blanks, outer quotes and a leading index dropped."""

    def __init__(self) -> None:
        src, dst, many = lookalike.mapping()
        self.table = dict(zip(map(ord, src), dst, strict=True)) | {ord(c): None for c in lookalike.INVISIBLE} | {ord(k): v for k, v in many}
        self.odd = set(map(chr, self.table))

    def __call__(self, text: str) -> str:
        import unicodedata

        t = text
        if not t.isascii():
            t = unicodedata.normalize("NFC", t)
            for _ in range(2):  # composing what was mapped may make a letter that is mapped too
                if not self.odd.isdisjoint(t):
                    t = unicodedata.normalize("NFC", t.translate(self.table))
        t = _QUOTED.sub("", t)
        t = _QUOTED.sub("", _INDEX.sub("", t, count=1))
        return _BLANKS.sub("", t)


LEAST = 32  # bytes; shorter texts are tiled to so many, since a frame outweighs them


def compressed(data: bytes, prompt: bytes | None = None) -> int:
    """Bytes of ``data`` compressed, with ``prompt`` as raw dictionary."""
    size = len(data) + len(prompt or b"")
    params = zstandard.ZstdCompressionParameters(
        window_log=max(10, size.bit_length() + 1), hash_log=min(18, max(8, size.bit_length())), chain_log=min(18, max(8, size.bit_length())), search_log=4, min_match=3, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    d = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if prompt else None
    return len(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress(data))


def extra(prompt: bytes, reply: bytes) -> int:
    """Bytes that the reply takes beside its prompt beyond what it takes beside itself: 0 for a copy, which is one match."""
    return compressed(reply, prompt) - compressed(reply, reply)


def is_copy(prompt: str, reply: str, fold: Folder, slack: int = 0) -> bool:
    """The reply is the prompt, as far as the eye can tell.

    Both are folded, and each is compressed with the other as dictionary. The
    reply may cost at most ``slack`` bytes more than a single match with the
    prompt (else it says something else), and the prompt no more with the
    reply (else it is a fragment); a text said twice is one match too, so the
    lengths must agree as well. Without slack a copy is the whole text; a
    changed word costs some 12 bytes, so ``slack=16`` takes in near copies.
    Replies without a character of the prompt share nothing that could be
    matched and aren't compressed; texts under three bytes are too short for
    the compressor and are compared as they are.
    """
    a, b = fold(prompt), fold(reply)
    if not a or not b or set(a).isdisjoint(b):
        return False
    x, y = a.encode("utf-8", "replace"), b.encode("utf-8", "replace")
    if abs(len(x) - len(y)) > slack:
        return False
    if min(len(x), len(y)) < 3:
        return a == b
    k = -(-LEAST // min(len(x), len(y)))
    x, y = x * k, y * k
    return extra(x, y) <= slack and extra(y, x) <= slack


# --- operator --------------------------------------------------------------------------------

VERDICTS = "region_id long, page_id string, defect string, lang string, cut boolean"


def judge(regions: DataFrame, models, limits: truncation.Limits) -> DataFrame:
    """(region_id, page_id, defect, lang, cut): what the two texts alone tell of each pair; ``lang`` is set where the whole reply surely is in one language, or in none of the nine (``und``)."""
    shared = regions.sparkSession.sparkContext.broadcast(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank, lim, fold, bands = models.value, shared.value, Folder(), repetition.Bands()
        for batch in batches:
            if not batch.num_rows:
                continue
            prompts, feeds = batch.column("source_text").to_pylist(), batch.column("source").to_pylist()
            coded = batch.column("translated_text").dictionary_encode()
            uniq, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            d = langid.decide(bank, uniq)
            known = d.single & d.whole_sure & (d.whole >= 0)
            refusal = [is_refusal(t) for t in uniq]
            letters = [_LETTER.search(t) is not None for t in uniq]
            defect, cut = [], []
            for k, (p, f) in zip(at, zip(prompts, feeds, strict=True), strict=True):
                t = uniq[k]
                x = "empty" if not letters[k] else "refusal" if refusal[k] else "copy" if is_copy(p, t, fold) else None
                defect.append(x)
                cut.append(x is None and truncation.is_cut(t, p, f, lim, bands))
            lang = [langid.LANGS[i] if ok else langid.NONE if strange else None for i, ok, strange in zip(d.whole[at], known[at], d.unknown[at], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("region_id"), batch.column("page_id"), pa.array(defect, pa.string()), pa.array(lang, pa.string()), pa.array(cut, pa.bool_())], names=["region_id", "page_id", "defect", "lang", "cut"])

    pairs = regions.where(F.col("source_text").rlike(r"\p{L}") & F.col("translated_text").isNotNull())
    return pairs.select("region_id", "page_id", "source", "source_text", "translated_text").mapInArrow(run, VERDICTS)


def defects(regions: DataFrame, pages: DataFrame, volumes: DataFrame, models) -> DataFrame:
    """(region_id, defect): one row per defective pair; the first that holds of empty, refusal, copy, other_language, truncated.

    Pairs without a letter in the prompt or with a null reply are left out;
    pages without a volume can't show 'other_language'. Only a few bytes a
    pair are shuffled to meet the volume's target language, with pages that
    hold a large share of all rows dealt over several tasks.
    """
    v = judge(regions, models, truncation.limits_of(regions))
    side = pages.select("page_id", "sub_dir").join(volumes.select("sub_dir", "target_lang"), "sub_dir").select("page_id", "target_lang").dropDuplicates(["page_id"])
    j = salted_join(v, side, "page_id", regions, F.col("region_id"))
    defect = F.coalesce(F.col("defect"), F.when(F.col("lang") != F.col("target_lang"), "other_language"), F.when(F.col("cut"), "truncated"))
    return j.select("region_id", defect.alias("defect")).where("defect is not null").distinct()
