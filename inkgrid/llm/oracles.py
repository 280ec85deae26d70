"""DuckDB SQL for the llm queries that SQL can express. Nothing here uses the operators' own tables."""

from __future__ import annotations

import unicodedata

# Letters that look alike, written side by side (the stranger first).
_ALIKE = """
аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw ӏl гr ѵv АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ҮY ԌG ѴV ёë ЁË їï ЇÏ
οo αa νv ιi κk ρp υu γy ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϳj ϹC ıi ɑa ɡg
工エ 力カ 口ロ 夕タ 二ニ 八ハ 卜ト 一ー へヘ べベ ぺペ 〇○
""".split()
# Narrow katakana beside the wide ones.
_NARROW = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ｡､｢｣･"
_WIDE = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゙゚。、「」・"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _form(col: str) -> str:
    """The one form of a text: decomposed, letters of one shape written alike, and composed again."""
    table = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict(zip(_NARROW, _WIDE, strict=True)) | {x[0]: x[1] for x in _ALIKE}
    table |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)}
    table = {k: table.get(v, v) for k, v in table.items()}
    x = f"regexp_replace({col}, '[\\x{{00ad}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}]', '', 'g')"
    x = f"regexp_replace({x}, '[\\t\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    for sign, letters in _LIGATURES.items():
        x = f"replace({x}, {_lit(sign)}, {_lit(letters)})"
    x = f"translate({x}, {_lit(''.join(table))}, {_lit(''.join(table.values()))})"
    return f"nfc_normalize(regexp_replace({x}, '^ +| +$', '', 'g'))"


def _texts() -> str:
    both = " union all ".join(f"select distinct region_id, '{f}' as field, {f} as text from regions where regexp_matches({f}, '\\p{{L}}')" for f in ("source_text", "translated_text"))
    return f"T as materialized (select region_id, field, text, {_form('text')} as k from ({both}))"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"with {_texts()} select distinct a.field, a.region_id as region_id_a, b.region_id as region_id_b from T a join T b on a.field=b.field and a.k=b.k and a.region_id<b.region_id and a.text<>b.text",
        "p2_canonical": f"with {_texts()}, C as (select field, k, min(text) as canonical from T group by 1,2) select distinct region_id, T.field, canonical from T join C on C.field=T.field and C.k=T.k",
    }
