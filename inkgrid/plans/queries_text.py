"""Queries over texts, confidences and translator calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkgrid.functions import scoring as Q
from inkgrid.functions import text as T
from inkgrid.plans.base import regions, with_regions
from inkgrid.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_WS = r"\s\x{a0}\x{3000}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{85}\x{1c}-\x{1f}"
_STRIP = lambda x: f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"

# --- scores --------------------------------------------------------------------------------------

_CC = "character_confidences"
_KEEP = f"case when source_text is not null and length(source_text)=len({_CC}) then list_transform(list_filter(list_zip({_CC}, string_split(source_text,'')), lambda z: not regexp_matches(z[2], '^[\\p{{P}}~ー]$')), lambda z: z[1]) else {_CC} end"
_SCORE = "case when confidence is null then null when used0 is null or len(used0)=0 then confidence when len(used)=0 then confidence else 0.5::double*confidence+0.5::double*list_avg(used)-0.25::double*len(list_filter(used, lambda x: x<0.70))/len(used)-0.80::double*list_stddev_pop(used)*0.1::double end"
_Q = f"Q as (select page_id, region_seq, l, t, r, b, {_SCORE} as score from (select *, {_CC} as used0, {_KEEP} as used from R))"


@query("P11_quality_score", with_regions("select page_id, region_seq, round(score,6) as score from Q", _Q))
def p11(s, d):
    x = regions(s, d, "confidence", "character_confidences", "source_text")
    return x.select("page_id", "region_seq", F.round(Q.quality(F.col("confidence"), F.col("character_confidences"), F.col("source_text")), 6).alias("score"))


def candidates(s, d, least: float = 0.75):
    """Regions whose quality isn't known to be low, with their place in reading order."""
    from inkgrid.operators.spatial import reading_order

    x = regions(s, d, "confidence", "character_confidences", "source_text", "received_at")
    score = Q.quality(F.col("confidence"), F.col("character_confidences"), F.col("source_text"))
    ranked = reading_order(x)
    return x.withColumn("score", score).where(Q.passes(F.col("score"), least)).join(ranked, ["page_id", "region_seq"])


@query("F1_translation_candidates", with_regions("select page_id, region_seq from Q where score is null or score >= 0.75", _Q))
def f1(s, d):
    return candidates(s, d).select("page_id", "region_seq")


@query("P12_is_punctuation", with_regions("select ch, regexp_matches(ch, '^[\\p{P}~ー]$') as punct, count(*) as n from (select unnest(string_split(source_text,'')) as ch from R where source_text<>'') group by 1,2"))
def p12(s, d):
    c = regions(s, d, "source_text").where("source_text <> ''").select(F.explode(F.split("source_text", "")).alias("ch"))
    return c.groupBy("ch").agg(F.count("*").alias("n")).select("ch", T.is_punctuation(F.col("ch")).alias("punct"), "n")


@query("P13_sentence_confidence", with_regions(f"select page_id, region_seq, round(case when len({_CC})>0 and len(list_filter({_CC}, lambda x: x<=0))=0 then exp(list_avg(list_transform({_CC}, lambda x: ln(x)))) else 0 end,6) as confidence from R where {_CC} is not null"))
def p13(s, d):
    x = regions(s, d, "character_confidences").where("character_confidences is not null")
    return x.select("page_id", "region_seq", F.round(Q.sentence_confidence(F.col("character_confidences")), 6).alias("confidence"))


_LEAD = "length(translated_text)-length(regexp_replace(translated_text,'^[\\s\\x{a0}\\x{3000}]+',''))"
_BARE = "regexp_replace(translated_text,'^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$','','g')"


@query("P14_strip_with_confidences", with_regions(f"select page_id, region_seq, {_BARE} as text, round(list_sum({_CC}[{_LEAD}+1:{_LEAD}+length({_BARE})]),6) as total from (select page_id, region_seq, translated_text, list_transform(range(0, length(translated_text)), lambda i: ((region_seq*31+i*7)%100+1)/100.0::double) as {_CC} from R where translated_text is not null)"))
def p14(s, d):
    x = regions(s, d, "translated_text").where("translated_text is not null")
    n = F.length("translated_text")
    conf = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ((F.col("region_seq") * 31 + i * 7) % 100 + 1) / 100.0)).otherwise(F.array().cast("array<double>"))
    c = Q.strip_with_confidences(F.col("translated_text"), conf)
    return x.select("page_id", "region_seq", c.alias("c")).select("page_id", "region_seq", "c.text", F.round(F.when(F.size("c.conf") > 0, F.aggregate("c.conf", F.lit(0.0), lambda a, v: a + v)), 6).alias("total"))


# --- filters -------------------------------------------------------------------------------------


@query("F10_drop_empty", with_regions(f"select page_id, region_seq, {_STRIP('source_text')} as text from R where {_STRIP('source_text')}<>''"))
def f10(s, d):
    return regions(s, d, "source_text").select("page_id", "region_seq", T.strip(F.col("source_text")).alias("text")).where("text <> ''")


@query("F11_active", with_regions("select page_id, region_seq from R where translated_text is not null and translated_text<>''"))
def f11(s, d):
    return regions(s, d, "translated_text").where("translated_text <> ''").select("page_id", "region_seq")


@query("F12_content_characters", with_regions("select page_id, region_seq, len(list_filter(string_split(source_text,''), lambda c: regexp_matches(c,'^[\\p{L}\\p{N}]$') and c not in ('ー','ｰ','〜','~')))::int as n from R where source_text<>''"))
def f12(s, d):
    return regions(s, d, "source_text").where("source_text <> ''").select("page_id", "region_seq", F.size(F.filter(F.split("source_text", ""), T.is_content)).alias("n"))


_CLS = """case when regexp_matches(ch,'^[A-Za-z0-9''\\-_]$') then 'latin' when instr('。.．｡﹒！!﹗︕¡？?﹖︖¿؟…︙⋯‥⋮‼⁇⁈⁉‽۔︒',ch)>0 then 'strong' when instr('，,、﹐﹑､；;︔؛：:︓؍',ch)>0 then 'clause' when regexp_matches(ch,'^[^\\p{L}\\p{N}\\p{Z}\\s]$') then 'symbol' else 'other' end"""


@query("F14_character_classes", with_regions(f"select {_CLS} as cls, count(*) as n from (select unnest(string_split(translated_text,'')) as ch from R where translated_text<>'') group by 1"))
def f14(s, d):
    c = regions(s, d, "translated_text").where("translated_text <> ''").select(F.explode(F.split("translated_text", "")).alias("ch"))
    return c.groupBy("ch").agg(F.count("*").alias("k")).groupBy(T.char_class(F.col("ch")).alias("cls")).agg(F.sum("k").alias("n"))


# --- translator texts ----------------------------------------------------------------------------

_C = "[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}]"


def _tidy(x: str) -> str:
    bare = _STRIP(f"regexp_replace({x}, '^[\\s\\x{{a0}}\\x{{3000}}.…⋯︙·\\-—~～]+', '')")
    y = f"regexp_replace(regexp_replace(regexp_replace({bare},'[.．]{{2,}}','…','g'),'[-—―ー]{{2,}}','—','g'),'[~～]{{2,}}','~','g')"
    for _ in range(2):
        y = f"regexp_replace({y},'({_C})[ \\t\\x{{3000}}]+({_C})','\\1\\2','g')"
    return f"case when {bare}<>'' then {y} else {_STRIP(x)} end"


@query("T1_format_response", with_regions(f"select page_id, region_seq, {_tidy('translated_text')} as text from R where translated_text is not null"))
def t1(s, d):
    return regions(s, d, "translated_text").where("translated_text is not null").select("page_id", "region_seq", T.tidy_reply(F.col("translated_text")).alias("text"))


_FENCED = "case region_seq%3 when 0 then '```text' || chr(10) || translated_text || chr(10) || '```' when 1 then '```' || translated_text || '```' else translated_text end"


def _fence(x: str) -> str:
    t = _STRIP(x)
    body = f"case when contains({t}, chr(10)) then regexp_replace({t}, '^[^\\n]*\\n', '') else substring({t}, 4) end"
    return _STRIP(f"case when {t} like '```%' then regexp_replace({body}, '```$', '') else {t} end")


@query("T2_strip_code_fence", with_regions(f"select page_id, region_seq, {_fence('x')} as text from (select page_id, region_seq, {_FENCED} as x from R where translated_text is not null)"))
def t2(s, d):
    x = regions(s, d, "translated_text").where("translated_text is not null")
    k, c = F.col("region_seq") % 3, F.col("translated_text")
    fenced = F.when(k == 0, F.concat(F.lit("```text\n"), c, F.lit("\n```"))).when(k == 1, F.concat(F.lit("```"), c, F.lit("```"))).otherwise(c)
    return x.select("page_id", "region_seq", T.strip_fence(fenced).alias("text"))


def requests(s, d):
    """Translator requests of at most eight regions: (page_id, req, n, content, texts); content is the numbered reply."""
    x = regions(s, d, "translated_text", "source_text").where("translated_text is not null")
    x = x.withColumn("req", F.floor(F.col("region_seq") / 8).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("region_seq", "translated_text", "source_text")))
    g = x.groupBy("page_id", "req").agg(rows.alias("rows"))
    num = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["translated_text"])
    return g.select("page_id", "req", F.size("rows").alias("n"), F.array_join(F.transform("rows", num), "\n").alias("content"), F.transform("rows", lambda r: r["source_text"]).alias("texts"), F.transform("rows", lambda r: r["translated_text"]).alias("replies"))


_REQ = "A as (select page_id, region_seq//8 as req, region_seq, source_text, translated_text, row_number() over (partition by page_id, region_seq//8 order by region_seq) as k from R where translated_text is not null), Z as (select page_id, req, count(*)::int as n, string_agg('[' || k || '] ' || translated_text, chr(10) order by k) as content, list(source_text order by k) as texts from A group by 1,2)"
_LN = f"""L0 as (select page_id, req, n, generate_subscripts(ls,1) as i, unnest(ls) as line from (select page_id, req, n, string_split_regex(content, '\\r\\n|[\\n\\r\\x{{b}}\\x{{c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') as ls from Z)),
L1 as (select page_id, req, n, i, {_STRIP('line')} as line from L0 where {_STRIP('line')}<>'' and lower({_STRIP('line')}) not in ('user','assistant','system')),
L2 as (select *, regexp_extract(line, '^\\s*\\[?(\\d{{1,9}})\\]?[\\s.:：、\\-—]*(.*)$', 1) as num, {_STRIP("regexp_extract(line, '^\\s*\\[?(\\d{1,9})\\]?[\\s.:：、\\-—]*(.*)$', 2)")} as rest from L1),
L3 as (select *, last_value(case when num<>'' then i end ignore nulls) over (partition by page_id, req order by i rows unbounded preceding) as seg from L2),
L4 as (select page_id, req, n, seg, max(case when i=seg then num::int end) as idx, {_STRIP("coalesce(string_agg(case when i=seg then nullif(rest,'') else line end, ' ' order by i),'')")} as text from L3 where seg is not null group by 1,2,3,4),
L5 as (select page_id, req, idx, text, row_number() over (partition by page_id, req, idx order by seg desc) as z from L4 where idx between 1 and n)"""


@query("T3_parse_indexed", with_regions("select Z.page_id, Z.req, q.k as idx, L5.text from Z, lateral (select unnest(range(1, Z.n+1)) as k) q left join L5 on L5.page_id=Z.page_id and L5.req=Z.req and L5.idx=q.k and L5.z=1", _REQ, _LN))
def t3(s, d):
    x = requests(s, d)
    return x.select("page_id", "req", F.posexplode(T.indexed_output(F.col("content"), F.col("n"))).alias("i", "text")).select("page_id", "req", (F.col("i") + 1).cast("long").alias("idx"), "text")


@query("T4_strip_index", with_regions(f"select page_id, region_seq, {_STRIP("regexp_replace(translated_text, '^\\s*\\[?\\d+\\]?[\\s.:：、\\-—]*', '')")} as text from R where translated_text is not null"))
def t4(s, d):
    return regions(s, d, "translated_text").where("translated_text is not null").select("page_id", "region_seq", T.strip_index(F.col("translated_text")).alias("text"))


_NUMBERED = f"list_aggregate(list_transform(texts, lambda x, i: '[' || i || '] ' || {_STRIP('replace(x, chr(10), chr(32))')}), 'string_agg', chr(10))"


@query("T5_numbered_prompt", with_regions(f"select page_id, req, {_NUMBERED} as prompt from Z", _REQ))
def t5(s, d):
    return requests(s, d).select("page_id", "req", T.numbered_prompt(F.col("texts")).alias("prompt"))


_ASK = "'Translate from ja to ' || target_lang || ':' || chr(10) || source_text"


@query("T6_user_message", f"select distinct page_seq, region_seq, attempt, case when coalesce({_STRIP('context')},'')='' then 'Translate from ja to en:' || chr(10) || source_text else 'Earlier lines:' || chr(10) || {_STRIP('context')} || chr(10) || chr(10) || 'Translate from ja to en:' || chr(10) || source_text end as message from translations")
def t6(s, d):
    x = table(s, d, "translations")
    return x.select("page_seq", "region_seq", "attempt", T.user_message(F.col("source_text"), F.col("context"), "ja", "en").alias("message")).distinct()


@query("T7_joined_context", with_regions(f"select page_id, req, coalesce(list_aggregate(list_filter(texts, lambda x: x is not null and {_STRIP('x')}<>''),'string_agg', chr(10)),'') as context from Z", _REQ))
def t7(s, d):
    return requests(s, d).select("page_id", "req", T.joined_context(F.col("texts")).alias("context"))


@query("S8_prompt_template", f"select sub_dir, {_STRIP("replace(replace(replace('  Turn {{source_language}} into {{target_language}}. {{context}} ','{{source_language}}',source_lang),'{{target_language}}',target_lang),'{{context}}','')")} as prompt from volumes")
def s8(s, d):
    x = table(s, d, "volumes")
    return x.select("sub_dir", T.fill_template("  Turn {{source_language}} into {{target_language}}. {{context}} ", F.col("source_lang"), F.col("target_lang")).alias("prompt"))


_SPLIT = "string_split_regex(translated_text, '\\r\\n|[\\n\\r\\x{b}\\x{c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]')"


@query("F13_O9_first_line", with_regions(f"select page_id, region_seq, coalesce(list_filter(list_transform({_SPLIT}, lambda x: {_STRIP('x')}), lambda x: x<>'' and lower(x) not in ('user','assistant','system'))[1], {_STRIP('translated_text')}) as line from (select page_id, region_seq, 'Assistant' || chr(10) || translated_text as translated_text from R where translated_text is not null)"))
def f13(s, d):
    x = regions(s, d, "translated_text").where("translated_text is not null")
    return x.select("page_id", "region_seq", T.first_line(F.concat(F.lit("Assistant\n"), F.col("translated_text"))).alias("line"))


@query("T10_message_content", "select event_id, json_extract_string('{\"message\":{\"content\":' || props || '}}', '$.message.content.k') as k from events")
def t10(s, d):
    x = table(s, d, "events").select("event_id", F.concat(F.lit('{"message":{"content":'), F.col("props"), F.lit("}}")).alias("j"))
    return x.select("event_id", F.get_json_object(T.message_content(F.col("j")), "$.k").alias("k"))


@query("T11_max_tokens", with_regions("select page_id, req, greatest(256, 32*n) as tokens from Z", _REQ))
def t11(s, d):
    return requests(s, d).select("page_id", "req", T.max_tokens(F.col("n")).alias("tokens"))


@query("T12_vertical_text", with_regions(f"select page_id, region_seq, translate(regexp_replace({_tidy('translated_text')},'\\.{{2,}}|．{{2,}}','…','g'), '{T.VERTICAL_FROM}', '{T.VERTICAL_TO}') as text from R where translated_text is not null"))
def t12(s, d):
    return regions(s, d, "translated_text").where("translated_text is not null").select("page_id", "region_seq", T.vertical(F.col("translated_text")).alias("text"))


_ASCII = "length(regexp_replace(translated_text,'[^\\x{1}-\\x{7f}]','','g'))"


@query("T16_text_length", with_regions(f"select page_id, region_seq, round(20*(0.55::double*{_ASCII}+(length(translated_text)-{_ASCII})),3) as width, 20*length(translated_text) as height from R where translated_text is not null"))
def t16(s, d):
    x = regions(s, d, "translated_text").where("translated_text is not null")
    return x.select("page_id", "region_seq", F.round(T.text_width(F.col("translated_text"), F.lit(20.0)), 3).alias("width"), T.text_height(F.col("translated_text"), F.lit(20)).alias("height"))


_BLANKLESS = "regexp_replace(translated_text,'[\\s\\x{a0}\\x{3000}]+','','g')"


@query("T17_short_title", with_regions(f"select page_id, region_seq, case when length({_BLANKLESS})<=4 and regexp_matches({_BLANKLESS},'[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}0-9]') then {_BLANKLESS} else translated_text end as text from R where translated_text is not null"))
def t17(s, d):
    return regions(s, d, "translated_text").where("translated_text is not null").select("page_id", "region_seq", T.short_title(F.col("translated_text")).alias("text"))


# --- tokens --------------------------------------------------------------------------------------

_ABC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ 。！？.,!?"


def _vocab():
    pairs = [F.lit(v) for i, c in enumerate(_ABC) for v in (c, i + 4)]
    return F.create_map(*pairs)


def _back():
    pairs = [F.lit(v) for i, c in enumerate(_ABC) for v in (i + 4, c)]
    return F.create_map(*pairs)


_IDS = f"[1] || list_transform(case when translated_text='' then [] else string_split(translated_text,'') end, lambda c: case when instr('{_ABC}', c)>0 then instr('{_ABC}', c)+3 else 3 end) || [2]"


@query("T18_encode", with_regions(f"select page_id, region_seq, {_IDS} as ids from R where translated_text is not null"))
def t18(s, d):
    return regions(s, d, "translated_text").where("translated_text is not null").select("page_id", "region_seq", T.char_ids(F.col("translated_text"), _vocab()).alias("ids"))


@query("T18_decode", with_regions(f"select page_id, region_seq, list_aggregate(list_filter(string_split(translated_text,''), lambda c: instr('{_ABC}', c)>0),'string_agg','') as text, len(list_filter(string_split(translated_text,''), lambda c: instr('{_ABC}', c)=0))::int+2 as special from R where translated_text<>'' and regexp_matches(translated_text,'[a-zA-Z]')"))
def t18d(s, d):
    x = regions(s, d, "translated_text").where(r"translated_text <> '' and translated_text rlike '[a-zA-Z]'")
    ids = T.char_ids(F.col("translated_text"), _vocab())
    return x.select("page_id", "region_seq", T.chars_of(ids, _back()).alias("text"), F.aggregate(T.special_mask(ids), F.lit(0), lambda a, v: a + v).alias("special"))


@query("C13_vocabulary", with_regions("select c as token, 3+row_number() over (order by c) as id from (select distinct unnest(string_split(source_text,'')) as c from R where source_text<>'') t"))
def c13(s, d):
    """The character vocabulary of all texts: the special tokens have 0 to 3, the characters follow in code-point order."""
    return T.vocabulary(regions(s, d, "source_text"), "source_text").where("id > 3")


_PX = "list_transform(embedding, lambda x: round(x::double,4))"


@query("W4_chosen_probability", f"select vec_id, round(exp(e[1+vec_id%8]-list_max(e))/list_sum(list_transform(e, lambda x: exp(x-list_max(e)))),6) as p, len(list_filter(e, lambda x: x>0))::int as positive from (select vec_id, {_PX} as e from embeddings)")
def w4(s, d):
    x = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("e"))
    return x.select("vec_id", F.round(Q.chosen_probability(F.col("e"), F.col("vec_id") % 8), 6).alias("p"), F.size(F.filter("e", lambda v: v > 0)).alias("positive"))


_EV = "list_transform(embedding, lambda x: (abs(x)*40)::int%5)"


@query("W4_until_end", "select vec_id, case when list_min(z) is null then ids else ids[1:list_min(z)-1] end as ids from (select vec_id, ids, list_filter(list_transform(ids, lambda x, i: case when x in (0,2) then i end), lambda i: i is not null) as z from (select vec_id, list_transform(embedding, lambda x: (floor(abs(x)*40)::int)%5+(case when abs(x)<0.3 then 3 else 0 end)) as ids from embeddings))")
def w4u(s, d):
    ids = F.transform("embedding", lambda x: (F.floor(F.abs(x) * 40).cast("int") % 5 + F.when(F.abs(x) < 0.3, 3).otherwise(0)))
    return table(s, d, "embeddings").select("vec_id", Q.until_end(ids).alias("ids"))


@query("W3_content_runs", with_regions("select page_id, region_seq, coalesce(max(n),0)::int as longest from (select page_id, region_seq, g, count(*) as n from (select page_id, region_seq, ch, i-row_number() over (partition by page_id, region_seq, ch order by i) as g from (select page_id, region_seq, unnest(string_split(source_text,'')) as ch, generate_subscripts(string_split(source_text,''),1) as i from R where source_text<>'')) group by page_id, region_seq, ch, g) group by 1,2"))
def w3(s, d):
    codes = F.transform(F.split("source_text", ""), lambda c: F.xxhash64(c))
    return regions(s, d, "source_text").where("source_text <> ''").select("page_id", "region_seq", Q.longest_run(codes).alias("longest"))


# --- context across pages ------------------------------------------------------------------------

_HAS = "H as (select page_id, count(*) as lines from R where translated_text is not null and translated_text<>'' group by 1)"


@query("W1_context_carry", with_regions("select p.page_id, p.page_seq, last_value(case when H.page_id is not null then p.page_seq end ignore nulls) over (partition by p.sub_dir order by p.page_seq rows between unbounded preceding and 1 preceding) as context_seq from pages p left join H using (page_id)", _HAS))
def w1(s, d):
    from inkgrid.operators.context import carry

    return carry(table(s, d, "pages"), regions(s, d, "translated_text")).select("page_id", "page_seq", "context_seq")


@query("W2_context_session", with_regions("select p.page_id, p.page_seq, coalesce(last_value(case when H.page_id is not null then p.page_seq end ignore nulls) over (partition by p.sub_dir order by p.page_seq rows between unbounded preceding and 1 preceding), -1) as context_seq from pages p left join H using (page_id)", _HAS))
def w2(s, d):
    """A session that starts with a context of its own (-1) instead of none."""
    from inkgrid.operators.context import carry

    return carry(table(s, d, "pages"), regions(s, d, "translated_text"), start=-1).select("page_id", "page_seq", "context_seq")
