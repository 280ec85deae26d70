"""Queries over text segmentation and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrid.functions import scoring as Q
from inkgrid.operators import layout as L
from inkgrid.plans.base import regions, with_regions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def said(s, d):
    return regions(s, d, "translated_text").where("translated_text is not null")


@query("T13_segment_text")
def t13(s, d):
    return L.segment_table(said(s, d)).select("page_id", "region_seq", F.posexplode("segments").alias("i", "x")).select("page_id", "region_seq", "i", "x.text", "x.break_after")


_SQUEEZE = "regexp_replace(translated_text, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{85}\\x{1c}-\\x{1f}]+', '', 'g')"


@query("T13_text_conserved", with_regions(f"select page_id, region_seq, {_SQUEEZE} as text from R where translated_text is not null"))
def t13c(s, d):
    """Invariant: the segments hold all characters of the text but its blanks, in order."""
    j = L.segment_table(said(s, d)).select("page_id", "region_seq", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("t"))
    return j.select("page_id", "region_seq", F.regexp_replace("t", r"[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{1c}-\x{1f}]+", "").alias("text"))


@query("T14_split_sentences")
def t14(s, d):
    return L.sentence_lists(said(s, d)).select("page_id", "region_seq", F.posexplode("sentences").alias("i", "sentence"))


# character by character: a line is full when the next one would pass the box's width
_WRAP = """C as (select page_id, region_seq, translated_text as t, r-l as w from R where translated_text is not null),
F as (select page_id, region_seq, t, w, 0::bigint as i, 0::bigint as a, 0::bigint as n, '' as line, []::varchar[] as lines from C
 union all
 select page_id, region_seq, t, w, i+1, case when c=chr(10) then 0 when full_ then (ascii(c)<128)::bigint else a+(ascii(c)<128)::bigint end, case when c=chr(10) then 0 when full_ then 1 else n+1 end,
  case when c=chr(10) then '' when full_ then c else line||c end, case when c=chr(10) or full_ then list_append(lines, line) else lines end
 from (select F.*, substr(t, i+1, 1) as c, n>0 and 16.0::double*(0.55::double*(a+(ascii(substr(t, i+1, 1))<128)::bigint)+(n+1-a-(ascii(substr(t, i+1, 1))<128)::bigint))>w as full_ from F where i<length(t)) q)"""


@query("T15_wrap_text", with_regions("select page_id, region_seq, list_append(lines, line) as lines from F where i=length(t)", _WRAP, recursive=True))
def t15(s, d):
    return L.wrapped(said(s, d).select("page_id", "region_seq", "translated_text", "l", "r"), 16.0)


@query("T15_wrap_conserved", with_regions("select page_id, region_seq, replace(translated_text, chr(10), '') as text from R where translated_text is not null"))
def t15c(s, d):
    w = L.wrapped(said(s, d).select("page_id", "region_seq", "translated_text", "l", "r"), 16.0)
    return w.select("page_id", "region_seq", F.array_join("lines", "").alias("text"))


@query("L1_horizontal_layout")
def l1(s, d):
    return L.layouts(said(s, d), False)


@query("L1_vertical_layout")
def l1v(s, d):
    return L.layouts(said(s, d), True)


def cut_words(lines):
    """How many ends of an array of lines cut a Latin word that doesn't fill its line."""
    latin = r"[A-Za-z0-9'\-_]"  # looked for at the two ends that meet, then in the whole line
    pairs = F.transform(F.when(F.size(lines) > 1, F.sequence(F.lit(1), F.size(lines) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.element_at(lines, i).alias("a"), F.element_at(lines, i + 1).alias("b")))
    return F.size(F.filter(pairs, lambda p: F.substring(p["a"], -1, 1).rlike(latin) & F.substring(p["b"], 1, 1).rlike(latin) & ~p["a"].rlike(f"^{latin}+$")))


@query("L4_kinsoku", with_regions(f"select page_id, region_seq, nullif({_SQUEEZE},'') as text, 0::bigint as broken from R where translated_text is not null"))
def l4(s, d):
    """Of each text, what its lines hold (all but the blanks, in order) and how many Latin words of up to the line's length they cut: none."""
    x = L.layouts(said(s, d), False)
    held = F.regexp_replace(F.array_join("lines", ""), r"[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{1c}-\x{1f}]+", "")
    return x.select("page_id", "region_seq", held.alias("text"), F.when(F.col("score") > -50000, cut_words(F.col("lines"))).otherwise(0).cast("long").alias("broken"))


# lines of a text as its words, at a size of 12 to 23, for the scores as expressions
_WORDS = "W as (select page_id, region_seq, l, t, r, b, 12+region_seq%12 as size, list_transform(string_split(translated_text,' '), lambda x: length(x)::int) as c from R where translated_text is not null and translated_text<>'')"
_SZ = "V as (select *, list_transform(c, lambda x: (x*size)::double) as s, len(c) as n from W), U as (select *, list_avg(s) as mu, list_stddev_pop(s) as dev, s[n] as lst from V)"
_RAG = lambda share: f"case when n>1 then 30.0::double*dev/greatest(1.0::double,mu)+case when lst<{share}::double*mu then 40.0::double else 0 end else 0 end"
_COM = lambda w, h: f"25.0::double*size+40.0::double*least(1.0::double,({w})*({h})/greatest(1.0::double,((r-l)*(b-t))::double))-75.0::double*(n-1)"
_OVER = lambda w, h: f"-100000.0::double-100.0::double*(greatest(0.0::double,({w})-(r-l))+greatest(0.0::double,({h})-(b-t)))"
_HW, _HH = "list_max(s)", "(1.25::double*size*n)"
_VW, _VH = "((n*size)::double)", "list_max(s)"


def lines_of(s, d):
    """Words as lines, only the last of which ends a sentence."""
    x = said(s, d).where("translated_text <> ''").withColumn("size", 12 + F.col("region_seq") % 12)
    x = x.withColumn("c", F.transform(F.split("translated_text", " "), lambda w: F.length(w)))
    x = x.withColumn("s", F.transform("c", lambda v: (v * F.col("size")).cast("double")))
    n = F.size("c")
    ends = F.transform("c", lambda v, i: F.struct((i == n - 1).alias("sentence"), F.lit(False).alias("paragraph")))
    return x.withColumn("ends", ends).withColumn("n", n), F.col("r") - F.col("l"), F.col("b") - F.col("t")


@query("P23_score_horizontal", with_regions(f"select page_id, region_seq, round(case when {_HW}>r-l or {_HH}>b-t then {_OVER(_HW, _HH)} else {_COM(_HW, _HH)}-({_RAG(0.35)}) end,4) as score from U", _WORDS, _SZ))
def p23(s, d):
    x, w, h = lines_of(s, d)
    sc = Q.horizontal_score(F.col("size"), F.col("s"), F.col("ends"), F.array_max("s"), 1.25 * F.col("size") * F.col("n"), w, h)
    return x.select("page_id", "region_seq", F.round(sc, 4).alias("score"))


@query("P24_score_vertical", with_regions(f"select page_id, region_seq, round(case when {_VW}>r-l or {_VH}>b-t then {_OVER(_VW, _VH)} when n>=2 and (list_max(c)<=1 or list_sum(c)<=3) then -100000.0::double else {_COM(_VW, _VH)}-({_RAG(0.30)})-case when n>=2 and list_min(c)=1 then 300.0::double else 0 end-15.0::double*abs({_VW}/greatest(1.0::double,{_VH})-(r-l)::double/greatest(1.0::double,(b-t)::double)) end,4) as score from U", _WORDS, _SZ))
def p24(s, d):
    x, w, h = lines_of(s, d)
    sc = Q.vertical_score(F.col("size"), F.col("s"), F.col("c"), F.col("ends"), (F.col("n") * F.col("size")).cast("double"), F.array_max("s"), w, h)
    return x.select("page_id", "region_seq", F.round(sc, 4).alias("score"))


@query("P25_score_mask_vertical", with_regions("select page_id, region_seq, round(case when n>1 and (list_max(c)<=1 or list_sum(c)<=3) then -1000.0::double else size/72.0::double-0.15::double*greatest(0,n-2)-case when n>2 then 10.0::double else 0 end+case when n>1 then 0.20::double*list_min(c)/greatest(1,list_max(c))-case when c[n]=1 and list_max(c)>=3 then 0.45::double when c[n]=2 and list_max(c)>=5 then 0.25::double else 0 end else 0 end end,6) as score from V", _WORDS, _SZ.split(", U as")[0]))
def p25(s, d):
    x, _w, _h = lines_of(s, d)
    return x.select("page_id", "region_seq", F.round(Q.vertical_mask_score(F.col("size"), F.lit(72), F.col("c"), F.lit(2), F.lit(1)), 6).alias("score"))


@query("O7_largest_size", with_regions("select page_id, region_seq, (select max(z) from range(12,73) q(z) where ceil(n::double/greatest(1,(b-t)//z))*z<=r-l and z<=b-t) as size from (select *, length(replace(translated_text,chr(10),'')) as n from R where translated_text is not null) where n>0"))
def o7(s, d):
    """Feasibility is monotone in the size, so the largest feasible of all sizes is what bisection finds."""
    x = said(s, d).withColumn("n", F.length(F.replace("translated_text", F.lit("\n"), F.lit("")))).where("n > 0")
    h, w = F.col("b") - F.col("t"), F.col("r") - F.col("l")
    ok = F.filter(F.sequence(F.lit(12), F.lit(72)), lambda z: (F.ceil(F.col("n") / F.greatest(F.lit(1), F.floor(h / z))) * z <= w) & (z <= h))
    return x.select("page_id", "region_seq", F.array_max(ok).cast("long").alias("size"))


@query("O6_best_size", with_regions("select page_id, region_seq, first(z order by sc desc, z desc)::int as size from (select page_id, region_seq, z, 100-abs(z*length(translated_text)-(r-l)) as sc from R, range(12,40) q(z) where translated_text is not null) group by 1,2"))
def o6(s, d):
    x = said(s, d)
    opts = F.transform(F.sequence(F.lit(12), F.lit(39)), lambda z: F.struct((100 - F.abs(z * F.length("translated_text") - (F.col("r") - F.col("l")))).alias("sc"), z.alias("z")))
    return x.select("page_id", "region_seq", F.array_max(opts)["z"].alias("size"))


@query("L11_column_places", with_regions("select page_id, region_seq, i::int as i, round(l+((r-l)+n*20+(n-1)*g)/2.0::double-20-(i-1)*(20+g),4) as x, round(t+((b-t)-c[i]*20)/2.0::double,4) as y from (select *, case when n>1 then least(greatest(0.0::double,(r-l)-n*20)/(n+1),30.0::double) else 0.0::double end as g from V), lateral (select unnest(range(1,n+1)) as i)", _WORDS, _SZ.split(", U as")[0]))
def l11(s, d):
    x, w, _h = lines_of(s, d)
    n = F.col("n")
    x = x.withColumn("g", F.when(n > 1, F.least(F.greatest(F.lit(0.0), w - n * 20) / (n + 1), F.lit(30.0))).otherwise(0.0))
    e = x.select("page_id", "region_seq", "l", "t", "r", "b", "n", "g", F.posexplode("c").alias("k", "c"))
    px = F.col("l") + ((F.col("r") - F.col("l")) + n * 20 + (n - 1) * F.col("g")) / 2.0 - 20 - F.col("k") * (20 + F.col("g"))
    return e.select("page_id", "region_seq", (F.col("k") + 1).alias("i"), F.round(px, 4).alias("x"), F.round(F.col("t") + ((F.col("b") - F.col("t")) - F.col("c") * 20) / 2.0, 4).alias("y"))


@query("L6_capacity_split")
def l6(s, d):
    """Texts spread over three columns of equal capacity."""
    import pyarrow as pa

    def f(t):
        n = -(-len(t) // 3) + 2
        return (L.by_capacity(t, [n, n, n]),)

    return L._map(said(s, d), ["translated_text"], f, "columns array<string>", [("columns", pa.list_(pa.string()))])


@query("L5_balanced_chunks")
def l5(s, d):
    import functools

    import pyarrow as pa

    def f(t):
        return (L.balanced_chunks(t, 120.0, functools.partial(L.width_of, size=16), False),)

    return L._map(said(s, d), ["translated_text"], f, "chunks array<string>", [("chunks", pa.list_(pa.string()))])


@query("L8_mask_layout")
def l8(s, d):
    """Texts set in the columns of their layout masks (runs on every fifth line)."""
    import pyarrow as pa

    from inkgrid.operators.masks import column_ranges
    from inkgrid.plans.queries_masks import runs

    r = column_ranges(runs(s, d, "layout"), regions(s, d), 12, 5)
    g = r.groupBy("page_id", "region_seq").agg(F.array_sort(F.collect_list(F.struct("x", "y0", "y1"))).alias("cols"))  # bounded by the box's width

    def f(t, cols):
        ranges: dict[int, list[tuple[int, int]]] = {}
        for c in cols:
            ranges.setdefault(c["x"], []).append((c["y0"], c["y1"]))
        got = L.in_mask(t, ranges, 12)
        return (None if got is None else [{"chunk": c, "x": x, "y": y} for c, x, y in got],)

    kind = pa.list_(pa.struct([("chunk", pa.string()), ("x", pa.int32()), ("y", pa.int32())]))
    return L._map(said(s, d).join(g, ["page_id", "region_seq"]), ["translated_text", "cols"], f, "placements array<struct<chunk:string,x:int,y:int>>", [("placements", kind)])
