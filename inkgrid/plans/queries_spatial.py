"""Queries over boxes: geometry, pair joins, groupings, orders. QUERIES and ORACLES have the same keys where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrid.functions import geometry as G
from inkgrid.functions.geometry import Box
from inkgrid.operators import spatial as S
from inkgrid.plans.base import pages, regions, with_regions
from inkgrid.session import cut_lineage, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- scalars -------------------------------------------------------------------------------------


@query("P1_bbox_area", with_regions("select page_id, region_seq, (r-l)::bigint*(b-t) as area from R"))
def p1(s, d):
    return regions(s, d).select("page_id", "region_seq", G.area(Box.of()).alias("area"))


_OVER = "from R a join R b on a.page_id=b.page_id and a.region_seq<b.region_seq and a.l<b.r and b.l<a.r and a.t<b.b and b.t<a.b"
_I = "(least(a.r,b.r)-greatest(a.l,b.l))::bigint*(least(a.b,b.b)-greatest(a.t,b.t))"


@query("P2_bbox_iou", with_regions(f"select page_id, a_seq, b_seq, round(i/u, 6) as iou from (select a.page_id, a.region_seq as a_seq, b.region_seq as b_seq, {_I}::double as i, ((a.r-a.l)::bigint*(a.b-a.t)+(b.r-b.l)::bigint*(b.b-b.t)-{_I})::double as u {_OVER})"))
def p2(s, d):
    p = S.overlap_pairs(regions(s, d))
    return p.select("page_id", F.col("a_region_seq").alias("a_seq"), F.col("b_region_seq").alias("b_seq"), F.round(G.iou(Box.of("a_"), Box.of("b_")), 6).alias("iou"))


@query("P3_bboxes_overlap", with_regions(f"select a.page_id, count(*) as pairs {_OVER} group by 1"))
def p3(s, d):
    return S.overlap_pairs(regions(s, d)).groupBy("page_id").agg(F.count("*").alias("pairs"))


_GX, _GY = "greatest(0,greatest(a.l,b.l)-least(a.r,b.r))", "greatest(0,greatest(a.t,b.t)-least(a.b,b.b))"
_NEAR = f"from R a join R b on a.page_id=b.page_id and a.region_seq<b.region_seq and {_GX}<=40 and {_GY}<=40"


@query("P4_bbox_gap_2d", with_regions(f"select a.page_id, a.region_seq as a_seq, b.region_seq as b_seq, {_GX} as gap_x, {_GY} as gap_y, round(sqrt(({_GX})*({_GX})+({_GY})*({_GY})),6) as gap {_NEAR}"))
def p4(s, d):
    gx, gy, g = G.gap_2d(Box.of("a_"), Box.of("b_"))
    return S.near_pairs(regions(s, d), 40).select("page_id", F.col("a_region_seq").alias("a_seq"), F.col("b_region_seq").alias("b_seq"), gx.alias("gap_x"), gy.alias("gap_y"), F.round(g, 6).alias("gap"))


@query("P5_interval_gap_ratio", with_regions(f"select a.page_id, a.region_seq as a_seq, b.region_seq as b_seq, {_GY} as gap, round(greatest(0,least(a.r,b.r)-greatest(a.l,b.l))::double/nullif(least(a.r-a.l,b.r-b.l),0),6) as ratio {_NEAR}"))
def p5(s, d):
    a, b = Box.of("a_"), Box.of("b_")
    return S.near_pairs(regions(s, d), 40).select("page_id", F.col("a_region_seq").alias("a_seq"), F.col("b_region_seq").alias("b_seq"), G.interval_gap(a.t, a.b, b.t, b.b).alias("gap"), F.round(G.interval_overlap_ratio(a.l, a.r, b.l, b.r), 6).alias("ratio"))


_SIZED = "join (select distinct page_id, width, height from pages where width is not null) p using (page_id)"
_RE = lambda x, m: f"greatest(0,least(round_even({x},0)::int,{m}))"


@query(
    "P6_clip_bbox",
    with_regions(
        f"select page_id, region_seq, case when cr>cl and cb>ct then cl end as l, case when cr>cl and cb>ct then ct end as t, case when cr>cl and cb>ct then cr end as r, case when cr>cl and cb>ct then cb end as b from (select page_id, region_seq, {_RE('l*0.5-10.0', 'width')} as cl, {_RE('t*0.5', 'height')} as ct, {_RE('r*0.5-10.0', 'width')} as cr, {_RE('b*0.5', 'height')} as cb from R {_SIZED})"
    ),
)
def p6(s, d):
    x = regions(s, d).join(pages(s, d).select("page_id", "width", "height").where("width is not null").distinct(), "page_id")
    c = G.clip(F.col("l") * 0.5 - 10.0, F.col("t") * 0.5, F.col("r") * 0.5 - 10.0, F.col("b") * 0.5, F.col("width"), F.col("height"))
    return x.select("page_id", "region_seq", c.alias("c")).select("page_id", "region_seq", "c.l", "c.t", "c.r", "c.b")


@query("P7_expand_bbox", with_regions(f"select page_id, region_seq, greatest(0,l-12) as l, greatest(0,t-12) as t, least(width,r+12) as r, least(height,b+12) as b from R {_SIZED}"))
def p7(s, d):
    x = regions(s, d).join(pages(s, d).select("page_id", "width", "height").where("width is not null").distinct(), "page_id")
    e = G.expand(Box.of(), 12, F.col("width"), F.col("height"))
    return x.select("page_id", "region_seq", e.l.alias("l"), e.t.alias("t"), e.r.alias("r"), e.b.alias("b"))


@query("P8_offset_in_roi", with_regions("select page_id, region_seq, greatest(0,l-layout_bbox.l) as l, greatest(0,t-layout_bbox.t) as t, least(layout_bbox.r-layout_bbox.l,r-layout_bbox.l) as r, least(layout_bbox.b-layout_bbox.t,b-layout_bbox.t) as b from R where layout_bbox is not null"))
def p8(s, d):
    x = regions(s, d, "layout_bbox").where("layout_bbox is not null")
    e = G.within_roi(Box.of(), Box.of("layout_bbox."))
    return x.select("page_id", "region_seq", e.l.alias("l"), e.t.alias("t"), e.r.alias("r"), e.b.alias("b"))


@query("P9_layout_or_bbox", with_regions("select page_id, region_seq, coalesce(layout_bbox.l,l) as l, coalesce(layout_bbox.t,t) as t, coalesce(layout_bbox.r,r) as r, coalesce(layout_bbox.b,b) as b from R"))
def p9(s, d):
    return regions(s, d, "layout_bbox").select("page_id", "region_seq", *[F.coalesce(F.col(f"layout_bbox.{c}"), F.col(c)).alias(c) for c in "ltrb"])


@query("P10_band_order", with_regions("select page_id, region_seq, row_number() over (partition by page_id order by round_even(((t+b)/2.0)/40.0,0), -((l+r)/2.0), region_seq) as rank from R"))
def p10(s, d):
    """Reading order by bands; ranks are within (page, band) plus the bands above, so no page is ranked in one task."""
    x = regions(s, d)
    band, right = G.band_key((F.col("l") + F.col("r")) / 2.0, (F.col("t") + F.col("b")) / 2.0, 40.0)
    return S.rank_in_bands(x, band, right)


@query("P15_stroke_info", with_regions("select page_id, region_seq, greatest(2,least(5,((b-t)//14))) as width, 0.299*ink_color.r+0.587*ink_color.g+0.114*ink_color.b<128 as white from R where ink_color is not null"))
def p15(s, d):
    w, white = G.stroke(F.col("ink_color.r"), F.col("ink_color.g"), F.col("ink_color.b"), F.col("b") - F.col("t"))
    return regions(s, d, "ink_color").where("ink_color is not null").select("page_id", "region_seq", w.alias("width"), white.alias("white"))


_BG = "(region_seq*37)%256"
_GREY = "greatest(ink_color.r,ink_color.g,ink_color.b)-least(ink_color.r,ink_color.g,ink_color.b)<25"
_LUMA = "(0.299*ink_color.r+0.587*ink_color.g+0.114*ink_color.b)"
_SNAP = lambda c: f"case when {_GREY} and {_BG}<128 and {_LUMA}>{_BG} then 255 when {_GREY} and {_BG}>=128 and {_LUMA}<{_BG} then 0 else ink_color.{c} end"


@query("P16_neutral_ink", with_regions(f"select page_id, region_seq, {_SNAP('r')} as r, {_SNAP('g')} as g, {_SNAP('b')} as b from R where ink_color is not null"))
def p16(s, d):
    x = regions(s, d, "ink_color").where("ink_color is not null")
    n = G.neutral_ink(F.col("ink_color.r"), F.col("ink_color.g"), F.col("ink_color.b"), F.pmod(F.col("region_seq") * 37, F.lit(256)))
    return x.select("page_id", "region_seq", n.alias("n")).select("page_id", "region_seq", "n.r", "n.g", "n.b")


@query("P17_luma", with_regions(f"select page_id, region_seq, round({_LUMA}::double,3) as luma from R where ink_color is not null"))
def p17(s, d):
    return regions(s, d, "ink_color").where("ink_color is not null").select("page_id", "region_seq", F.round(G.luma(F.col("ink_color.r"), F.col("ink_color.g"), F.col("ink_color.b")), 3).alias("luma"))


@query("P18_text_color", with_regions("select page_id, region_seq, coalesce(ink_color.r,0) as r, coalesce(ink_color.g,0) as g, coalesce(ink_color.b,0) as b from R"))
def p18(s, d):
    return regions(s, d, "ink_color").select("page_id", "region_seq", *[F.coalesce(F.col(f"ink_color.{c}"), F.lit(0)).alias(c) for c in "rgb"])


_CJK, _ALPHA = r"regexp_matches(coalesce(translated_text,''),'[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]')", r"regexp_matches(coalesce(translated_text,''),'[a-zA-Z\x{c0}-\x{24f}\x{400}-\x{4ff}]')"


@query("P19_horizontal", with_regions(f"select page_id, region_seq, case when {_ALPHA} and not {_CJK} then true when layout_bbox is not null then false when {_CJK} then greatest(1,r-l)>=greatest(1,b-t)*2.0 else greatest(1,r-l)>=greatest(1,b-t)*1.3::double end as horizontal from R"))
def p19(s, d):
    x = regions(s, d, "translated_text", "layout_bbox")
    return x.select("page_id", "region_seq", G.runs_horizontal(Box.of(), F.coalesce("translated_text", F.lit("")), F.col("layout_bbox").isNotNull()).alias("horizontal"))


@query("P21_geometric_dilation", with_regions(f"select page_id, region_seq, greatest(2,least(24,round_even(0.10::double*greatest(12,least(64,least(r-l,b-t)))*greatest(0.6::double,least(2.5::double,greatest(width,height)/1600.0::double)),0)+1))::int as px from R {_SIZED}"))
def p21(s, d):
    x = regions(s, d).join(pages(s, d).select("page_id", "width", "height").where("width is not null").distinct(), "page_id")
    return x.select("page_id", "region_seq", G.geometric_dilation(Box.of(), F.col("width"), F.col("height"), 2).alias("px"))


# --- filters and joins ---------------------------------------------------------------------------


@query("F3_class_filter", "select vec_id from embeddings where label = 3")
def f3(s, d):
    """Detector rows of the wanted class; a class that isn't among the model's fails the query."""
    from inkgrid.operators.detect import of_class

    names = {k: ("text" if k == 3 else f"other{k}") for k in range(64)}
    return of_class(table(s, d, "embeddings").select("vec_id", F.col("label").alias("class_id")), names, "Text").select("vec_id")


@query("F4_confidence_threshold", with_regions("select page_id, region_seq from R where det >= 0.6"))
def f4(s, d):
    return regions(s, d).where("det >= 0.6").select("page_id", "region_seq")


_F6 = "exists (select 1 from R j where j.page_id=i.page_id and j.region_seq<>i.region_seq and j.b>j.t and 5*(i.b-i.t)<2*(j.b-j.t) and 2*(j.t-i.b)>=-(i.b-i.t) and 2*(j.t-i.b)<=(i.b-i.t) and 2*greatest(0,least(i.r,j.r)-greatest(i.l,j.l))>=i.r-i.l) and i.r>i.l and i.b>i.t"


@query("F6_suppress_annotations", with_regions(f"select page_id, region_seq from R i where not ({_F6})"))
def f6(s, d):
    return S.without_annotations(regions(s, d)).select("page_id", "region_seq")


@query("F2_skipped", with_regions("select page_id, region_seq from R where not (confidence is null or confidence >= 0.75)"))
def f2(s, d):
    x = regions(s, d, "confidence")
    return S.skipped(x, x.where("confidence is null or confidence >= 0.75"))


# text boxes: regions with recognised text; segments: all layout boxes
_T = "T as (select * from R where source_text<>'')"
_G = "G as (select page_id, region_seq, layout_bbox.l as l, layout_bbox.t as t, layout_bbox.r as r, layout_bbox.b as b from R where layout_bbox is not null)"
_IOU = f"({_I})::double/((a.r-a.l)::bigint*(a.b-a.t)+(b.r-b.l)::bigint*(b.b-b.t)-{_I})"
_IOU0 = "(greatest(0,least(a.r,b.r)-greatest(a.l,b.l))::bigint*greatest(0,least(a.b,b.b)-greatest(a.t,b.t)))::double/((a.r-a.l)::bigint*(a.b-a.t)+(b.r-b.l)::bigint*(b.b-b.t)-greatest(0,least(a.r,b.r)-greatest(a.l,b.l))::bigint*greatest(0,least(a.b,b.b)-greatest(a.t,b.t)))"
_RUNS = "M as (select distinct page_id, region_seq, y, x0, x1 from mask_runs where kind='layout')"
_MATCH = f"H as (select a.page_id, a.region_seq, b.region_seq as match_seq, {_IOU0} as iou, row_number() over (partition by a.page_id, a.region_seq order by {_IOU0} desc, b.region_seq) as k from T a join G b on a.page_id=b.page_id and (({_IOU0})>=0.1 or exists (select 1 from M m where m.page_id=b.page_id and m.region_seq=b.region_seq and m.y=floor((a.t+a.b)/2) and floor((a.l+a.r)/2)>=m.x0 and floor((a.l+a.r)/2)<m.x1)))"
_BEST = "B as (select T.page_id, T.region_seq, H.match_seq, H.iou from T left join H on H.page_id=T.page_id and H.region_seq=T.region_seq and H.k=1)"


def _texts(s, d):
    return regions(s, d, "source_text").where("source_text <> ''").drop("source_text")


def _segments(s, d):
    x = regions(s, d, "layout_bbox").where("layout_bbox is not null")
    return x.select("page_id", "region_seq", "layout_bbox.l", "layout_bbox.t", "layout_bbox.r", "layout_bbox.b", "det")


def _runs(s, d):
    return table(s, d, "mask_runs").where("kind = 'layout'").select("page_id", "region_seq", "y", "x0", "x1").distinct()


def _matches(s, d):
    return S.best_match(_texts(s, d), _segments(s, d), _runs(s, d))


@query("J1_best_match", with_regions("select page_id, region_seq, match_seq, round(iou,6) as iou from B where match_seq is not null", _T, _G, _RUNS, _MATCH, _BEST))
def j1(s, d):
    return _matches(s, d).where("match_seq is not null").select("page_id", "region_seq", "match_seq", F.round("iou", 6).alias("iou"))


@query("J2_unmatched_segments", with_regions("select page_id, region_seq from G where (page_id, region_seq) not in (select page_id, match_seq from B where match_seq is not null)", _T, _G, _RUNS, _MATCH, _BEST))
def j2(s, d):
    return S.unmatched(_segments(s, d), _matches(s, d))


@query("J3_unmatched_texts", with_regions("select T.page_id, T.region_seq, T.l, T.t, T.r, T.b, T.det from T join B using (page_id, region_seq) where match_seq is null", _T, _G, _RUNS, _MATCH, _BEST))
def j3(s, d):
    lone = _matches(s, d).where("match_seq is null").select("page_id", "region_seq")
    return _texts(s, d).join(lone, ["page_id", "region_seq"]).select("page_id", "region_seq", "l", "t", "r", "b", "det")


@query("J6_skipped_overlap", with_regions("select a.page_id, a.region_seq, exists (select 1 from R b where b.page_id=a.page_id and (b.confidence is null or b.confidence>=0.75) and a.l<b.r and b.l<a.r and a.t<b.b and b.t<a.b) as touched from R a where not (a.confidence is null or a.confidence>=0.75)"))
def j6(s, d):
    x = regions(s, d, "confidence")
    keep = "confidence is null or confidence >= 0.75"
    return S.touches(x.where(f"not ({keep})"), x.where(keep))


_LIM = "X as (select page_id, region_seq, l, t, r, b, least(coalesce(layout_bbox.l,l),l) as ll, least(coalesce(layout_bbox.t,t),t) as lt, greatest(coalesce(layout_bbox.r,r),r) as lr, greatest(coalesce(layout_bbox.b,b),b) as lb from R)"
_VO, _HO = "greatest(0,least(a.b,b.b)-greatest(a.t,b.t))", "greatest(0,least(a.r,b.r)-greatest(a.l,b.l))"
_BOTH = f"({_VO}>0 and {_HO}>0)"
_HOR = f"(({_VO}>0) or ({_HO}=0 and {_GX}<={_GY}))"
_XS, _YS = "((greatest(a.l,b.l)+least(a.r,b.r))//2)", "((greatest(a.t,b.t)+least(a.b,b.b))//2)"
_CAPS = f"""C as (select a.page_id, a.region_seq,
 min(case when {_BOTH} then case when {_VO}>={_HO} and a.l+a.r<b.l+b.r then {_XS} end when {_HOR} and a.r<=b.l then (a.r+b.l)//2 end) as r1,
 max(case when {_BOTH} then case when {_VO}>={_HO} and a.l+a.r>=b.l+b.r then {_XS} end when {_HOR} and a.r>b.l and b.r<=a.l then (b.r+a.l)//2 end) as l1,
 min(case when {_BOTH} then case when {_VO}<{_HO} and a.t+a.b<b.t+b.b then {_YS} end when not {_HOR} and a.b<=b.t then (a.b+b.t)//2 end) as b1,
 max(case when {_BOTH} then case when {_VO}<{_HO} and a.t+a.b>=b.t+b.b then {_YS} end when not {_HOR} and a.b>b.t and b.b<=a.t then (b.b+a.t)//2 end) as t1
 from X a join X b on a.page_id=b.page_id and a.region_seq<>b.region_seq group by 1,2)"""


@query("G6_J7_render_bounds", with_regions("select X.page_id, X.region_seq, least(l,greatest(ll,l1)) as l, least(t,greatest(lt,t1)) as t, greatest(r,least(lr,r1)) as r, greatest(b,least(lb,b1)) as b from X left join C using (page_id, region_seq)", _LIM, _CAPS))
def g6(s, d):
    x = regions(s, d, "layout_bbox")
    return S.render_bounds(x.select("page_id", "region_seq", "l", "t", "r", "b", *[F.col(f"layout_bbox.{c}").alias(f"l{c}") for c in "ltrb"]))


# --- orders and groups ---------------------------------------------------------------------------

_O1 = """S as (select page_id, region_seq, l, t, r, b, row_number() over (partition by page_id order by t, region_seq) as k from R),
F as (select page_id, 0::bigint as k, []::struct(t int, b int)[] as rws, 0 as rowno, -1 as region_seq, 0 as l, 0 as r from (select distinct page_id from S)
 union all
 select S.page_id, S.k,
  case when h is null then list_append(F.rws, {'t': S.t, 'b': S.b}) else list_transform(F.rws, lambda x, i: case when i=h then {'t': least(x.t,S.t), 'b': greatest(x.b,S.b)} else x end) end,
  (case when h is null then len(F.rws)+1 else h end)::int, S.region_seq, S.l, S.r
 from F join S on S.page_id=F.page_id and S.k=F.k+1,
 lateral (select list_min(list_filter(range(1, len(F.rws)+1), lambda i: least(S.b,F.rws[i].b)-greatest(S.t,F.rws[i].t)>0 and 5*(least(S.b,F.rws[i].b)-greatest(S.t,F.rws[i].t))>=2*least(greatest(1,S.b-S.t),greatest(1,F.rws[i].b-F.rws[i].t)))) as h) q)"""


@query("O1_reading_order", with_regions("select page_id, region_seq, row_number() over (partition by page_id order by rowno, -r, -l, k) as rank from F where k>0", _O1, recursive=True))
def o1(s, d):
    return S.reading_order(regions(s, d))


@query("O3_file_order", "select page_id, row_number() over (order by lower(name), page_seq) as n from pages")
def o3(s, d):
    from inkgrid.sources.files import number_by_name

    return number_by_name(pages(s, d).select("page_id", "name", F.col("page_seq").alias("seq")), "n").select("page_id", "n")


@query("O4_nms_order", with_regions("select page_id, region_seq, row_number() over (partition by page_id order by det desc, region_seq) as rank from R"))
def o4(s, d):
    """Confidence falls from band to band, so ranks come from the bands' counts and no page is sorted as a whole."""
    return S.rank_in_bands(regions(s, d), F.floor((1 - F.col("det")) * 1024), -F.col("det"))


@query("O5_argmax_base", with_regions("select page_id, first(region_seq order by det desc, region_seq) as region_seq from R group by 1"))
def o5(s, d):
    best = F.max(F.struct("det", (-F.col("region_seq")).alias("n")))
    return regions(s, d).groupBy("page_id").agg(best.alias("m")).select("page_id", (-F.col("m.n")).cast("int").alias("region_seq"))


_E5 = f"E as (select a.page_id, a.region_seq as x, b.region_seq as y {_OVER} where 2*({_I})>=((a.r-a.l)::bigint*(a.b-a.t)+(b.r-b.l)::bigint*(b.b-b.t)-{_I})), E2 as (select page_id,x,y from E union all select page_id,y,x from E)"
_NMS = """N as (select page_id, region_seq, row_number() over (partition by page_id order by det desc, region_seq) as k from R),
K as (select page_id, 0::bigint as k, []::int[] as kept from (select distinct page_id from E)
 union all select N.page_id, N.k, case when exists (select 1 from E2 where E2.page_id=N.page_id and E2.x=N.region_seq and list_contains(K.kept, E2.y)) then K.kept else list_append(K.kept, N.region_seq) end
 from K join N on N.page_id=K.page_id and N.k=K.k+1),
L as (select page_id, kept from (select page_id, kept, row_number() over (partition by page_id order by k desc) as z from K) where z=1)"""


@query("G1_nms", with_regions("select R.page_id, R.region_seq from R left join L using (page_id) where L.page_id is null or list_contains(L.kept, R.region_seq)", _E5, _NMS, recursive=True))
def g1(s, d):
    return S.non_maximum_suppression(regions(s, d), 0.5)


_REACH = (
    "E2 as (select page_id,x,y from E union all select page_id,y,x from E)",
    "P as (select page_id,x,y from E2 union select P.page_id,P.x,E2.y from P join E2 on E2.page_id=P.page_id and E2.x=P.y)",
)


def _components_sql(edges: str, name: str = "cluster", nodes: str = "R", *ctes: str) -> str:
    """Smallest number that each region reaches over the edges."""
    return with_regions(
        f"select N.page_id, N.region_seq, least(N.region_seq, coalesce(min(P.y), N.region_seq)) as {name} from {nodes} N left join P on P.page_id=N.page_id and P.x=N.region_seq group by 1,2",
        *ctes,
        f"E as ({edges})",
        *_REACH,
        recursive=True,
    )


_GAPS = f"select a.page_id, a.region_seq as x, b.region_seq as y from R a join R b on a.page_id=b.page_id and a.region_seq<b.region_seq and {_GX}<=4 and {_GY}<=4"


@query("G8_cluster_components", _components_sql(_GAPS + ""))
def g8(s, d):
    return S.clusters(regions(s, d), 4, 4)


@query("G7_union_find", _components_sql(_GAPS + ""))
def g7(s, d):
    """The same components by min-label joins, the way for graphs wider than a group."""
    x = regions(s, d)
    p = S.near_pairs(x, 4)
    c = S.components(p.select("page_id", F.col("a_region_seq").alias("a"), F.col("b_region_seq").alias("b")), x)
    return c.select("page_id", "region_seq", F.col("component").alias("cluster"))


@query("G4_merge_bboxes", with_regions("select page_id, region_seq//5 as g, min(l) as l, min(t) as t, max(r) as r, max(b) as b, max(det) as det, count(*) as members from R group by 1,2"))
def g4(s, d):
    return S.merge_boxes(regions(s, d).withColumn("g", F.floor(F.col("region_seq") / 5).cast("int")), ["page_id", "g"])


def _along(lo: str, hi: str, left: str, right: str) -> str:
    """Both boxes are three times as long as wide along (lo, hi), nearly cover each other across it, and touch along it."""
    la, lb, wa, wb = f"(a.{hi}-a.{lo})", f"(b.{hi}-b.{lo})", f"(a.{right}-a.{left})", f"(b.{right}-b.{left})"
    across = f"greatest(0,least(a.{right},b.{right})-greatest(a.{left},b.{left}))::double/least({wa},{wb})>=0.9"
    return f"(least({la},{lb},{wa},{wb})>0 and {la}>=3*{wa} and {lb}>=3*{wb} and {across} and greatest(a.{lo},b.{lo})<=least(a.{hi},b.{hi}))"


_STRIPS = f"select a.page_id, a.region_seq as x, b.region_seq as y from TM a join TM b on a.page_id=b.page_id and a.match_seq=b.match_seq and a.region_seq<b.region_seq and ({_along('t', 'b', 'l', 'r')} or {_along('l', 'r', 't', 'b')})"
_TM = "TM as (select T.*, B.match_seq from T join B using (page_id, region_seq) where B.match_seq is not null)"


@query("G5_long_strips", _components_sql(_STRIPS, "strip", "TM", _T, _G, _RUNS, _MATCH, _BEST, _TM))
def g5(s, d):
    return S.long_strips(_texts(s, d), _matches(s, d))


_PAD = "A0 as (select page_id, region_seq, greatest(0,l-8) as l, greatest(0,t-8) as t, least(coalesce(width,1073741824),r+8) as r, least(coalesce(height,1073741824),b+8) as b from R left join (select distinct page_id, width, height from pages) p using (page_id))"


@query("G9_cluster_bboxes", with_regions("select page_id, count(*) as boxes from A0 group by 1", _PAD))
def g9(s, d):
    """Invariant that SQL can check: every box is in exactly one cluster of its page."""
    return S.padded_clusters(regions(s, d), pages(s, d), 8).groupBy("page_id").agg(F.sum("members").cast("long").alias("boxes"))


# every box grows to the hull of all that overlap it, until none does: then boxes are equal or apart
_GROW = """A as (select page_id, region_seq, l, t, r, b, 0 as k from A0
 union all
 select page_id, region_seq, l, t, r, b, k from
  (select a.page_id, a.region_seq, min(b.l) as l, min(b.t) as t, max(b.r) as r, max(b.b) as b, a.k+1 as k, min(b.l)<a.l or min(b.t)<a.t or max(b.r)>a.r or max(b.b)>a.b as grew
   from A a join A b on a.page_id=b.page_id and (a.region_seq=b.region_seq or (a.l<b.r and b.l<a.r and a.t<b.b and b.t<a.b)) group by a.page_id, a.region_seq, a.l, a.t, a.r, a.b, a.k) q
  qualify bool_or(grew) over (partition by page_id))"""


@query("G9_clusters", with_regions("select A.page_id, l, t, r, b, count(*)::int as members from A join (select page_id, max(k) as k from A group by 1) z on z.page_id=A.page_id and z.k=A.k group by 1,2,3,4,5", _PAD, _GROW, recursive=True))
def g9c(s, d):
    return S.padded_clusters(regions(s, d), pages(s, d), 8)


# in order of region_seq a box goes if a larger one that is still there covers 0.35 of it; J has the pairs merged on the way
_I0 = "(greatest(0,least(a.r,b.r)-greatest(a.l,b.l))::bigint*greatest(0,least(a.b,b.b)-greatest(a.t,b.t)))"
_COVER = f"V as (select a.page_id, a.region_seq as x, b.region_seq as y, greatest(1,(b.r-b.l)*(b.b-b.t))>greatest(1,(a.r-a.l)*(a.b-a.t)) as larger, {_I0}::double/greatest(1,(b.r-b.l)*(b.b-b.t))>=0.35 as mutual from R a join R b on a.page_id=b.page_id and a.region_seq<>b.region_seq and {_I0}>0 and {_I0}::double/greatest(1,(a.r-a.l)*(a.b-a.t))>=0.35)"
_GONE = """VX as (select page_id, x, row_number() over (partition by page_id order by x) as k from (select distinct page_id, x from V)),
D as (select page_id, 0::bigint as k, []::int[] as gone, []::struct(x int, y int)[] as pairs from (select distinct page_id from VX)
 union all
 select D.page_id, VX.k, case when q.stop is not null then list_append(D.gone, VX.x) else D.gone end, list_concat(D.pairs, q.got)
 from D join VX on VX.page_id=D.page_id and VX.k=D.k+1,
 lateral (select min(case when larger then y end) as stop, coalesce(list({'x': x, 'y': y}) filter (where mutual and not larger), []) as got from V where V.page_id=D.page_id and V.x=VX.x and not list_contains(D.gone, V.y)) q),
Z as (select page_id, gone, pairs from D qualify row_number() over (partition by page_id order by k desc)=1),
J as (select page_id, unnest(pairs) as p from Z)"""
_KEPT = """W as (select R.*, least(R.region_seq, coalesce(u.m, R.region_seq)) as grp from R left join (select page_id, x, min(y) as m from P group by 1,2) u on u.page_id=R.page_id and u.x=R.region_seq
 where not exists (select 1 from Z where Z.page_id=R.page_id and list_contains(Z.gone, R.region_seq))),
O as (select page_id, first(region_seq order by det desc, region_seq) as region_seq, min(l) as l, min(t) as t, max(r) as r, max(b) as b, row_number() over (partition by page_id order by min(region_seq)) as i from W group by page_id, grp),
Q as (select a.page_id, a.i as i, b.i as j, row_number() over (partition by a.page_id order by a.i, b.i) as k from O a join O b on a.page_id=b.page_id and a.i<b.i and a.l<b.r and b.l<a.r and a.t<b.b and b.t<a.b)"""


def _cut_sql() -> str:
    """One pair of boxes p, q cut apart at the middle of their overlap, across its shorter side."""
    mid = lambda lo, hi: f"((greatest(p.{lo},q.{lo})+least(p.{hi},q.{hi}))//2)"

    def cut(lo: str, hi: str) -> str:
        one = lambda x, first: f"{{'l': {x}.l, 't': {x}.t, 'r': {x}.r, 'b': {x}.b}}".replace(f"'{hi if first else lo}': {x}.{hi if first else lo}", f"'{hi if first else lo}': {'least' if first else 'greatest'}({x}.{hi if first else lo}, {mid(lo, hi)})")
        return f"case when p.{lo}+p.{hi}<=q.{lo}+q.{hi} then [{one('p', True)}, {one('q', False)}] else [{one('p', False)}, {one('q', True)}] end"

    wide, tall = "(least(p.r,q.r)-greatest(p.l,q.l))", "(least(p.b,q.b)-greatest(p.t,q.t))"
    return f"case when {wide}<=0 or {tall}<=0 then [p, q] when {tall}>={wide} then {cut('l', 'r')} else {cut('t', 'b')} end"


_APART = f"""Y as (select page_id, 0::bigint as k, list({{'l': l, 't': t, 'r': r, 'b': b}} order by i) as bx from O group by page_id
 union all
 select Y.page_id, Q.k, list_transform(Y.bx, lambda x, n: case when n=Q.i then c[1] when n=Q.j then c[2] else x end)
 from Y join Q on Q.page_id=Y.page_id and Q.k=Y.k+1, lateral (select {_cut_sql()} as c from (select Y.bx[Q.i] as p, Y.bx[Q.j] as q)) z),
YZ as (select page_id, bx from Y qualify row_number() over (partition by page_id order by k desc)=1)"""


@query("G10_resolve_overlaps", with_regions("select O.page_id, O.region_seq, bx[i].l as l, bx[i].t as t, bx[i].r as r, bx[i].b as b from O join YZ using (page_id)", _COVER, _GONE, "E as (select page_id, p.x as x, p.y as y from J)", *_REACH, _KEPT, _APART, recursive=True))
def g10(s, d):
    return S.resolve_overlaps(regions(s, d), 0.35)


@query("G10_no_overlap", with_regions("select page_id, count(*) as left_over, 0::bigint as overlapping from O group by 1", _COVER, _GONE, "E as (select page_id, p.x as x, p.y as y from J)", *_REACH, _KEPT, recursive=True))
def g10n(s, d):
    """Of each page, how many boxes are left and how many pairs of them overlap."""
    x = cut_lineage(S.resolve_overlaps(regions(s, d), 0.35))
    laps = S.overlap_pairs(x).groupBy("page_id").agg(F.count("*").alias("n"))
    return x.groupBy("page_id").agg(F.count("*").alias("left_over")).join(laps, "page_id", "left").select("page_id", "left_over", F.coalesce("n", F.lit(0)).cast("long").alias("overlapping"))


@query("G15_median_size", with_regions("select page_id, coalesce(quantile_cont(r-l,0.5) filter (where r-l>=6 and b-t>=6),30.0) as w, coalesce(quantile_cont(b-t,0.5) filter (where r-l>=6 and b-t>=6),30.0) as h from R group by 1"))
def g15(s, d):
    x = regions(s, d)
    ok = (F.col("r") - F.col("l") >= 6) & (F.col("b") - F.col("t") >= 6)
    med = lambda c: F.coalesce(F.percentile(F.when(ok, c), F.lit(0.5)), F.lit(30.0))
    return x.groupBy("page_id").agg(med(F.col("r") - F.col("l")).alias("w"), med(F.col("b") - F.col("t")).alias("h"))
