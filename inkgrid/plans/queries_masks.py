"""Queries over masks as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrid.operators import masks as M
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


def runs(s, d, kind: str):
    return table(s, d, "mask_runs").where(F.col("kind") == kind).select("page_id", "region_seq", "y", "x0", "x1").distinct()


def _r(kind: str, name: str) -> str:
    """Disjoint runs of a kind."""
    return f"""{name}0 as (select distinct page_id, region_seq, y, x0, x1 from mask_runs where kind='{kind}' and x1>x0),
{name}1 as (select *, case when x0 > max(x1) over (partition by page_id, region_seq, y order by x0, x1 rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from {name}0),
{name}2 as (select *, sum(n) over (partition by page_id, region_seq, y order by x0, x1 rows unbounded preceding) as g from {name}1),
{name} as (select page_id, region_seq, y, min(x0) as x0, max(x1) as x1 from {name}2 group by page_id, region_seq, y, g)"""


def all_runs(s, d):
    """Masks of all kinds, numbered 4 * region_seq + kind, so that those of one region meet."""
    kind = F.when(F.col("kind") == "layout", 0).when(F.col("kind") == "ocr", 1).otherwise(2)
    return table(s, d, "mask_runs").select("page_id", (4 * F.col("region_seq") + kind).cast("int").alias("region_seq"), "y", "x0", "x1").distinct()


_ALL = _r("layout", "M").replace("select distinct page_id, region_seq, y, x0, x1 from mask_runs where kind='layout' and", "select distinct page_id, 4*region_seq+case kind when 'layout' then 0 when 'ocr' then 1 else 2 end as region_seq, y, x0, x1 from mask_runs where")

_CLIP = "K as (select m.page_id, m.region_seq, y-t as y, greatest(x0,l)-l as x0, least(x1,r)-l as x1, l, t, r, b from M m join R using (page_id, region_seq) where y>=t and y<b and least(x1,r)>greatest(x0,l))"


@query("D5_mask_area", with_regions("select page_id, region_seq, sum(x1-x0)::bigint as area, min(x0) as l, min(y) as t, max(x1) as r, max(y)+1 as b from M group by 1,2", _r("layout", "M")))
def d5(s, d):
    return M.area(runs(s, d, "layout"))


@query("I1_slice_to_roi", with_regions("select page_id, region_seq, y, x0, x1 from K", _r("layout", "M"), _CLIP))
def i1(s, d):
    return M.clip(runs(s, d, "layout"), regions(s, d))


@query("I2_mask_and", with_regions("select a.page_id, a.region_seq, a.y, greatest(a.x0,m.x0) as x0, least(a.x1,m.x1) as x1 from A a join M m on a.page_id=m.page_id and a.region_seq=m.region_seq and a.y=m.y and a.x0<m.x1 and m.x0<a.x1", _r("layout", "M"), _r("inpaint", "A")))
def i2(s, d):
    return M.intersect(runs(s, d, "inpaint"), runs(s, d, "layout"))


@query("I2_mask_or", "with " + _r("layout' or kind='ocr' or kind='inpaint", "U").replace("where kind=", "where (kind=").replace("inpaint' and", "inpaint') and") + " select page_id, region_seq, y, x0, x1 from U")
def i2o(s, d):
    return M.unite(M.unite(runs(s, d, "layout"), runs(s, d, "ocr")), runs(s, d, "inpaint"))


_MIOU = "I as (select a.page_id, a.region_seq as a_seq, b.region_seq as b_seq, sum(least(a.x1,b.x1)-greatest(a.x0,b.x0)) as i from M a join M b on a.page_id=b.page_id and a.y=b.y and a.region_seq<b.region_seq and a.x0<b.x1 and b.x0<a.x1 group by 1,2,3), N as (select page_id, region_seq, sum(x1-x0) as n from M group by 1,2), V as (select I.page_id, a_seq, b_seq, i::double/(x.n+y.n-i) as iou from I join N x on x.page_id=I.page_id and x.region_seq=a_seq join N y on y.page_id=I.page_id and y.region_seq=b_seq)"


@query("J4_mask_iou", with_regions("select page_id, a_seq, b_seq, round(iou,6) as iou from V", _ALL, _MIOU))
def j4(s, d):
    return M.mask_iou(all_runs(s, d)).select("page_id", "a_seq", "b_seq", F.round("iou", 6).alias("iou"))


@query(
    "G2_merge_masks",
    "with recursive " + _ALL + ", " + _MIOU + ", E as (select page_id,a_seq as x,b_seq as y from V where iou>=0.2 union all select page_id,b_seq,a_seq from V where iou>=0.2), P as (select page_id,x,y from E union select P.page_id,P.x,E.y from P join E on E.page_id=P.page_id and E.x=P.y) select N.page_id, N.region_seq, least(N.region_seq, coalesce(min(P.y),N.region_seq)) as merged from N left join P on P.page_id=N.page_id and P.x=N.region_seq group by 1,2",
)
def g2(s, d):
    return M.merged_masks(all_runs(s, d), 0.2)


@query(
    "G3_merged_mask_area",
    "with recursive " + _ALL + ", " + _MIOU + ", E as (select page_id,a_seq as x,b_seq as y from V where iou>=0.2 union all select page_id,b_seq,a_seq from V where iou>=0.2), P as (select page_id,x,y from E union select P.page_id,P.x,E.y from P join E on E.page_id=P.page_id and E.x=P.y), L as (select N.page_id, N.region_seq, least(N.region_seq, coalesce(min(P.y),N.region_seq)) as merged from N left join P on P.page_id=N.page_id and P.x=N.region_seq group by 1,2), X as (select distinct page_id, merged, y, unnest(range(x0,x1)) as x from M join L using (page_id, region_seq)) select page_id, merged as region_seq, count(*) as area from X group by 1,2",
)
def g3(s, d):
    m = all_runs(s, d)
    j = m.join(M.merged_masks(m, 0.2), ["page_id", "region_seq"]).drop("region_seq").withColumnRenamed("merged", "region_seq")
    return M.area(j).select("page_id", "region_seq", "area")


_E = "least(6,greatest(1,(least(r-l,b-t)//24)))"
_F8 = f"W as (select page_id, region_seq, l,t,r,b, sum(x1-x0) as n, count(distinct y) as lines, sum(case when y<{_E} then x1-x0 else 0 end) as et, sum(case when y>=b-t-{_E} then x1-x0 else 0 end) as eb, sum(greatest(0,least(x1,{_E})-x0)) as el, sum(greatest(0,x1-greatest(x0,r-l-{_E}))) as er, max(x1)-min(x0) as bw, max(y)+1-min(y) as bh from K group by 1,2,3,4,5,6)"


@query("F8_enclosed_mask", with_regions(f"select page_id, region_seq, n<=0.92*lines*(r-l) and (et>0.35*{_E}*(r-l))::int+(eb>0.35*{_E}*(r-l))::int+(el>0.35*{_E}*lines)::int+(er>0.35*{_E}*lines)::int<3 and not (bw>=0.96*(r-l) and bh>=0.96*(b-t)) as enclosed from W", _r("layout", "M"), _CLIP, _F8))
def f8(s, d):
    return M.enclosed(runs(s, d, "layout"), regions(s, d))


def _anchored(s, d):
    return regions(s, d, "layout_bbox").select("page_id", "region_seq", "l", "t", "r", "b", *[F.col(f"layout_bbox.{c}").alias(f"l{c}") for c in "ltrb"])


@query("I7_ink_anchor", with_regions("select R.page_id, R.region_seq, coalesce(al,l) as l, coalesce(at_,t) as t, coalesce(ar,r) as r, coalesce(ab,b) as b from R left join (select page_id, region_seq, min(greatest(x0,layout_bbox.l+5)) as al, min(y) as at_, max(least(x1,layout_bbox.r-5)) as ar, max(y)+1 as ab from M join R using (page_id, region_seq) where layout_bbox is not null and y>=layout_bbox.t+5 and y<layout_bbox.b-5 and least(x1,layout_bbox.r-5)>greatest(x0,layout_bbox.l+5) group by 1,2) A using (page_id, region_seq)", _r("ocr", "M")))
def i7(s, d):
    return M.ink_anchor(runs(s, d, "ocr"), _anchored(s, d))


_L7 = "S as (select distinct page_id, region_seq, unnest(range((x0+9)//10, x1//10)) as c, y from K), S2 as (select *, case when y-lag(y) over (partition by page_id, region_seq, c order by y)>5 then 1 else 0 end as n from S), S3 as (select *, sum(n) over (partition by page_id, region_seq, c order by y rows unbounded preceding) as g from S2)"


@query("L7_column_ranges", with_regions("select page_id, region_seq, c*10 as x, min(y) as y0, max(y)+5 as y1 from S3 group by page_id, region_seq, c, g having max(y)+5-min(y)>=10", _r("layout", "M"), _CLIP, _L7))
def l7(s, d):
    return M.column_ranges(runs(s, d, "layout"), regions(s, d), 10, 5)


_L10 = "C as (select page_id, region_seq, 0 as center, l+(r-l)//4 as cx, (t+b)//2 as cy from R union all select page_id, region_seq, 1, l+3*(r-l)//4, t+(b-t)//4 from R), X as (select page_id, region_seq, y, unnest(range(x0,x1)) as x from M), W as (select X.page_id, X.region_seq, X.y, X.x, first(center order by (x-cx)*(x-cx)+(y-cy)*(y-cy), center) as center from X join C using (page_id, region_seq) group by 1,2,3,4)"


@query("L10_partition_by_centers", with_regions("select page_id, region_seq, center, count(*) as area, min(x)::int as l, min(y) as t, max(x)::int+1 as r, max(y)+1 as b from W group by 1,2,3", _r("layout", "M"), _L10))
def l10(s, d):
    x = regions(s, d)
    half = lambda e: F.floor(e).cast("int")
    a = x.select("page_id", "region_seq", F.lit(0).alias("center"), (F.col("l") + half((F.col("r") - F.col("l")) / 4)).alias("cx"), half((F.col("t") + F.col("b")) / 2).alias("cy"))
    b = x.select("page_id", "region_seq", F.lit(1).alias("center"), (F.col("l") + half(3 * (F.col("r") - F.col("l")) / 4)).alias("cx"), (F.col("t") + half((F.col("b") - F.col("t")) / 4)).alias("cy"))
    return M.nearest_center(runs(s, d, "layout"), a.unionByName(b))


_G16 = "T as (select *, row_number() over (partition by page_id, region_seq order by y, x0) as i from M), E as (select a.page_id, a.region_seq, a.i as x, b.i as y from T a join T b on a.page_id=b.page_id and a.region_seq=b.region_seq and b.y in (a.y-5,a.y+5) and a.x0<=b.x1 and b.x0<=a.x1), P as (select page_id,region_seq,x,y from E union select P.page_id,P.region_seq,P.x,E.y from P join E on E.page_id=P.page_id and E.region_seq=P.region_seq and E.x=P.y), L as (select T.*, least(i, coalesce((select min(P.y) from P where P.page_id=T.page_id and P.region_seq=T.region_seq and P.x=T.i), i)) as c from T)"


@query("G16_connected_components", with_regions("select page_id, region_seq, min(x0) as l, min(y) as t, max(x1) as r, max(y)+1 as b, sum(x1-x0)::int as area from L group by page_id, region_seq, c", _r("layout", "M"), _G16, recursive=True))
def g16(s, d):
    return M.label_runs(runs(s, d, "layout"), 5).drop("component")


@query("K5_viewer_offsets", "select page_id, sub_dir, page_seq, coalesce(sum(h+10) over (partition by sub_dir order by page_seq rows between unbounded preceding and 1 preceding),0)::bigint as y, h from (select page_id, sub_dir, page_seq, greatest(1,round_even(height*least(1.0::double,800.0::double/width),0))::int as h from pages where width is not null and height is not null)")
def k5(s, d):
    from inkgrid.sources.sinks import viewer_offsets

    return viewer_offsets(table(s, d, "pages"), 800).select("page_id", "sub_dir", "page_seq", "y", "h")


@query("K4_side_by_side", "select page_id, greatest(1,round_even(width*greatest(height,1200)::double/height,0))::int as w1, greatest(1,round_even(900*greatest(height,1200)::double/1200,0))::int as w2, greatest(height,1200) as height from pages where width is not null")
def k4(s, d):
    from inkgrid.functions.geometry import side_by_side

    x = table(s, d, "pages").where("width is not null")
    return x.select("page_id", side_by_side(F.col("width"), F.col("height"), F.lit(900), F.lit(1200)).alias("z")).select("page_id", "z.w1", "z.w2", "z.height")


@query("K2_output_path", "select page_id, 'out/' || sub_dir || '/' || case when member is not null then replace(member,'/','_') || '__' else '' end || stem || '_translated.jpg' as path from pages")
def k2(s, d):
    from inkgrid.sources.sinks import output_path

    return table(s, d, "pages").select("page_id", output_path("out", F.col("sub_dir"), F.col("member"), F.col("stem"), "jpg").alias("path"))


@query("K6_failures", "select coalesce(error.stage,'ok') as stage, count(*) as pages from pages group by 1")
def k6(s, d):
    from inkgrid.sources.sinks import failure_counts

    return failure_counts(table(s, d, "pages"))


@query("S3_suffix", "select page_id, lower(regexp_extract(name,'[^/]+(\\.[^./]+)$',1)) as suffix, lower(regexp_extract(name,'[^/]+(\\.[^./]+)$',1)) in ('.png','.jpg','.jpeg','.webp') as image from pages")
def s3(s, d):
    from inkgrid.sources.files import is_image, suffix

    return table(s, d, "pages").select("page_id", suffix(F.col("name")).alias("suffix"), is_image(F.col("name")).alias("image"))


@query("S2_zip_members", "select page_id, member, row_number() over (partition by sub_dir order by lower(member), page_seq) as n from pages where member is not null and not ends_with(member,'/') and not starts_with(regexp_extract(member,'([^/]*)$',1),'.') and not starts_with(member,'__MACOSX') and lower(regexp_extract(member,'[^/]+(\\.[^./]+)$',1)) in ('.png','.jpg','.jpeg','.webp')")
def s2(s, d):
    from inkgrid.sources.files import is_member, number_members

    x = table(s, d, "pages").where(F.col("member").isNotNull() & is_member(F.col("member")))
    return number_members(x.select("page_id", "sub_dir", "member", F.col("page_seq").alias("seq"))).select("page_id", "member", "n")


@query("J5_join_branches", with_regions("select a.page_id, a.n as translated, b.n as inpainted from (select page_id, count(*) as n from R where translated_text is not null group by 1) a join (select page_id, count(*) as n from R where inpaint_bbox is not null group by 1) b using (page_id)"))
def j5(s, d):
    from inkgrid.plans.pipeline import join_branches

    x = regions(s, d, "translated_text", "inpaint_bbox")
    a = x.where("translated_text is not null").groupBy("page_id").agg(F.count("*").alias("translated"))
    b = x.where("inpaint_bbox is not null").groupBy("page_id").agg(F.count("*").alias("inpainted"))
    return join_branches(a, b)


@query("J8_zip_strict", with_regions("select page_id, region_seq, i::int as i, ch, round(c,6) as conf from (select page_id, region_seq, generate_subscripts(character_confidences,1) as i, unnest(string_split(source_text,'')) as ch, unnest(character_confidences) as c from R where character_confidences is not null and len(character_confidences)=length(source_text) and source_text<>'')"))
def j8(s, d):
    from inkgrid.plans.pipeline import zip_strict

    x = regions(s, d, "source_text", "character_confidences").where("character_confidences is not null and source_text <> '' and size(character_confidences) = length(source_text)")
    z = zip_strict(x, F.split("source_text", ""), F.col("character_confidences"))
    return z.select("page_id", "region_seq", (F.col("i") + 1).alias("i"), F.col("a").alias("ch"), F.round("b", 6).alias("conf"))


@query("G17_axis_islands", with_regions("select page_id, region_seq, (mb+nt)//2 as point from (select page_id, region_seq, max(y+1) over (partition by page_id, region_seq order by y, x0 rows unbounded preceding) as mb, lead(y) over (partition by page_id, region_seq order by y, x0) as nt from M) where nt-mb>=4", _r("layout", "M")))
def g17(s, d):
    """Where each mask may be split from top to bottom: between scan lines that lie apart."""
    from inkgrid.operators.spatial import axis_splits

    m = M.joined(runs(s, d, "layout")).withColumn("y1", F.col("y") + 1).withColumn("n", F.lit(2**30))
    return axis_splits(m, ["page_id", "region_seq"], "y", "y1", "n", 4, 0)


_BOXES = " union all ".join(f"select page_id, region_seq, '{k}' as kind, '{c}' as color, {b}.l as l, {b}.t as t, {b}.r as r, {b}.b as b from R0 where {b} is not null" for b, k, c in (("bbox", "text", "blue"), ("layout_bbox", "layout", "green"), ("inpaint_bbox", "inpaint", "red")))


@query("K3_overlay_boxes", f"with R0 as (select distinct page_id, region_seq, bbox, layout_bbox, inpaint_bbox from regions) {_BOXES}")
def k3(s, d):
    from inkgrid.sources.sinks import overlay

    return overlay(table(s, d, "regions").select("page_id", "region_seq", "bbox", "layout_bbox", "inpaint_bbox").dropDuplicates(["page_id", "region_seq"]))


@query("S4_lazy_content", "select page_id, octet_length(content)::bigint as bytes from pages where content is not null")
def s4(s, d):
    """Only a plan that uses the content reads it; this one does."""
    return table(s, d, "pages").where("content is not null").select("page_id", F.length("content").cast("long").alias("bytes"))
