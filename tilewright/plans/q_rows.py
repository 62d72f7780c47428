"""Queries over projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import classes as cl
from tilewright.functions import once
from tilewright.functions import geometry as g
from tilewright.functions import names as nm
from tilewright.functions import text as tx
from tilewright.operators import labels as lb
from tilewright.operators import metrics, raster, tiling
from tilewright.operators.runs import training_status
from tilewright.plans import views as v
from tilewright.plans.jobs import unmapped_classes
from tilewright.plans.registry import query
from tilewright.session import stored

XYWH = ("x0", "y0", "w", "h")


def cols(*names):
    return [F.col(n) for n in names]


@query("f1_not_test", "select tile, slide, sample, fold from ftiles where fold <> 'test'")
def f1(spark, d):
    return lb.not_test(v.folded_tiles(spark, d))


@query("f2_min_file_size", "select doc_id, n_chars from documents where n_chars >= 1000")
def f2(spark, d):
    return lb.min_size(v.table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 1000)


@query("f3_drop_small_objects", "select tile, slide, obj, class, xc, yc, w, h from nboxes where w >= 0.15 and h >= 0.15")
def f3(spark, d):
    return lb.drop_small(v.shares(v.boxes(spark, d)))


@query("f3_drop_small_counts", """
    select count(*) as n_before, count(*) filter (w >= 0.15 and h >= 0.15) as n_after from nboxes""")
def f3_counts(spark, d):
    return lb.drop_small_counts(v.shares(v.boxes(spark, d)))


@query("f4_drop_class", "select tile, slide, sample, class, count(*) as n from objs where class <> 2 group by all")
def f4(spark, d):
    return lb.drop_class(v.labels(spark, d), 2).groupBy("tile", "slide", "sample", "class").agg(F.count("*").alias("n"))


@query("f5_drop_empty_labels", "select tile from objs group by tile having count(*) filter (class <> 0) = 0")
def f5(spark, d):
    before = v.labels(spark, d).select("tile", "class")
    return lb.emptied_tiles(before, lb.drop_class(before, 0))


@query("f6_drop_empty_annotations", """
    select doc_id, quality from labels where doc_id in (select doc_id from documents where contains(text, '{') or doc_id % 3 = 0)""")
def f6(spark, d):
    # Every third text gets an object, so that both kinds occur.
    docs = v.table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit('{"type":"Feature"}'))).otherwise(F.col("text")).alias("text")
    )
    return lb.with_annotations(v.table(spark, d, "labels").select("doc_id", "quality"), docs, "doc_id", "text")


@query("f7_aspect_filter", """
    select tile, obj, w::int as w, h from boxes where not (w < h * 0.6 or h < w * 0.6)""")
def f7(spark, d):
    return lb.squarish(v.boxes(spark, d).select("tile", "obj", "w", "h"))


def uneven_rects(spark, d):
    return v.rects(spark, d).withColumn("x1", F.col("x1") - F.col("slide") % 3 * 200)


@query("f8_region_at_least_tile", """
    select slide, sample_n, x0, y0, x1 - (slide % 3) * 200 as x1, y1 from rects where x1 - (slide % 3) * 200 - x0 >= 2048""")
def f8(spark, d):
    return lb.at_least_tile(uneven_rects(spark, d), v.TILE, v.TILE)


@query("f9_min_polygon_area", """
    with n as (select *, lead(x) over o as nx, lead(y) over o as ny, first_value(x) over p as fx, first_value(y) over p as fy
               from vertices window o as (partition by tile, obj order by ord), p as (partition by tile, obj order by ord))
    select tile, obj, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y))::double / 2 as area
    from n group by tile, obj having abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y))::double / 2 >= 20000""")
def f9(spark, d):
    return lb.min_area(v.objects(spark, d), 20000).select("tile", "obj", "area")


@query("f10_conf_filter", "select tile, pred, conf, 'detection_classes.pt' as weights from preds where conf >= 0.425")
def f10(spark, d):
    kept = lb.by_confidence(v.preds(spark, d), lb.model_registry(spark), "yolo", "detection", True)
    return kept.select("tile", "pred", "conf", "weights")


@query("f11_allowed_values", """
    select o_orderkey, 'o_orderpriority' as "column", o_orderpriority as value from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
    union all select o_orderkey, 'o_orderstatus', o_orderstatus from orders where o_orderstatus not in ('F', 'O')""")
def f11(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    allowed = {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "o_orderstatus": ["F", "O"]}
    return lb.not_allowed(o, allowed).select("o_orderkey", "column", "value")


@query("f11_ratio_and_map_checks", """
    select o_custkey as slide, count(*) % 2 <> 0 as bad_ratio, count(*) % 3 <> 0 as bad_map from orders group by o_custkey""")
def f11_checks(spark, d):
    s = v.slides(spark, d)
    ratio = F.array(F.lit(0.7), F.lit(0.2), F.when(F.col("n_tiles") % 2 == 0, 0.1).otherwise(0.3))
    ids = F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.when(F.col("n_tiles") % 3 == 0, 1).otherwise(2))
    return s.select("slide", lb.bad_ratio(ratio).alias("bad_ratio"), lb.not_zero_indexed(ids).alias("bad_map"))


@query("f12_max_objects_check", "select tile, count(*) as n from objs group by tile having count(*) > 7")
def f12(spark, d):
    return lb.crowded_tiles(v.labels(spark, d).select("tile"), 7)


@query("f13_class_set_check", """
    with e(status) as (values ('click'), ('view'), ('purchase'), ('false_positives')), seen as (select distinct exp, status from runs)
    select x.exp, e.status, 'missing' as problem from (select distinct exp from runs) x cross join e
    where not exists (select 1 from seen s where s.exp = x.exp and s.status = e.status)
    union all select exp, status, 'extra' from seen where status not in (select status from e)""")
def f13(spark, d):
    return lb.class_set_problems(v.runs(spark, d), "exp", "status", ["click", "view", "purchase", "false_positives"])


@query("p1_parse_name", """
    select tile as key, 'S' || slide || '_PAS' as slide, sample::int as sample, (tile % 7)::int as tile_i, (tile % 5)::int as tile_j,
           (case when tile % 2 = 0 then tile % 4 end)::int as crop, (case when tile % 3 = 0 then tile % 11 end)::int as copy, name as tile_name
    from names
    union all
    select o_orderkey + 1000000000000, 'H' || o_custkey || '_', null, null, null, null, null, 'H' || o_custkey || '_ROI_' || (o_orderkey % 4) from orders""")
def p1(spark, d):
    n = v.image_names(spark, d)
    s = lambda c: c.cast("string")
    crop = F.when(F.col("tile") % 2 == 0, F.concat(F.lit("_crop"), s(F.col("tile") % 4))).otherwise("")
    copy = F.when(F.col("tile") % 3 == 0, F.concat(F.lit("Augm_"), s(F.col("tile") % 11), F.lit("_"))).otherwise("")
    roi = F.concat(F.lit("H"), s(F.col("slide")), F.lit("_ROI_"), s(F.col("tile") % 4), F.lit(".png"))
    both = F.array(
        F.struct(F.col("tile").alias("key"), F.concat(copy, "name", crop, F.lit(".jpg")).alias("file")),
        F.struct((F.col("tile") + 1000000000000).alias("key"), roi.alias("file")),
    )
    rows = n.select(F.explode(both).alias("r")).select("r.key", nm.parse_name(F.col("r.file")).alias("n"))
    return rows.select("key", "n.slide", "n.sample", "n.tile_i", "n.tile_j", "n.crop", "n.copy", F.col("n.tile").alias("tile_name"))


@query("p2_rename_key", """
    select o_orderkey as key, 'S' || o_custkey || '_PAS.tif' as stained, 'S' || o_custkey || '.tif' as tidy,
           'S' || o_custkey || '.gson' as gson, 'S' || o_custkey || '_PAS.json' as named, 'S' || o_custkey || '.tif' as bare from orders""")
def p2(spark, d):
    slide = F.concat(F.lit("S"), F.col("slide").cast("string"))
    return v.tiles(spark, d).select(
        F.col("tile").alias("key"),
        nm.stain_name(F.concat(slide, F.lit("_PAS_old scan.tif")), "pas").alias("stained"),
        nm.tidy_extension(F.concat(slide, F.lit(".tiff"))).alias("tidy"),
        nm.tidy_extension(F.concat(slide, F.lit(".mrxs.gson"))).alias("gson"),
        nm.add_stain(F.concat(slide, F.lit(".json")), "pas").alias("named"),
        nm.drop_stain_prefix(F.concat(F.lit("PAS_"), slide, F.lit(".tif"))).alias("bare"),
    )


def counted(df):
    return df.groupBy("tile", "class").agg(F.count("*").alias("n"))


@query("p3_replace_class", "select tile, case class when 2 then 5 else class end as class, count(*) as n from objs group by 1, 2")
def p3(spark, d):
    return counted(lb.replace_class(v.labels(spark, d), 2, 5))


@query("p3_replace_problems", """
    select problem from (select case when count(*) filter (class = 7) = 0 then 'old class missing' end as problem from objs
    union all select case when count(*) filter (class = 1) > 0 then 'new class present' end from objs) where problem is not null""")
def p3_problems(spark, d):
    return lb.replace_problems(v.labels(spark, d), 7, 1)


@query("p4_merge_classes", "select tile, case class when 2 then 1 else class end as class, count(*) as n from objs group by 1, 2")
def p4(spark, d):
    return counted(lb.merge_classes(v.labels(spark, d), 2, 1))


@query("p5_switch_binary_class", "select tile, case class when 1 then 0 else 1 end as class, count(*) as n from objs group by 1, 2")
def p5(spark, d):
    return counted(lb.switch_binary(v.labels(spark, d)))


@query("p6_map_class", """
    select tile, obj, case class when 0 then 'Glomerulus' when 1 then 'Cellular Crescent' else 'false_positives' end as class_name,
           (case class when 2 then 3 else class end)::int as class_id, case class when 2 then 'false_positives' else 'item' end as item from boxes""")
def p6(spark, d):
    ids = cl.with_false_positives(v.SCORE_IDS)
    known = F.when(F.col("class") == 2, ids[cl.FALSE_POSITIVES]).otherwise(F.col("class"))
    named = v.boxes(spark, d).select("tile", "obj", cl.class_name(known, ids).alias("class_name"))
    return named.withColumns({"class_id": cl.class_id(F.col("class_name"), ids), "item": cl.single_class(F.col("class_name"))})


@query("p7_reassign_class_randomly", """
    select tile, obj, (case when class <> 1 then class when ascii(substr(md5(concat_ws(':', tile, obj, 10)), 1, 1)) % 2 = 0 then 0 else 2 end)::int as class
    from boxes""")
def p7(spark, d):
    return lb.assign_randomly(v.boxes(spark, d).select("tile", "obj", "class"), ["tile", "obj"])


@query("p8_bbox_of_polygon", """
    select tile, obj, class, class as class_fine, (min(x) + max(x)) / 2.0 as xc, (min(y) + max(y)) / 2.0 as yc,
           max(x) - min(x) as w, max(y) - min(y) as h from vertices group by tile, obj, class""")
def p8(spark, d):
    rows = once(v.objects(spark, d).withColumn("class_fine", F.col("class")), "b", g.polygon_box(F.col("vertices")))
    return rows.select("tile", "obj", "class", "class_fine", "b.xc", "b.yc", "b.w", "b.h")


@query("p9_box_from_row", "select tile, obj, n::int as form, xc, yc, w, h from nboxes cross join (values (4), (8)) t(n)")
def p9(spark, d):
    x0, y0 = F.col("xc") - F.col("w") / 2, F.col("yc") - F.col("h") / 2
    x1, y1 = F.col("xc") + F.col("w") / 2, F.col("yc") + F.col("h") / 2
    forms = F.array(F.array(*cols("xc", "yc", "w", "h")), F.array(x0, y0, x1, y0, x1, y1, x0, y1))
    rows = v.shares(v.boxes(spark, d)).select("tile", "obj", F.explode(forms).alias("n"))
    return rows.select("tile", "obj", F.size("n").alias("form"), g.box_from_numbers(F.col("n")).alias("b")).select("tile", "obj", "form", "b.*")


@query("p10_normalise_box", """
    select tile, pred, (x0 + w / 2.0) / 2048 as xc, (y0 + h / 2.0) / 2048 as yc, w / 2048.0 as w, h / 2048.0 as h,
           greatest(x0, 0) as px0, greatest(y0, 0) as py0, least(x0 + w, 2048) as px1, least(y0 + h, 2048) as py1 from preds""")
def p10(spark, d):
    box = g.normalise_box(*cols(*XYWH), v.TILE, v.TILE)
    rows = v.preds(spark, d).select("tile", "pred", box.alias("b")).select("tile", "pred", "b.*")
    back = g.pixel_box(*cols("xc", "yc", "w", "h"), v.TILE, v.TILE)
    return rows.withColumn("p", back).select("tile", "pred", "xc", "yc", "w", "h", *[F.col(f"p.{c}").alias("p" + c) for c in ("x0", "y0", "x1", "y1")])


@query("p11_clip_translate_to_sample", """
    select v.tile, v.obj, '[' || string_agg('{' || (least(greatest(x, x0), x1) - x0) || ', ' || (least(greatest(y, y0), y1) - y0) || '}', ', ' order by ord) || ']' as ring
    from vertices v join rects r on r.slide = v.slide and r.sample_n = v.slide % 3 group by v.tile, v.obj""")
def p11(spark, d):
    own = v.rects(spark, d).filter("sample_n = slide % 3")
    rows = v.objects(spark, d).join(own, "slide")
    moved = g.clip_shift(F.col("vertices"), *cols("x0", "y0", "x1", "y1"))
    return rows.select("tile", "obj", g.vertex_text(moved).alias("ring"))


@query("p12_rescale_to_level", """
    select tile, obj, '[' || string_agg('{' || trunc(x / 6144.0::double * 1000)::bigint || ', ' || trunc(y / 4096.0::double * 700)::bigint || '}', ', ' order by ord) || ']' as ring
    from vertices group by tile, obj""")
def p12(spark, d):
    moved = g.rescale(F.col("vertices"), F.lit(v.SLIDE_W), F.lit(v.SLIDE_H), F.lit(1000), F.lit(700))
    return v.objects(spark, d).select("tile", "obj", g.vertex_text(moved).alias("ring"))


@query("p13_letterbox_geometry", """
    with s as (select tile, obj, 224.0::double / greatest(w, h) as ratio, w as ow, h as oh from boxes),
         n as (select tile, obj, ratio, trunc(ow * ratio)::bigint as w, trunc(oh * ratio)::bigint as h from s)
    select tile, obj, ratio, w, h, (224 - w) // 2 as "left", 224 - w - (224 - w) // 2 as "right", (224 - h) // 2 as top,
           224 - h - (224 - h) // 2 as bottom from n""")
def p13(spark, d):
    return v.boxes(spark, d).select("tile", "obj", g.letterbox(F.col("w"), F.col("h"), 224, 224).alias("b")).select("tile", "obj", "b.*")


@query("p14_centre_crop_geometry", """
    with p as (select tile, pred, (x0 + w / 2.0::double) / 2048 as xc, (y0 + h / 2.0::double) / 2048 as yc, w / 2048.0::double as w, h / 2048.0::double as h from preds),
         s as (select greatest(quantile_cont(w, 0.9), quantile_cont(h, 0.9)) as size from p),
         b as (select tile, pred, size, trunc((xc - w / 2) * 2048)::bigint as src_x0, trunc((yc - h / 2) * 2048)::bigint as src_y0,
                      trunc((xc + w / 2) * 2048)::bigint as src_x1, trunc((yc + h / 2) * 2048)::bigint as src_y1 from p cross join s),
         e as (select *, trunc(size / 2 * 2048 - (src_x1 - src_x0) / 2.0::double)::bigint as dst_x0, trunc(size / 2 * 2048 - (src_y1 - src_y0) / 2.0::double)::bigint as dst_y0 from b)
    select tile, pred, src_x0, src_y0, src_x1, src_y1, dst_x0, dst_y0, dst_x0 + src_x1 - src_x0 as dst_x1, dst_y0 + src_y1 - src_y0 as dst_y1,
           src_x1 - src_x0 > trunc(size * 2048) or src_y1 - src_y0 > trunc(size * 2048) as too_big from e""")
def p14(spark, d):
    p = v.shares(v.preds(spark, d).drop("slide"))
    size = metrics.crop_size(p).select("size").scalar()
    crop = g.centred_crop(*cols("xc", "yc", "w", "h"), size, v.TILE, v.TILE)
    return p.select("tile", "pred", crop.alias("c")).select("tile", "pred", "c.*")


def slide_boxes(spark, d):
    b = v.boxes(spark, d)
    return b.select("slide", "tile", "obj", "class", F.col("sx0").alias("x0"), F.col("sy0").alias("y0"), "w", "h")


@query("p15_tile_to_slide_coords", """
    select slide, tile, obj, sx0::double as x0, sy0::double as y0, (sx0 + w)::double as x1, (sy0 + h)::double as y1 from boxes""")
def p15(spark, d):
    cut = tiling.tile_boxes(slide_boxes(spark, d), v.TILE, 1024, F.lit(v.SLIDE_W), F.lit(v.SLIDE_H))
    return tiling.untile_boxes(cut, v.TILE, 1024, ["slide", "tile", "obj"])


@query("p16_duration_text", """
    with s as (select event_id, trunc(value * 100)::bigint as s from events)
    select event_id, (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' as duration, s as seconds,
           case when s < 60 then '<1min' else 'completed' end as status from s""")
def p16(spark, d):
    e = v.table(spark, d, "events").select("event_id", tx.duration_text(F.col("value") * 100).alias("duration"))
    back = tx.duration_seconds(F.col("duration"))
    return e.withColumn("seconds", back).withColumn("status", training_status(F.col("seconds")))


@query("p17_parse_timestamp", """
    select event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') as "text", epoch(date_trunc('second', ts))::bigint as seconds from events""")
def p17(spark, d):
    e = v.table(spark, d, "events").select("event_id", tx.log_time_text(F.col("ts").cast("timestamp")).alias("text"))
    return e.withColumn("seconds", F.unix_seconds(tx.log_time(F.col("text"))))


@query("p18_rgb_to_class", """
    select tile, obj, class, (class = 0)::int as is_0, (class = 1)::int as is_1, (class = 2)::int as is_2 from boxes""")
def p18(spark, d):
    part = lambda k: F.when(F.col("class") == k, 255).otherwise(0)
    coloured = v.boxes(spark, d).select("tile", "obj", part(1).alias("r"), part(0).alias("g"), part(2).alias("b"))
    known = coloured.select("tile", "obj", cl.colour_class(*cols("r", "g", "b")).alias("class"))
    marks = known.withColumn("hot", cl.one_hot(F.col("class"), 3))
    return marks.select("tile", "obj", "class", *[F.get("hot", k).alias(f"is_{k}") for k in range(3)])


@query("p18_class_at_mean", """
    with p as (select tile, pred, trunc(x0 + w / 2.0)::bigint as px, trunc(y0 + h / 2.0)::bigint as py from preds),
         m as (select p.tile, p.pred, arg_max(b.class, b.obj) as class from p join boxes b on b.tile = p.tile
               and px // 64 between b.x0 // 64 and (b.x0 + b.w) // 64 and py // 64 between b.y0 // 64 and (b.y0 + b.h) // 64 group by all)
    select p.tile, p.pred, m.class::int as class, m.class is null as background from p left join m on m.tile = p.tile and m.pred = p.pred""")
def p18_at_mean(spark, d):
    """Predictions as outlines on a mask of painted boxes: the class is that of the colour at the vertices' mean.

    Boxes and mask are written, which takes less than the shuffles that make them.
    """
    own = stored(v.boxes(spark, d).select("tile", "slide", "obj", "class", "x0", "y0", "w", "h"), "boxes")
    cells = tiling.rasterise(own.select("tile", "obj", "class", "x0", "y0", "w", "h"), 64, v.TILE)
    part = lambda k: F.when(F.col("class_mark") == k + 1, 255).otherwise(0)
    mask = stored(raster.run_rows(cells.select("tile", "cell_x", "cell_y", part(1).alias("r"), part(0).alias("g"), part(2).alias("b")), ["r", "g", "b"]), "mask")
    x1, y1 = F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    outline = F.array(corner(F.col("x0"), F.col("y0")), corner(x1, F.col("y0")), corner(x1, y1), corner(F.col("x0"), y1))
    marked = raster.marks_at_mean(v.preds_of(own).select("tile", "pred", outline.alias("vertices")), mask, ["r", "g", "b"], cell=64)
    known = marked.select("tile", "pred", cl.colour_class(*cols("r", "g", "b")).alias("class"))
    return known.withColumn("background", F.col("class").isNull())


@query("p19_argmax_class", """
    select vec_id as instance, (list_position(embedding[1:4], list_max(embedding[1:4])) - 1)::int as predicted from embeddings""")
def p19(spark, d):
    return v.instances(spark, d).select("instance", cl.best_class(F.slice("embedding", 1, 4)).alias("predicted"))


@query("p6_unmapped_classes", f"""
    select case class when 0 then 'Glomerulus' when 1 then 'Cellular Crescent' else 'unheard of' end as class_name, count(*) as n
    from objs where class > 0 group by 1""")
def p6_unmapped(spark, d):
    name = F.when(F.col("class") == 0, "Glomerulus").when(F.col("class") == 1, "Cellular Crescent").otherwise("unheard of")
    return unmapped_classes(v.labels(spark, d).withColumn("class_name", name), {"Glomerulus": 0})


@query("f11_configuration_values", """
    select o_orderkey, 'task' as "column", case o_orderstatus when 'F' then 'detection' when 'O' then 'sorting' end as value from orders where o_orderstatus <> 'F'""")
def f11_configuration(spark, d):
    """A value that is missing is reported too."""
    task = F.when(F.col("o_orderstatus") == "F", "detection").when(F.col("o_orderstatus") == "O", "sorting")
    o = v.table(spark, d, "orders").select("o_orderkey", task.alias("task"), F.lit("tcd").alias("datasource"))
    return lb.not_allowed(o, {k: lb.ALLOWED[k] for k in ("task", "datasource")}).select("o_orderkey", "column", "value")
