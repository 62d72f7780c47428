"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.functions import names as nm
from tilewright.operators import bags, folds, matching, merging, pairing, runs, tiling
from tilewright.plans import views as v
from tilewright.plans.registry import query
from tilewright.session import fresh_dir
from tilewright.sources import layout


@query("j1_full_tiles", "select tile, slide, sample, fold from statuses where not is_empty")
def j1_full(spark, d):
    return pairing.full_tiles(v.folded_tiles(spark, d), v.labels(spark, d), ["tile"])


@query("j1_empty_tiles", "select tile, slide, sample, fold from statuses where is_empty")
def j1_empty(spark, d):
    return pairing.empty_tiles(v.folded_tiles(spark, d), v.labels(spark, d), ["tile"])


@query("j2_unpaired_labels", "select tile, slide, obj, class from boxes where tile % 7 = 0")
def j2(spark, d):
    thinned = v.tiles(spark, d).filter("tile % 7 <> 0")
    return pairing.unpaired_labels(v.boxes(spark, d).select("tile", "slide", "obj", "class"), thinned, ["tile"])


@query("j2_paired_labels", "select tile, slide, obj, class from boxes where tile % 7 <> 0")
def j2_paired(spark, d):
    thinned = v.tiles(spark, d).filter("tile % 7 <> 0")
    return pairing.paired_labels(v.boxes(spark, d).select("tile", "slide", "obj", "class"), thinned, ["tile"])


def stored(spark, df, key):
    """`df` in buckets by `key`; two tables get the same layout whatever their sizes."""
    return layout.write_bucketed(df, fresh_dir(spark, "stored"), [key], max(8, layout.buckets_for(df.count())))


@query("j1_stored_tables", "select tile, slide, sample, fold, is_empty from statuses")
def j1_stored(spark, d):
    """J1 on stored tables: one pass over the buckets, no shuffle."""
    tiles, labels = stored(spark, v.folded_tiles(spark, d), "tile"), stored(spark, v.labels(spark, d), "tile")
    return pairing.flag_empty(tiles, labels, ["tile"])


@query("j2_stored_tables", "select tile, slide, obj, class, tile % 7 <> 0 as paired from boxes")
def j2_stored(spark, d):
    labels = stored(spark, v.boxes(spark, d).select("tile", "slide", "obj", "class"), "tile")
    thinned = stored(spark, v.tiles(spark, d).filter("tile % 7 <> 0"), "tile")
    paired = pairing.paired_labels(labels, thinned, ["tile"]).withColumn("paired", F.lit(True))
    return paired.unionByName(pairing.unpaired_labels(labels, thinned, ["tile"]).withColumn("paired", F.lit(False)))


@query("j9_stored_tables", "select tile, slide, sample, fold from ftiles")
def j9_stored(spark, d):
    slides = stored(spark, v.slides(spark, d).select("slide", v.fold_of(F.col("slide")).alias("fold")), "slide")
    return pairing.inherit_fold(stored(spark, v.tiles(spark, d), "slide"), slides).select("tile", "slide", "sample", "fold")


@query("j3_assign_objects_to_samples", """
    with c as (select tile, slide, obj, class, avg(x) as cx, avg(y) as cy from vertices group by tile, slide, obj, class)
    select c.tile, c.slide, c.obj, r.sample_n, case c.class when 0 then 'Glomerulus' else 'Glo-NA' end as class_name,
           '[' || string_agg('{' || (least(greatest(x, x0), x1) - x0) || ', ' || (least(greatest(y, y0), y1) - y0) || '}', ', ' order by ord) || ']' as ring
    from c join rects r on r.slide = c.slide and cx between x0 and x1 and cy between y0 and y1
    join vertices v on v.tile = c.tile and v.obj = c.obj where c.class <> 2 group by c.tile, c.slide, c.obj, r.sample_n, c.class""")
def j3(spark, d):
    # Class 0 is named, class 1 has no name, class 2 is tissue.
    name = F.when(F.col("class") == 0, "Glomerulus").when(F.col("class") == 2, "Tissue")
    named = v.objects(spark, d).select("tile", "slide", "obj", "vertices", name.alias("class_name"))
    rows = tiling.samples_of_objects(named, v.rects(spark, d))
    return rows.select("tile", "slide", "obj", "sample_n", "class_name", g.vertex_text(F.col("vertices")).alias("ring"))


# Every fiftieth slide has 500 rectangles of many sizes, the others three.
MANY_SQL = """(select slide, k::int as sample_n, k % 25 * 240 as x0, k // 25 * 200 as y0, k % 25 * 240 + 60 * (1 << (k % 7)::int) as x1, k // 25 * 200 + 50 * (1 << (k % 5)::int) as y1
        from slides cross join range(0, 500) t(k) where slide % 50 = 0 union all select slide, sample_n::int, x0, y0, x1, y1 from rects where slide % 50 <> 0)"""


def many_rects(spark, d):
    k = F.col("sample_n")
    grid = v.slides(spark, d).filter("slide % 50 = 0").select("slide", F.explode(F.sequence(F.lit(0), F.lit(499))).alias("sample_n"))
    x0, y0 = k % 25 * 240, F.floor(k / 25).cast("int") * 200
    sizes = F.array(*[F.lit(60 << i) for i in range(7)]), F.array(*[F.lit(50 << i) for i in range(5)])
    made = grid.withColumns({"x0": x0, "y0": y0, "x1": x0 + F.get(sizes[0], k % 7), "y1": y0 + F.get(sizes[1], k % 5)})
    return made.unionByName(v.rects(spark, d).filter("slide % 50 <> 0"))


@query("j3_many_rectangles", f"""
    with c as (select tile, slide, obj, avg(x) as cx, avg(y) as cy from vertices group by tile, slide, obj)
    select c.tile, c.slide, c.obj, r.sample_n, x1 - x0 as region_w, y1 - y0 as region_h
    from c join {MANY_SQL} r on r.slide = c.slide and cx between x0 and x1 and cy between y0 and y1""")
def j3_many(spark, d):
    objects = v.objects(spark, d).select("tile", "slide", "obj", "vertices", F.lit("Glomerulus").alias("class_name"))
    return tiling.samples_of_objects(objects, many_rects(spark, d)).select("tile", "slide", "obj", "sample_n", "region_w", "region_h")


@query("j3_crowded_slides", f"select slide, count(*) as n from {MANY_SQL} group by slide having count(*) > 10")
def j3_crowded(spark, d):
    return tiling.crowded_slides(many_rects(spark, d))


@query("j4_tile_boxes", """
    with b as (select slide, tile, obj, class, sx0 as x0, sy0 as y0, sx0 + w as x1, sy0 + h as y1 from boxes),
         t as (select b.*, i, j, greatest(x0, j * 1024) - j * 1024 as a0, least(x1, j * 1024 + 2048) - j * 1024 as a1,
                      greatest(y0, i * 1024) - i * 1024 as b0, least(y1, i * 1024 + 2048) - i * 1024 as b1
               from b join range(0, 5) tj(j) on x1 >= j * 1024 and x0 <= j * 1024 + 2048
               join range(0, 3) ti(i) on y1 >= i * 1024 and y0 <= i * 1024 + 2048)
    select slide, tile, obj, class, i::int as tile_i, j::int as tile_j, (a0 + a1) / 2.0::double / 2048 as xc, (b0 + b1) / 2.0::double / 2048 as yc,
           (a1 - a0)::double / 2048 as w, (b1 - b0)::double / 2048 as h from t""")
def j4(spark, d):
    b = v.boxes(spark, d).select("slide", "tile", "obj", "class", F.col("sx0").alias("x0"), F.col("sy0").alias("y0"), "w", "h")
    return tiling.tile_boxes(b, v.TILE, 1024, F.lit(v.SLIDE_W), F.lit(v.SLIDE_H))


POLYGONS_SQL = """
    select slide, tile, obj, class, i::int as i, j::int as j, count(*)::int as n,
           '[' || string_agg('{' || (x - j * 1024) || ', ' || (y - i * 1024) || '}', ', ' order by ord) || ']' as ring
    from vertices join range(0, 5) tj(j) on x >= j * 1024 and x < j * 1024 + 2048
    join range(0, 3) ti(i) on y >= i * 1024 and y < i * 1024 + 2048 group by all"""


def polygons(spark, d):
    return tiling.tile_polygons(v.objects(spark, d), v.TILE, 1024, F.lit(v.SLIDE_W), F.lit(v.SLIDE_H))


@query("j5_tile_polygons", POLYGONS_SQL)
def j5(spark, d):
    return polygons(spark, d).select(
        "slide", "tile", "obj", "class", "i", "j", F.size("vertices").alias("n"), g.vertex_text(F.col("vertices")).alias("ring")
    )


@query("j6_match_predictions", """
    select tile, pred, obj, class, coalesce(n_matches, 0) as n_matches, class is null as false_positive from matches""")
def j6(spark, d):
    m = matching.match_predictions(v.preds(spark, d), v.boxes(spark, d), v.TILE)
    return m.select("tile", "pred", "obj", "class", "n_matches", F.col("class").isNull().alias("false_positive"))


# Twice as large: boxes in the coordinates of tiles of 4096 pixels.
WIDE_SQL = "(select tile, {key}, x0 * 2 as x0, y0 * 2 as y0, w * 2 as w, h * 2 as h{more} from {rows})"


def wide(df):
    return df.withColumns({c: F.col(c) * 2 for c in ("x0", "y0", "w", "h")})


@query("j6_tiles_of_4096", f"""
    with p as {WIDE_SQL.format(key='pred', more='', rows='preds')}, b as {WIDE_SQL.format(key='obj', more=', class', rows='boxes')},
         m as (select p.tile, p.pred, b.obj, b.class, row_number() over (partition by p.tile, p.pred order by
               power(p.x0 + p.w / 2.0 - (b.x0 + b.w / 2.0), 2) + power(p.y0 + p.h / 2.0 - (b.y0 + b.h / 2.0), 2), b.obj) as r, count(*) over (partition by p.tile, p.pred) as n
               from p join b on b.tile = p.tile and p.x0 + p.w / 2.0 between b.x0 and b.x0 + b.w and p.y0 + p.h / 2.0 between b.y0 and b.y0 + b.h)
    select p.tile, p.pred, obj, class, coalesce(n, 0) as n_matches from p left join (select * from m where r = 1) m on m.tile = p.tile and m.pred = p.pred""")
def j6_wide(spark, d):
    m = matching.match_predictions(wide(v.preds(spark, d)), wide(v.boxes(spark, d)), 2 * v.TILE)
    return m.select("tile", "pred", "obj", "class", "n_matches")


@query("j6_outside_boxes", f"""
    select tile, obj, class from {WIDE_SQL.format(key='obj', more=', class', rows='boxes')} where x0 > 2048 or y0 > 2048""")
def j6_outside(spark, d):
    """Boxes that a wrong tile size would leave out."""
    return matching.outside_tile(wide(v.boxes(spark, d)), v.TILE).select("tile", "obj", "class")


# Both sides are written out with the columns that are needed, and a prediction keeps one row before it meets the others.
@query("j7_overlap_match", """
    with q as materialized (select tile, pred, x0, y0, x0 + w as x1, y0 + h as y1, (w * h)::double as area from preds),
         g as materialized (select tile, obj, class, x0, y0, x0 + w as x1, y0 + h as y1 from boxes),
         m as (select q.tile, q.pred, g.obj, g.class, ((least(q.x1, g.x1) - greatest(q.x0, g.x0)) * (least(q.y1, g.y1) - greatest(q.y0, g.y0)))::double / area as covered
               from q join g on g.tile = q.tile where q.x0 < g.x1 and g.x0 < q.x1 and q.y0 < g.y1 and g.y0 < q.y1),
         r as materialized (select tile, pred, count(*) as n, arg_max({'obj': obj, 'class': class, 'covered': covered}, {'c': covered, 'o': -obj}) as best
                            from m where covered >= 0.25 group by tile, pred)
    select tile, pred, coalesce(n, 0) as n_matches, best.obj as obj, best.class as class, best.covered as covered from q left join r using (tile, pred)""")
def j7(spark, d):
    return matching.overlap_match(v.preds(spark, d), v.boxes(spark, d), v.TILE)


@query("j8_refine_class", """
    with f as (select a.tile, a.obj, count(*) as n, min(b.class) as lo, max(b.class) as hi
               from boxes a join boxes b on b.tile = a.tile and b.x0 + b.w / 2.0 between a.x0 and a.x0 + a.w and b.y0 + b.h / 2.0 between a.y0 and a.y0 + a.h
               where a.class = 0 and not (a.class = b.class and a.x0 = b.x0 and a.y0 = b.y0 and a.w = b.w and a.h = b.h) group by a.tile, a.obj)
    select a.tile, a.obj, coalesce(n, 0) as n_found, case when lo is null then 0 when lo = hi then lo end as refined, coalesce(lo <> hi, false) as conflict
    from boxes a left join f on f.tile = a.tile and f.obj = a.obj where a.class = 0""")
def j8(spark, d):
    b = v.boxes(spark, d)
    return matching.refine_class(b.filter("class = 0"), b, v.TILE)


@query("j9_inherit_fold", "select tile, slide, sample, fold from ftiles")
def j9(spark, d):
    slides = v.slides(spark, d).select("slide", v.fold_of(F.col("slide")).alias("fold"))
    return pairing.inherit_fold(v.tiles(spark, d), slides).select("tile", "slide", "sample", "fold")


@query("j10_pair_slides_labels", """
    select 'C' || o_custkey || '_PAS_Wholeslide_Default_Extended.tif_pyr.tif' as slide_name, 'C' || o_custkey || '_PAS.mrxs.gson' as label_name,
           o_custkey in (select c_custkey from customer where c_custkey % 5 <> 0) as paired from orders where o_custkey % 3 <> 0""")
def j10(spark, d):
    stain = lambda key: F.when(key % 3 == 0, "_HE").otherwise("_PAS")
    name = lambda key, end: F.concat(F.lit("C"), key.cast("string"), stain(key), F.lit(end))
    lab = v.table(spark, d, "orders").select(name(F.col("o_custkey"), ".mrxs.gson").alias("label_name"))
    slides = v.table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(
        name(F.col("c_custkey"), "_Wholeslide_Default_Extended.tif_pyr.tif").alias("slide_name")
    )
    expected = lambda c: F.regexp_replace(c, r"\.mrxs\.gson$", "_Wholeslide_Default_Extended.tif_pyr.tif")
    return pairing.pair_by_name(lab, slides, expected, "_PAS")


@query("j11_completeness_audit", """
    with f as (select o_custkey, bool_or(o_orderstatus = 'F') as gson, bool_or(o_orderstatus = 'O') as geojson, bool_or(o_orderstatus = 'P') as txt from orders group by 1)
    select c_custkey as slide, coalesce(gson, false) as gson, coalesce(geojson, false) as geojson, coalesce(txt, false) as txt,
           coalesce(gson and geojson and txt, false) as complete from customer left join f on o_custkey = c_custkey""")
def j11(spark, d):
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "gson").when(status == "O", "geojson").when(status == "P", "txt")
    have = v.table(spark, d, "orders").select(F.col("o_custkey").alias("slide"), kind.alias("kind"))
    return pairing.completeness(v.table(spark, d, "customer").select(F.col("c_custkey").alias("slide")), have, ["gson", "geojson", "txt"])


@query("j12_skip_completed", """
    select c_custkey as slide from customer where c_custkey not in (select o_custkey from orders group by 1 having count(*) > 8)""")
def j12(spark, d):
    work = v.table(spark, d, "customer").select(F.col("c_custkey").alias("slide"))
    return pairing.unfinished(work, v.tiles(spark, d), ["slide"])


@query("j13_label_bags", "select bag, slide, label from lbags")
def j13(spark, d):
    i = v.instances(spark, d)
    made = bags.bag_key(bags.make_bags(i))
    return pairing.label_bags(made, bags.slide_labels(i)).select("bag", "slide", "label")


@query("j14_crops_for_predictions", """
    select tile, pred as k, conf, tile || '_crop' || pred as crop, md5(tile || '_crop' || pred) as digest from preds where (tile + pred) % 3 <> 0""")
def j14(spark, d):
    rows = v.preds(spark, d).select("tile", F.col("pred").alias("k"), "conf")
    # The crop files of two thirds of the predictions; tile and number are read back from the names.
    name = nm.crop_name(F.col("tile").cast("string"), F.col("k"))
    listed = rows.filter("(tile + k) % 3 <> 0").select(name.alias("crop")).withColumn("digest", F.md5("crop"))
    part = lambda i: F.regexp_extract("crop", r"^(\d+)_crop(\d+)$", i).cast("bigint")
    return pairing.with_crops(rows, listed.select("crop", "digest", part(1).alias("tile"), part(2).alias("k")))


@query("j15_image_bag_to_feature_bag", """
    select bag, ord, instance, len(embedding)::int as n, embedding[1]::double as first from kbags join embeddings on vec_id = instance""")
def j15(spark, d):
    made = bags.bag_key(bags.make_bags(v.instances(spark, d)))
    rows = pairing.feature_bags(made, v.features(spark, d))
    return rows.select("bag", "ord", "instance", F.size("embedding").alias("n"), F.get("embedding", 0).cast("double").alias("first"))


def halves(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), "o_custkey", (F.col("o_totalprice") * 100).cast("bigint").alias("size"))
    return o.filter("file % 3 <> 0"), o.filter("file % 5 <> 0").withColumn("size", F.col("size") + 1)


HALVES_SQL = """with a as (select o_orderkey as file, o_custkey, trunc(o_totalprice * 100)::bigint as size from orders where o_orderkey % 3 <> 0),
    b as (select o_orderkey as file, o_custkey, trunc(o_totalprice * 100)::bigint + 1 as size from orders where o_orderkey % 5 <> 0)"""


@query("u1_merge_datasets", HALVES_SQL + " select * from a union all select * from b where file not in (select file from a)")
def u1(spark, d):
    return merging.merge_datasets(*halves(spark, d), ["file"])


@query("u1_merge_gap", HALVES_SQL + """, m as (select file from a union select file from b)
    select (select count(*) from a) as n_first, (select count(*) from b) as n_second, (select count(*) from m) as n_merged,
           abs((select count(*) from a) + (select count(*) from b) - (select count(*) from m)) < 6 as ok""")
def u1_gap(spark, d):
    a, b = halves(spark, d)
    return merging.merge_gap(a, b, merging.merge_datasets(a, b, ["file"]))


@query("u2_merge_dims", HALVES_SQL + """
    select coalesce(b.file, a.file) as file, coalesce(b.size, a.size) as size, coalesce(b.o_custkey, a.o_custkey) as o_custkey
    from a full join b on a.file = b.file""")
def u2(spark, d):
    return merging.merge_dims(*halves(spark, d), "file", ["size", "o_custkey"])


@query("u3_folds_disjoint", """
    select md5(text) as digest, count(*) filter (doc_id % 4 <> 0) as n_train, count(*) filter (doc_id % 4 = 0) as n_val
    from documents group by 1 having count(*) filter (doc_id % 4 <> 0) > 0 and count(*) filter (doc_id % 4 = 0) > 0""")
def u3(spark, d):
    docs = v.table(spark, d, "documents").select(
        F.md5("text").alias("digest"), F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("fold")
    )
    return folds.leaks(docs, "digest")


@query("u4_append_run", f"""
    select {", ".join(f"{e} as {c}" for c, e in {**{c: "null::varchar" for c in runs.LOG_COLUMNS},
        "datetime": "strftime(ts, '%d/%m/%Y %H:%M:%S')", "status": "event_type", "exp_fold": "user_id::varchar"}.items())} from events
    union all select {", ".join(f"{e} as {c}" for c, e in {**{c: "null::varchar" for c in runs.LOG_COLUMNS},
        "status": "'prepared'", "exp_fold": "user_id::varchar", "epochs": "count(*)::varchar"}.items())} from events group by user_id""")
def u4(spark, d):
    e = v.runs(spark, d)
    log = e.select(F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("datetime"), "status", F.col("exp").alias("exp_fold"), "value")
    new = e.groupBy(F.col("exp").alias("exp_fold")).agg(F.count("*").alias("epochs")).withColumn("status", F.lit("prepared"))
    return runs.append_run(log, new)


@query("j9_unknown_slides", "select tile, slide, sample from tiles where slide % 9 = 0")
def j9_unknown(spark, d):
    return pairing.unknown_slides(v.tiles(spark, d), v.slides(spark, d).filter("slide % 9 <> 0"))


@query("j13_mixed_bags", """
    select slide % 24 || '_' || bag_n as bag, min(slide) as first, max(slide) as last from bags group by 1 having min(slide) <> max(slide)""")
def j13_mixed(spark, d):
    made = bags.make_bags(v.instances(spark, d)).withColumn("bag", F.concat_ws("_", (F.col("slide") % 24).cast("string"), F.col("bag_n").cast("string")))
    return pairing.mixed_bags(made)


@query("w9_bags_by_sample", """
    with i as (select *, instance % 3 as sample from instances),
         r as (select instance, slide, sample, row_number() over (partition by slide, sample order by md5(concat(instance, ':10')), instance) as rank,
                      count(*) over (partition by slide, sample) as size from i)
    select slide, sample, instance, (rank - 1) // 9 as bag_n, ((rank - 1) % 9)::int as ord from r
    union all
    select slide, sample, instance, size // 9, (size % 9 + x - 1)::int from (
        select *, row_number() over (partition by slide, sample order by md5(concat(instance, ':10b')), instance) as x
        from r where size % 9 > 0 and rank <= size - size % 9) where x <= 9 - size % 9""")
def w9_by_sample(spark, d):
    i = v.instances(spark, d).withColumn("sample", F.col("instance") % 3)
    return bags.make_bags(i, by=("slide", "sample")).select("slide", "sample", "instance", "bag_n", "ord")
