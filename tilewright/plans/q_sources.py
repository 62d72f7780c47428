"""Queries over sources and sinks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.operators import clinical, tiling
from tilewright.plans import views as v
from tilewright.plans.registry import query
from tilewright.session import discard_one, fresh_dir, shuffles_dropped, stored
from tilewright.sources import annotations, features, files, layout, listing, splits

NAMES = {0: "Glomerulus", 1: "Cellular Crescent", 2: "FibrousCrescent"}
NAME_SQL = "case class when 0 then 'Glomerulus' when 1 then 'Cellular Crescent' else 'FibrousCrescent' end"


def class_text(cid=None):
    cid = F.col("class") if cid is None else cid
    return F.when(cid == 0, NAMES[0]).when(cid == 1, NAMES[1]).otherwise(NAMES[2])


@query("s1_dataset_manifest", """
    select 'tiles' as level, fold, 'images' as kind, name, 'png' as ext, (tile * 37) % 1000000 as size,
           'S' || slide || '_PAS' as slide, sample::int as sample, (tile % 7)::int as tile_i, (tile % 5)::int as tile_j
    from names""")
def s1(spark, d):
    paths = F.concat(F.lit("/data/tiles/"), "fold", F.lit("/images/"), "name", F.lit(".png"))
    listed = v.image_names(spark, d).select(paths.alias("path"), (F.col("tile") * 37 % 1000000).alias("length"))
    return files.manifest_rows(listed)


@query("s2_label_rows", """
    select tile, obj, n::int as line_n, class, xc, yc, w, h from nboxes cross join (values (0), (1)) t(n)""")
def s2(spark, d):
    b = v.shares(v.boxes(spark, d))
    x0, y0 = F.col("xc") - F.col("w") / 2, F.col("yc") - F.col("h") / 2
    x1, y1 = F.col("xc") + F.col("w") / 2, F.col("yc") + F.col("h") / 2
    text = F.concat_ws(
        "\n",
        files.label_line(F.col("class"), *[F.col(c) for c in ("xc", "yc", "w", "h")]),
        files.label_line(F.col("class"), x0, y0, x1, y0, x1, y1, x0, y1),
    )
    return files.boxes_of_lines(files.label_lines(b.select("tile", "obj", text.alias("text")), "text", "tile", "obj"))


@query("s3_annotation_objects", f"""
    select form, tile, obj, class_name, ring, n::int as n from (
      select tile, obj, {NAME_SQL} as class_name, '[' || string_agg('{{' || x || ', ' || y || '}}', ', ' order by ord) || ']' as ring, count(*) as n
      from vertices group by tile, obj, class)
    cross join (values ('collection'), ('gson')) t(form)""")
def s3(spark, d):
    feature = annotations.annotation_text(F.col("vertices"), class_text())
    texts = v.objects(spark, d).select(F.col("tile"), F.col("obj").alias("n_obj"), feature.alias("feature"))
    # One pass over the objects writes both file forms of each.
    both = texts.select("tile", "n_obj", F.explode(F.array(
        F.struct(F.lit("collection").alias("form"), F.concat(F.lit('{"features":['), "feature", F.lit("]}")).alias("text")),
        F.struct(F.lit("gson").alias("form"), annotations.gson_text(F.concat(F.lit("junk \\["), "feature", F.lit("]"))).alias("text")),
    )).alias("f")).select("tile", "n_obj", "f.*")
    rows = annotations.objects_of(both, "text", "form", "tile", "n_obj")
    whole = F.col("vertices").cast("array<struct<x:bigint,y:bigint>>")
    return rows.select(
        "form", "tile", F.col("n_obj").alias("obj"), "class_name", g.vertex_text(whole).alias("ring"), F.size("vertices").alias("n")
    )


@query("s4_sample_rects", """
    select slide, 0 as sample_n, x0::double as x0, y0::double as y0, x1::double as x1, y1::double as y1,
           (x1 - x0)::double as w, (y1 - y0)::double as h, true as valid from rects""")
def s4(spark, d):
    one = annotations.rect_text(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), one, F.lit("]}"))
    return annotations.rects_of(v.rects(spark, d).select("slide", text.alias("text")), "text")


@query("s5_default_rect", """
    select slide, coalesce(sample_n, 0) as sample_n, coalesce(x0, 0) as x0, coalesce(y0, 0) as y0,
           coalesce(x1, w) as x1, coalesce(y1, h) as y1
    from slides left join (select * from rects where slide % 4 <> 0) using (slide)""")
def s5(spark, d):
    return tiling.with_default_rect(v.slides(spark, d), v.rects(spark, d).filter("slide % 4 <> 0"))


@query("s6_training_metrics", """
    select 'run=' || (exp % 20) as exp, epoch::double as epoch, "precision", recall,
           case when exp % 20 % 3 = 2 then epoch * 2.0::double end as extra from epochs""")
def s6(spark, d):
    """Experiments whose files differ in the order and the number of their columns."""
    out = fresh_dir(spark, "results")
    curves = v.epochs(spark, d).withColumn("run", F.col("exp") % 20).drop("exp")
    headers = [["epoch", "precision", "recall"], ["recall", " epoch", "precision"], ["precision", "extra", "epoch ", "recall"]]
    for k, header in enumerate(headers):
        part = curves.filter(F.col("run") % 3 == k).withColumn("extra", F.col("epoch") * 2.0).hint("rebalance", "run")
        part.select("run", *[F.col(c.strip()).alias(c) for c in header]).write.mode("append").partitionBy("run").csv(out, header=True)
    return files.training_metrics(spark, out).select("exp", "epoch", "precision", "recall", "extra")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SEGMENT_SQL = ", ".join(f"(c_mktsegment = '{s}')::int as c_mktsegment_{s}" for s in SEGMENTS)


def patients(spark, d):
    c = v.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return clinical.one_hot_clinical(c, {"c_mktsegment": SEGMENTS}).withColumn("label", (F.col("c_custkey") % 4).cast("int"))


@query("s7_clinical_table", f"""
    select c_custkey as id, {", ".join(f"(c_mktsegment = '{s}')::int::double as c_mktsegment_{s}" for s in SEGMENTS)},
           c_nationkey::double as c_nationkey, c_acctbal, (c_custkey % 4)::int as label from customer""")
def s7(spark, d):
    out = fresh_dir(spark, "patients")
    p = patients(spark, d)
    p.select("c_custkey", *[c for c in p.columns if c != "c_custkey"]).write.csv(out, header=True)
    return files.clinical_table(spark, out)


@query("s8_feature_table", """
    select vec_id as instance, len(embedding)::int as n, embedding[1]::double as first, embedding[-1]::double as last from embeddings""")
def s8(spark, d):
    f = files.feature_table(v.table(spark, d, "embeddings"), "vec_id", "embedding")
    at = lambda k: F.element_at("embedding", k).cast("double")
    return f.select("instance", F.size("embedding").alias("n"), at(1).alias("first"), at(-1).alias("last"))


@query("s8_feature_files", """
    select vec_id as instance, len(embedding)::int as n, embedding[1]::double as first, embedding[-1]::double as last,
           round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total from embeddings""")
def s8_files(spark, d):
    """A saved array for each vector, read back."""
    out = fresh_dir(spark, "feats")
    features.write_feature_files(v.table(spark, d, "embeddings"), listing.qualified(spark, out), "vec_id", "embedding")
    at = lambda k: F.element_at("embedding", k).cast("double")
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    read = features.feature_files(spark, out)
    return read.select(F.col("instance").cast("bigint").alias("instance"), F.size("embedding").alias("n"), at(1).alias("first"), at(-1).alias("last"), total.alias("total"))


@query("s9_write_labels", """
    select fold, tile, obj, class, xc, yc, nboxes.w, nboxes.h from nboxes join ftiles using (tile)""")
def s9(spark, d):
    out = fresh_dir(spark, "labels")
    rows = v.shares(v.boxes(spark, d)).withColumn("fold", v.fold_of(F.col("slide")))
    files.write_labels(rows, out, files.label_line(F.col("class"), *[F.col(c) for c in ("xc", "yc", "w", "h")]))
    return files.boxes_of_lines(files.read_labels(spark, out))


@query("s10_write_split_dataset", """
    select class, count(*) as n, count(distinct slide) as n_slides from objs join (select tile as t, fold from ftiles) on t = tile
    where fold = 'train' group by class""")
def s10(spark, d):
    out = fresh_dir(spark, "split")
    files.write_split_dataset(v.labels(spark, d).withColumn("fold", v.fold_of(F.col("slide"))), out)
    back = spark.read.schema("tile bigint, slide bigint, sample bigint, fold string, class int").parquet(out)
    return back.filter("fold = 'train'").groupBy("class").agg(
        F.count("*").alias("n"), F.count_distinct("slide").alias("n_slides")
    )


@query("s10_bucketed", """
    select fold, class, count(*) as n, count(distinct slide) as n_slides, sum(tile) as tiles from objs join (select tile as t, fold from ftiles) on t = tile group by fold, class""")
def s10_bucketed(spark, d):
    """A split dataset in buckets, opened again by its layout."""
    out = fresh_dir(spark, "split")
    files.write_split_dataset(v.labels(spark, d).withColumn("fold", v.fold_of(F.col("slide"))), out, buckets=8)
    back = layout.open_bucketed(spark, out)
    return back.groupBy("fold", "class").agg(F.count("*").alias("n"), F.count_distinct("slide").alias("n_slides"), F.sum("tile").alias("tiles"))


@query("s1_from_files", """
    select 'tiles' as level, fold, 'labels' as kind, 'txt' as ext, sum(octet_length(encode(tile || ' ' || slide || ' ' || fold)) + 1)::bigint as bytes from ftiles group by fold
    union all
    select 'wsi', fold, 'images', 'txt', sum(octet_length(encode(slide || ' ' || fold)) + 1)::bigint
    from (select distinct slide, fold from ftiles) group by fold""")
def s1_from_files(spark, d):
    """A dataset tree on disk, listed: the files of every level and fold have the bytes that were written there."""
    out = fresh_dir(spark, "tree")
    tiles = v.folded_tiles(spark, d)
    kinds = {"tiles": ("labels", tiles.select("fold", F.concat_ws(" ", "tile", "slide", "fold").alias("value")))}
    kinds["wsi"] = ("images", tiles.select("slide", "fold").distinct().select("fold", F.concat_ws(" ", "slide", "fold").alias("value")))
    for level, (kind, rows) in kinds.items():
        for fold in ("train", "val", "test"):
            rows.filter(F.col("fold") == fold).select("value").write.text(f"{out}/{level}/{fold}/{kind}")
    listed = files.dataset_manifest(spark, out, "*.txt")
    return listed.groupBy("level", "fold", "kind", "ext").agg(F.sum("size").alias("bytes"))


@query("s2_from_files", """
    select class, count(*) as n, sum(xc)::double as xc, sum(w)::double as w from (select class, round(xc * 4096)::bigint as xc, round(w * 4096)::bigint as w from nboxes) b group by class""")
def s2_from_files(spark, d):
    """Label lines in text files, read back by `label_rows`."""
    out = fresh_dir(spark, "label-files")
    b = v.shares(v.boxes(spark, d))
    lines = b.select(files.label_line(F.col("class"), *[F.col(c) for c in ("xc", "yc", "w", "h")]).alias("value"), (F.col("tile") % 40).alias("part"))
    lines.hint("rebalance", "part").write.partitionBy("part").text(out)
    read = files.boxes_of_lines(files.label_rows(spark, out))
    whole = lambda c: F.round(F.col(c) * 4096).cast("bigint")
    return read.groupBy("class").agg(F.count("*").alias("n"), F.sum(whole("xc")).cast("double").alias("xc"), F.sum(whole("w")).cast("double").alias("w"))


@query("s9_to_s2", """
    select fold, tile, row_number() over (partition by tile order by obj)::int - 1 as line_n, class, xc, yc, nboxes.w, nboxes.h from nboxes join ftiles using (tile)""")
def s9_to_s2(spark, d):
    """Labels as text, many tiles per file, each line with its tile in front; read back as label rows."""
    out = fresh_dir(spark, "label-text")
    rows = v.shares(v.boxes(spark, d)).withColumn("fold", v.fold_of(F.col("slide")))
    files.write_label_text(rows, out, files.label_line(F.col("class"), *[F.col(c) for c in ("xc", "yc", "w", "h")]))
    return files.boxes_of_lines(files.read_label_text(spark, out)).withColumn("tile", F.col("tile").cast("bigint"))


@query("s3_unreadable_files", "select slide, sample_n as n, 'unreadable' as problem from rects where (slide + sample_n) % 5 = 0")
def s3_unreadable(spark, d):
    one = annotations.rect_text(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), one, F.lit("]}"))
    cut = F.when((F.col("slide") + F.col("sample_n")) % 5 == 0, F.substr(text, F.lit(1), F.length(text) - 9)).otherwise(text)
    return annotations.unreadable(v.rects(spark, d).select("slide", F.col("sample_n").alias("n"), cut.alias("text")), "text", "slide", "n")


@query("s3_split_files", f"""
    select part, row_number() over (partition by part order by tile, obj)::int - 1 as obj, class_name, n, first_x, last_y
    from (select tile % 4 as part, tile, obj, {NAME_SQL} as class_name, count(*)::int as n, min(x) filter (ord = 0)::double as first_x, min(y) filter (ord = 7)::double as last_y
          from vertices group by tile, obj, class)""")
def s3_split_files(spark, d):
    """Four collections that hold all objects, read by as many tasks as they have splits.

    One after the other is written, read and deleted, so that a quarter of the texts is there at a time.
    """
    own = stored(v.boxes(spark, d).select("tile", "slide", "obj", "class", "sx0", "sy0", "w", "h"), "boxes")
    part, key = F.col("tile") % 4, F.struct("tile", "obj")
    ends = own.groupBy(part.alias("part")).agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()  # a row each
    read = [_read_collection(spark, own.filter(part == e["part"]), e) for e in sorted(ends)]
    return functools.reduce(DataFrame.unionByName, read) if read else _no_collection(spark)


def _read_collection(spark, own, ends):
    out = fresh_dir(spark, "collections")
    at = lambda name: (F.col("tile") == ends[name]["tile"]) & (F.col("obj") == ends[name]["obj"])
    lead = F.when(at("first"), F.lit('{"type":"FeatureCollection","features":[\n')).otherwise(",")
    tail = F.when(at("last"), F.lit("\n]}")).otherwise("")
    # Boxes are dealt and sorted, and turned into texts as they are written: one file.
    ordered = v.objects_of(own.repartition(1).sortWithinPartitions("tile", "obj"))
    text = annotations.annotation_text(F.col("vertices"), class_text())
    with shuffles_dropped(spark):
        ordered.select(F.concat(lead, text, tail).alias("value")).write.text(f"{out}/part={ends['part']}")
    read = stored(_first_and_last(_objects_read(spark, out)), "read")
    discard_one(spark, out)
    return read


def _no_collection(spark):
    out = fresh_dir(spark, "collections")
    spark.createDataFrame([], "value string").write.text(out)
    return _first_and_last(_objects_read(spark, out))


def _objects_read(spark, out):
    found = splits.listed_objects(spark, out, "*.txt")
    part = F.regexp_extract("path", r"part=(-?\d+)", 1).cast("bigint").alias("part")
    one = annotations.object_features(F.concat(F.lit("["), F.col("text"), F.lit("]")))
    return found.select(part, F.col("n").cast("int").alias("obj"), F.get(one, 0).alias("f"))


def _first_and_last(read):
    at = lambda k: F.element_at("f.vertices", k)
    return read.select("part", "obj", "f.class_name", F.size("f.vertices").alias("n"), at(1)["x"].alias("first_x"), at(8)["y"].alias("last_y"))
