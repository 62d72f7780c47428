"""Queries over models, streams and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import bags, clinical, pairing, pooling, sampling
from tilewright.plans import jobs
from tilewright.plans import views as v
from tilewright.plans.q_aggs import CLASS_SQL, COUNT_SQL, NAMED_SQL, QUERY_VECTOR, RUN_STATUS_SQL, SHARE_SQL, SHARED_SQL
from tilewright.plans.q_sources import NAMES, SEGMENT_SQL, SEGMENTS, class_text, patients
from tilewright.plans.registry import query
from tilewright.session import checkpointed, fresh_dir
from tilewright.sources import annotations
from tilewright.streaming import labels as label_stream
from tilewright.streaming import runs as run_stream


@query("m1_one_hot_clinical", f"select c_custkey, {SEGMENT_SQL}, c_nationkey, c_acctbal, (c_custkey % 4)::int as label from customer")
def m1(spark, d):
    return patients(spark, d)


@query("m2_decision_tree")
def m2(spark, d):
    names = [f"c_mktsegment_{s}" for s in SEGMENTS] + ["c_nationkey", "c_acctbal"]
    return clinical.fit_tree(graded(spark, d), names, "c_custkey")[1]


def graded(spark, d):
    """Patients whose label follows from their features: balance above 5000 counts two, two of the segments one."""
    rich = F.when(F.col("c_acctbal") >= 5000, 2).otherwise(0)
    segment = F.col("c_mktsegment_BUILDING") + F.col("c_mktsegment_MACHINERY")
    return patients(spark, d).withColumn("label", (rich + segment).cast("int"))


GRADED_SQL = """(select c_custkey as key, case when c_acctbal >= 5000 then 2 else 0 end
    + case when c_mktsegment in ('BUILDING', 'MACHINERY') then 1 else 0 end as label from customer)"""
SPLIT_SQL = """
    with o as (select key, label, row_number() over (partition by label order by md5(concat(key, ':10')), key) as r, count(*) over (partition by label) as n from {rows})
    select label::int as label, case when r <= round_even(0.3::double * n, 0) then 'test' else 'train' end as fold, count(*) as n from o group by 1, 2"""


@query("m2_compiled_tree", f"select key as id, label::int as label, label::int as predicted from {GRADED_SQL}")
def m2_compiled(spark, d):
    """The tree as an expression, on every patient. The label follows from three features of two values each, so the tree is exact."""
    known = graded(spark, d).withColumn("rich", (F.col("c_acctbal") >= 5000).cast("int"))
    names = [f"c_mktsegment_{s}" for s in SEGMENTS] + ["rich"]
    model, _ = clinical.fit_tree(checkpointed(known), names, "c_custkey")
    return known.select(F.col("c_custkey").alias("id"), "label", clinical.tree_column(model, names).alias("predicted"))


@query("m2_split_sizes", SPLIT_SQL.format(rows=GRADED_SQL))
def m2_sizes(spark, d):
    return split_sizes(graded(spark, d), "c_custkey")


def split_sizes(df, key):
    return sampling.split_stratified(df.select(key, "label"), key, "label", 0.3).groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("m3_split_sizes", SPLIT_SQL.format(rows="(select bag as key, label from lbags)"))
def m3_sizes(spark, d):
    i = v.instances(spark, d)
    return split_sizes(pairing.label_bags(bags.bag_key(bags.make_bags(i)), bags.slide_labels(i)), "bag")


@query("m3_bag_classifier")
def m3(spark, d):
    i = v.instances(spark, d)
    made = checkpointed(bags.bag_key(bags.make_bags(i)))
    pooled = pooling.attention(pairing.feature_bags(made.select("bag", "instance"), v.features(spark, d)), QUERY_VECTOR)
    # The label follows from the pooled vector, so that a classifier that ignores its input fails.
    known = pairing.label_bags(made, bags.slide_labels(i)).select("bag")
    label = F.when(F.get("pooled", 0) > 0, 1).otherwise(0)
    return clinical.fit_bags(pooled.join(known, "bag").withColumn("label", label))[1]


@query("t1_run_status_stream", RUN_STATUS_SQL)
def t1(spark, d):
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.table(spark, d, "events").schema)
    out = run_stream.run_status_table(spark, f"{d}/event[s].parquet", fields, v.shape_runs)
    return out.select("exp", "status", F.unix_micros("started").alias("started_us"), F.unix_micros("updated").alias("updated_us"))


@query("t1_status_counts", """
    with m as (select max(ts) as last from events)
    select epoch_us(date_trunc('day', ts::timestamp)) as start_us, event_type as status, count(*) as n from events cross join m
    where date_trunc('day', ts::timestamp) + interval 2 day <= last group by 1, 2""")
def t1_counts(spark, d):
    """All entries of closed windows, however many files bring them in whatever order."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.table(spark, d, "events").schema)
    out = run_stream.status_count_table(spark, f"{d}/event[s].parquet", fields, v.shape_runs)
    return out.select(F.unix_micros("start").alias("start_us"), "status", (F.col("n") + F.col("n_late")).alias("n"))


@query("t1_late_entries", """
    with m as (select max(ts) as last from events),
         a as (select *, least(2, (epoch_us(last) - epoch_us(ts)) // 864000000000) as third from events cross join m),
         e as (select date_trunc('day', ts) as start, ts, event_type as status,
                      case when third = 2 then 2 when third = 1 and event_id % 7 <> 0 then 0 else 1 end as delivery from a),
         k as (select max(ts) filter (delivery = 0) as m0, max(ts) filter (delivery < 2) as m1, max(ts) as m2 from e),
         f as (select *, coalesce((delivery = 1 and start + interval 2 day <= m0) or (delivery = 2 and start + interval 2 day <= m1), false) as is_late from e cross join k)
    select epoch_us(start::timestamp) as start_us, status, count(*) filter (not is_late) as n, count(*) filter (is_late) as n_late,
           bool_or(start + interval 2 day <= m2) as closed from f group by 1, 2""")
def t1_late(spark, d):
    """Entries that come in three deliveries, the oldest third last and some a delivery after their neighbours."""
    src, out, state = (fresh_dir(spark, f"log-{k}") for k in ("files", "ledger", "state"))
    entries = v.shape_runs(v.table(spark, d, "events"))
    last = entries.agg(F.max("ts").alias("last")).scalar()
    third = F.least(F.lit(2), F.floor((F.unix_micros(last) - F.unix_micros("ts")) / (10 * 86_400_000_000)))
    delivery = F.when(third == 2, 2).when((third == 1) & (F.col("event_id") % 7 != 0), 0).otherwise(1)
    dealt = entries.withColumn("delivery", delivery)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    for k in range(3):
        dealt.filter(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(src)
        run_stream.count_arrivals(run_stream.run_log(spark, src, schema, files_per_batch=1_000_000), out, state)
    return run_stream.arrival_counts(spark, out).select(F.unix_micros("start").alias("start_us"), "status", "n", "n_late", "closed")


LINES_SQL = """
    select doc_id, line, min(pos)::int as pos from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
    group by doc_id, line"""


@query("t2_redelivered_labels", LINES_SQL)
def t2_again(spark, d):
    """Two thirds of the files come first, half of those again with the rest, and all of them once more under other paths."""
    src, out, state = (fresh_dir(spark, f"files-{k}") for k in ("in", "out", "state"))
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    for k, share in enumerate(("doc_id % 3 <> 0", "doc_id % 3 <> 1", "true")):
        docs.filter(share).write.parquet(f"{src}/delivery{k}")
        label_stream.ingest(spark.readStream.schema(docs.schema).parquet(f"{src}/*"), "text", "doc_id", out, state)
    return label_stream.ingested(spark, out)


@query("t2_ingest_labels_stream", LINES_SQL)
def t2(spark, d):
    out, state = fresh_dir(spark, "ingested"), fresh_dir(spark, "ingest-state")
    # A glob, so that the table may be one file or a directory.
    arriving = spark.readStream.schema("doc_id bigint, text string").parquet(f"{d}/document[s].parquet")
    label_stream.ingest(arriving, "text", "doc_id", out, state)
    return label_stream.ingested(spark, out)


CLEAN_SQL = """
    with kept as (select tile, class, x0, y0, w, h, min(obj) as obj from boxes join (select tile as t, fold from ftiles) on t = tile where fold <> 'test' group by all),
         st as (select *, row_number() over (partition by is_empty order by md5(concat(tile, ':10')), tile) as r from statuses where fold <> 'test'),
         n as (select count(*) as f from st where not is_empty),
         k as (select tile, fold from st cross join n where not is_empty or r <= round_even(f / 0.99::double, 0) - f)
    select k.tile, k.fold, count({main}) as n_labels, count({fine}) as n_fine from k left join kept using (tile) group by k.tile, k.fold
    union all select t.tile, t.fold, count(obj), count(obj) from ftiles t left join boxes using (tile) where t.fold = 'test' group by t.tile, t.fold"""


def cleaned(spark, d, source, **options):
    b = v.boxes(spark, d).select("tile", "obj", "class", "x0", "y0", "w", "h")
    tiles, labels = jobs.clean(source, v.folded_tiles(spark, d).select("tile", "fold"), b, ["class", "x0", "y0", "w", "h"], empty_share=0.01, **options)
    n = labels.groupBy("tile").agg(F.count("class").alias("n_labels"), F.count("class_fine").alias("n_fine"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_labels", "n_fine")}
    return tiles.join(n, "tile", "left").withColumns(zero).select("tile", "fold", "n_labels", "n_fine")


@query("clean_tcd", CLEAN_SQL.format(main="case when class = 0 then 1 end", fine="case when class <> 2 then 1 end"))
def clean_tcd(spark, d):
    return cleaned(spark, d, "tcd", remove=(2,), ignore=(1,))


@query("clean_muw", CLEAN_SQL.format(main="case when class in (0, 2) then 1 end", fine="class"))
def clean_muw(spark, d):
    return cleaned(spark, d, "muw")


@query("clean_hubmap", CLEAN_SQL.format(main="class", fine="class"))
def clean_hubmap(spark, d):
    return cleaned(spark, d, "hubmap")


@query("build_tile_labels", """
    with c as (select tile, slide, obj, class, avg(x) as cx, avg(y) as cy from vertices group by all),
         s as (select v.tile, v.obj, v.class, r.sample_n, ord, least(greatest(x, x0), x1) - x0 as x, least(greatest(y, y0), y1) - y0 as y
               from c join rects r on r.slide = c.slide and cx between x0 and x1 and cy between y0 and y1 join vertices v on v.tile = c.tile and v.obj = c.obj),
         l as (select *, lead(x) over w as nx, lead(y) over w as ny from s window w as (partition by tile, obj, sample_n order by ord)),
         m as (select tile, obj, class, sample_n, least(x, 2047) as x, least(y, 4095) as y from l union all
               select tile, obj, class, sample_n, least(trunc((x + nx) / 2.0)::bigint, 2047), least(trunc((y + ny) / 2.0)::bigint, 4095) from l where nx is not null)
    select tile, obj, class, sample_n, i::int as i, 0 as j, (min(x) + max(x)) / 2.0::double / 2048 as xc, (min(y - i * 512) + max(y - i * 512)) / 2.0::double / 2048 as yc,
           (max(x) - min(x))::double / 2048 as w, (max(y) - min(y))::double / 2048 as h
    from m join range(0, 5) t(i) on y >= i * 512 and y < i * 512 + 2048 group by tile, obj, class, sample_n, i""")
def build_tile_labels(spark, d):
    objects = v.objects(spark, d).withColumn("class_name", class_text())
    rows = jobs.build_labels(objects, v.slides(spark, d), v.rects(spark, d), v.TILE, 512)
    return rows.select("tile", "obj", "class", "sample_n", "i", "j", "xc", "yc", "w", "h")


@query("label_crops", """
    with s as (select greatest(quantile_cont(w, 0.9), quantile_cont(h, 0.9)) as size from preds),
         m as (select tile, pred, case when class is null then 3 else class end as class, w, h, tile || '_crop' || pred as crop from matches cross join s where w <= size and h <= size),
         q as (select * from m where not (w < h * 0.6 or h < w * 0.6)),
         r as (select *, row_number() over (partition by class order by md5(concat(crop, ':10')), crop) as r, count(*) over (partition by class) as n from q),
         x as (select max(n) as x from r),
         c as (select tile, pred, class, crop, (x - n) // n + case when r <= (x - n) % n then 1 else 0 end as k from r cross join x),
         e as (select tile, pred, class, crop as name from c union all select tile, pred, class, 'Augm_' || unnest(range(0, k)) || '_' || crop from c),
         o as (select *, row_number() over (partition by class order by md5(concat(name, ':10')), name) as o, count(*) over (partition by class) as n from e)
    select tile, pred, class, name, case when o <= round_even(0.2::double * n, 0) then 'test' else 'train' end as fold from o""")
def label_crops(spark, d):
    p = v.preds(spark, d).select("tile", "pred", "x0", "y0", "w", "h")
    return jobs.label_crops(p, v.boxes(spark, d), v.TILE).select("tile", "pred", "class", "name", "fold")


@query("score_crop_names", f"""
    select 'S' || slide || '_PAS' as slide, {NAMED_SQL}, {SHARED_SQL}, {CLASS_SQL.format('sa + sb + sc')} as berden from {SHARE_SQL.format(COUNT_SQL.format(by='slide'))}""")
def score_crop_names(spark, d):
    names = v.image_names(spark, d).select("tile", F.concat("name", F.lit("_crop0.jpg")).alias("name"))
    crops = v.labels(spark, d).select("tile", "class").join(names, "tile")
    return jobs.score_crops(crops, v.SCORE_IDS)


FLOW_STEP = 1024


@query("flow_tile_dataset", f"""
    with b as (select slide, row_number() over (partition by slide order by tile, obj) - 1 as n, class, sx0 as x0, sy0 as y0, w, h from boxes),
         v as (select slide, n, class, k as ord, x0 + floor(w * fx / 2.0)::bigint as x, y0 + floor(h * fy / 2.0)::bigint as y
               from b cross join (values (0,0,0),(1,1,0),(2,2,0),(3,2,1),(4,2,2),(5,1,2),(6,0,2),(7,0,1),(8,0,0)) t(k, fx, fy)),
         c as (select slide, n, class, avg(x) as cx, avg(y) as cy from v group by all),
         s as (select v.slide, v.n, v.class, r.sample_n, ord, least(greatest(x, x0), x1) - x0 as x, least(greatest(y, y0), y1) - y0 as y
               from c join rects r on r.slide = c.slide and cx between x0 and x1 and cy between y0 and y1 join v on v.slide = c.slide and v.n = c.n),
         l as (select *, lead(x) over w as nx, lead(y) over w as ny from s window w as (partition by slide, n, sample_n order by ord)),
         m as (select slide, n, class, sample_n, least(x, 2047) as x, least(y, 4095) as y from l union all
               select slide, n, class, sample_n, least(trunc((x + nx) / 2.0)::bigint, 2047), least(trunc((y + ny) / 2.0)::bigint, 4095) from l where nx is not null),
         w as (select slide || '_sample' || sample_n || '_' || i || '_0' as tile, n, class, min(x) || ' ' || max(x) || ' ' || min(y) || ' ' || max(y) as box
               from m join range(0, 3) t(i) on y >= i * {FLOW_STEP} and y < i * {FLOW_STEP} + 2048 group by slide, n, class, sample_n, i),
         a as (select slide || '_sample' || sample_n || '_' || i || '_0' as tile, case when slide % 10 = 0 then 'test' when slide % 10 < 3 then 'val' else 'train' end as fold
               from rects cross join range(0, 3) t(i)),
         f as (select a.*, a.tile not in (select tile from w) as is_empty from a),
         st as (select *, row_number() over (partition by is_empty order by md5(concat(tile, ':10')), tile) as r from f where fold <> 'test'),
         q as (select count(*) as n_full from st where not is_empty),
         k as (select tile, fold from st cross join q where not is_empty or r <= round_even(n_full / 0.9::double, 0) - n_full),
         u as (select tile, class, box, min(n) as n from w group by all)
    select k.tile, k.fold, count(case when class = 0 then 1 end) as n_labels, count(case when class <> 2 then 1 end) as n_fine
    from k left join u using (tile) group by k.tile, k.fold
    union all select f.tile, f.fold, count(n), count(n) from f left join w using (tile) where fold = 'test' group by f.tile, f.fold""")
def flow_tile_dataset(spark, d):
    """Annotation documents are written and read, cut into tile labels with classes, and cleaned.

    A slide's boxes are collected, and turned into texts as they are written.
    """
    listed = v.boxes(spark, d).groupBy("slide").agg(F.sort_array(F.collect_list(F.struct("tile", "obj", "class", "sx0", "sy0", "w", "h"))).alias("o"))
    one = F.transform("o", lambda b: annotations.annotation_text(v.outline(lambda c: b[c]), class_text(b["class"])))
    text = lambda parts: F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(parts, ","), F.lit("]}"))
    out, areas = fresh_dir(spark, "annotations"), fresh_dir(spark, "areas")
    annotations.write_annotation_lines(listed.select("slide", text(one).alias("text")), out, "slide", "text", "gzip")
    corners = v.rects(spark, d).groupBy("slide").agg(F.sort_array(F.collect_list(F.struct("sample_n", "x0", "y0", "x1", "y1"))).alias("r"))
    rect = F.transform("r", lambda r: annotations.rect_text(r["x0"], r["y0"], r["x1"], r["y1"]))
    annotations.write_annotation_lines(corners.select("slide", text(rect).alias("text")), areas, "slide", "text")

    objects = annotations.objects_of(annotations.annotation_lines(spark, out), "text", "slide")
    rects = annotations.rects_of(annotations.annotation_lines(spark, areas), "text").filter("valid")
    slides = v.slides(spark, d).withColumn("slide", F.col("slide").cast("string"))
    labels = jobs.build_labels(objects, slides, rects, v.TILE, FLOW_STEP, classes={n: k for k, n in NAMES.items()})
    folds = slides.select("slide", v.fold_of(F.col("slide").cast("bigint")).alias("fold"))
    tiles = jobs.tile_table(slides, rects, folds, v.TILE, FLOW_STEP)
    kept, cleaned_labels = jobs.clean("tcd", tiles.select("tile", "fold"), labels, ["class", "xc", "yc", "w", "h"], (2,), (1,), empty_share=0.1)
    n = cleaned_labels.groupBy("tile").agg(F.count("class").alias("n_labels"), F.count("class_fine").alias("n_fine"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_labels", "n_fine")}
    return kept.join(n, "tile", "left").withColumns(zero).select("tile", "fold", "n_labels", "n_fine")
