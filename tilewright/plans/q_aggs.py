"""Queries over aggregations and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import geometry as g
from tilewright.operators import bags, folds, labels, matching, metrics, pairing, pooling, profile, runs, scoring, tiling
from tilewright.operators.quantiles import exact_quantiles
from tilewright.plans import views as v
from tilewright.plans.q_joins import polygons
from tilewright.plans.registry import query
from tilewright.session import checkpointed


@query("a1_unique_classes", "select distinct class from objs")
def a1(spark, d):
    return profile.unique_classes(v.labels(spark, d))


@query("a2_class_freq", "select c::int as class, (select count(*) from objs where class = c) as n from range(0, 5) t(c)")
def a2(spark, d):
    return profile.class_freq(v.labels(spark, d), 5)


def sized(spark, d):
    b = v.shares(v.boxes(spark, d))
    return b.withColumns({"fold": v.fold_of(F.col("slide")), "sample": F.col("tile") % 3})


@query("a3_instances_table", """
    select class, round_even(w, 4) as width, round_even(h, 4) as height, round_even(w * h, 4) as area, obj, tile, fold, sample, slide
    from nboxes join (select tile, fold, sample from ftiles) using (tile)
    union all select null, null, null, null, null, tile, fold, sample, slide from statuses where is_empty""")
def a3(spark, d):
    return profile.instances_table(sized(spark, d), v.folded_tiles(spark, d))


@query("a4_tiles_table", """
    select tile, slide, sample, fold, coalesce(n, 0) as n_obj, case when n is null then 'empty' when healthy then 'healthy' else 'unhealthy' end as kind
    from ftiles left join (select tile, count(*) as n, bool_or(class = 1) as healthy from objs group by tile) using (tile)""")
def a4(spark, d):
    return profile.tiles_table(v.folded_tiles(spark, d), v.labels(spark, d))


@query("a5_size_summary", "with s as (select round_even(w, 4) as width, round_even(h, 4) as height from nboxes) " + " union all ".join(f"""
    select '{c}' as "column", count(*) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c}) as "min", quantile_cont({c}, 0.25) as q1,
           quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.75) as q3, max({c}) as "max" from s""" for c in ("width", "height")))
def a5(spark, d):
    b = v.shares(v.boxes(spark, d)).select(F.bround("w", 4).alias("width"), F.bround("h", 4).alias("height"))
    out = profile.size_summary(b, ["width", "height"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


# Sizes in micrometres: no two scales are equal, so hardly any values are.
MICRONS_SQL = "(select tile, w::double / (2048 + tile % 977 / 7.0::double) as width, h::double * (0.2425::double + tile % 31 / 1000.0::double) as height from boxes)"


def microns(df):
    t = F.col("tile")
    return df.select("tile", (F.col("w") / (2048 + t % 977 / 7.0)).alias("width"), (F.col("h") * (0.2425 + t % 31 / 1000.0)).alias("height"))


@query("a5_unrounded_sizes", f"with s as {MICRONS_SQL} " + " union all ".join(f"""
    select '{c}' as "column", count(*) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 9) as "min", round(quantile_cont({c}, 0.25), 9) as q1,
           round(quantile_cont({c}, 0.5), 9) as median, round(quantile_cont({c}, 0.75), 9) as q3, round(max({c}), 9) as "max" from s""" for c in ("width", "height")))
def a5_unrounded(spark, d):
    out = profile.size_summary(microns(v.boxes(spark, d)), ["width", "height"])
    return out.withColumns({c: F.round(c, 6 if c in ("mean", "std") else 9) for c in ("mean", "std", "min", "q1", "median", "q3", "max")})


@query("a6_size_histogram", """
    select fold, floor(w * h / 0.002::double)::bigint as bin, count(*) as n from nboxes join (select tile, fold from ftiles) using (tile) group by all""")
def a6(spark, d):
    return profile.histogram(sized(spark, d).withColumn("area", F.col("w") * F.col("h")), "area", 0.002)


@query("a7_size_scatter", "select trunc(w * 100)::int as w_pct, trunc(h * 100)::int as h_pct, class, count(*) as n from nboxes group by all")
def a7(spark, d):
    return profile.size_scatter(v.shares(v.boxes(spark, d)))


@query("a8_tile_class_by_fold", """
    select fold, count(*) filter (n > 0 and healthy) as healthy, count(*) filter (n > 0 and not healthy) as unhealthy, count(*) filter (n is null) as empty
    from ftiles left join (select tile, count(*) as n, bool_or(class = 1) as healthy from objs group by tile) using (tile) group by fold""")
def a8(spark, d):
    return profile.kinds_by_fold(a4(spark, d), ["healthy", "unhealthy", "empty"])


@query("a9_objects_per_sample", "select slide, sample, count(*) as n from objs group by slide, sample")
def a9(spark, d):
    return profile.objects_per_sample(v.labels(spark, d))


@query("a10_crop_percentile", """
    with s as (select quantile_cont(w::double / 2048, 0.9) as w_size, quantile_cont(h::double / 2048, 0.9) as h_size from preds)
    select tile, pred, w::double / 2048 as w, h::double / 2048 as h, greatest(w_size, h_size) as size from preds cross join s
    where w::double / 2048 <= greatest(w_size, h_size) and h::double / 2048 <= greatest(w_size, h_size) and w::double / 2048 >= 0.05 and h::double / 2048 >= 0.05""")
def a10(spark, d):
    p = v.shares(v.preds(spark, d)).select("tile", "pred", "w", "h")
    size = metrics.crop_size(p)
    return metrics.croppable(p, size, 0.05).withColumn("size", size.select("size").scalar())


@query("a10_unrounded_shares", f"with s as {MICRONS_SQL.replace('from boxes', 'from preds')} " + " union all ".join(f"""
    select {p} as percentile, round(quantile_cont(width, {p / 100}), 9) as w_size, round(quantile_cont(height, {p / 100}), 9) as h_size from s""" for p in (50, 90, 99)))
def a10_unrounded(spark, d):
    sizes = microns(v.preds(spark, d)).select(F.col("width").alias("w"), F.col("height").alias("h"))
    found = exact_quantiles(sizes, ["w", "h"], [0.5, 0.9, 0.99])
    rows = spark.createDataFrame(list(zip((50, 90, 99), found["w"], found["h"])), "percentile int, w_size double, h_size double")
    return rows.select("percentile", F.round("w_size", 9).alias("w_size"), F.round("h_size", 9).alias("h_size"))


COUNT_SQL = """select {by}, count(*) filter (class = 0) as a, count(*) filter (class = 1) as b, count(*) filter (class = 2) as c from objs group by {by}"""
SHARE_SQL = """(select *, round_even(a::double / (a + b + c), 4) as sa, round_even(b::double / (a + b + c), 4) as sb, round_even(c::double / (a + b + c), 4) as sc from ({0}))"""
CLASS_SQL = """case when sa > 0.5 then 'Focal' when sb > 0.5 then 'Crescentic' when sc > 0.5 then 'Sclerotic' when {0} > 0.5 then 'Sclerotic' else 'Mixed' end"""
NAMED_SQL = 'a as "Glomerulus", b as "Cellular Crescent", c as "FibrousCrescent"'
SHARED_SQL = 'a + b + c as total, sa as "Glomerulus share", sb as "Cellular Crescent share", sc as "FibrousCrescent share"'


@query("a11_class_crosstab", f"select slide, {NAMED_SQL} from ({COUNT_SQL.format(by='slide')})")
def a11(spark, d):
    return scoring.class_crosstab(v.labels(spark, d), ["slide"], v.SCORE_IDS)


@query("a11_class_crosstab_by_sample", f"select slide, sample, {NAMED_SQL} from ({COUNT_SQL.format(by='slide, sample')})")
def a11_sample(spark, d):
    return scoring.class_crosstab(v.labels(spark, d), ["slide", "sample"], v.SCORE_IDS)


@query("a12_class_percent", f"select slide, {NAMED_SQL}, {SHARED_SQL} from {SHARE_SQL.format(COUNT_SQL.format(by='slide'))}")
def a12(spark, d):
    return scoring.class_shares(a11(spark, d), list(v.SCORE_IDS))


@query("a13_berden_class", f"""
    select slide, {NAMED_SQL}, {SHARED_SQL}, {CLASS_SQL.format('sa + sb + sc')} as berden from {SHARE_SQL.format(COUNT_SQL.format(by='slide'))}""")
def a13(spark, d):
    return scoring.berden_scores(v.labels(spark, d), ["slide"], v.SCORE_IDS)


@query("a13_berden_class_by_sample", f"""
    select slide, sample, {NAMED_SQL}, {SHARED_SQL}, {CLASS_SQL.format('sc')} as berden from {SHARE_SQL.format(COUNT_SQL.format(by='slide, sample'))}""")
def a13_sample(spark, d):
    return scoring.berden_scores(v.labels(spark, d), ["slide", "sample"], v.SCORE_IDS, mixed_rule=True)


@query("a14_slide_label", """
    with n as (select slide, count(*) filter (class = 0) as h, count(*) filter (class = 1) as u from objs group by slide)
    select tile, t.slide, least(floor(u::double / (h + u) * 4), 3)::int as label from tiles t join n using (slide) where h + u > 0""")
def a14(spark, d):
    known = bags.slide_labels(v.labels(spark, d))
    return bags.labelled_only(v.tiles(spark, d).select("tile", "slide"), known).join(known, "slide")


def made_bags(spark, d):
    return bags.bag_key(bags.make_bags(v.instances(spark, d)))


def written_bags(spark, d):
    """Bags as a table, for queries that use them more than once."""
    return checkpointed(made_bags(spark, d))


def labelled(spark, d, made):
    return pairing.label_bags(made, bags.slide_labels(v.instances(spark, d)))


@query("a15_bag_class_freq", "select c::int as label, (select count(*) from lbags where label = c) as n from range(0, 4) t(c)")
def a15(spark, d):
    return bags.bag_class_freq(labelled(spark, d, made_bags(spark, d)), 4)


@query("a16_bag_checks", """
    select bag, 'too small' as problem from kbags where instance % 97 <> 0 group by bag having count(*) < 9
    union all select distinct bag, 'no features' from kbags where instance % 97 <> 0 and instance % 31 = 0
    union all select null, 'labels not balanced' from (select min(n) as lo, max(n) as hi from (select label, count(*) as n from lbags group by label)) where lo <> hi""")
def a16(spark, d):
    made = written_bags(spark, d)
    broken = made.filter("instance % 97 <> 0")
    return bags.bag_problems(broken, v.features(spark, d).filter("instance % 31 <> 0"), labelled(spark, d, made), 9)


@query("a17_bag_summary", """
    select (select count(*) from lbags) as n_bags, (select sum(label)::bigint from lbags) as n_positive, (select (count(*) - sum(label))::bigint from lbags) as n_negative,
           min(x) as feat_min, max(x) as feat_max, round(avg(x), 8) as feat_mean from bagelements""")
def a17(spark, d):
    made = written_bags(spark, d)
    out = bags.bag_summary(made, v.features(spark, d), labelled(spark, d, made))
    return out.withColumn("feat_mean", F.round("feat_mean", 8))


@query("a18_bag_vector", """
    select bag, (row_number() over (partition by bag order by ord, dim) - 1)::int as pos, round(x, 6) as x from bagelements join kbags using (bag, instance)""")
def a18(spark, d):
    out = bags.bag_vectors(made_bags(spark, d), v.features(spark, d))
    return out.select("bag", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


QUERY_VECTOR = [(k % 7 - 3) / 4 for k in range(64)]


def bag_features(spark, d):
    """Pooling passes over its input twice, so the bags are written first; features are joined as they are read."""
    return written_bags(spark, d).select("bag", "instance").join(v.features(spark, d), "instance")


def by_dim(df, digits=6):
    return df.select("bag", F.posexplode("pooled").alias("pos", "x")).withColumn("x", F.round("x", digits))


@query("a19_pool_attention", """
    with s as (select bag, instance, sum(x * (((dim - 1) % 7 - 3) / 4.0::double)) as s from bagelements group by all),
         w as (select bag, instance, exp(s - max(s) over (partition by bag)) as e from s)
    select bag, (dim - 1)::int as pos, round(sum(e * x) / sum(e), 6) as x from w join bagelements using (bag, instance) group by bag, dim""")
def a19(spark, d):
    return by_dim(pooling.attention(bag_features(spark, d), QUERY_VECTOR))


@query("a19_attention_weights", """
    with s as (select bag, instance, sum(x * (((dim - 1) % 7 - 3) / 4.0::double)) as s from bagelements group by all),
         w as (select bag, instance, exp(s - max(s) over (partition by bag)) as e from s)
    select bag, instance, round(e / sum(e) over (partition by bag), 6) as weight from w""")
def a19_weights(spark, d):
    return pooling.attention_weights(bag_features(spark, d), QUERY_VECTOR).withColumn("weight", F.round("weight", 6))


@query("a20_pool_noisy_and", """
    with m as (select bag, avg(x) as m from bagelements group by bag)
    select bag, round((1 / (1 + exp(-10 * (m - 0.01))) - 1 / (1 + exp(0.1))) / (1 / (1 + exp(-9.9)) - 1 / (1 + exp(0.1))), 6) as score from m""")
def a20(spark, d):
    return pooling.noisy_and(bag_features(spark, d)).withColumn("score", F.round("score", 6))


@query("a21_pool_softmax_mean", """
    select bag, (dim - 1)::int as pos, round(sum(x * exp(x)) / sum(exp(x)), 6) as x from bagelements group by bag, dim""")
def a21(spark, d):
    return by_dim(pooling.softmax_mean(bag_features(spark, d)))


def verdicts(spark, d):
    """Matched class against a predicted one; 3 stands for false positives."""
    m = matching.match_predictions(v.preds(spark, d).select("tile", "pred", "x0", "y0", "w", "h"), v.boxes(spark, d), v.TILE)
    guess = ((F.col("tile") * 5 + F.col("pred") * 3) % 4).cast("int")
    return m.select("tile", "pred", F.coalesce("class", F.lit(3)).alias("truth"), guess.alias("predicted"))


@query("a22_confusion_matrix", """
    select t::int as truth, p::int as predicted, (select count(*) from verdicts where truth = t and predicted = p)::double / (select count(*) from verdicts) as share
    from range(0, 4) a(t) cross join range(0, 4) b(p)""")
def a22(spark, d):
    return metrics.confusion_matrix(verdicts(spark, d), 4)


@query("a23_macro_metrics", """
    with c as (select k, count(*) filter (truth = k and predicted = k)::double as tp, count(*) filter (truth <> k and predicted = k)::double as fp,
                      count(*) filter (truth = k and predicted <> k)::double as fn from verdicts cross join range(0, 4) t(k) group by k having tp + fp + fn > 0)
    select round((select avg((truth = predicted)::int) from verdicts), 8) as accuracy, round(avg(case when tp + fp > 0 then tp / (tp + fp) else 0 end), 8) as "precision",
           round(avg(case when tp + fn > 0 then tp / (tp + fn) else 0 end), 8) as recall, round(avg(case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end), 8) as f1 from c""")
def a23(spark, d):
    out = metrics.macro_metrics(verdicts(spark, d))
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query("a24_batch_mean_accuracy", """
    with r as (select (truth = predicted)::int as hit, row_number() over (order by md5(concat(tile, '_', pred, ':10')), concat(tile, '_', pred)) as r from verdicts),
         b as (select (r - 1) // 64 as b, avg(hit) as acc from r group by 1)
    select count(*) as n_batches, round(avg(acc), 8) as accuracy from b""")
def a24(spark, d):
    keyed = verdicts(spark, d).withColumn("key", F.concat_ws("_", "tile", "pred"))
    return metrics.batch_mean_accuracy(keyed, "key", 64).withColumn("accuracy", F.round("accuracy", 8))


@query("a25_tile_grid", """
    select slide, sample_n, n_i::int as n_i, n_j::int as n_j, (n_i * n_j)::int as n_tiles from (
        select slide, sample_n, (y1 - y0 - 1024) // 512 + 1 as n_i, (x1 - slide % 3 * 200 - x0 - 1024) // 512 + 1 as n_j from rects)""")
def a25(spark, d):
    r = v.rects(spark, d).withColumn("x1", F.col("x1") - F.col("slide") % 3 * 200)
    return tiling.tile_grid(r, 1024, 512).select("slide", "sample_n", "n_i", "n_j", "n_tiles")


@query("a25_tile_windows", """
    select slide, sample_n, i::int as i, j::int as j, (j * 1024)::int as x, (i * 1024)::int as y
    from rects cross join range(0, 3) a(i) cross join range(0, 1) b(j)""")
def a25_windows(spark, d):
    return tiling.tile_windows(v.rects(spark, d), v.TILE, 1024)


@query("a26_sample_count", "select slide, (max(sample_n) + 1)::int as n_samples from rects group by slide")
def a26(spark, d):
    return tiling.sample_count(v.rects(spark, d))


@query("a27_rasterise_boxes", """
    with c as (select tile, obj, class, cx, cy from boxes join range(0, 32) a(cx) on cx between x0 // 64 and (x0 + w) // 64
               join range(0, 32) b(cy) on cy between y0 // 64 and (y0 + h) // 64)
    select tile, cx::int as cell_x, cy::int as cell_y, max(obj) as "object", (arg_max(class, obj) + 1)::int as class_mark from c group by tile, cx, cy""")
def a27(spark, d):
    return tiling.rasterise(v.boxes(spark, d), 64, v.TILE)


@query("a28_fold_inventory", """
    select fold, tile, count(*) over (partition by fold) as n_in_fold, 'exp1' as run from ftiles""")
def a28(spark, d):
    return profile.fold_inventory(v.folded_tiles(spark, d), "exp1")


@query("w1_dedup_rows_keep_first", """
    select doc_id, line, min(pos)::int as pos from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
    group by doc_id, line""")
def w1(spark, d):
    return labels.first_lines(labels.lines_of(v.table(spark, d, "documents"), "text", "doc_id"), "doc_id")


@query("w2_interpolate_vertices", """
    with a as (select *, lead(x) over w as nx, lead(y) over w as ny from vertices window w as (partition by tile, obj order by ord)),
         b as (select tile, obj, ord * 2 as ord, x, y from a union all
               select tile, obj, ord * 2 + 1, trunc((x + nx) / 2.0)::bigint, trunc((y + ny) / 2.0)::bigint from a where nx is not null)
    select tile, obj, count(*)::int as n, '[' || string_agg('{' || x || ', ' || y || '}', ', ' order by ord) || ']' as ring from b group by tile, obj""")
def w2(spark, d):
    more = g.midpoints(F.col("vertices"))
    rows = v.objects(spark, d).select("tile", "obj", more.alias("m"))
    return rows.select("tile", "obj", F.size("m").alias("n"), g.vertex_text(F.col("m")).alias("ring"))


@query("w3_insert_corner", """
    with p as (select slide, tile, obj, i, j, x - j * 1024 as x, y - i * 1024 as y, row_number() over (partition by tile, obj, i, j order by ord) as ord
               from vertices join range(0, 5) tj(j) on x >= j * 1024 and x < j * 1024 + 2048 join range(0, 3) ti(i) on y >= i * 1024 and y < i * 1024 + 2048),
         s as (select *, case when x <= 0.15::double * 2048 then 0 when x >= 0.85::double * 2048 then 1 end as bx,
                         case when y <= 0.15::double * 2048 then 0 when y >= 0.85::double * 2048 then 1 end as by_ from p),
         l as (select *, lag(bx) over w as lx, lag(by_) over w as ly from s window w as (partition by tile, obj, i, j order by ord)),
         h as (select *, case when lx is not null and by_ is not null then '{' || (lx * 2048) || ', ' || (by_ * 2048) || '}' when ly is not null and bx is not null then '{' || (bx * 2048) || ', ' || (ly * 2048) || '}' end as corner from l),
         f as (select *, row_number() over (partition by tile, obj, i, j, corner is not null order by ord) as nth from h)
    select tile, obj, i::int as i, j::int as j, '[' || string_agg(case when corner is not null and nth = 1 then corner || ', ' else '' end || '{' || x || ', ' || y || '}', ', ' order by ord) || ']' as ring
    from f group by tile, obj, i, j""")
def w3(spark, d):
    # Borders this wide make jumps common in the stand-in outlines; the default is 0.005.
    ring = g.with_corner(F.col("vertices"), v.TILE, v.TILE, 0.15)
    return polygons(spark, d).select("tile", "obj", "i", "j", g.vertex_text(ring).alias("ring"))


@query("w4_kfold_contiguous", """
    with f as (select slide, (5 * row_number() over (order by slide) - 1) // count(*) over () as fold_n from slides)
    select slide, fold_n::int as fold_n, s::int as split, case when s = fold_n then 'val' else 'train' end as fold from f cross join range(0, 5) t(s)""")
def w4(spark, d):
    return folds.rotations(folds.contiguous_folds(v.slides(spark, d), "slide", 5), 5).select("slide", "fold_n", "split", "fold")


GROUPED_SQL = "with f as (select slide, (4 * row_number() over (order by slide) - 1) // count(*) over () as fold_n from slides) "


@query("w5_kfold_grouped", GROUPED_SQL + "select tile, slide, fold_n::int as fold_n from tiles join f using (slide)")
def w5(spark, d):
    return folds.grouped_folds(v.tiles(spark, d), "slide", 4).select("tile", "slide", "fold_n")


@query("w5_fold_balance", GROUPED_SQL.replace("from slides", "from (select distinct slide from objs)") + """
    select s::int as split, case when s = fold_n then 'val' else 'train' end as fold, class, count(*) as n
    from objs join f using (slide) cross join range(0, 4) t(s) group by all""")
def w5_balance(spark, d):
    return folds.fold_balance(folds.grouped_folds(v.labels(spark, d), "slide", 4), 4)


@query("w6_latest_run", "select arg_max(exp, (ts, event_id)) as exp, epoch_us(max(ts)) as ts_us from runs")
def w6(spark, d):
    return runs.latest_run(v.runs(spark, d)).select("exp", F.unix_micros("ts").alias("ts_us"))


@query("w6_latest_n", "select exp, epoch_us(min(ts)) as created_us from runs group by exp order by min(ts) desc, exp desc limit 3")
def w6_n(spark, d):
    return runs.latest_runs(v.runs(spark, d), 3).select("exp", F.unix_micros("created").alias("created_us"))


RUN_STATUS_SQL = """
    select exp, arg_max(status, (ts, event_id)) as status, epoch_us(min(ts)) as started_us, epoch_us(max(ts)) as updated_us from runs group by exp"""


@query("w8_run_status", RUN_STATUS_SQL.replace(" from runs", """,
    epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as seconds from runs"""))
def w8(spark, d):
    s = runs.run_status(v.runs(spark, d))
    return s.select("exp", "status", F.unix_micros("started").alias("started_us"), F.unix_micros("updated").alias("updated_us"), "seconds")


@query("w9_make_bags", "select slide, bag_n, ord, instance from bags")
def w9(spark, d):
    return bags.make_bags(v.instances(spark, d))


@query("w10_best_epoch", """
    select exp, arg_min(epoch, (-"precision", epoch)) as epoch, max("precision") as "precision" from epochs group by exp""")
def w10(spark, d):
    return runs.best_epoch(v.epochs(spark, d), "precision")


@query("w10_best_so_far", """
    select exp, epoch, "precision" from (select *, max("precision") over (partition by exp order by epoch rows between unbounded preceding and 1 preceding) as b from epochs)
    where b is null or "precision" > b""")
def w10_so_far(spark, d):
    return runs.best_so_far(v.epochs(spark, d), "precision").select("exp", "epoch", "precision")


@query("w11_learning_curve", 'select exp, epoch, "precision", recall from epochs order by exp, epoch')
def w11(spark, d):
    return runs.learning_curve(v.epochs(spark, d), ["precision", "recall"])
