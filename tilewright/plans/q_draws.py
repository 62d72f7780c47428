"""Queries over splits, samples and bags drawn at random."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import bags, pairing, sampling
from tilewright.plans import views as v
from tilewright.plans.registry import query
from tilewright.session import checkpointed


@query("l1_split_random", """
    with r as (select slide, row_number() over (order by md5(concat(slide, ':10')), slide) as r, count(*) over () as n from slides)
    select slide, case when r <= round_even(0.2::double * n, 0) then 'val' when r <= round_even(0.2::double * n, 0) + floor(0.1::double * n) then 'test' else 'train' end as fold from r""")
def l1(spark, d):
    return sampling.split_random(v.slides(spark, d).select("slide"), "slide", [0.7, 0.2, 0.1])


@query("l1_split_two_way", """
    with r as (select slide, row_number() over (order by md5(concat(slide, ':11')), slide) as r, count(*) over () as n from slides)
    select slide, case when r <= round_even(0.25::double * n, 0) then 'val' else 'train' end as fold from r""")
def l1_two(spark, d):
    return sampling.split_random(v.slides(spark, d).select("slide"), "slide", [0.75, 0.25], seed=11)


def statuses(spark, d):
    return pairing.flag_empty(v.folded_tiles(spark, d), v.labels(spark, d).select("tile"), ["tile"])


RANKED = "select *, row_number() over (partition by is_empty order by md5(concat(tile, ':10')), tile) as r from statuses"


@query("l2_split_tiles_with_empties", f"""
    with r as ({RANKED}), n as (select count(*) as f, round_even(0.2::double * count(*), 0)::bigint as v, round_even(0.1::double * count(*), 0)::bigint as t from r where not is_empty),
         c as (select *, floor(0.01::double * floor((f - v - t) * 1.01::double))::bigint as e from n)
    select tile, slide, case when is_empty then 'train' when r <= v then 'val' when r <= v + t then 'test' else 'train' end as fold, is_empty
    from r cross join c where not is_empty or r <= e""")
def l2(spark, d):
    tiles = statuses(spark, d).drop("fold")
    return sampling.split_with_empties(tiles, "tile", [0.7, 0.2, 0.1], 0.01).select("tile", "slide", "fold", "is_empty")


@query("l3_downsample_empty", f"""
    with r as ({RANKED}), n as (select count(*) as f from r where not is_empty)
    select tile, slide, fold, is_empty from r cross join n where not is_empty or r <= round_even(f / 0.99::double, 0) - f""")
def l3(spark, d):
    return sampling.downsample_empty(statuses(spark, d), "tile", 0.01).select("tile", "slide", "fold", "is_empty")


@query("l4_downsample_empty_train", """
    with r as (select *, row_number() over (partition by is_empty order by md5(concat(tile, ':10')), tile) as r from statuses where fold = 'train'),
         n as (select count(*) filter (not is_empty) as f, count(*) as a from r)
    select tile, slide, fold, is_empty from r cross join n where not is_empty or (a - f)::double / a <= 0.005 or r <= floor(f * 1.005::double) - f
    union all select tile, slide, fold, is_empty from statuses where fold <> 'train'""")
def l4(spark, d):
    return sampling.downsample_empty_train(statuses(spark, d), "tile", 0.005).select("tile", "slide", "fold", "is_empty")


def keyed_boxes(spark, d):
    return v.boxes(spark, d).select("class", F.concat_ws("_", "tile", "obj").alias("key"))


BY_CLASS = """select class, concat(tile, '_', obj) as key, row_number() over (partition by class order by md5(concat(tile, '_', obj, ':10')), concat(tile, '_', obj)) as r,
    count(*) over (partition by class) as n from boxes"""


@query("l5_split_stratified", f"""
    with r as ({BY_CLASS}) select class, key, case when r <= round_even(0.2::double * n, 0) then 'test' else 'train' end as fold from r""")
def l5(spark, d):
    return sampling.split_stratified(keyed_boxes(spark, d), "key", "class")


@query("l6_oversample_to_max", f"""
    with r as ({BY_CLASS}), m as (select max(n) as m from r),
         c as (select class, key, (m - n) // n + case when r <= (m - n) % n then 1 else 0 end as k from r cross join m)
    select class, key, null::int as copy from c union all select class, key, unnest(range(0, k))::int from c""")
def l6(spark, d):
    return sampling.oversample(keyed_boxes(spark, d), "key", "class")


@query("l6_drop_copies", "select class, concat(tile, '_', obj) as key from boxes")
def l6_originals(spark, d):
    return sampling.originals(sampling.oversample(keyed_boxes(spark, d), "key", "class")).drop("copy")


@query("l7_pad_small_slides", """
    with s as (select slide, 30 - count(*) as lack, count(*) filter (class = 2) as own from instances group by slide having count(*) < 30),
         fp as (select slide as owner, instance, row_number() over (order by md5(concat(instance, ':10')), instance) as place,
                       row_number() over (partition by slide order by md5(concat(instance, ':10')), instance) as r from instances where class = 2),
         m as (select count(*) as m from fp),
         a as (select slide, own, lack, k, (('0x' || substr(md5(concat(slide, ':10s')), 1, 12))::bigint % m + k) % m + 1 as place
               from (select *, unnest(range(0, least(lack, m))) as k from s cross join m where lack > own)),
         b as (select a.slide, fp.instance, own, lack, row_number() over (partition by a.slide order by k) as r from a join fp using (place) where owner <> a.slide)
    select slide, instance, r::int as ord from s join fp on owner = slide where r <= lack
    union all select slide, instance, (own + r)::int from b where r <= lack - own""")
def l7(spark, d):
    return bags.pad_small_slides(v.instances(spark, d), 30)


@query("l8_balance_bags", """
    with c as (select l as label, (select count(*) from lbags where label = l) as n from range(0, 4) t(l)), m as (select max(n) as m from c),
         able as (select slide, any_value(size) as size, label from bagrank join ilabels using (slide) group by slide, label having any_value(size) >= 9),
         q as (select *, row_number() over (partition by label order by md5(concat(slide, ':10')), slide) as seat, count(*) over (partition by label) as seats from able),
         due as (select slide, q.label, size, (m - n - seat) // seats + 1 as turns from q join c using (label) cross join m where m - n >= seat),
         want as (select slide, label, size, t, i from (select *, unnest(range(0, turns)) as t from due) cross join range(0, 9) x(i))
    select w.slide, w.label, w.t as turn, w.i::int as ord, b.instance from want w join bagrank b on b.slide = w.slide and b.rank = (w.t * 9 + w.i) % w.size + 1""")
def l8(spark, d):
    i = v.instances(spark, d)
    known = bags.slide_labels(i)
    made = pairing.label_bags(bags.bag_key(bags.make_bags(i)), known)
    freq = checkpointed(bags.bag_class_freq(made, 4))  # four rows that the balancing reads twice
    return bags.balance_bags(i, freq, known)


@query("l9_random_k", """
    select tile, slide, sample from tiles where tile in (select tile from objs) order by md5(concat(tile, ':10')), tile limit 6""")
def l9(spark, d):
    return sampling.random_k(v.tiles(spark, d), v.labels(spark, d), "tile")


@query("l10_limit_bags", "select distinct bag from kbags order by bag limit 20")
def l10(spark, d):
    return bags.first_bags(bags.bag_key(bags.make_bags(v.instances(spark, d))), 20)
