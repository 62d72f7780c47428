"""Split numbering equals one window, whatever the group sizes."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions.draws import draw, slot
from tilewright.operators import bags, folds, ranks, runs, sampling
from tilewright.plans import views


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group."""
    ids = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100))
    return ids.withColumn("d", draw("id"))


def window_rank(df, by):
    return df.withColumn("want", F.row_number().over(Window.partitionBy(*by).orderBy("d", "id")))


def test_split_rank(skewed):
    got = ranks.split_rank(skewed, ["g"], [slot(F.col("d"), 1)], ["d", "id"])
    assert window_rank(got, ["g"]).filter("rank <> want").count() == 0 and got.count() == 3000


def test_split_rank_of_the_whole_table(skewed):
    got = ranks.split_rank(skewed, [], [slot(F.col("d"), 1)], ["d", "id"])
    assert [r.rank for r in got.orderBy("d", "id").collect()] == list(range(1, 3001))


@pytest.mark.parametrize("rows", [10, 500, 10_000])
def test_group_rank(skewed, rows):
    got = ranks.group_rank(skewed, ["g"], [slot(F.col("d"), 1)], ["d", "id"], rows=rows)
    assert window_rank(got, ["g"]).filter("rank <> want").count() == 0 and got.count() == 3000


def test_a_hot_group_is_spread_even_if_the_input_is_hashed_on_it(skewed):
    got = ranks.split_rank(skewed.repartition(8, "g"), ["g"], [slot(F.col("d"), 2)], ["d", "id"])
    assert "REPARTITION_BY_COL" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [1, 8])
def test_first_n(skewed, n):
    got = ranks.first_n(skewed, ["g"], "d", "id", n)
    want = window_rank(skewed, ["g"]).filter(F.col("want") <= n)
    assert got.select("g", "id", "rank").exceptAll(want.select("g", "id", "want")).isEmpty() and got.count() == want.count()


def test_global_rank(spark):
    names = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("n"))
    got = ranks.global_rank(names, ["n"]).orderBy("n").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))


@pytest.mark.parametrize("cut", [0, 1, 299, 1000, 5000])
def test_parts_by_draw(skewed, cut):
    df = skewed.filter("g = 0").drop("d")
    got = ranks.parts_by_draw(df, draw("id"), "id", [lambda *_: F.lit(cut)])
    want = df.withColumn("r", F.row_number().over(Window.orderBy(draw("id"), "id"))).filter(F.col("r") <= cut)
    first = got.filter("part = 0").select("id")
    assert first.count() == min(cut, df.count()) and first.exceptAll(want.select("id")).isEmpty()


def test_boxes_of_hot_tiles_get_the_same_numbers(spark, sf):
    plain, hot = views.boxes(spark, sf), views.boxes(spark, sf, hot_rows=3)
    assert plain.exceptAll(hot).isEmpty() and hot.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("k", [2, 3, 7])
def test_folds_are_disjoint_complete_and_cut_like_linspace(spark, k):
    names = spark.createDataFrame([(f"s{i:03d}",) for i in range(25)], "slide string")
    got = {r.slide: r.fold_n for r in folds.contiguous_folds(names, "slide", k).collect()}
    cuts = [int(25 * i / k) for i in range(k + 1)]
    assert [got[f"s{i:03d}"] for i in range(25)] == [next(f for f in range(k) if cuts[f] <= i < cuts[f + 1]) for i in range(25)]


def test_bags_have_n_instances_and_full_cover(spark):
    i = spark.range(2000).select(F.col("id").alias("instance"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("slide"))
    for hot in (100, 10**6):
        b = bags.bag_key(bags.make_bags(i, 9, hot_rows=hot))
        assert b.groupBy("bag").count().filter("count <> 9").isEmpty()
        assert b.groupBy("bag").agg(F.count_distinct("ord").alias("o")).filter("o <> 9").isEmpty()
        assert b.groupBy("bag").agg(F.count_distinct("instance").alias("o")).filter("o <> 9").isEmpty()
        assert b.select("instance").distinct().count() == 2000
    one = bags.make_bags(i, 9, hot_rows=100)
    assert one.exceptAll(bags.make_bags(i, 9)).isEmpty()


def test_a_bag_of_exactly_n_is_not_topped_up(spark):
    i = spark.range(9).select(F.col("id").alias("instance"), F.lit(1).alias("slide"))
    assert bags.make_bags(i, 9).count() == 9


def test_padding_reaches_n_without_repeats(spark):
    rows = [(k, k // 4, 2 if k % 4 < 2 else 0) for k in range(40)]
    i = spark.createDataFrame(rows, "instance int, slide int, class int")
    extra = bags.pad_small_slides(i, 9)
    per = extra.groupBy("slide").agg(F.count("*").alias("n"), F.count_distinct("instance").alias("d"), F.max("ord").alias("o")).collect()
    assert len(per) == 10 and all(r.n == r.d == r.o == 5 for r in per)
    own = extra.join(i.select("instance", F.col("slide").alias("owner")), "instance").filter("owner = slide")
    assert own.groupBy("slide").agg(F.count("*").alias("n"), F.max("ord").alias("o")).filter("n <> 2 or o <> 2").isEmpty()


def test_oversampling_evens_out_classes(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") < 70, 0).when(F.col("id") < 93, 1).otherwise(2).alias("class"))
    out = sampling.oversample(df, "k", "class")
    assert {r["count"] for r in out.groupBy("class").count().collect()} == {70}
    assert sampling.originals(out).count() == 100 and out.groupBy("k", "copy").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_best_so_far_over_slices(spark, width):
    curve = spark.createDataFrame([("a", e, v) for e, v in enumerate([1.0, 1.0, 3.0, 2.0, 4.0, 4.0, 5.0], 1)], "exp string, epoch int, value double")
    assert sorted(r.epoch for r in runs.best_so_far(curve, slice_epochs=width).collect()) == [1, 3, 5, 7]
    assert runs.best_epoch(curve).first().epoch == 7


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
def test_range_rank(skewed, by):
    df = skewed.withColumns({"h": F.col("id") % 2 == 0, "g": F.when(F.col("g") != 7, F.col("g"))})
    got = ranks.range_rank(df, by, ["d", "id"])
    want = df.withColumn("want", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("d", "id")))
    assert got.columns == [*df.columns, "rank"] and got.count() == 3000
    assert got.join(want.select("id", "want"), "id").filter("rank <> want").isEmpty()


def test_a_log_of_one_minute_is_spread(spark, monkeypatch):
    """All entries of an experiment in one minute: many tasks number them, with the ranks of one window."""
    log = spark.range(20_000).selectExpr(
        "case when id % 20 = 0 then id % 7 else 99 end as exp", "20000 - id as event_id", "timestamp_micros(1700000000000000 + (id * 7919) % 59000000) as ts", "id % 13 / 13.0D as precision"
    )
    parts = []
    real = ranks.stored
    monkeypatch.setattr(ranks, "stored", lambda df, name: (parts.append(real(df, name)), parts[-1])[1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.group_rank(log, ["exp"], None, ["ts", "event_id"], "epoch", rows=5_000)
        want = log.withColumn("epoch", F.row_number().over(Window.partitionBy("exp").orderBy("ts", "event_id")).cast("bigint"))
        assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [r["count"] for r in parts[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5_000
    best = runs.best_epoch(got, "precision").filter("exp = 99").first()
    assert best.epoch == want.filter("exp = 99 and precision = 12 / 13.0D").agg(F.min("epoch")).first()[0]


def test_epochs_of_hot_experiments_get_the_same_numbers(spark, sf):
    plain, cut = views.epochs(spark, sf), views.epochs(spark, sf, hot_rows=20)
    assert plain.exceptAll(cut).isEmpty() and plain.count() == cut.count()


def test_cuts_do_not_bring_a_group_to_one_task(spark):
    """Nothing is dealt by the group alone, even where the optimiser broadcasts nothing by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2_000).selectExpr("id as key", "if(id < 1500, 0, 1) as class")
        split = sampling.split_stratified(df, "key", "class")
        plan = split._jdf.queryExecution().executedPlan().toString()
        # What is left of the plan's joins of the whole table are broadcast joins.
        assert plan.count("SortMergeJoin") <= 1 and "LeftOuter, BuildRight" in plan
        assert sorted((r["class"], r["fold"], r["count"]) for r in split.groupBy("class", "fold").count().collect()) == [(0, "test", 300), (0, "train", 1200), (1, "test", 100), (1, "train", 400)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
