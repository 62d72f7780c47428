"""Random splits, down- and oversampling. Random means: in the order of `draw(key, seed)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.draws import SEED, draw
from tilewright.operators.ranks import parts_by_draw
from tilewright.session import stored


def _named(df: DataFrame, names: list[str], out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.get(F.array(*[F.lit(n) for n in names]), F.col("part"))).drop("part")


def split_random(df: DataFrame, key: str, ratio: list[float], seed: int = SEED, round_test: bool = False) -> DataFrame:
    """`fold` = val for round(ratio[1]·n) rows, test for int(ratio[2]·n) of the next, train for the rest.

    Whole slides are cut with int() for test; tiles with round() (`round_test`).
    """
    val = lambda n, *_: F.bround(F.lit(float(ratio[1])) * n)
    cuts, names = [val], ["val", "train"]
    if len(ratio) == 3:
        test = lambda n: F.lit(float(ratio[2])) * n
        cuts.append(lambda n, *_: val(n) + (F.bround(test(n)) if round_test else F.floor(test(n))))
        names = ["val", "test", "train"]
    return _named(parts_by_draw(df, draw(key, seed=seed), key, cuts), names)


def split_with_empties(tiles: DataFrame, key: str, ratio: list[float], empty_share: float, seed: int = SEED) -> DataFrame:
    """Full tiles are split three ways; train then takes int(p·int(train·(1+p))) empty tiles, the others drop out.

    `tiles` carries `is_empty`. Cuts take several passes, so the tiles are written once, with their draw.
    """
    tiles = _drawn(tiles, key, seed)

    def train_size(full):
        return full - F.bround(F.lit(float(ratio[1])) * full) - F.bround(F.lit(float(ratio[2])) * full)

    def extra(n, everything, _):
        wished = F.floor(train_size(everything - n) * (1 + empty_share))
        return F.floor(F.lit(float(empty_share)) * wished)

    val = lambda n: F.bround(F.lit(float(ratio[1])) * n)
    test = lambda n: F.bround(F.lit(float(ratio[2])) * n)
    full = _named(
        parts_by_draw(tiles.filter("not is_empty"), F.col("_draw"), key,
                      [lambda n, *_: val(n), lambda n, *_: val(n) + test(n)]),
        ["val", "test", "train"],
    )
    # The cut for the empty tiles depends on the number of full ones, so both are counted together.
    spare = parts_by_draw(tiles, F.col("_draw"), key, [extra], by=["is_empty"])
    taken = spare.filter("is_empty and part = 0").withColumn("fold", F.lit("train")).drop("part")
    return full.unionByName(taken).drop("_draw")


def _drawn(tiles: DataFrame, key: str, seed: int) -> DataFrame:
    return stored(tiles.withColumn("_draw", draw(key, seed=seed)), "drawn")


def _keep_empties(tiles: DataFrame, key: str, wished, seed: int) -> DataFrame:
    """`tiles` are written once, with their draw: flags come from a join, and three passes follow."""
    kept = parts_by_draw(_drawn(tiles, key, seed), F.col("_draw"), key, [wished], by=["is_empty"])
    return kept.filter(~F.col("is_empty") | (F.col("part") == 0)).drop("part", "_draw")


def downsample_empty(tiles: DataFrame, key: str, share: float = 0.1, seed: int = SEED) -> DataFrame:
    """Empty tiles are cut down to `share` of all tiles; nothing happens if they are fewer already."""
    wished = lambda n, everything, _: F.bround((everything - n) / (1 - share)) - (everything - n)
    return _keep_empties(tiles, key, wished, seed)


def downsample_empty_train(tiles: DataFrame, key: str, share: float = 0.1, seed: int = SEED) -> DataFrame:
    """In train int(full·(1+p)) tiles remain in all, unless the share of empties is at most p already."""

    def wished(n, everything, _):
        full = everything - n
        return F.when(n / everything <= share, n).otherwise(F.floor(full * (1 + share)) - full)

    tiles = stored(tiles, "tiles")
    train = _keep_empties(tiles.filter("fold = 'train'"), key, wished, seed)
    return tiles.filter("fold <> 'train'").unionByName(train)


def split_stratified(df: DataFrame, key: str, by: str, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Train and test with equal class shares: round(test·n) rows of every class are test."""
    cut = lambda n, *_: F.bround(F.lit(float(test)) * n)
    return _named(parts_by_draw(df, draw(key, seed=seed), key, [cut], by=[by]), ["test", "train"])


def oversample(df: DataFrame, key: str, by: str, seed: int = SEED) -> DataFrame:
    """Every class is filled up to the largest one with copies of its rows; `copy` is null for originals.

    A class that lacks `need` rows copies each of its n rows need div n times, and need mod n of them,
    drawn at random, once more.
    """
    extra = lambda n, _, most: (most - n) % n
    sized = parts_by_draw(df, draw(key, seed=seed), key, [extra], by=[by], sizes_as=("_n", "_most"))
    copies = F.floor((F.col("_most") - F.col("_n")) / F.col("_n")) + (F.col("part") == 0).cast("int")
    numbers = F.sequence(F.lit(0), copies.cast("int"))
    rows = sized.withColumn("_m", F.explode(numbers))
    return rows.withColumn("copy", F.when(F.col("_m") > 0, F.col("_m") - 1)).drop("_n", "_most", "_m", "part")


def originals(df: DataFrame) -> DataFrame:
    """Drop the copies again."""
    return df.filter(F.col("copy").isNull())


def random_k(tiles: DataFrame, labels: DataFrame, key: str, k: int = 6, seed: int = SEED) -> DataFrame:
    """k random tiles that have both image and label rows; a per-task top k, not a full sort."""
    both = tiles.join(labels.select(key).distinct(), key, "left_semi")
    return both.withColumn("_d", draw(key, seed=seed)).orderBy("_d", key).limit(k).drop("_d")
