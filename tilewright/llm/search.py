"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments; each block of the index has a table per segment. A query looks up its own
segments first, then all segment values within radius 1, 2, ... After radius r has been searched in the first
j segments (and r - 1 in the others), every code not yet seen is at least j * (r + 1) + (m - j) * r bits away;
once the kth verified distance is below that, the answer is complete. No parameter trades recall for speed.

Equal codes are one entry that carries its k + 1 smallest ids, so a code that a third of all rows share costs
what any other does. The index is dealt over blocks of codes and the queries over blocks of queries; each pair
of blocks is one task with bounded tables, and only its top k leave it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.text import spread

BLOCK_CODES = 100_000
BLOCK_QUERIES = 20_000


def sign_code(vector: Column, bits: int = 64) -> Column:
    """One bit per dimension: set where the value is positive. Missing dimensions are 0; a null vector has no code."""
    each = [F.when(F.get(vector, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")) for i in range(bits)]
    return F.when(vector.isNotNull(), reduce(lambda a, b: a.bitwiseOR(b), each))


def segment_bits(codes: int, bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: about log2(codes) wide, as evenly as possible, 16 at most."""
    width = min(16, max(4, round(np.log2(max(2, codes)))))
    m = -(-bits // width)
    edges = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def flips(width: int, radius: int) -> np.ndarray:
    """All masks of `width` bits with `radius` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


class MultiIndex:
    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.parts = codes.view(np.uint64), segment_bits(len(codes), bits)
        self.tables = []
        for first, width in self.parts:
            value = ((self.codes >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << width) + 1)), order))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def search(self, query: np.uint64, need: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, distances) holding every entry at most as far as the kth id; `need`: ids an entry stands for."""
        seen = np.zeros(len(self.codes), bool)
        entries, distances = [], []
        within = np.zeros(130, np.int64)  # ids found at each distance
        m = len(self.parts)
        for radius in range(max(w for _, w in self.parts) + 1):
            for j, (first, width) in enumerate(self.parts):
                if radius <= width:
                    if (width, radius) not in self.masks:
                        self.masks[width, radius] = flips(width, radius)
                    edges, order = self.tables[j]
                    probe = self.masks[width, radius] ^ (int(query >> np.uint64(first)) & ((1 << width) - 1))
                    found = order[spread(edges[probe], edges[probe + 1] - edges[probe])]
                    found = found[~seen[found]]
                    seen[found] = True
                    far = np.bitwise_count(self.codes[found] ^ query).astype(np.int64)
                    entries.append(found)
                    distances.append(far)
                    within += np.bincount(far, weights=need[found], minlength=130).astype(np.int64)
                sure = (j + 1) * (radius + 1) + (m - j - 1) * radius  # nothing unseen is nearer than this
                if within[:sure].sum() >= k:
                    e, d = np.concatenate(entries), np.concatenate(distances)
                    return e[d < sure], d[d < sure]
        return np.concatenate(entries), np.concatenate(distances)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, bits: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, neighbor_id, rank, distance): for each row where `queries` holds, its k nearest other rows.

    Distance is Hamming distance of sign codes; ties go to the smaller id, so the result is unique. Rows with a
    null key or vector have no code: they find nothing and are not found. Rows that repeat an id count once per
    code. Fewer than k other rows give fewer results; an empty table none. Other columns are ignored.
    """
    # A key of another type than long keeps it; ids are only compared.
    coded = vectors.select(F.col(key).alias("id"), sign_code(F.col(vector), bits).alias("code"), F.coalesce(queries, F.lit(False)).alias("asks"))
    coded = coded.filter("id is not null and code is not null")
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    first = lambda by: Window.partitionBy(*by).orderBy("id")
    # The k + 1 smallest ids of each code, first per salt and then over the few that are left.
    few = coded.groupBy("id", "code").agg(F.max("asks").alias("asks")).withColumn("salt", salt)
    few = few.withColumn("r", F.row_number().over(first(["code", "salt"]))).filter(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(first(["code"]))).filter(F.col("r") <= k + 1)
    index = few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asking = coded.filter("asks").select("code").distinct()
    n_codes, n_queries = index.count(), asking.count()
    blocks, turns = max(1, -(-n_codes // BLOCK_CODES)), max(1, -(-n_queries // BLOCK_QUERIES))
    spot = lambda n: F.pmod(F.xxhash64(F.lit("spot"), "code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = index.withColumn("block", spot(blocks)).withColumn("turn", every(turns))
    asking = asking.withColumn("turn", spot(turns)).withColumn("block", every(blocks))

    def search(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(codes) and len(asked):
            table = MultiIndex(codes["code"].to_numpy(np.int64), bits)
            ids = codes["ids"].tolist()
            need = np.fromiter(map(len, ids), np.int64, len(ids))
            for q in asked["code"].to_numpy(np.int64).view(np.uint64):
                entry, far = table.search(q, need, k + 1)
                near = sorted((int(d), i) for e, d in zip(entry, far) for i in ids[e])[: k + 1]
                out += [(int(q.view(np.int64)), i, d) for d, i in near]
        return pd.DataFrame(out, columns=["code", "neighbor_id", "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    found = index.groupBy("block", "turn").cogroup(asking.groupBy("block", "turn")).applyInPandas(search, f"code long, neighbor_id {kind}, distance int")
    best = Window.partitionBy("code").orderBy("distance", "neighbor_id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    pairs = coded.filter("asks").select(F.col("id").alias("query_id"), "code").distinct().join(found, "code").filter("query_id <> neighbor_id")
    order = Window.partitionBy("query_id", "code").orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", "distance")
