"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features are hashes of single words and word pairs, in two views: the words as they are, and their shapes
(the order-free set of changes between character classes, so `heat***` and `the***` look alike), and of word
triples seen earlier in the text. A feature's value is its share of the text's n-grams. Training data is a
bounded sample of labelled rows (`sample` of them, drawn by hash, a documented parameter); everything is
scored. Each of `learners` tasks trains on its part of the sample, and their weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import text as tx

DIMS = 1 << 18
SAMPLE = 8192
LEARNERS = 8
SCALE = 8.0

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[97:123] = _CLASS[128:256] = 2
_CLASS[48:58] = 3
for _b in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_b] = _b
_CHANGES = tx.mix(np.arange(1, 256 * 256 + 1, dtype=np.uint64)).reshape(256, 256)


def _shapes(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    kinds = _CLASS[raw]
    step = np.zeros(len(raw), np.uint64)
    step[1:] = np.where(kinds[1:] != kinds[:-1], _CHANGES[kinds[:-1], kinds[1:]], 0)
    total = np.append(np.uint64(0), np.cumsum(step))
    # A word's first byte is judged by its own class, not by what stands before the word.
    return tx.mix(total[end] - total[first + 1] + _CHANGES[0, kinds[first]])


def slice_features(raw: np.ndarray, starts: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram of the slice, rows rising; feature 0 is left for the bias."""
    first, end, before = tx.words(raw, starts)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = tx.row_of(before)
    code, shape = tx.word_codes(raw, first, end), _shapes(raw, first, end)
    pair = np.flatnonzero(row[1:] == row[:-1])
    found = [(row, code), (row[pair], tx.Rolling(code).grams(2)[pair]), (row, ~shape), (row[pair], ~tx.Rolling(shape).grams(2)[pair])]
    if len(row) > 2:
        three = np.flatnonzero(row[2:] == row[:-2])
        grams = tx.mix(tx.Rolling(code).grams(3)[three] ^ tx.mix(row[three].astype(np.uint64)))
        order = np.argsort(grams, kind="stable")
        later = order[1:][grams[order[1:]] == grams[order[:-1]]]
        again = np.sort(row[three[later]])
        found.append((again, np.full(len(again), 12345, np.uint64)))
    rows = np.concatenate([r for r, _ in found])
    features = np.concatenate([(tx.mix(c) % np.uint64(dims - 1)).astype(np.int64) + 1 for _, c in found])
    return rows, features


def train(texts: list[str], labels: np.ndarray, dims: int = DIMS, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> np.ndarray:
    """Weights after `epochs` passes of per-coordinate follow-the-regularised-leader; weight 0 is the bias."""
    rows = []
    for at, raw, starts in tx.slices(pa.array(texts, pa.string())):
        r, f = slice_features(raw, starts, dims)
        order = np.argsort(r, kind="stable")
        cut = np.searchsorted(r[order], np.arange(len(starts)))
        for k in range(len(starts) - 1):
            feature, count = np.unique(f[order[cut[k] : cut[k + 1]]], return_counts=True)
            value = SCALE * count / max(1, count.sum())
            rows.append((np.append(0, feature), np.append(1.0, value)))
    z, n = np.zeros(dims), np.zeros(dims)
    shrink = np.full(dims, l1)
    shrink[0] = 0

    def weights(at=slice(None)):
        push = np.sign(z[at]) * np.maximum(np.abs(z[at]) - shrink[at], 0)
        return -push / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for (at, value), y in zip(rows, labels):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - y) * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights()


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: crc32 of the key's text leaves remainder 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, learners: int = LEARNERS, dims: int = DIMS, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """The averaged weights. At most about `sample` labelled rows are read, drawn by the hash of their key.

    Rows without label, key or text, and held-out rows, are not learned from. Without any row the weights are 0.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    usable = usable.groupBy(key).agg(F.max(label).cast("double").alias("_y"))
    rows = usable.count()
    if not rows:
        return np.zeros(dims)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / (1 << 30)
    chosen = usable.filter(draw < min(1.0, sample / rows))
    # The hint is safe: `chosen` holds about `sample` rows of a key and a label.
    known = docs.select(key, text).join(F.broadcast(chosen), key).filter(F.col(text).isNotNull())
    dealt = known.select(F.col(text).alias("text"), "_y", F.xxhash64(key).alias("_h"), F.pmod(F.xxhash64(F.lit("learner"), F.col(key)), F.lit(learners)).alias("_part"))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_h", "text"])
        w = train(part["text"].tolist(), part["_y"].to_numpy(), dims)
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": at, "weight": w[at], "n": len(part)})

    # A learner's part is bounded by the sample.
    found = dealt.groupBy("_part").applyInPandas(learn, "feature long, weight double, n long").toPandas()
    parts = found[found["feature"] == 0]["n"]
    w = np.zeros(dims)
    np.add.at(w, found["feature"].to_numpy(), found["weight"].to_numpy() * found["n"].to_numpy())
    return w / max(1, parts.sum())


def _probabilities(w: np.ndarray, texts: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for _, raw, starts in tx.slices(texts):
        rows = len(starts) - 1
        r, f = slice_features(raw, starts, len(w))
        total, count = np.bincount(r, weights=w[f], minlength=rows), np.bincount(r, minlength=rows)
        out.append(1 / (1 + np.exp(-np.clip(w[0] + SCALE * total / np.maximum(1, count), -30, 30))))
    return np.concatenate(out)


def with_score(docs: DataFrame, weights: np.ndarray, name: str = "score", text: str = "text") -> DataFrame:
    """`docs` and one more column, the score of every whole text, as sparse dot products; null scores as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # `dims` numbers

    def apply(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(_probabilities(shared.value, part))

    return docs.withColumn(name, F.arrow_udf(apply, "double")(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted): fit on the labelled sample, score all rows.

    Repeated rows are scored alike; a null key is never held out and never learned from; other columns are
    ignored; an empty table gives no rows. Only the sample is moved; scoring needs no shuffle.
    """
    scored = with_score(docs.select(key, text), fit(docs, labels, label, key=key, text=text), "score", text)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
