"""Near-duplicate documents: Jaccard join of word 5-gram sets by T-occurrence search (DivideSkip).

1. A text's set is the sorted array of its shingles' 64-bit hashes. Equal sets within a partition are one set.
2. Candidates. Of a set of n shingles, at most d = n - ceil(t n) are missing from a set it links with. So two
   linked sets share at least e of their d + e smallest shingles (e = 1 + n // 16, of the smaller set). These
   are the sets' keys. All sets with a key in common form a group led by the smallest of them; a set belongs
   to few groups, as its copies share nearly all its keys. A set with fewer shared keys than e has no links.
3. Long lists are skipped: a set may leave its e - 1 keys in the largest groups, in one order for all sets,
   and still meets each partner in the group of their smallest common key. A passage in a third of all
   documents therefore brings nobody together that has not more in common.
4. Each remaining group is searched in one task; a group above `BLOCK` sets is dealt over pairs of blocks, so a
   task's size is bounded. There every set is a query for the T-occurrence problem: its short inverted lists
   are merged, its long ones are only probed by binary search for what the merge left over, and the exact
   test follows. A pair that is already connected needs no test; a few pivots connect bulk copies first.
5. The links that connect each group go to a distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm import text as tx
from tilewright.llm.components import components
from tilewright.llm.store import dropped, written

WORDS = 5
PERCENT = 75
BLOCK = 2000
GROUPS_PER_TASK = 500  # sets that a task of ordinary groups gets, about
PIVOTS = 6
PROBES = 1 << 18  # looked up at once


def slice_sets(raw: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingles of each row, rising, one row after another."""
    low = tx.lowered(raw)
    first, end, before = tx.words(low, starts)
    rows = len(starts) - 1
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    code, row = tx.word_codes(low, first, end), tx.row_of(before)
    rolling = tx.Rolling(code)
    whole = np.flatnonzero(row[words - 1 :] == row[: len(row) - words + 1]) if len(row) >= words else np.zeros(0, np.int64)
    short = np.flatnonzero((np.diff(before) > 0) & (np.diff(before) < words))
    grams = rolling(whole, whole + words)
    h = np.concatenate([grams, rolling(before[short], before[short + 1])])
    r = np.concatenate([row[whole], short])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(r[order].astype(np.int32), kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.bincount(r[new], minlength=rows)


def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that a linked set can lack."""
    return n - -(-n * percent // 100)


def shared(n: np.ndarray, percent: int) -> np.ndarray:
    """Keys that a set of n shares with any set it links with, at least."""
    return 1 + (-(-n * percent // 100)) // 16


def key_table(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """(doc, same_as, n, keys): keys only for the first document of each set in its partition."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, raw, starts in tx.slices(batch.column(1)):
                h, n = slice_sets(raw, starts, words)
                begin = np.cumsum(n) - n
                sums = [np.append(np.uint64(0), np.cumsum(tx.mix(h ^ np.uint64(s)))) for s in (0x5BD1E995, 0xC2B2AE35)]
                marks = [(s[begin + n] - s[begin]).tolist() for s in sums]
                doc, same, take = ids[at : at + len(n)], [], np.zeros(len(n), np.int64)
                length = n - -(-n * percent // 100) + 1 + n // 16
                for r, own in enumerate(doc):
                    if own is None or not n[r]:
                        same.append(own)
                        continue
                    known_as = known.setdefault((marks[0][r], marks[1][r], int(n[r])), own)
                    same.append(known_as)
                    if known_as == own:
                        take[r] = length[r]
                flat = tx.signed(h[tx.spread(begin, take)]) if len(h) else np.zeros(0, np.int64)
                columns = [pa.array(doc, pa.int64()), pa.array(same, pa.int64()), pa.array(n.astype(np.int64)), tx.lists(flat, take, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "same_as", "n", "keys"])

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(keys, "doc long, same_as long, n long, keys array<long>")


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (k, doc) sorted by both: (doc, leader, keys), the members of all keys that more than one set has.

    A stream: only the current key and its leader are remembered, so a key of any size passes through.
    """
    last_key, leader, alone, before = None, 0, False, None
    for batch in batches:
        k, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        start = np.ones(len(k), bool)
        start[1:] = k[1:] != k[:-1]
        start[0] = last_key is None or k[0] != last_key
        group = np.cumsum(start)  # 0 for what goes on from the batch before
        lead = np.append(leader, doc[start])[group]
        other = doc != lead
        several = np.zeros(group[-1] + 1, bool)
        several[group[other]] = True
        # A leader goes out with its group's first other member, be it in this batch or a later one.
        use = other | (start & several[group])
        out_doc, out_lead = doc[use], lead[use]
        if alone and several[0]:
            out_doc, out_lead = np.append(leader, out_doc), np.append(leader, out_lead)
        was_alone = alone if group[-1] == 0 else True
        alone = was_alone and not several[group[-1]]
        last_key, leader = k[-1], lead[-1]
        if len(out_doc):
            frame = pd.DataFrame({"doc": out_doc, "leader": out_lead}).groupby(["doc", "leader"], sort=False).size()
            found = frame.reset_index(name="keys")
            yield pa.RecordBatch.from_pandas(found.astype("int64"), preserve_index=False)


class Links:
    """Union-find over the sets of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))])


def _pivot(flat: np.ndarray, offsets: np.ndarray, size: np.ndarray, pivot: int, percent: int) -> np.ndarray:
    own = flat[offsets[pivot] : offsets[pivot + 1]]
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    total = np.append(0, np.cumsum(hit))
    both = total[offsets[1:]] - total[offsets[:-1]]
    return 100 * both >= percent * (size + len(own) - both)


def connect(sets: list[np.ndarray], percent: int = PERCENT, pivots: int = PIVOTS, probe: int = 0) -> np.ndarray:
    """For each set the first set of its component, components being those of all links within the group.

    Where lists are merged in less time than it takes to probe them, at `probe` entries a probe, they are merged.
    """
    size = np.array([len(s) for s in sets])
    flat, offsets = np.concatenate(sets), np.append(0, np.cumsum(size))
    links = Links(len(sets))
    open_, rest = np.ones(len(sets), bool), np.ones(len(sets), bool)
    for _ in range(pivots):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        near = _pivot(flat, offsets, size, int(at[0]), percent)
        for x in np.flatnonzero(near):
            links.join(int(at[0]), int(x))
        open_ &= ~near
        rest[at[0]] = False
    root = links.roots()
    # Pivots have met every set. Sets that pivots closed have not met each other: two of different components may link.
    rest = np.flatnonzero(rest)
    if not len(rest) or (root[rest] == root[rest[0]]).all():
        return root
    # Inverted lists: the sets that hold each shingle, rising. So the pairs of both, as one number each, rise too.
    holder = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    lists = holder[order]
    new = np.append(True, flat[order[1:]] != flat[order[:-1]])
    edges = np.append(np.flatnonzero(new), len(flat))
    rank = np.cumsum(new) - 1
    held = rank * len(sets) + lists
    place = np.empty(len(flat), np.int64)
    place[order] = rank
    length = np.diff(edges)
    largest = np.bincount(root[rest]).argmax()
    for x in rest[root[rest] != largest].tolist():  # a pair of different components has an end outside the largest
        at = place[offsets[x] : offsets[x + 1]]
        need = -(-int(size[x]) * percent // 100)
        skip = min(need - 1, int(need / (0.01 * np.log2(length[at].max() + 1) + 1)))  # the number of long lists
        if length[at].sum() <= probe * len(at):
            skip = 0
        by_length = np.argsort(length[at], kind="stable")
        short, long = at[by_length[: len(at) - skip]], at[by_length[len(at) - skip :]]
        merged = np.bincount(lists[tx.spread(edges[short], length[short])], minlength=len(sets))
        here = links.root(x)
        found = [y for y in np.flatnonzero(merged >= max(1, need - skip)).tolist() if links.root(y) != here]
        if skip and found and length[long].sum() <= probe * skip * len(found):
            merged, skip = merged + np.bincount(lists[tx.spread(edges[long], length[long])], minlength=len(sets)), 0
        step = PROBES // skip + 1 if skip else len(found)
        for lo in range(0, len(found), max(1, step)):
            some = np.array(found[lo : lo + step])
            both = merged[some]
            if skip:
                asked = long[:, None] * len(sets) + some
                both = both + (held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked).sum(axis=0)
            for y in some[100 * both >= percent * (size[x] + size[some] - both)].tolist():
                links.join(x, y)
    return links.roots()


def _groups(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """(task, leader, cell, doc, text): each member, once for each group or pair of blocks it belongs to.

    Texts are moved, not sets: a shuffle packs them to a fraction of the hashes' size.
    """
    # Leaders per document are bounded by its keys.
    wanted = members.groupBy("doc").agg(F.collect_list(F.struct("leader", "task", "blocks")).alias("at"))
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).join(wanted, "doc")
    placed = texts.select("doc", "text", F.explode("at").alias("p")).select("doc", "text", "p.*")
    mine = F.pmod(F.xxhash64(F.lit("block"), "doc"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda o: (F.col("blocks") == 1) | (o != F.col("mine")))
    paired = placed.withColumn("mine", mine).withColumn("other", F.explode(others))
    cell = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    return paired.withColumn("cell", cell).select((F.col("task") + F.col("cell")).alias("task"), "leader", "cell", "doc", "text")


def leaders(known: DataFrame) -> DataFrame:
    """(doc, leader, keys): the groups that the keys bring each set of `known` into."""
    posts = known.filter("same_as = doc").select(F.explode("keys").alias("k"), "doc").repartition("k").sortWithinPartitions("k", "doc")
    return posts.mapInArrow(_led, "doc long, leader long, keys long").groupBy("doc", "leader").agg(F.sum("keys").alias("keys"))


def jaccard_links(docs: DataFrame, known: DataFrame, led: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """(a, b): links that connect all components among the sets of `known`. `led` is written, and dropped here."""
    own = led.groupBy("doc").agg(F.sum("keys").alias("all_keys")).join(known.filter("same_as = doc").select("doc", "n").distinct(), "doc")
    need = (1 + F.floor(F.ceil(F.col("n") * percent / 100) / 16)).cast("bigint")
    own = own.withColumn("need", need).filter("all_keys >= need").select("doc", "need")
    every, led = led, written(led.join(own, "doc"), "members")
    dropped(every)
    size = led.groupBy("leader").agg(F.countDistinct("doc").alias("g"))
    ordered = Window.partitionBy("doc").orderBy(F.desc("g"), F.desc("leader"))
    kept = led.join(size, "leader").withColumn("passed", F.sum("keys").over(ordered)).filter("passed >= need")
    kept = written(kept.select("doc", "leader").distinct(), "kept")
    dropped(led)
    size = kept.groupBy("leader").agg(F.count("*").alias("g")).filter("g > 1")
    tasks = max(1, kept.count() // GROUPS_PER_TASK)
    blocks = F.when(F.col("g") > BLOCK, F.ceil(2 * F.col("g") / BLOCK)).otherwise(1).cast("bigint")
    task = F.when(F.col("g") > BLOCK, F.shiftright(F.xxhash64(F.lit("cells"), "leader"), 1)).otherwise(F.pmod(F.xxhash64("leader"), F.lit(tasks)))
    members = kept.join(size.select("leader", blocks.alias("blocks"), task.alias("task")), "leader")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        found = [slice_sets(raw, starts, words) for _, raw, starts in tx.slices(pa.array(part["text"], pa.string()))]
        h, n = (np.concatenate(x) for x in zip(*found))
        sets = np.split(h, np.cumsum(n)[:-1])
        leader, cell, doc = (part[c].to_numpy() for c in ("leader", "cell", "doc"))
        order = np.lexsort((doc, cell, leader))
        new = (np.diff(leader[order]) != 0) | (np.diff(cell[order]) != 0)
        out = [np.zeros((2, 0), np.int64)]
        for group in np.split(order, np.flatnonzero(new) + 1):
            if len(group) > 1:
                root = connect([sets[x] for x in group], percent)
                apart = root != np.arange(len(root))
                out.append(np.stack([doc[group][apart], doc[group][root[apart]]]))
        a, b = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    return _groups(docs, members, key, text).groupBy("task").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every document; the key must be an integer.

    Two documents link when 100 * shared shingles >= percent * shingles of both; component_id is the smallest key
    reachable by links. A text with fewer than `words` words is one shingle; a null text or one without words
    has none, links with nothing and is its own component. Rows with a null key have no component and link with
    nothing; rows that repeat a key are one document as far as links go. Other columns are ignored; an empty
    table gives no rows.
    """
    keyed = written(key_table(docs, words, percent, key, text), "keys")
    led = written(leaders(keyed), "led")
    # The keys, half as large as the texts, have brought the sets together; what follows needs the sets' sizes only.
    known = written(keyed.select("doc", "same_as", "n"), "sets")
    dropped(keyed)
    links = written(jaccard_links(docs, known, led, words, percent, key, text), "links")
    copies = known.filter("same_as <> doc").select(F.col("doc").alias("a"), F.col("same_as").alias("b"))
    found = components(links.unionByName(copies))
    kind = docs.schema[key].dataType
    out = known.select("doc", "n").join(found.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select(
        F.col("doc").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").cast(kind).alias("component_id")
    )
