"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are estimated, not set.

Per text a few counts are taken (one Arrow pass). Each rule turns them into a vote: 1 for good, -1 for bad,
0 to abstain. Texts with the same votes are one pattern, so all the estimation needs is the number of texts
of each pattern - at most 3 ** rules rows, whatever the corpus holds. Expectation-maximisation over these
counts gives every rule's accuracy on good and on bad texts and the share of good texts; a text's posterior
probability of good quality follows from its pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import text as tx
from tilewright.llm.store import written

SYMBOLS = b"#*$%&|<>"
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_marked_words", "n_distinct_words",
]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?#*$%&|<>")] = True


def _within(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True flags of each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def _per_row(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The codes made different between rows."""
    return tx.mix(code ^ tx.mix(row.astype(np.uint64) + np.uint64(1)))


def _repeats(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the code found more than once, is it found earlier)."""
    order = np.argsort(code, kind="stable")
    same = np.zeros(len(code) + 1, bool)
    same[1:-1] = code[order[1:]] == code[order[:-1]]
    again, later = np.zeros(len(code), bool), np.zeros(len(code), bool)
    again[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return again, later


def slice_counts(raw: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    first, end, before = tx.words(raw, starts)
    row = tx.row_of(before)
    rows = len(starts) - 1
    code = tx.word_codes(raw, first, end) if len(first) else np.zeros(0, np.uint64)
    out = {"n_words": np.diff(before)}
    solid = np.zeros(len(raw) + 1, np.int8)
    solid[first] = 1
    solid[end] -= 1  # a word that ends where the next row's word begins cancels out
    inside = np.cumsum(solid[:-1], dtype=np.int8).astype(bool) if len(raw) else solid[:0].astype(bool)
    out["word_chars"] = _within(inside & ((raw & 0xC0) != 0x80), starts)
    out["n_symbols"] = _within(_SYMBOL[raw], starts)
    # Lines: cut at line feeds and at the row's borders; only those with a word count.
    feeds = np.flatnonzero(raw == 10)
    begins = np.sort(np.concatenate([starts[:-1], feeds + 1]), kind="stable")
    line_row = np.sort(np.concatenate([np.arange(rows), np.searchsorted(starts, feeds, "right") - 1]), kind="stable")
    finish = np.where(np.append(line_row[1:] != line_row[:-1], True), starts[line_row + 1], np.append(begins[1:], 0) - 1)
    with_word = np.searchsorted(first, finish) > np.searchsorted(first, begins)
    begins, finish, line_row = begins[with_word], finish[with_word], line_row[with_word]
    lines = tx.Rolling(tx.byte_codes(raw))(begins, finish) if len(raw) else np.zeros(0, np.uint64)
    out["n_dup_lines"] = np.bincount(line_row[_repeats(_per_row(lines, line_row))[1]], minlength=rows)
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    # 3-word windows that stay in one row.
    covered = np.zeros(len(first), bool)
    if len(first) > 2:
        starts3 = np.flatnonzero(row[2:] == row[:-2])
        grams = tx.Rolling(code).grams(3)[starts3]
        found = starts3[_repeats(_per_row(grams, row[starts3]))[0]]
        for k in range(3):
            covered[found + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    out["n_upper"] = _within(upper, starts)
    out["n_letters"] = _within(upper | lower, starts)
    marked = _MARK[raw[end - 1]] if len(end) else np.zeros(0, bool)
    out["n_marked_words"] = np.bincount(row[marked], minlength=rows)
    out["n_distinct_words"] = np.bincount(row[~_repeats(_per_row(code, row))[1]], minlength=rows)
    return out


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of every whole text; a null text has none of anything."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, starts in tx.slices(batch.column(1)):
                found = slice_counts(raw, starts)
                columns = [batch.column(0).slice(row, len(starts) - 1), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]]
                yield pa.RecordBatch.from_arrays(columns, ["key", *COUNTS])

    return docs.select(key, text).mapInArrow(count, f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("key", key)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """One vote per rule. Shares are compared by multiplication, so nothing is divided by zero."""
    n = F.col("n_words")

    def share(part: str, whole: str, good: int, bad: int) -> Column:
        p, w = F.col(part), F.col(whole)
        return _vote(F.when(w > 0, p), 100 * p <= good * w, 100 * p > bad * w)

    return {
        "long_enough": _vote(n, n >= 100, n < 50),
        "few_symbols": share("n_symbols", "n_words", 2, 10),
        "few_dup_lines": share("n_dup_lines", "n_lines", 0, 15),
        "few_repeat_words": share("n_repeat_words", "n_words", 10, 30),
        "word_length": _vote(F.when(n > 0, n), F.col("word_chars").between(3 * n, 10 * n), ~(2 * F.col("word_chars")).between(5 * n, 24 * n)),
        "few_capitals": share("n_upper", "n_letters", 15, 50),
        "few_marked_words": share("n_marked_words", "n_words", 3, 15),
        "varied_words": _vote(F.when(n > 0, n), 100 * F.col("n_distinct_words") >= 55 * n, 100 * F.col("n_distinct_words") < 25 * n),
    }


def estimate(votes: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(accuracy on good texts, accuracy on bad texts, share of good texts, posterior of each pattern).

    A rule's two accuracies are the probabilities that its vote is right, given that it votes, on good and on bad
    texts: a rule that finds one kind of junk is nearly always right on good texts and often wrong on bad ones,
    and then only its vote against a text says much. The estimation starts from texts without a vote against
    them being good. A rule whose votes turn out to say the opposite is held neutral, which fixes the meaning of
    good and bad. Half a vote each way is added, so no estimate is 0 or 1.
    """
    total = max(1.0, float(count.sum()))
    for_, against = votes > 0, votes < 0
    posterior = np.where(against.any(axis=1), 0.1, 0.95)
    good = bad = np.full(votes.shape[1], 0.5)
    prior = 0.5
    for _ in range(rounds):
        g, b = count * posterior, count * (1 - posterior)
        good = (for_.T @ g + 0.5) / ((for_ | against).T @ g + 1)
        bad = (against.T @ b + 0.5) / ((for_ | against).T @ b + 1)
        turned = good + bad < 1
        both = (for_.T @ count + 0.5) / ((for_ | against).T @ count + 1)
        good, bad = np.where(turned, both, good), np.where(turned, 1 - both, bad)
        prior = (g.sum() + 0.5) / (total + 1)
        odds = np.log(prior / (1 - prior)) + for_ @ np.log(good / (1 - bad)) + against @ np.log((1 - good) / bad)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return good, bad, prior, posterior


def quality_verdicts(docs: DataFrame, rules: dict[str, Column] | None = None, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the five base counts, base_failed, kept, posterior, one vote column per rule) of every whole text.

    `kept` is false if the base check failed, else posterior >= `least`. A null or empty text has no words and
    fails the base check. Repeated rows and null keys get rows of their own; other columns are ignored; an
    empty table gives no rows. The counts are written once and read twice; nothing is shuffled but the
    patterns' counts. The posterior table has at most 3 ** rules rows and is joined by broadcast.
    """
    rules = default_rules() if rules is None else rules
    names = [f"vote_{r}" for r in rules]
    counts = written(text_counts(docs, key, text), "counts").withColumns({f"vote_{r}": v.cast("int") for r, v in rules.items()})
    patterns = counts.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** rules
    patterns.sort(key=lambda r: tuple(r[c] for c in names))
    votes = np.array([[r[c] for c in names] for r in patterns], float).reshape(-1, len(names))
    *_, posterior = estimate(votes, np.array([r["n"] for r in patterns], float))
    spark = docs.sparkSession
    scored = spark.createDataFrame(
        [(*[int(r[c]) for c in names], float(p)) for r, p in zip(patterns, posterior)],
        ", ".join(f"{c} int" for c in names) + ", posterior double",
    )
    failed = base_failed()
    out = counts.join(F.broadcast(scored), names, "left")
    kept = ~failed & (F.col("posterior") >= least)
    return out.select(key, *COUNTS[:5], failed.alias("base_failed"), kept.alias("kept"), "posterior", *names)
