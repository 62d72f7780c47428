"""Suffix arrays by induced sorting, and permuted common prefixes, in array operations."""

from __future__ import annotations

import numpy as np

FEW = 64  # runs of one symbol that are followed together


def _smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them; the last one is not (an end smaller than all follows)."""
    n = len(t)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _leftmost(smaller: np.ndarray) -> np.ndarray:
    """Smaller suffixes with a larger one before them."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _split(rank: np.ndarray, live: np.ndarray, symbols: np.ndarray, bits: int) -> np.ndarray:
    """Refine the ranks of `live` by symbols; ranks are places, so a group's rank is its first place.

    Returns those that are still tied with another one.
    """
    key = (rank[live].astype(np.uint64) << np.uint64(bits)) | symbols
    by = np.argsort(key)
    key, rows = key[by], live[by]
    place = np.arange(len(rows))
    new = np.append(True, key[1:] != key[:-1])
    old = key >> np.uint64(bits)
    group = np.append(True, old[1:] != old[:-1])
    start = np.maximum.accumulate(np.where(new, place, 0))
    rank[rows] += start - np.maximum.accumulate(np.where(group, place, 0))
    alone = new & np.append(new[1:], True)
    return rows[~alone]


def _ranked(typed: np.ndarray, at: np.ndarray, length: np.ndarray, tail: np.ndarray | None = None) -> np.ndarray:
    """Ranks (equal ones alike, without gaps) of the stretches typed[at : at + length], then of `tail`.

    `typed` holds numbers above 0 and 0 follows its end. No stretch is the beginning of another but one that
    reaches the end. The first round packs as many symbols into one key as fit. Later ones do so for the stretches
    still tied or, where a stretch begins at every place, use the rank of the place they have come to, which doubles
    what is compared.
    """
    n = len(at)
    everywhere = n == len(typed)
    bits, room = max(1, int(typed.max()).bit_length()), max(1, n.bit_length())
    take = max(1, (63 - room) // bits)
    padded = np.append(typed, 0).astype(np.uint64)
    to_end = at + length >= len(typed)
    rank, live, done = np.zeros(n, np.int64), np.arange(n), 0
    tied = []
    while len(live):
        if everywhere and done:
            still = _split(rank, live, np.append(rank + 1, 0)[live + done].astype(np.uint64), room)
            done *= 2
        else:
            key = np.zeros(len(live), np.uint64)
            for k in range(done, done + take):
                inside = (length[live] > k) | to_end[live]
                key = (key << np.uint64(bits)) | np.where(inside, padded[np.minimum(at[live] + k, len(typed))], np.uint64(0))
            still = _split(rank, live, key, bits * take)
            done += take
        more = (length[still] > done) | (to_end[still] & (at[still] + done <= len(typed)))  # the end is a symbol, too
        tied.append(still[~more])
        live = still[more]
    if tail is not None and sum(map(len, tied)):
        last = np.concatenate(tied)
        _split(rank, last, (tail[last] + 1).astype(np.uint64), max(1, int(tail.max() + 1).bit_length()))
    used = np.zeros(n, np.int64)
    used[rank] = 1
    return (np.cumsum(used) - 1)[rank]


def _leftmost_order(t: np.ndarray, smaller: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The leftmost-smaller suffixes (positions `marks`) in order."""
    typed = t.astype(np.int64) * 2 + smaller + 1
    length = np.minimum(np.append(marks[1:], len(t)) + 1, len(t)) - marks  # up to and with the next one
    name = _ranked(typed, marks, length)
    if int(name.max()) + 1 < len(marks):
        return marks[_reduced_order(name)]
    return marks[np.argsort(name, kind="stable")]


def _reduced_order(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names: its leftmost-smaller suffixes recursively, the others from them.

    A suffix compares by its typed symbols up to the next leftmost-smaller suffix, then by that one's rank.
    """
    if len(t) == 1:
        return np.zeros(1, np.int64)
    smaller = _smaller(t)
    marks = _leftmost(smaller)
    rank = np.full(len(t) + 1, -1, np.int64)
    if len(marks):
        rank[_leftmost_order(t, smaller, marks)] = np.arange(len(marks))
    index = np.arange(len(t))
    after = np.append(marks, len(t))[np.searchsorted(marks, index, "right")]
    typed = t * 2 + smaller + 1
    return np.argsort(_ranked(typed, index, np.minimum(after + 1, len(t)) - index, rank[after]), kind="stable")


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of bytes: leftmost-smaller suffixes first, all others induced bucket by bucket in linear time."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int32)
    smaller = _smaller(t)
    marks = _leftmost(smaller)
    order = _leftmost_order(t, smaller, marks).astype(np.int32) if len(marks) else np.zeros(0, np.int32)
    seeds = np.split(order, np.searchsorted(t[order], np.arange(1, 256)))
    larger_parts: list[list[np.ndarray]] = [[] for _ in range(256)]
    smaller_parts: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(found: np.ndarray, into: list[list[np.ndarray]]) -> None:
        if len(found):
            char = t[found]
            by = np.argsort(char, kind="stable")
            found, edges = found[by], np.cumsum(np.bincount(char, minlength=256))
            for c in np.flatnonzero(np.diff(np.append(0, edges))):
                into[c].append(found[(edges[c - 1] if c else 0) : edges[c]])

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def before(found: np.ndarray, kind: bool) -> np.ndarray:
        back = found[found > 0] - 1
        return back[smaller[back] == kind]

    run_start = np.append(True, t[1:] != t[:-1])
    run_start = np.maximum.accumulate(np.where(run_start, np.arange(n, dtype=np.int32), np.int32(0)))

    def in_bucket(now: np.ndarray, kind: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(suffixes, what they induce elsewhere), both in order: within runs of its symbol a bucket induces itself."""
        own, out = [], []
        while len(now) > FEW:
            own.append(now)
            go_on = run_start[now] < now
            out.append(before(now[~go_on], kind))
            now = now[go_on] - 1
        if len(now):  # a few runs that may be long: all their steps at once, in the order of the steps
            steps = now - run_start[now] + 1
            step = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
            own.append((np.repeat(now, steps) - step)[np.argsort(step, kind="stable")].astype(np.int32))
            out.append(before(run_start[now[np.argsort(steps, kind="stable")]], kind))
        return own, out

    larger: list[np.ndarray] = []
    deal(np.array([n - 1], np.int32), larger_parts)
    for c in range(256):
        own, out = in_bucket(joined(larger_parts[c]), False)
        larger.append(joined(own))
        out.append(before(seeds[c], False))
        deal(joined(out), larger_parts)
    result: list[np.ndarray] = [np.zeros(0, np.int32)] * 512
    for c in range(255, -1, -1):
        own, out = in_bucket(joined(smaller_parts[c]), True)
        out.append(before(larger[c][::-1], True))
        deal(joined(out), smaller_parts)
        result[2 * c], result[2 * c + 1] = larger[c], joined(own)[::-1]
    return np.concatenate(result)


def common_prefixes(t: np.ndarray, order: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(permuted common prefixes, neighbours): by position, what a suffix shares with the one before it in `order`.

    ends[k] is the end of the kth part of t (each followed by a separator); a prefix is counted to its part's
    end at most. Only irreducible values are compared byte by byte, eight at a time: where the bytes before
    both suffixes agree, the value is that of the position before less one.
    """
    n = len(t)
    neighbour = np.full(n, -1, np.int64)
    neighbour[order[1:]] = order[:-1]
    index = np.arange(n)
    limit = np.append(ends, n)[np.searchsorted(ends, index, "left")]
    first = np.zeros(n, bool)
    first[0] = True
    first[np.minimum(ends + 1, n - 1)] = True
    has = neighbour > 0
    agree = np.zeros(n, bool)
    inner = np.flatnonzero(has[1:]) + 1
    agree[inner] = t[inner - 1] == t[neighbour[inner] - 1]
    fresh = np.flatnonzero(~agree | first | (neighbour < 0))
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    eight = np.ndarray((n + 8,), "<u8", padded.tobytes(), 0, (1,))
    shared = np.zeros(n, np.int64)
    live = fresh[neighbour[fresh] >= 0]
    done = 0
    while len(live):
        differ = eight[live + done] ^ eight[np.minimum(neighbour[live] + done, n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        shared[live] += same
        done += 8
        live = live[(differ == 0) & (live + done < limit[live])]
    # Neither suffix goes beyond its end, where the padding might seem to agree.
    shared = np.minimum(shared, np.maximum(0, np.minimum(limit - index, n - np.maximum(neighbour, 0))))
    start = np.zeros(n, np.int64)
    start[fresh] = fresh
    start = np.maximum.accumulate(start)
    return np.maximum(0, shared[start] - (index - start)), neighbour
