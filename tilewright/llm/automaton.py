"""Generalised suffix automaton over word codes, with the windows of its sequences as marked states.

A state stands for all word sequences that end at the same places of the items; its link leads to the longest
suffix with other places. A pattern is what counts as found: a window of `size` words of an item, or a whole item
of fewer words. It is marked at the state that holds it, and each state names the longest pattern that is a
suffix of its sequences; from there `shorter` leads through the others.
"""

from __future__ import annotations

import pickle

import numpy as np

from tilewright.llm import text as tx


class _Builder:
    def __init__(self):
        self.link, self.length, self.steps = [-1], [0], [{}]

    def _state(self, length: int, steps: dict, link: int) -> int:
        self.length.append(length)
        self.steps.append(steps)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, before: int, word: int, target: int) -> int:
        """A copy of `target` for the sequences no longer than those of `before` and one word."""
        copy = self._state(self.length[before] + 1, dict(self.steps[target]), self.link[target])
        self.link[target] = copy
        while before >= 0 and self.steps[before].get(word) == target:
            self.steps[before][word] = copy
            before = self.link[before]
        return copy

    def extend(self, last: int, word: int) -> int:
        """The state after `word`, read from state `last` of the item being added."""
        known = self.steps[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.steps[at]:
            self.steps[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.steps[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new


def build(sequences: list[np.ndarray], names: list[str], size: int) -> bytes:
    """The automaton of the items' word codes, as bytes. Items of no words are passed over."""
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *sequences]))
    listed = sorted(set(names))
    number = {name: k for k, name in enumerate(listed)}
    words = [np.searchsorted(vocabulary, s).tolist() for s in sequences]
    b = _Builder()
    for item in words:
        last = 0
        for word in item:
            last = b.extend(last, word)
    # A pattern is known by its state and length; each has the items it occurs in.
    found: dict[tuple[int, int], set[int]] = {}
    for item, name in zip(words, names):
        want = min(size, len(item))
        at = 0
        for read, word in enumerate(item, 1):
            at = b.steps[at][word]
            while b.length[b.link[at]] >= want:
                at = b.link[at]
            if read >= want:
                found.setdefault((at, want), set()).add(number[name])
    by_state: dict[int, list[tuple[int, int]]] = {}
    patterns = sorted(found)
    for k, (state, n) in enumerate(patterns):
        by_state.setdefault(state, []).append((n, k))
    top, shorter = [-1] * len(b.link), [-1] * len(patterns)
    for state in sorted(range(1, len(b.link)), key=b.length.__getitem__):
        top[state] = top[b.link[state]]
        for _, k in by_state.get(state, []):
            shorter[k], top[state] = top[state], k
    key = np.array([s * len(vocabulary) + w for s, out in enumerate(b.steps) for w in out], np.int64)
    to = np.array([t for out in b.steps for t in out.values()], np.int64)
    lists = [sorted(found[p]) for p in patterns]
    flat = {
        "vocabulary": vocabulary, "step_key": key, "step_to": to, "link": b.link, "length": b.length, "top": top,
        "words": [n for _, n in patterns], "shorter": shorter, "item_start": np.cumsum([0, *map(len, lists)]), "item": [i for part in lists for i in part],
    }
    return pickle.dumps({"names": listed, **{f: v if f == "vocabulary" else np.array(v, np.int64) for f, v in flat.items()}})


class Automaton:
    def __init__(self, stored: bytes):
        flat = pickle.loads(stored)
        self.vocabulary, self.names = flat["vocabulary"], np.array(flat["names"], object)
        self.steps = dict(zip(flat["step_key"].tolist(), flat["step_to"].tolist()))
        self.link, self.length = flat["link"].tolist(), flat["length"].tolist()
        self.top, self.words, self.shorter, self.item_start, self.item = (flat[f] for f in ("top", "words", "shorter", "item_start", "item"))
        self.least = int(self.words.min()) if len(self.words) else 0

    def _walk(self, word: list[int], stretches: list[int]) -> tuple[list[int], list[int]]:
        """(state, matching length) after each of the words, all of them known, which form stretches of these lengths."""
        steps, link, length, width = self.steps, self.link, self.length, len(self.vocabulary)
        states, lengths = [], []
        done = 0
        for stretch in stretches:
            at = n = 0
            for w in word[done : done + stretch]:
                to = steps.get(at * width + w)
                while to is None:  # the first state has a step for every known word
                    at = link[at]
                    n = length[at]
                    to = steps.get(at * width + w)
                at = to
                n += 1
                states.append(at)
                lengths.append(n)
            done += stretch
        return states, lengths

    def matches(self, codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end, words, pattern, matching length) of every occurrence of a pattern in the rows' word codes.

        A word that no item has leads back to the first state, so only the stretches between such words are walked,
        and of them only those that have room for the shortest pattern.
        """
        none = np.zeros(0, np.int64)
        if not len(codes) or not self.least:
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == codes
        cut = np.append(True, (row[1:] != row[:-1]) | (known[1:] != known[:-1]))
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(codes))
        use = known[start] & (stop - start >= self.least)
        start, stop = start[use], stop[use]
        if not len(start):
            return none, none, none, none
        place = tx.spread(start, stop - start)
        states, lengths = self._walk(at[place].tolist(), (stop - start).tolist())
        reach = np.array(lengths)
        pattern = self.top[np.array(states)]
        out = []
        while True:
            live = np.flatnonzero(pattern >= 0)
            place, reach, pattern = place[live], reach[live], pattern[live]
            if not len(live):
                break
            fits = self.words[pattern] <= reach
            out.append((place[fits] + 1, self.words[pattern[fits]], pattern[fits], reach[fits]))
            pattern = self.shorter[pattern]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (none, none, none, none)

    def items_of(self, row: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item's number in `names`), each pair once, of the rows' patterns."""
        pairs = np.unique(np.stack([row, pattern]), axis=1)
        n = self.item_start[pairs[1] + 1] - self.item_start[pairs[1]]
        both = np.unique(np.stack([np.repeat(pairs[0], n), self.item[tx.spread(self.item_start[pairs[1]], n)]]), axis=1)
        return both[0], both[1]
