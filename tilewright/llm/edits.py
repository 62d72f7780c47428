"""Cheapest repair of a sequence of roles to (s?(ua)+)?, by block tables after the Four Russians.

A row is a symbol: its role's class, and whether it must go or costs one more if it stays. What the rest of a
conversation costs from each of the four states (nothing yet, after s, after u, after a) is a cost vector. States are
never more than a few units apart, so vectors less their smallest entry are few; for each of them and every block of
BLOCK symbols the vector before the block is precomputed. A conversation is read from its end, a lookup a block, and
only vectors between blocks are kept. From the front, each block is then expanded backward from the vector behind it,
and the least letter that keeps the cost optimal is chosen in every state, so that ties fall to the least text.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BLOCK = 4
DELETE, INSERT, KEEP, REROLE = "DIKR"

# States and symbols.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
PAD, GOES = 0, 1
SYMBOLS = 10  # PAD, GOES, and 2 + 2 * class + (1 if it costs one more to stay); classes: s, u, a, other
NEXT = (USER, USER, ASSISTANT, USER)  # the state after a turn of the role that may follow
KEPT = {(EMPTY, 0): SYSTEM, (EMPTY, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
END = ("", INSERT * 2, INSERT, "")  # what is missing at the end, by state
ROLES = {USER: "user", ASSISTANT: "assistant"}


def symbols(role_class: np.ndarray, goes: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.where(goes, GOES, 2 + 2 * role_class + extra).astype(np.int64)


def _before(vector: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The costs from each state before a row, given those after it."""
    if symbol == PAD:
        return vector
    out = [3 + c for c in vector]
    if symbol != GOES:
        role, extra = divmod(symbol - 2, 2)
        for state in range(4):
            out[state] = min(out[state], 2 + extra + vector[NEXT[state]])
            if (state, role) in KEPT:
                out[state] = min(out[state], extra + vector[KEPT[state, role]])
    for _ in range(2):
        out = [min(c, 2 + out[NEXT[state]]) for state, c in enumerate(out)]
    return tuple(out)


def _edit(vector: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """(edits up to the row's own, state after it): the least letters of those that cost least."""
    if symbol == PAD:
        return "", state
    here = _before(vector, symbol)
    role, extra = divmod(symbol - 2, 2)
    said = ""
    while True:
        if here[state] == 3 + vector[state]:
            return said + DELETE, state
        if here[state] == 2 + here[NEXT[state]]:
            said, state = said + INSERT, NEXT[state]
        elif (state, role) in KEPT and here[state] == extra + vector[KEPT[state, role]]:
            return said + KEEP, KEPT[state, role]
        else:
            return said + REROLE, NEXT[state]


class Tables:
    def __init__(self, block: int = BLOCK):
        self.block = block
        last = tuple(2 * len(e) for e in END)
        self.vectors, step, cost = [last], [], []
        number = {last: 0}
        for vector in self.vectors:  # grows while it is read
            before = [_before(vector, s) for s in range(SYMBOLS)]
            least = [min(b) for b in before]
            for b, low in zip(before, least):
                plain = tuple(c - low for c in b)
                if plain not in number:
                    number[plain] = len(self.vectors)
                    self.vectors.append(plain)
            step.append([number[tuple(c - low for c in b)] for b, low in zip(before, least)])
            cost.append(least)
        self.step, self.cost = np.array(step), np.array(cost)
        self.edits = [[[_edit(v, s, q) for q in range(4)] for s in range(SYMBOLS)] for v in self.vectors]
        # By vector behind the block and block; the first symbol is the highest digit.
        before, total = self.step, self.cost
        for _ in range(block - 1):
            before, total = (
                np.concatenate([self.step[before, s] for s in range(SYMBOLS)], axis=1),
                np.concatenate([total + self.cost[before, s] for s in range(SYMBOLS)], axis=1),
            )
        self.codes = SYMBOLS**block
        self.block_before, self.block_cost = before.ravel().tolist(), total.ravel().tolist()
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def blocks(self, symbol: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each block, first block of each row and their number): rows are filled up in front."""
        n = np.diff(starts)
        count = -(-n // self.block)
        first = np.append(0, np.cumsum(count))
        filled = np.full(int(first[-1]) * self.block, PAD)
        at = np.arange(len(symbol)) + np.repeat(first[1:] * self.block - starts[1:], n)
        filled[at] = symbol
        return filled.reshape(-1, self.block) @ SYMBOLS ** np.arange(self.block)[::-1], first

    def back(self, codes: list[int], vector: int) -> tuple[list[int], int, int]:
        """(vector behind each block, vector before the first, cost taken out on the way)."""
        behind, cost = [], 0
        before, block_cost, width = self.block_before, self.block_cost, self.codes
        for code in reversed(codes):
            behind.append(vector)
            at = vector * width + code
            cost += block_cost[at]
            vector = before[at]
        behind.reverse()
        return behind, vector, cost

    def _trace(self, vector: int, code: int, state: int) -> tuple[str, int]:
        digits = [code // SYMBOLS**k % SYMBOLS for k in range(self.block)]  # the last symbol first
        behind = []
        for s in digits:
            behind.append(vector)
            vector = int(self.step[vector, s])
        said = ""
        for v, s in zip(reversed(behind), reversed(digits)):
            more, state = self.edits[v][s][state]
            said += more
        return said, state

    def forth(self, codes: list[int], behind: list[int], state: int) -> tuple[str, int]:
        """(edits of the blocks, state after them). Traced blocks are remembered: at most one for each vector, block and state."""
        parts, traced = [], self.traced
        for code, vector in zip(codes, behind):
            key = (vector, code, state)
            done = traced.get(key)
            if done is None:
                done = traced[key] = self._trace(*key)
            parts.append(done[0])
            state = done[1]
        return "".join(parts), state

    def audit(self, codes: list[int]) -> tuple[str, int]:
        """(edits, cost) of a whole sequence; an empty one needs none."""
        behind, vector, cost = self.back(codes, 0)
        said, state = self.forth(codes, behind, EMPTY)
        return said + END[state], cost + self.vectors[vector][EMPTY]


@cache
def tables() -> Tables:
    return Tables()


def replay(audit: str, role_class: list[int], state: int) -> list[tuple[int, str | None]]:
    """(row or -1 for an inserted turn, new role or None for its own) of every turn of the result."""
    out, row = [], 0
    for edit in audit:
        if edit == KEEP:
            out.append((row, None))
            state = KEPT[state, role_class[row]]
        elif edit != DELETE:
            state = NEXT[state]
            out.append((-1 if edit == INSERT else row, ROLES[state]))
        row += edit != INSERT
    return out
