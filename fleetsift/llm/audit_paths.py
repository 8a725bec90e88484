"""Least-cost repairs of rows of turns: cost DP over four states, and the least audit by prefix doubling.

A node is (rows used, state). Its arcs are one edit each: D deletes the next row, K keeps it, R gives it the
role that the state asks for, I inserts that role without using a row. The state after an edit follows
from its letter, so no two arcs of a node carry the same letter.
"""

from __future__ import annotations

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the role that each state asks for; what a kept row of initial s, u, a or another leads to.
ASKED = (USER, USER, ASSISTANT, USER)
KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
FAR = 1 << 50
LETTERS = np.frombuffer(b"DIKR", np.uint8)
#: Costs to go behind the last row: nothing or a closed exchange may stand, the rest is inserted.
AT_END = (0, 2 * INSERT, INSERT, 0)


def row_code(initial: str, blank: bool, repeated: bool, cut: bool) -> int:
    """A row as a number: three times the kind of its role's initial, plus 2 if it must go, 1 if it is cut off."""
    kind = "sua".find(initial) if initial else -1
    return 3 * (kind if kind >= 0 else 3) + (2 if blank or repeated else 1 if cut else 0)


def _before(code: int, after: tuple) -> tuple:
    """Costs to go in front of a row from those behind it."""
    kind, fault = divmod(code, 3)
    costs = []
    for state in range(4):
        best = DELETE + after[state]
        if fault < 2:
            extra = CUT * fault
            best = min(best, REROLE + extra + after[ASKED[state]])
            if KEPT[state][kind] >= 0:
                best = min(best, KEEP + extra + after[KEPT[state][kind]])
        costs.append(best)
    for _ in range(3):
        costs = [min(c, INSERT + costs[ASKED[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, FAR) for c in costs)


class Costs:
    """Costs to go along rows. Costs less their minimum take few values, so each step is looked up."""

    def __init__(self):
        self.known: dict = {}

    def along(self, codes: list[int], after: tuple = AT_END) -> list[tuple]:
        """Costs to go by state in front of every row and behind the last."""
        base, found = min(after), [after]
        after = tuple(c - base for c in after)
        for code in reversed(codes):
            step = self.known.get((code, after))
            if step is None:
                costs = _before(code, after)
                low = min(costs)
                step = self.known[(code, after)] = (low, tuple(c - low for c in costs))
            base += step[0]
            after = step[1]
            found.append(tuple(base + c for c in after))
        found.reverse()
        return found

    def matrix(self, codes: list[int]) -> list[int]:
        """Least costs from every state in front of the rows to every state behind them, row by row."""
        ends = [_spread(self, codes, state) for state in range(4)]
        return [min(ends[t][s], FAR) for s in range(4) for t in range(4)]


def _spread(costs: Costs, codes: list[int], state: int) -> tuple:
    return costs.along(codes, tuple(0 if s == state else FAR for s in range(4)))[0]


class Audits:
    """Least audits of several runs of rows at once.

    runs: (codes, costs behind the last row, whether nothing follows, first state) of each run.
    """

    def __init__(self, runs: list[tuple], costs: Costs):
        sizes = np.array([len(codes) + 1 for codes, _, _, _ in runs])
        self.first = np.append(0, np.cumsum(sizes))[:-1]
        togo = np.array([c for codes, after, _, _ in runs for c in costs.along(codes, after)], np.int64)
        rows = np.full(len(togo), -1)
        last = self.first + sizes - 1
        rows[np.setdiff1d(np.arange(len(togo)), last)] = [code for codes, _, _, _ in runs for code in codes]
        final = np.zeros(len(togo), bool)
        final[last] = [closed for _, _, closed, _ in runs]
        self.cost = togo[self.first, [state for _, _, _, state in runs]]
        self._arcs(togo, rows, final)
        self._double()
        self.begin = 4 * self.first + [state for _, _, _, state in runs]

    def _arcs(self, togo: np.ndarray, rows: np.ndarray, final: np.ndarray) -> None:
        """Targets of the optimal arcs of every node, by letter; -1 where there is none."""
        n = len(togo)
        node = np.arange(4 * n)
        state, row = node % 4, node // 4
        code = rows[row]
        kind, fault = np.maximum(code, 0) // 3, np.maximum(code, 0) % 3
        asked, kept = np.array(ASKED)[state], np.array(KEPT)[state, kind]
        flat, has, usable = togo.ravel(), code >= 0, (code >= 0) & (fault < 2)
        extra = CUT * fault
        targets = []
        for target, weight, allowed in ((node + 4, DELETE, has), (4 * row + asked, INSERT, has | final[row]),
                                        (4 * (row + 1) + kept, KEEP + extra, usable & (kept >= 0)),
                                        (4 * (row + 1) + asked, REROLE + extra, usable)):
            target = np.where(allowed, np.minimum(target, 4 * n - 1), node)
            targets.append(np.where(allowed & (flat[target] + weight == flat) & (flat < FAR), target, -1))
        self.targets = np.stack(targets)

    def _double(self) -> None:
        """Rank nodes by the first 1, 2, 4, ... letters of their least audits.

        A node's optimal arcs have different letters, so its least 2^k letters end in one node, and a
        pointer to that node is enough to look at the next 2^k.
        """
        n = self.targets.shape[1]
        some = self.targets >= 0
        letter = np.where(some.any(0), some.argmax(0) + 1, 0)
        jump = np.where(letter > 0, self.targets[np.maximum(letter - 1, 0), np.arange(n)], np.arange(n))
        rank, length, self.jumps = letter.astype(np.int64), (letter > 0).astype(np.int64), [jump]
        while not (self.jumps[-1][self.jumps[-1]] == self.jumps[-1]).all():
            jump = self.jumps[-1]
            rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
            length = length + length[jump]
            self.jumps.append(jump[jump])
        # Of a node's optimal arcs, the one with the least letter and then the least rank behind it.
        key = np.where(some, np.arange(4)[:, None] * (rank.max() + 1) + rank[np.maximum(self.targets, 0)], FAR)
        self.letter = np.where(letter > 0, key.argmin(0), -1)
        self.length = length

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(edits of each run, letter of each edit, row it stands at within its run, state before it)."""
        count = self.length[self.begin]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        node = np.repeat(self.begin, count)
        for k, jump in enumerate(self.jumps):
            node = np.where(step >> k & 1, jump[node], node)
        return count, self.letter[node], node // 4 - np.repeat(self.first, count), node % 4

    def ends(self) -> np.ndarray:
        """The state behind the last row of each run."""
        return self.jumps[-1][self.begin] % 4
