"""An indexable skip list over the units of a text.

A unit is a run of ASCII letters or one other code point. The base lane has
one node for each run of letters (one unit) and for each run of other code
points (as many units as code points). A node of an express lane stands for
the nodes of the lane below up to the lane's next node. Every node carries
two widths, in units and in code points. To find where ``rank`` units end,
:meth:`SkipList.cut` goes right while the widths passed stay within ``rank``,
then one lane down, so it reads some ``FAN`` nodes a lane.
"""

from __future__ import annotations

import numpy as np

from ledgerlens.llm.words import mixed

# A node is in the next lane with a chance of one in FAN.
FAN = 8
# Code points turned into nodes in one go, so a very long text needs little
# more than its nodes.
PIECE = 1 << 20


def _is_letter(points: np.ndarray) -> np.ndarray:
    return ((points | np.uint32(32)) - np.uint32(97)) < np.uint32(26)


def _spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Units and code points of the base lane's nodes. A run of letters that
    goes on in the next piece is continued there by a node of no units."""
    units, chars = [], []
    open_word = False
    for k in range(0, len(text), PIECE):
        points = np.frombuffer(text[k:k + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter(points)
        begin = np.flatnonzero(np.diff(letter, prepend=not letter[0]))
        size = np.diff(begin, append=len(points)).astype(np.int32)
        word = letter[begin]
        unit = np.where(word, np.int32(1), size)
        if open_word and word[0]:
            unit[0] = 0
        open_word = bool(word[-1])
        units.append(unit)
        chars.append(size)
    empty = np.empty(0, np.int32)
    return np.concatenate([empty, *units]), np.concatenate([empty, *chars])


class SkipList:
    def __init__(self, text: str):
        units, chars = _spans(text)
        # Lanes from the base up: (units, code points, place of each node in
        # the lane below).
        self.lanes = [(units, chars, None)]
        # Drawn per node, and the same whenever the list is built again.
        draw = mixed(np.arange(len(units), dtype=np.uint64) + np.uint64(1))
        while len(units) > FAN:
            up = draw % np.uint64(FAN) == 0
            up[0] = True
            place = np.flatnonzero(up)
            if len(place) == len(units):
                break
            draw = draw[place] // np.uint64(FAN)
            units = np.add.reduceat(units, place, dtype=np.int64)
            chars = np.add.reduceat(chars, place, dtype=np.int64)
            self.lanes.append((units, chars, place))
        self.n_units = int(units.sum(dtype=np.int64))
        self.n_chars = int(chars.sum(dtype=np.int64))

    def cut(self, rank: int) -> int:
        """Code points before the place where the first ``rank`` units end."""
        passed = chars = at = 0
        for unit, char, place in reversed(self.lanes):
            while at < len(unit) and passed + unit[at] <= rank:
                passed += int(unit[at])
                chars += int(char[at])
                at += 1
            if at == len(unit):
                return chars
            if place is not None:
                at = int(place[at])
        # Inside a run of single code points.
        return chars + rank - passed
