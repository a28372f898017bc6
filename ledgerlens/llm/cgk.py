"""Edit distance turned into Hamming distance by random walks (CGK), with
bit-sampling LSH over windows of characters, and exact verification.

The embedding of a sequence under a walk: stand at its first character; at each
step emit the character stood on, then stay or move on by a random bit that
depends on the step and the character. Sequences at small edit distance emit
mostly equal characters, since a walk falls into step again after an edit. A
repetition is one walk; its key is the hash of the characters emitted at sampled
steps, evenly spaced, so that an edit between them can go unnoticed.

Walks begin at every character of the items and of the texts, so that any
window of a copy meets the window of the item that it stems from, and cross
windows of ``w`` characters in 2w steps. An item is a candidate where ``need``
equal keys, of all repetitions, lie on diagonals as near each other as the edits
allow. Window, repetitions and ``need`` are tuned for items of each size on
copies edited up to the accepted distance: the longer an item, the more of its
windows stay alike, and the more equal keys can be asked for.
"""

from __future__ import annotations

import itertools
import unicodedata
from functools import cached_property

import numpy as np

from ledgerlens.llm import words

# Every so many steps of a walk are sampled.
SPACING = 3
MAX_WINDOW = 16
TARGET_RECALL = 0.95
# Shares of characters edited, in whole words and in typos, that each have to
# reach TARGET_RECALL.
RATES = (0.05, 0.1, 0.15, 0.2, 0.25)
# (window, repetitions, least number of equal keys) tried, from the fewest
# false candidates on. The most equal keys that reach TARGET_RECALL are asked for.
LADDER = ((13, 1, 8), (13, 2, 2), (13, 3, 3), (11, 3, 3), (9, 3, 3), (7, 4, 2), (5, 4, 2), (4, 4, 2),
          (3, 8, 1), (2, 16, 1), (1, 1, 1))
# Items that each size is tuned on, and copies of each edit rate.
TUNED_ITEMS = 96
# Equal keys looked at in one go (those of one text at least).
MAX_PAIRS = 1 << 18
# Characters walked from in one go, so that the arrays stay in the cache.
BLOCK = 1 << 15
# Bits of a bitmap for each key, and the most that address it.
BITMAP_SHARE = 16
BITMAP_BITS = 24
LAST = 0x20000
# Scripts written without spaces: every character is a word. From LAST on all are.
_ALONE = ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x19E0), (0x1A20, 0x1AB0),
          (0x2E80, 0xA4D0), (0xA9E0, 0xAA00), (0xAA60, 0xAAE0), (0xF900, 0xFB00), (0xFF66, 0xFFA0))


class Reader:
    """Texts as code points, words and plain characters."""

    def __init__(self):
        self.kind = np.zeros(LAST + 1, np.uint8)  # 0 between words, 1 in a word, 2 a word alone
        self.lower = np.arange(LAST + 1, dtype=np.uint32)
        for c in range(LAST):
            x = chr(c)
            if unicodedata.category(x)[0] in "LMN":
                self.kind[c] = 1
                if len(small := x.lower()) == 1:
                    self.lower[c] = ord(small)
        for a, b in _ALONE:
            self.kind[a:b] *= 2
        self.kind[LAST] = 2
        self.up = self.down = np.empty(0, np.uint64)

    def read(self, texts: list[str]) -> Read:
        return Read(self, texts)


class Read:
    """A chunk of texts. ``plain``: the words in lower case, one space between
    words that something stands between; ``src``: where in the joined texts its
    characters are; ``begin``, ``end``: its words; ``h``: their hashes;
    ``bound``: where the texts begin in it, and the end."""

    def __init__(self, reader: Reader, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.cumsum(sizes + 1) - sizes
        cp = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        low = np.minimum(cp, LAST)
        kind = reader.kind[low]
        inside, alone = kind > 0, kind == 2
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | alone[1:] | alone[:-1]
        keep = inside.copy()
        keep[:-1] |= begins[1:]
        self.src = np.flatnonzero(keep)
        within = inside[self.src]
        self.plain = np.where(within, np.where(cp < LAST, reader.lower[low], cp)[self.src], 32).astype(np.uint32)
        starts = begins[self.src]
        self.begin = np.flatnonzero(starts)
        follow = np.append(starts[1:] | ~within[1:], True) if len(within) else within
        self.end = np.flatnonzero(within & follow) + 1
        self.bound = np.searchsorted(self.src, np.append(self.offset, len(cp)))
        self.first = np.searchsorted(self.begin, self.bound)
        self.reader = reader

    @cached_property
    def h(self) -> np.ndarray:
        reader, n = self.reader, len(self.plain)
        if n > len(reader.up):
            reader.up = words.powers(words.STEP, n + n // 4)
            reader.down = words.powers(words.STEP_INVERSE, n + n // 4)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words.mixed(self.plain + np.uint64(1)) * reader.up[:n], out=total[1:])
        return words.mixed((total[self.end] - total[self.begin]) * reader.down[self.begin]
                           + (self.end - self.begin).astype(np.uint64))

    def text(self, a: int, b: int) -> str:
        return self.plain[a:b].tobytes().decode("utf-32-le")

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and number of characters from the first word of each text to
        its last."""
        some = np.diff(self.first) > 0
        at, size = self.bound[:-1].copy(), np.zeros(len(some), np.int64)
        at[some] = self.begin[self.first[:-1][some]]
        size[some] = self.end[self.first[1:][some] - 1] - at[some]
        return at, size


class Walk:
    """One repetition for windows of ``w`` characters: 2w steps, which cross it."""

    def __init__(self, w: int, repetition: int):
        rng = np.random.Generator(np.random.PCG64([w, repetition, 71]))
        self.w = w
        self.steps = range(0, 2 * w, SPACING)
        self.factor, self.mix, self.place = (rng.integers(1, 2 ** 31, 3) * 2 + 1).astype(np.uint32)

    def keys(self, plain: np.ndarray) -> np.ndarray:
        """Keys of the walks from every character on, all abreast from the last
        step back: what a walk emits from a step on is what it emits there and
        what the walk emits from the next step on, here or one character on.

        Nothing stands beyond the end. Bit ``t`` of a character's hash says
        whether it is left at step ``t``."""
        n, steps = len(plain), self.steps[-1] + 1
        out = np.empty(n, np.uint32)
        plain = np.append(plain, np.zeros(steps, np.uint32))
        for a in range(0, n, BLOCK):
            h = (plain[a:min(n, a + BLOCK) + steps] + np.uint32(1)) * self.factor
            h ^= h >> np.uint32(15)
            h *= self.mix
            h ^= h >> np.uint32(13)
            key = np.zeros(len(h) + 1, np.uint32)
            stay, on = key[:-1], key[1:]
            move, other = np.empty_like(h), np.empty_like(h)
            for step in range(steps - 1, -1, -1):
                np.left_shift(h, np.uint32(31 - step), out=move)
                signed = move.view(np.int32)
                np.right_shift(signed, np.int32(31), out=signed)
                np.bitwise_xor(stay, on, out=other)
                other &= move
                stay ^= other
                if step in self.steps:
                    stay *= self.place
                    stay += h
            found = stay[:min(n, a + BLOCK) - a]
            found ^= found >> np.uint32(16)
            found *= self.mix
            found ^= found >> np.uint32(15)
            out[a:a + len(found)] = found
        return out


def starts_of(first: np.ndarray, count: np.ndarray, w: int, step: int):
    """(start, owner) of the windows at every ``step``-th word of sequences
    that begin at ``first`` and hold ``count`` words."""
    n = np.maximum(0, (count - w) // step + 1)
    owner = np.repeat(np.arange(len(first)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return first[owner] + k * step, owner


class Table:
    """Sorted keys with what they stand for, and a bitmap before them."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, at: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], item[order], at[order]
        bits = min(BITMAP_BITS, max(8, (BITMAP_SHARE * len(keys)).bit_length()))
        self.shift = keys.dtype.type(8 * keys.dtype.itemsize - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[keys >> self.shift] = True
        # For the first of equal keys, how many there are.
        self.equal = np.searchsorted(self.keys, self.keys, side="right") - np.arange(len(keys))

    def found(self, probe: np.ndarray):
        """(probe, place of its first equal key, number of equal keys)."""
        maybe = np.flatnonzero(self.bitmap.take((probe >> self.shift).astype(np.int64), mode="clip"))
        wanted = probe[maybe]
        low = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        equal = self.keys[low] == wanted
        return maybe[equal], low[equal], self.equal[low[equal]]

    def spread(self, probe: np.ndarray, low: np.ndarray, n: np.ndarray):
        """(probe, item, place in the item) of all equal keys."""
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(probe, n), self.item[at], self.at[at]

    def hits(self, probe: np.ndarray):
        return self.spread(*self.found(probe))


class Index:
    """The items by the keys of their walks. ``items`` are read as one chunk;
    ``plan`` has, for items of a size: window, members, repetitions and number
    of equal keys."""

    def __init__(self, items: Read, plan: list[tuple], slack: np.ndarray):
        self.slack = slack
        self.need = np.ones(len(slack), np.int64)
        first, size = items.spans()
        held: dict[tuple[int, int], list] = {}
        for w, members, repetitions, need in plan:
            self.need[members] = need
            for r in range(repetitions):
                held.setdefault((w, r), []).append(members)
        self.tables: dict[int, list] = {}
        for (w, r), parts in sorted(held.items()):
            which = np.concatenate(parts)
            at, owner = starts_of(first[which], size[which], 1, 1)
            walk = Walk(w, r)
            self.tables.setdefault(w, []).append((walk, Table(
                walk.keys(items.plain)[at], which[owner], at - items.bound[which[owner]])))

    def hits(self, docs: Read):
        """(text, item, diagonal) of equal keys in ascending order, some texts
        at a time; an item has one window size, so its hits come together."""
        for pairs in self.tables.values():
            found = [table.found(walk.keys(docs.plain)) for walk, table in pairs]
            place = np.concatenate([f[0] for f in found])
            order = np.argsort(place, kind="stable")
            text = np.searchsorted(docs.bound[1:], place[order], side="right")
            n = np.concatenate([f[2] for f in found])[order]
            for a, b in slices(text, n):
                # Whole texts: the places from the first one's begin to the last one's end.
                low, high = docs.bound[text[a]], docs.bound[text[b - 1] + 1]
                some = []
                for (_, table), (at, from_, count) in zip(pairs, found):
                    here = slice(*np.searchsorted(at, (low, high)))
                    some.append(table.spread(at[here], from_[here], count[here]))
                at, item, offset = (np.concatenate(x) for x in zip(*some))
                doc, diagonal = np.searchsorted(docs.bound[1:], at, side="right"), at - offset
                order = np.lexsort((diagonal, item, doc))
                yield doc[order], item[order], diagonal[order]

    def candidates(self, docs: Read):
        """Rows (text, item, least, greatest diagonal), some texts at a time."""
        for doc, item, diagonal in self.hits(docs):
            last = np.arange(len(doc)) + self.need[item] - 1
            near = np.flatnonzero(last < len(doc))
            last = last[near]
            fit = ((doc[near] == doc[last]) & (item[near] == item[last])
                   & (diagonal[last] - diagonal[near] <= self.slack[item[near]]))
            near, last = near[fit], last[fit]
            yield merged(np.stack([doc[near], item[near], diagonal[near], diagonal[last]]), self.slack)

    def most(self, docs: Read, owner: np.ndarray) -> np.ndarray:
        """For each text the greatest number of near equal keys of the item
        that ``owner`` names."""
        out = np.zeros(len(owner), np.int64)
        for doc, item, diagonal in self.hits(docs):
            own = owner[doc] == item
            doc, item, diagonal = doc[own], item[own], diagonal[own]
            # One ascending number line, on which texts lie far apart.
            line = doc * (2 * len(docs.plain) + 2) + diagonal - diagonal.min(initial=0)
            stop = np.searchsorted(line, line + self.slack[item], side="right")
            np.maximum.at(out, doc, stop - np.arange(len(doc)))
        return out


def slices(text: np.ndarray, n: np.ndarray):
    """(from, to) of whole texts with about MAX_PAIRS in ``n`` each."""
    last = np.flatnonzero(np.append(np.diff(text) != 0, True)[:len(text)]) + 1
    total, a, before = np.cumsum(n), 0, 0
    for k, b in enumerate(last.tolist()):
        if k + 1 == len(last) or total[last[k + 1] - 1] - before > MAX_PAIRS:
            yield a, b
            a, before = b, total[b - 1]


def merged(found: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Candidates of one text and item whose diagonals are near, as one."""
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    if not found.shape[1]:
        return found
    new = np.ones(found.shape[1], bool)
    new[1:] = ((np.diff(found[0]) != 0) | (np.diff(found[1]) != 0)
               | (np.diff(found[2]) > slack[found[1][1:]]))
    at = np.flatnonzero(new)
    return np.stack([found[0][at], found[1][at], found[2][at], np.maximum.reduceat(found[3], at)])


def edited(item: str, rate: float, typos: bool, rng) -> str:
    """``item`` with about ``rate`` of its characters edited: one by one, or
    by words dropped, added and replaced."""
    parts, joint = (list(item), "") if typos else (item.split(" "), " ")
    letters = sorted(set(item) - {" "})
    # At most two new parts for each: in place of it and after it.
    drawn = iter([letters[k] for k in rng.integers(0, len(letters), 2 * len(item))])

    def other(part: str) -> str:
        return "".join(itertools.islice(drawn, len(part)))

    out = []
    for part, kind in zip(parts, rng.random(len(parts)) * 3):
        if kind < rate:
            continue
        out.append(other(part) if kind < 2 * rate else part)
        if 2 * rate <= kind < 3 * rate:
            out.append(other(part))
    return joint.join(out)


def plan(texts: list[str], reader: Reader, share: float, sizes: np.ndarray) -> list[tuple]:
    """(window, members, repetitions, number of equal keys) for the items of
    each size, by powers of two: the first of LADDER that finds edited copies
    of the items within ``share`` with TARGET_RECALL at each of RATES."""
    out = []
    size_class = np.log2(np.maximum(sizes, 1)).astype(int)
    for c in sorted(set(size_class.tolist())):
        members = np.flatnonzero(size_class == c)
        by_size = members[np.argsort(sizes[members], kind="stable")]
        some = by_size[np.unique(np.linspace(0, len(by_size) - 1, TUNED_ITEMS).astype(int))]
        copies = Copies([texts[k] for k in some], reader, share)
        for w, repetitions, least in LADDER:
            need = copies.most_asked(w, repetitions)
            if need >= least:
                out.append((w, members, repetitions, need))
                break
        else:
            raise ValueError(f"items of {sizes[members].min()} to {sizes[members].max()} words "
                             f"are not found with a recall of {TARGET_RECALL}")
    return out


class Copies:
    """Edited copies of items, of those that are within ``share``."""

    def __init__(self, texts: list[str], reader: Reader, share: float, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64([len(texts), seed]))
        self.items = reader.read(texts)
        plains = [self.items.text(a, a + n) for a, n in zip(*self.items.spans())]
        self.slack = np.array([int(share * len(p)) for p in plains])
        copies, cells, owner = [], [], []
        # Enough copies in each cell, also of few items.
        for k in np.arange(max(len(plains), TUNED_ITEMS)) % len(plains):
            for rate in RATES:
                for typos in (False, True):
                    copy = edited(plains[k], rate, typos, rng)
                    if best_match(plains[k], copy)[0] <= self.slack[k]:
                        pad = ["".join(rng.choice(list("etaoinshr"), 5)) for _ in range(4)]
                        copies.append(" ".join([*pad[:2], copy, *pad[2:]]))
                        cells.append((rate, typos))
                        owner.append(k)
        self.cells = {c: np.array([x == c for x in cells]) for c in sorted(set(cells))}
        self.read, self.owner = reader.read(copies), np.array(owner)

    def _most(self, w: int, repetitions: int) -> np.ndarray:
        index = Index(self.items, [(w, np.arange(len(self.slack)), repetitions, 1)], self.slack)
        return index.most(self.read, self.owner)

    def recall(self, w: int, repetitions: int, need: int) -> dict:
        """The share of copies found, by (rate, typos)."""
        most = self._most(w, repetitions)
        return {c: float(np.mean(most[those] >= need)) for c, those in self.cells.items()}

    def most_asked(self, w: int, repetitions: int) -> int:
        """The greatest number of equal keys that TARGET_RECALL of the copies of
        every cell have."""
        most = self._most(w, repetitions)
        return int(min((np.sort(most[those])[int((1 - TARGET_RECALL) * those.sum())]
                        for those in self.cells.values()), default=1))


def recalls(texts: list[str], reader: Reader, share: float, w: int, seed: int = 5):
    """Function of (repetitions, number of equal keys): the share of acceptable
    copies found by windows of ``w`` characters, by (rate, typos)."""
    copies = Copies(texts, reader, share, seed)

    def recall(repetitions: int, need: int) -> dict:
        return copies.recall(w, repetitions, need)
    return recall


def pieces(pattern: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(offset, part) of parts of at most 64 characters."""
    n = -(-len(pattern) // 64)
    cuts = [len(pattern) * k // n for k in range(n + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:])]


def least_distances(patterns: list[np.ndarray], which: np.ndarray,
                    texts: list[np.ndarray]) -> np.ndarray:
    """Least edit distance of ``patterns[which]``, of at most 64 characters, to
    any part of its text: the recurrence of :func:`best_match`, all pairs abreast.

    A pattern ends at the highest bit; the bits before it are rows that every
    letter matches at no cost."""
    used, which = np.unique(which, return_inverse=True)
    several = [patterns[k] for k in used.tolist()]
    n, one, high = len(which), np.uint64(1), np.uint64(63)
    count = np.array([len(p) for p in several])
    letters, code = np.unique(np.concatenate(several), return_inverse=True)
    kinds = len(letters) + 1
    at = np.concatenate([np.arange(64 - c, 64) for c in count.tolist()]).astype(np.uint64)
    free = np.array([(1 << 64 - c) - 1 for c in count.tolist()], np.uint64)
    table = np.repeat(free, kinds)
    np.bitwise_or.at(table, np.repeat(np.arange(len(several)), count) * kinds + code + 1, one << at)
    padded = np.zeros((n, max(map(len, texts))), np.uint32)
    for row, t in zip(padded, texts):
        row[:len(t)] = t
    at = np.minimum(np.searchsorted(letters, padded), len(letters) - 1)
    codes = np.where(letters[at] == padded, at + 1, 0) + (which * kinds)[:, None]
    up, down = ~free[which], np.zeros(n, np.uint64)
    score = count[which].astype(np.uint64)
    best = score.copy()
    eq, xh, rise, fall = (np.empty(n, np.uint64) for _ in range(4))
    for column in np.ascontiguousarray(codes.T):
        np.take(table, column, out=eq, mode="clip")
        np.bitwise_and(eq, up, out=xh)
        xh += up
        xh ^= up
        xh |= eq
        np.bitwise_or(xh, up, out=rise)
        np.invert(rise, out=rise)
        rise |= down
        np.bitwise_and(up, xh, out=fall)
        eq |= down
        score += np.right_shift(rise, high, out=xh)
        score -= np.right_shift(fall, high, out=xh)
        np.minimum(best, score, out=best)
        rise <<= one
        fall <<= one
        np.bitwise_and(rise, eq, out=down)
        eq |= rise
        np.invert(eq, out=eq)
        np.bitwise_or(fall, eq, out=up)
    return best.astype(np.int64)


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any part of ``text``, end of the
    first such part), by the bit-parallel recurrence of Myers."""
    m = len(pattern)
    if not m:
        return 0, 0
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (~(xh | up) & full), up & xh
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (~(xv | rise) & full), rise & xv
        if score < best:
            best, end = score, j + 1
    return best, end
