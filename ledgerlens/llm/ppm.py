"""Variable-order byte contexts with escape probabilities, frozen for scoring.

A language's model is a tree of its own: the contexts (the empty one, and
suffixes of one to three bytes) that occur most often in its training text,
with the counts of the bytes that followed them.
The probability of a byte in a context is that of prediction by partial
matching, escape method C:

    seen in the context:  count / (total + distinct)
    else:                 distinct / (total + distinct)  times the
                          probability in the next shorter context,

ending in a uniform distribution over 256 bytes. All counts are fixed before
scoring, so the cost of a byte depends on the context alone and is tabulated:
one table row per context kept, the longest kept suffix being used. A text's
code length is the sum of the table entries its bytes meet.
"""

from __future__ import annotations

import numpy as np

ORDER = 3
# Context nodes a language keeps (its most frequent ones), which bounds its
# tables: NODES * 256 floats, and less than 2 MB to find a context's row.
NODES = 2048
PAD = b"\0" * ORDER


def grams(texts: list[bytes]):
    """(key, count) of the 4-byte windows of ``texts`` (each led by PAD): three
    bytes of context and the byte that follows, as one integer."""
    buf = np.frombuffer(PAD + PAD.join(texts), np.uint8).astype(np.uint32)
    n = len(buf) - ORDER
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = (buf[:n] << 24) | (buf[1:n + 1] << 16) | (buf[2:n + 2] << 8) | buf[3:]
    key = key[buf[3:] != 0]  # the padding itself is not predicted
    keys, counts = np.unique(key, return_counts=True)
    return keys.astype(np.int64), counts.astype(np.int64)


def _distinct(values: np.ndarray, counts: np.ndarray):
    keys, inverse = np.unique(values, return_inverse=True)
    return keys, np.bincount(inverse, weights=counts, minlength=len(keys))


def _costs(keys, counts, ones, pairs, threes) -> np.ndarray:
    """Bits of every byte in every context kept, shorter contexts first."""
    def follow(order: int, kept: np.ndarray) -> np.ndarray:
        seen = np.zeros((len(kept), 256))
        if len(kept) and len(keys):
            ctx = (keys >> 8) & ((1 << (8 * order)) - 1)
            at = np.searchsorted(kept_sorted := np.sort(kept), ctx)
            at = np.minimum(at, len(kept) - 1)
            hit = kept_sorted[at] == ctx
            place = np.argsort(kept, kind="stable")[at[hit]]
            np.add.at(seen, (place, keys[hit] & 255), counts[hit])
        return seen

    def refine(seen: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        total = seen.sum(axis=1, keepdims=True)
        kinds = (seen > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            known = seen / (total + kinds)
            lost = kinds / (total + kinds) * shorter
        return np.where(total == 0, shorter, np.where(seen > 0, known, lost))

    zero = np.zeros((1, 256))
    if len(keys):
        np.add.at(zero, (np.zeros(len(keys), np.int64), keys & 255), counts)
    p0 = refine(zero, np.full((1, 256), 1 / 256))
    p1 = refine(follow(1, ones), np.repeat(p0, len(ones), axis=0))
    order1 = {int(c): i for i, c in enumerate(ones)}
    up2 = np.array([order1[int(c) & 255] for c in pairs], np.int64)
    p2 = refine(follow(2, pairs), p1[up2] if len(pairs) else np.empty((0, 256)))
    order2 = {int(c): i for i, c in enumerate(pairs)}
    up3 = np.array([order2[int(c) & 0xFFFF] for c in threes], np.int64)
    p3 = refine(follow(3, threes), p2[up3] if len(threes) else np.empty((0, 256)))
    return (-np.log2(np.concatenate([p0, p1, p2, p3]))).astype(np.float32).ravel()


def tree(keys: np.ndarray, counts: np.ndarray, nodes: int = NODES) -> dict[str, np.ndarray]:
    """One language's contexts and their costs, from its grams."""
    # Contexts of order 1, 2, 3 by frequency; a context's shorter suffixes are
    # kept with it: a suffix is at least as frequent as the contexts it ends, so
    # it is ranked before them.
    ranked = []
    for order in range(1, ORDER + 1):
        ctx, n = _distinct((keys >> 8) & ((1 << (8 * order)) - 1), counts)
        ranked.append(np.stack([np.full(len(ctx), order), ctx, n.astype(np.int64)]))
    ranked = np.concatenate(ranked, axis=1)
    ranked = ranked[:, np.lexsort((ranked[1], ranked[0], -ranked[2]))][:, :nodes - 1]
    ones, pairs, threes = (ranked[1, ranked[0] == order] for order in (1, 2, 3))
    base2, base3 = 1 + len(ones), 1 + len(ones) + len(pairs)
    state1 = np.zeros(256, np.int32)
    state1[ones] = 1 + np.arange(len(ones))
    state2 = np.tile(state1, 256)
    state2[pairs] = base2 + np.arange(len(pairs))
    # The step from (older pair, last byte) to the context's row.
    older = np.unique(threes >> 8)
    pair_id = np.zeros(1 << 16, np.int32)
    pair_id[older] = 1 + np.arange(len(older))
    state3 = np.full((len(older) + 1, 256), -1, np.int32)
    state3[pair_id[threes >> 8], threes & 255] = base3 + np.arange(len(threes))
    return {"pair_id": pair_id, "state2": state2, "state3": state3,
            "cost": _costs(keys, counts, ones, pairs, threes)}


class Model:
    """The trees of some languages, built from their (gram, count) arrays."""

    def __init__(self, langs: list[str], per_lang: list[tuple[np.ndarray, np.ndarray]],
                 nodes: int = NODES):
        self.langs = langs
        self.trees = [tree(keys, counts, nodes) for keys, counts in per_lang]

    @classmethod
    def restored(cls, state: dict) -> Model:
        model = cls.__new__(cls)
        vars(model).update(state)
        return model

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code lengths in bits: texts x languages."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        buf = np.frombuffer(PAD + PAD.join(texts), np.uint8).astype(np.int32)
        first = np.cumsum(sizes + ORDER) - sizes
        out = np.zeros((len(texts), len(self.langs)))
        if len(buf) <= ORDER:
            return out
        older, last_two = (buf[:-3] << 8) | buf[1:-2], (buf[1:-2] << 8) | buf[2:-1]
        total = np.zeros(len(buf) - ORDER + 1)
        for k, t in enumerate(self.trees):
            state = t["state3"][t["pair_id"][older], buf[2:-1]]
            short = state < 0
            state[short] = t["state2"][last_two[short]]
            np.cumsum(t["cost"][(state << 8) | buf[3:]], out=total[1:], dtype=np.float64)
            out[:, k] = total[first + sizes - ORDER] - total[first - ORDER]
        return out
