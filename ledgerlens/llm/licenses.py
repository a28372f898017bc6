"""Licence notices in documents.

Templates and texts are read as words (letters and digits; case and
punctuation do not count). The winnowed k-gram fingerprints of the templates
form an inverted index: of every ``WINDOW`` consecutive k-grams the least hash
is kept, so any ``GRAM + WINDOW - 1`` words shared with a template share a
fingerprint; of templates up to ``SHORT_WORDS`` words every k-gram is kept.
Every k-gram of every text is looked up. Hits on neighbouring diagonals make a
candidate if they are at least one in ``WORDS_PER_HIT`` of the template's words;
it is aligned with the template in a band around its diagonal (``BAND`` words
to either side, half the template's words if that is less). A match reports
the share of the template's words aligned, and the span.

A template may have telling phrases (a licence's name, its version): each must
stand in the matched span word by word, so that a notice is not read as one of
another licence or version. Of overlapping spans of different licences only the
one with the most words matched stays; forms of one licence may overlap.

Templates are a parameter; more than ``SLICE_WORDS`` words of them are scanned
in slices, whose matches meet again per document.

Defined cases: a null or empty text has no notice; a template of fewer than
``GRAM`` words is an error; repeated rows are reported for each; an empty
table gives no rows; null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import license_notices, ship, words
from ledgerlens.llm.common import row_keyed, small_batches, text_of
from ledgerlens.llm.license_notices import TELLING, TEMPLATES, licence_of

ship(__name__, words.__name__, license_notices.__name__)

GRAM = 3
WINDOW = 3
BAND = 8
COVERAGE = 0.75
SHORT_WORDS = 24
WORDS_PER_HIT = 50
SLICE_WORDS = 200_000

_FOUND = "doc_id long, license string, coverage double, matched int, start long, length long"
_KINDS = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
_NAMES = ("doc_id", "license", "coverage", "matched", "start", "length")


def grams(h: np.ndarray, owner: np.ndarray, k: int = GRAM):
    """(hash, position) of the k-grams that stay within one text."""
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        total += h[j:len(h) - k + 1 + j] * words.PLACE[j]
    at = np.flatnonzero(owner[:len(h) - k + 1] == owner[k - 1:])
    return words.mixed(total[at]), at


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions kept: the rightmost least hash of every window."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())])
    rows = np.lib.stride_tricks.sliding_window_view(hashes, window)
    least = window - 1 - rows[:, ::-1].argmin(axis=1)
    return np.unique(least + np.arange(len(rows)))


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND):
    """(words matched, first, last + 1) of the best alignment of ``template``
    with a part of ``text`` whose diagonals (text - template) lie within
    ``band`` of ``diagonal``. Gaps cost one, as do differing words."""
    m, n = len(template), len(text)
    width = 2 * band + 1
    # score, matches, start, by diagonal
    low = -10 ** 9
    score, matched, start = [0] * width, [0] * width, [diagonal - band + d for d in range(width)]
    for i in range(m):
        new_s, new_m, new_b = [low] * width, [0] * width, [0] * width
        for d in range(width):
            j = i + diagonal - band + d
            same = 0 <= j < n and template[i] == text[j]
            options = [(score[d] + (1 if same else -1), matched[d] + same, start[d])]
            if d + 1 < width:  # template word without a partner
                options.append((score[d + 1] - 1, matched[d + 1], start[d + 1]))
            if d:  # text word without a partner
                options.append((new_s[d - 1] - 1, new_m[d - 1], new_b[d - 1]))
            new_s[d], new_m[d], new_b[d] = max(options, key=lambda o: (o[0], o[1]))
        score, matched, start = new_s, new_m, new_b
    best = max(range(width), key=lambda d: (score[d], matched[d]))
    stop = m + diagonal - band + best
    return matched[best], max(0, start[best]), min(n, max(stop, 0))


def contains(text: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether the words of ``phrase`` stand in ``text`` one after the other."""
    last = len(text) - len(phrase) + 1
    if last < 1:
        return False
    at = np.flatnonzero(text[:last] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[text[at + j] == phrase[j]]
    return len(at) > 0


def best_spans(spans: list[tuple]) -> list[tuple]:
    """Of ``(name, matched, start, stop)`` those that stay: the most words matched
    first (then the shorter span, the earlier one, the name), none that overlaps
    one of another licence, or one of the same template, before it."""
    kept: list[tuple] = []
    by_licence: dict[str, list] = {}
    by_name: dict[str, list] = {}

    def clash(taken: list, start: int, stop: int) -> bool:
        k = bisect.bisect_left(taken, (stop,))
        return k > 0 and taken[k - 1][2] > start

    def take(taken: list, start: int, stop: int) -> None:
        # The third part is the greatest end so far, as spans may overlap.
        k = bisect.bisect_right(taken, (start, stop, stop))
        taken.insert(k, (start, stop, max(stop, taken[k - 1][2] if k else stop)))
        while k + 1 < len(taken) and taken[k + 1][2] < taken[k][2]:
            taken[k + 1] = (*taken[k + 1][:2], taken[k][2])
            k += 1

    for span in sorted(spans, key=lambda x: (-x[1], x[3] - x[2], x[2], x[0])):
        name, _, start, stop = span
        mine = licence_of(name)
        if clash(by_name.setdefault(name, []), start, stop) or any(
                clash(taken, start, stop) for other, taken in by_licence.items() if other != mine):
            continue
        take(by_name[name], start, stop)
        take(by_licence.setdefault(mine, []), start, stop)
        kept.append(span)
    return sorted(kept, key=lambda x: (x[2], x[0]))


class Index:
    def __init__(self, templates: dict[str, str], telling: dict[str, tuple]):
        hasher = words.Hasher(words.IS_ALNUM)
        self.names, self.seqs, self.telling, self.least, self.band = [], [], [], [], []
        keys, ids, offsets = [], [], []
        for name, text in sorted(templates.items()):
            h, _, _, owner, _ = hasher.words([text.encode()])
            if len(h) < GRAM:
                raise ValueError(f"template {name!r} has fewer than {GRAM} words")
            hashes, at = grams(h, owner)
            kept = np.arange(len(hashes)) if len(h) <= SHORT_WORDS else winnowed(hashes)
            keys.append(hashes[kept])
            offsets.append(at[kept])
            ids.append(np.full(len(kept), len(self.names)))
            self.names.append(name)
            self.seqs.append(h)
            self.telling.append([hasher.words([p.encode()])[0] for p in telling.get(name, ())])
            self.least.append(max(1, len(h) // WORDS_PER_HIT))
            # Narrow for short templates, so that one right behind another is seen.
            self.band.append(min(BAND, len(h) // 2))
        keys, ids, offsets = (np.concatenate(x) for x in (keys, ids, offsets))
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids, self.offsets = keys[order], ids[order], offsets[order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.keys >> np.uint64(44)] = True

    def tells(self, template: int, text: np.ndarray) -> bool:
        return all(contains(text, phrase) for phrase in self.telling[template])

    def hits(self, hashes: np.ndarray):
        """(k-gram, template, offset) of every fingerprint met."""
        maybe = np.flatnonzero(self.bitmap[hashes >> np.uint64(44)])
        low = np.searchsorted(self.keys, hashes[maybe], side="left")
        n = np.searchsorted(self.keys, hashes[maybe], side="right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(maybe, n), self.ids[at], self.offsets[at]


def _candidates(index: Index, doc, which, diagonal):
    """(text, template, diagonal) of hits that lie within a band, where they are
    enough for the template; sorted."""
    order = np.lexsort((diagonal, which, doc))
    doc, which, diagonal = doc[order], which[order], diagonal[order]
    k, n = 0, len(doc)
    edges = np.flatnonzero((np.diff(doc) != 0) | (np.diff(which) != 0)) + 1
    for stop in [*edges.tolist(), n] if n else []:
        while k < stop:
            upto = k + int(np.searchsorted(diagonal[k:stop], diagonal[k] + index.band[which[k]],
                                           side="right"))
            if upto - k >= index.least[which[k]]:
                yield int(doc[k]), int(which[k]), int(diagonal[k])
            k = upto


def _scan(templates: dict[str, str], telling: dict[str, tuple], coverage: float, resolve: bool):
    def run(batches):
        index, hasher = Index(templates, telling), words.Hasher(words.IS_ALNUM)
        for batch in batches:
            docs = batch.column("_id").to_pylist()
            blobs = pc.cast(batch.column("_text"), pa.binary()).to_pylist()
            rows = []
            for a, b in words.chunks(blobs):
                h, begin, end, owner, offsets = hasher.words(blobs[a:b])
                count = np.bincount(owner, minlength=b - a)
                first = np.cumsum(count) - count
                hashes, at = grams(h, owner)
                gram, which, offset = index.hits(hashes)
                place = at[gram]
                doc = owner[place] if len(place) else place
                found: dict[int, dict] = {}
                for d, t, diagonal in _candidates(index, doc, which, place - first[doc] - offset):
                    seq, band = index.seqs[t], index.band[t]
                    text = h[first[d]:first[d] + count[d]]
                    low = max(0, diagonal - band)
                    part = text[low:diagonal + len(seq) + band + 1]
                    if not index.tells(t, part):
                        continue
                    matched, left, right = align(seq.tolist(), part.tolist(), diagonal - low, band)
                    if (matched >= coverage * len(seq) and right > left
                            and index.tells(t, part[left:right])):
                        found.setdefault(d, {}).setdefault((t, low + left), (matched, low + right))
                for d, spans in found.items():
                    every = [(index.names[t], m, left, right) for (t, left), (m, right) in spans.items()]
                    blob, base = blobs[a + d], offsets[d]
                    for name, matched, left, right in best_spans(every) if resolve else every:
                        x, y = begin[first[d] + left] - base, end[first[d] + right - 1] - base
                        size = len(index.seqs[index.names.index(name)])
                        rows.append((docs[a + d], name, matched / size, matched,
                                     len(blob[:x].decode()), len(blob[x:y].decode())))
            columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)],
                                             list(_NAMES))
        hasher = None
        words.release()
    return run


def _slices(templates: dict[str, str]) -> list[dict[str, str]]:
    """The templates in slices of about ``SLICE_WORDS`` words."""
    out, size = [{}], 0
    for name, text in sorted(templates.items()):
        n = len(text.split())
        if out[-1] and size + n > SLICE_WORDS:
            out.append({})
            size = 0
        out[-1][name] = text
        size += n
    return out


def _resolve(found: pd.DataFrame) -> pd.DataFrame:
    """The spans of one document that stay, over all slices of templates."""
    keep = best_spans(list(zip(found["license"], found["matched"], found["start"],
                               found["start"] + found["length"])))
    where = {k: i for i, k in enumerate(zip(found["license"], found["start"]))}
    return found.iloc[[where[name, start] for name, _, start, _ in keep]]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES,
                  coverage: float = COVERAGE, id_col: str = "doc_id",
                  text_col: str = "text", telling: dict[str, tuple] | None = None) -> DataFrame:
    """One row per notice found: ``doc_id, license, coverage, matched, start,
    length`` (the span in code points of the text).

    ``telling`` maps a template's name to the phrases that must be there (those
    of the default templates if not given)."""
    small_batches(docs.sparkSession)
    telling = TELLING if telling is None else telling
    parts = _slices(templates)
    if len(parts) == 1:
        rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
        return rows.mapInArrow(_scan(templates, telling, coverage, True), _FOUND)
    rows = row_keyed(docs.select(F.col(id_col).cast("long").alias("_doc"),
                                 text_of(text_col).alias("_text")), "license-rows")
    texts = rows.select(F.col("_row").alias("_id"), "_text")
    found = None
    for part in parts:
        more = texts.mapInArrow(_scan(part, telling, coverage, False), _FOUND)
        found = more if found is None else found.unionByName(more)
    # A document's matches are bounded by its text and the templates.
    kept = found.withColumnRenamed("doc_id", "_row").groupBy("_row").applyInPandas(
        _resolve, _FOUND.replace("doc_id", "_row", 1))
    return kept.join(rows.select("_row", F.col("_doc").alias("doc_id")), "_row").select(*_NAMES)
