"""Documents that hold a benchmark item, exactly or with a few edits.

Texts and items are read as words (letters and digits; case and punctuation
do not count; in scripts without spaces every character is a word). Windows of
their characters, from every character on, are embedded by CGK random walks;
bit sampling over the embeddings looks up candidates in the index of the items,
with windows, repetitions and numbers of equal keys that reach the target recall
on copies edited up to ``MAX_EDITS`` (:mod:`ledgerlens.llm.cgk`). Every
candidate is verified by its exact edit distance, in characters, to the best
aligned part of the text: it counts when the distance is at most ``MAX_EDITS``
of the item's length. An item of fewer than ``MIN_WORDS`` words is found where
its words stand in a row, unedited.

Items are broadcast in slices of at most ``SLICE_ITEMS``, each slice a pass
over the documents, so what is broadcast is bounded whatever the benchmark.

Defined cases: a null or empty text holds nothing; an item that is null or
has no word is not looked for; repeated items and rows
are reported for each; an empty table on either side gives no rows; null ids
pass through; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import cgk, ship, words
from ledgerlens.llm.common import row_keyed, saved, small_batches, text_of

ship(__name__, cgk.__name__, words.__name__)

MAX_EDITS = 0.25
MIN_WORDS = 5
SLICE_ITEMS = 5_000
# Parts of candidates compared abreast, and characters of text they are
# compared with in all (those of one part at least).
PAIRS = 2048
CELLS = 1 << 19
# Characters of text read in one go: about 200 bytes of arrays for each.
CHUNK = 1 << 17

_FOUND = "doc_id long, item_id long, distance int, similarity double, start long, length long"


def _sequences(h: np.ndarray, first: np.ndarray, count: np.ndarray, m: int):
    """(key, first word, owner) of every ``m`` words in a row."""
    at, owner = cgk.starts_of(first, count, m, 1)
    total = np.zeros(len(at), np.uint64)
    for j in range(m):
        total += h[at + j] * words.PLACE[j]
    return words.mixed(total), at, owner


class _Items:
    """What a task looks up: the items as read, and the tables of the plan."""

    def __init__(self, ids: list, texts: list[str], plan: list[tuple], reader: cgk.Reader):
        self.ids, self.reader = ids, reader
        read = reader.read(texts)
        self.patterns = [read.plain[read.begin[a]:read.end[b - 1]]
                         for a, b in zip(read.first[:-1], read.first[1:])]
        self.size = np.array([len(p) for p in self.patterns])
        self.slack = np.array([int(MAX_EDITS * m) for m in self.size.tolist()])
        parts = [cgk.pieces(p) for p in self.patterns]
        self.parts = np.array([len(x) for x in parts])
        self.part_offset = np.array([o for x in parts for o, _ in x])
        self.part = [p for x in parts for _, p in x]
        self.index = cgk.Index(read, plan, self.slack)
        self.short = {}
        count = np.diff(read.first)
        for m in range(1, MIN_WORDS):
            those = np.flatnonzero(count == m)
            if len(those):
                keys, _, owner = _sequences(read.h, read.first[those], count[those], m)
                self.short[m] = cgk.Table(keys, those[owner], np.zeros(len(keys), np.int64))

    def _bound(self, docs: cgk.Read, doc, item, low, high) -> np.ndarray:
        """No more than the distance of each candidate: the sum over the parts
        of the item of the least distance to where the part can be."""
        n = self.parts[item]
        pair = np.repeat(np.arange(len(item)), n)
        part = (np.cumsum(self.parts) - self.parts)[item[pair]]
        part += np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        size = np.array([len(p) for p in self.part])[part]
        slack = self.slack[item[pair]]
        start = np.maximum(docs.bound[doc[pair]], low[pair] + self.part_offset[part] - slack)
        stop = np.minimum(docs.bound[doc[pair] + 1], high[pair] + self.part_offset[part] + size + slack)
        stop = np.maximum(start, stop)
        out = np.zeros(len(item), np.int64)
        order = np.argsort(start - stop, kind="stable")  # the longest first
        k = 0
        while k < len(order):
            longest = int(stop[order[k]] - start[order[k]])
            some = order[k:k + max(1, min(PAIRS, CELLS // max(longest, 1)))]
            k += len(some)
            texts = [docs.plain[a:b] for a, b in zip(start[some].tolist(), stop[some].tolist())]
            np.add.at(out, pair[some], cgk.least_distances(self.part, part[some], texts))
        return out

    def found(self, docs: cgk.Read) -> dict:
        """(text, item): (distance, first, last + 1 character) in ``docs.plain``."""
        best: dict[tuple[int, int], tuple] = {}
        for m, table in self.short.items():
            keys, at, owner = _sequences(docs.h, docs.first[:-1], np.diff(docs.first), m)
            hit, item, _ = table.hits(keys)
            for k, i in zip(hit.tolist(), item.tolist()):
                best.setdefault((int(owner[k]), i), (0, docs.begin[at[k]], docs.end[at[k] + m - 1]))
        for found in self.index.candidates(docs):
            doc, item, low, high = found[:, self._bound(docs, *found) <= self.slack[found[1]]].tolist()
            for d, i, a, b in zip(doc, item, low, high):
                a = max(int(docs.bound[d]), a - int(self.slack[i]))
                b = min(int(docs.bound[d + 1]), b + int(self.size[i] + self.slack[i]))
                if b > a:
                    text = docs.text(a, b)
                    pattern = self.patterns[i].tobytes().decode("utf-32-le")
                    distance, stop = cgk.best_match(pattern, text)
                    if distance > self.slack[i]:
                        continue
                    known = best.get((d, i))
                    if known and (known[0], known[1]) <= (distance, a):
                        continue
                    _, back = cgk.best_match(pattern[::-1], text[:stop][::-1])
                    # The words that hold its first and its last character.
                    left = np.searchsorted(docs.begin, a + stop - back, side="right") - 1
                    left = max(left, np.searchsorted(docs.begin, a))
                    right = np.searchsorted(docs.begin, a + max(stop, 1) - 1, side="right") - 1
                    best[d, i] = (distance, docs.begin[left], docs.end[max(left, right)])
        return best


def _search(shipped):
    def run(batches):
        reader = cgk.Reader()
        items = _Items(*shipped.value, reader)
        for batch in batches:
            docs = batch.column("_id").to_pylist()
            texts = batch.column("_text").to_pylist()
            rows = []
            for a, b in words.chunks(texts, CHUNK):
                read = reader.read(texts[a:b])
                for (doc, item), (distance, left, right) in sorted(items.found(read).items()):
                    start, stop = int(read.src[left]), int(read.src[right - 1]) + 1
                    rows.append((docs[a + doc], items.ids[item], distance,
                                 1 - distance / len(items.patterns[item]),
                                 start - int(read.offset[doc]), stop - start))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            names = ("doc_id", "item_id", "distance", "similarity", "start", "length")
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             list(names))
        items = reader = None
        words.release()
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """One row per (document, item) that it holds: ``doc_id, item_id, distance,
    similarity, start, length`` (the span in code points of the text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("_id"),
                             text_of(item_text_col).alias("_text"))
    slices = -(-items.count() // SLICE_ITEMS)
    dealt = items.withColumn("_slice", F.pmod(F.xxhash64("_id", "_text"), F.lit(max(slices, 1))))
    out = spark.createDataFrame([], _FOUND)
    reader = cgk.Reader()
    for k in range(slices):
        # About SLICE_ITEMS rows, the bound of the broadcast.
        part = dealt.filter(F.col("_slice") == k).collect()
        read = reader.read([r["_text"] for r in part])
        count = np.diff(read.first)
        kept = np.flatnonzero(count)
        ids, texts = [part[i]["_id"] for i in kept], [part[i]["_text"] for i in kept]
        if ids:
            long = np.flatnonzero(count[kept] >= MIN_WORDS)
            plan = [(w, long[members], *rest) for w, members, *rest in cgk.plan(
                [texts[i] for i in long], reader, MAX_EDITS, read.spans()[1][kept][long])]
            sent = spark.sparkContext.broadcast((ids, texts, plan))
            out = out.unionByName(rows.mapInArrow(_search(sent), _FOUND))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whatever their ids."""
    keyed = row_keyed(docs, "decontamination-rows")
    found = saved(contaminated(keyed, benchmark, "_row", text_col).select(
        F.col("doc_id").alias("_row")).distinct(), "contaminated")
    return keyed.join(found, "_row", "left_anti").select(*docs.columns)
