"""Ranked lexical search: the best documents for each item of a query set.

Terms are runs of letters, digits and non-ASCII characters; A-Z count as a-z.
A score sums, over an item's distinct terms, the term's weight times a
saturating function of its count in the document and of the document's
length, in whole numbers.

1. One pass over the texts keeps, of every document, its length and the counts
   of the items' terms, and writes these sparse vectors. Corpus size, total
   length and document frequencies are sums over that table.
2. The vectors are searched partition by partition with a dual-tree search
   (:mod:`ledgerlens.llm.dual_tree`), in blocks of ``BLOCK_DOCS`` documents.
   Rounds over a growing share of the documents (``ROUND`` times larger each,
   the last over all the rest) hand on the k-th best scores found so far; a
   task then returns only documents that reach them, some ``ROUND`` times k
   an item over all tasks, however many tasks there are.
3. The best k of each item's returned documents are its result.

Items are taken in blocks of a bounded number of term entries, the bound of
what is collected and broadcast; each block is matched against all documents.

Defined cases: a null or empty text, or one without a term, has no rank and
does not count into N; an item without a term has no rows; rows that repeat a
document id are documents of their own; equal scores rank by ascending id,
null last; rows that repeat an item are separate items under one id; a null
item id is kept; an empty table gives no rows; other columns are ignored,
whatever their names. Texts of any length are read whole, in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import dual_tree, ship, words
from ledgerlens.llm.common import saved, small_batches

ship(__name__, dual_tree.__name__, words.__name__)

TOP = 50
# Term entries (item, term) of a block of items; an item beyond that is a
# block of its own.
BLOCK_TERMS = 1_000_000
# Documents whose hierarchy is built at once, and bytes of text read at once.
BLOCK_DOCS = 4096
PIECE = 1 << 20
# Each round covers this many times the documents of the one before; the
# first, at least about FIRST documents.
ROUND = 64
FIRST = 2048

# Bytes of terms as they count (a-z for A-Z), a space for all others.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if words.IS_ALNUM[c] else 32 for c in range(256))

_VECTOR = "doc_id long, n long, coords binary, counts binary, lane int"
_FOUND = "item int, score long, doc_id long"


def terms(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``PIECE`` bytes, cut where no term is."""
    start = 0
    while len(data) - start > PIECE:
        inside = words.IS_ALNUM[np.frombuffer(data, np.uint8, offset=start + PIECE)]
        after = int(np.argmin(inside))
        if inside[after]:  # one term up to the end
            break
        yield data[start:start + PIECE + after]
        start += PIECE + after
    yield data[start:] if start else data


def _vectors(shipped, shares: list[float]):
    """Sparse vectors over the items' terms, and the round of each document."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())

    def run(batches):
        place = {t: i for i, t in enumerate(shipped.value)}
        for batch in batches:
            rows = []
            for doc, text, draw in zip(*(batch.column(c).to_pylist()
                                         for c in ("_id", "_text", "_draw"))):
                n, hits = 0, []
                for part in pieces(text):
                    found = terms(part)
                    n += len(found)
                    at = np.fromiter(map(place.get, found, repeat(-1)), np.int32, len(found))
                    hits.append(at[at >= 0])
                coords, counts = np.unique(np.concatenate(hits), return_counts=True)
                if n:
                    lane = next(k for k, share in enumerate(shares) if draw < share)
                    rows.append((doc, n, coords.astype("<i4").tobytes(),
                                 counts.astype("<i4").tobytes(), lane))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "n", "coords", "counts", "lane"])
        place = None
        words.release()
    return run


def _frequencies(n_terms: int):
    """Per task, the documents that hold each coordinate."""
    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for data in batch.column("coords"):
                total[np.frombuffer(data.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])],
                                         ["coord", "df"])
    return run


def _searched(shipped, top: int):
    def run(batches):
        starts, coords, weights, floors, n_docs, length = shipped.value
        items = dual_tree.Items(starts, coords, len(weights))
        search = dual_tree.Search(items, top, floors)
        block: list = []
        for batch in batches:
            block += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "coords", "counts")))
            while len(block) >= BLOCK_DOCS:
                _add(search, block[:BLOCK_DOCS], weights, n_docs, length)
                block = block[BLOCK_DOCS:]
        _add(search, block, weights, n_docs, length)
        found = [(item, score, None if known == 0 else -minus)
                 for item, score, (known, minus) in search.results()]
        columns = list(zip(*found)) if found else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()))],
            ["item", "score", "doc_id"])
        words.release()
    return run


def _add(search, block: list, weights: np.ndarray, n_docs: int, length: int) -> None:
    """Turn counts into the coordinates' shares of a score and search them."""
    if not block:
        return
    found = [np.frombuffer(c, "<i4") for _, _, c, _ in block]
    size = np.fromiter(map(len, found), np.int64, len(found))
    coord = np.concatenate(found).astype(np.int64)
    tf = np.concatenate([np.frombuffer(c, "<i4") for *_, c in block]).astype(np.int64)
    # In Python's whole numbers: 50 * n * N may pass 64 bits.
    m = np.array([50 + 50 * n * n_docs // length for _, n, _, _ in block], np.int64)
    value = weights[coord] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, size)))
    ids = [(0, 0) if i is None else (1, -i) for i, *_ in block]
    search.add(ids, np.concatenate([[0], np.cumsum(size)]), coord, value)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """(item ids, their distinct terms) in blocks of ``BLOCK_TERMS`` entries.
    Rows are fetched partition by partition, never all at once."""
    ids, sets, size = [], [], 0
    for row in items.toLocalIterator():
        found = sorted(set(terms(bytes(row["_text"]))))
        if not found:
            continue
        if size and size + len(found) > BLOCK_TERMS:
            yield ids, sets
            ids, sets, size = [], [], 0
        ids.append(row["_id"])
        sets.append(found)
        size += len(found)
    if ids:
        yield ids, sets


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _shares(n_rows: int) -> list[float]:
    """Upper edges of the rounds' shares of the documents; the last is 1."""
    rounds = max(0, math.floor(math.log(max(n_rows / FIRST, 1), ROUND)))
    return [float(ROUND) ** -(rounds - k) for k in range(rounds + 1)]


def _ranked(rows: DataFrame, ids: list, sets: list, top: int, shares: list[float]) -> DataFrame:
    """``item, rank, doc_id, score`` of one block of items."""
    spark = rows.sparkSession
    vocabulary = sorted(set().union(*sets))
    place = {t: i for i, t in enumerate(vocabulary)}
    sent = spark.sparkContext.broadcast(vocabulary)
    vectors = saved(rows.mapInArrow(_vectors(sent, shares), _VECTOR), "lexical-vectors")
    n_docs, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = dict(vectors.select("coords").mapInArrow(_frequencies(len(vocabulary)), "coord int, df long")
              .groupBy("coord").agg(F.sum("df")).collect())  # one row a term of the block
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    coords = [np.array([place[t] for t in s], np.int64) for s in sets]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in coords])])
    floors = np.zeros(len(ids), np.int64)
    best = spark.createDataFrame([], _FOUND)
    for lane in range(len(shares)):
        shipped = spark.sparkContext.broadcast(
            (starts, np.concatenate(coords), weights, floors, n_docs, length or 1))
        found = (vectors.filter(F.col("lane") == lane).select("doc_id", "n", "coords", "counts")
                 .mapInArrow(_searched(shipped, top), _FOUND))
        best = saved(_best(best.unionByName(found), top), "lexical-best").select(
            "item", "score", "doc_id", "rank")
        floors = np.zeros(len(ids), np.int64)
        for item, score in best.filter(F.col("rank") == top).select("item", "score").collect():
            floors[item] = score  # one row an item of the block
        if lane + 1 < len(shares):
            best = best.drop("rank")
    return best


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """The ``top`` documents of every item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    small_batches(spark)

    def text(column: str):
        return F.coalesce(F.col(column), F.lit("")).cast("binary").alias("_text")

    draw = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 11) / float(2 ** 53)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text(text_col), draw.alias("_draw"))
    queries = items.select(F.col(item_col).cast("long").alias("_id"), text(item_text_col))
    shares = _shares(docs.count())
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for ids, sets in _blocks(queries):
        best = _ranked(rows, ids, sets, top, shares)
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        out = out.unionByName(best.join(F.broadcast(names), "item").select(
            "item_id", "rank", "doc_id", "score"))
    return out
