"""Token ids of all documents in a compressed binary format, and its reader.

Documents are dealt into ranges of ascending id; each task of a range encodes
its texts and writes chunks of consecutive documents. Counts of all ids give
one global canonical Huffman code, under which every chunk becomes one
independent block (see :mod:`ledgerlens.llm.huffman`). A written corpus is a
folder with ``blocks`` (rows ``part, chunk, n_docs, n_ids, payload``, ordered
by part and chunk) and ``code`` (one row per id in use: its code length),
both through Spark's committed writers, so lost tasks leave no half files.

Encoding: a task splits texts at ASCII white space, encodes each distinct
piece once with the tokenizers library, and assembles the documents from the
pieces. This equals encoding whole texts for tokenizers whose tokens never
contain white space, which is checked on the tokenizer before the job runs.

Defined cases: a null text is empty (its ids are the end id alone); documents
are ordered by id, null first, rows that repeat an id by a hash of their
text; an empty table gives no blocks and no rows; a text of any length is
encoded whole, in one block; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import huffman, ship, words
from ledgerlens.llm.common import saved, small_batches, text_of, text_volume
from ledgerlens.session import scratch_root

ship(__name__, huffman.__name__, words.__name__)

END_ID = 2
# Bytes of text a range is sized for, bytes encoded in one go (distinct pieces
# repeat more within larger groups), ids a block is filled to, and pieces that
# go into one call of the library.
RANGE_BYTES = 16 << 20
GROUP_BYTES = 18 << 20
BLOCK_IDS = 1 << 20
CALL_PIECES = 4_000
# Words of documents assembled in one go (those of one document at least).
SLICE_PIECES = 1 << 18

_CHUNK = "part int, chunk int, doc_ids binary, nulls binary, sizes binary, ids binary"


class Encoder:
    """Ids of texts, each distinct piece encoded once."""

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id = Tokenizer.from_str(spec), end_id
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.folds = self._folds(self.tokenizer)
        self.closes = np.zeros(max([end_id, *vocabulary.values()]) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @staticmethod
    def _folds(t) -> bool:
        """Whether the tokenizer itself lowers case, and always cuts between a
        letter and a full stop, comma and the like, never within a-z
        (checked on its parts)."""
        if t.normalizer is None or t.pre_tokenizer is None or t.normalizer.normalize_str("Az") != "az":
            return False
        if [p for p, _ in t.pre_tokenizer.pre_tokenize_str("abz")] != ["abz"]:
            return False
        return all([p for p, _ in t.pre_tokenizer.pre_tokenize_str(f"ab{c}'s{c}b")]
                   == [p for part in ("ab", f"{c}'s", f"{c}b")
                       for p, _ in t.pre_tokenizer.pre_tokenize_str(part)] for c in ".,;:!?")

    def _spelled(self, pieces: pa.Array) -> tuple[list, list]:
        """(ids, ids per piece) of a-z words: nothing to normalise or cut, so
        the library's model is asked directly."""
        tokenize = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokenize(p)] for p in _joined(pieces).split(" ")]
        return ([np.fromiter(itertools.chain.from_iterable(ids), np.uint32)],
                [np.fromiter(map(len, ids), np.int64, len(ids))])

    def _encoded(self, pieces: pa.Array, letters: bool) -> tuple[list, list]:
        """(ids, ids per piece) of other pieces, many to a call."""
        all_ids, all_sizes = [], []
        for k in range(0, len(pieces), CALL_PIECES):
            part = pieces.slice(k, CALL_PIECES)
            enc = self.tokenizer.encode(_joined(part), add_special_tokens=False)
            ids = np.array(enc.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if letters and len(ends) == len(part):
                # A piece of letters is one word, whose last id closes it.
                sizes = np.diff(ends, prepend=0)
            else:
                lens = pc.utf8_length(part).to_numpy().astype(np.int64)
                starts = np.cumsum(lens + 1) - lens - 1
                begins = np.array(enc.offsets, np.int64).reshape(-1, 2)[:, 0]
                owner = np.searchsorted(starts, begins, side="right") - 1
                sizes = np.bincount(owner, minlength=len(part))
            all_ids.append(ids)
            all_sizes.append(sizes)
        return all_ids, all_sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; ids per text)."""
        texts = pc.fill_null(texts, "")
        if self.folds:
            # Fewer distinct pieces: fold A-Z and cut off closing marks, both
            # of which the tokenizer does itself (special tokens are exact).
            texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?])", r"\1 \2")
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(split.values.slice(bounds[0], bounds[-1] - bounds[0]))
        bounds = bounds - bounds[0]
        pieces = coded.dictionary
        kind = np.full(len(pieces), 3)
        kind[pc.match_substring_regex(pieces, r"^\pL+$").to_numpy(zero_copy_only=False)] = 2
        if self.folds:
            kind[pc.match_substring_regex(pieces, "^[a-z]+$").to_numpy(zero_copy_only=False)] = 1
        kind[pc.equal(pieces, "").to_numpy(zero_copy_only=False)] = 0
        # Ids of all pieces one after another; the last stands for the end of
        # a document.
        ids, sizes = [], [np.zeros(int((kind == 0).sum()), np.int64)]
        for k in (1, 2, 3):
            part = pieces.filter(pa.array(kind == k))
            if len(part):
                more = self._spelled(part) if k == 1 else self._encoded(part, k == 2)
                ids += more[0]
                sizes += more[1]
        flat = np.concatenate([*ids, np.array([self.end_id], np.uint32)])
        sizes = np.concatenate([*sizes, [1]])
        place = np.empty(len(pieces) + 1, np.int64)
        place[np.argsort(kind, kind="stable")] = np.arange(len(pieces))
        place[-1] = len(pieces)
        at, n = (np.cumsum(sizes) - sizes)[place].astype(np.int32), sizes[place].astype(np.int32)
        del texts, split, ids
        # Some documents at a time: the arrays of a group's words are several
        # times its text.
        out, per_text = [np.empty(0, flat.dtype)], [np.empty(0, np.int64)]
        first = 0
        while first < len(bounds) - 1:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_PIECES, side="right")) - 1)
            some, count = self._assembled(coded.indices.slice(bounds[first], bounds[last] - bounds[first]),
                                          bounds[first:last + 1] - bounds[first], at, n, flat)
            out.append(some)
            per_text.append(count)
            first = last
        return np.concatenate(out), np.concatenate(per_text)

    @staticmethod
    def _assembled(pieces: pa.Array, bounds: np.ndarray, at: np.ndarray, n: np.ndarray,
                   flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of the texts whose pieces begin at ``bounds``;
        ``at``, ``n``: where in ``flat`` a piece's ids are, the end id last."""
        order = np.insert(pieces.to_numpy(), bounds[1:], len(at) - 1)
        n, begin = n[order], at[order]
        ends = np.cumsum(n, dtype=np.int64)
        closing = ends[bounds[1:] + np.arange(len(bounds) - 1)]
        # One step on within a piece, a jump where the next piece starts.
        some = n > 0
        begin, n, ends = begin[some], n[some], ends[some]
        step = np.ones(int(ends[-1]) if len(ends) else 0, np.int32)
        if len(step):
            step[0] = begin[0]
            step[ends[:-1]] = begin[1:] - (begin[:-1] + n[:-1] - 1)
        return flat[np.cumsum(step, out=step)], np.diff(closing, prepend=0)


def _joined(pieces: pa.Array) -> str:
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(whole, " ")[0].as_py()


def _tokenize(spec, end_id: int, width: str):
    def run(batches):
        from pyspark import TaskContext
        part, chunk = TaskContext.get().partitionId(), 0
        encoder, held, size = Encoder(spec.value, end_id), [], 0

        def blocks():
            nonlocal chunk
            table = pa.Table.from_batches(held).combine_chunks()
            ids, sizes = encoder.encode(table.column("_text").combine_chunks()
                                        if table.num_rows else pa.array([], pa.string()))
            docs = table.column("_id").combine_chunks()
            nulls = pc.is_null(docs).to_numpy(zero_copy_only=False)
            docs = pc.fill_null(docs, 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):
                base = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + BLOCK_IDS, side="right")))
                here = slice(first, last)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                    "doc_ids": pa.array([docs[here].astype("<i8").tobytes()], pa.binary()),
                    "nulls": pa.array([nulls[here].astype("u1").tobytes()], pa.binary()),
                    "sizes": pa.array([sizes[here].astype("<u8").tobytes()], pa.binary()),
                    "ids": pa.array([ids[base:ends[last - 1]].astype(width).tobytes()], pa.binary())})
                chunk += 1
                first = last

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= GROUP_BYTES:
                yield from blocks()
                held, size = [], 0
        if held:
            yield from blocks()
        held = encoder = None
        words.release()
    return run


def _count(width: str, vocabulary: int):
    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for blob in batch.column("ids"):
                total += np.bincount(np.frombuffer(blob.as_py(), width), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()),
                                          "n": pa.array(total[used], pa.int64())})
    return run


def _blocks(width: str, lengths):
    def run(batches):
        tables = huffman.packing_tables(lengths.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], width)
                docs = np.frombuffer(row["doc_ids"], "<i8")
                blob = huffman.write_block(docs, np.frombuffer(row["nulls"], "u1"),
                                           np.frombuffer(row["sizes"], "<u8"), ids, tables)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]], pa.int32()),
                    "chunk": pa.array([row["chunk"]], pa.int32()),
                    "n_docs": pa.array([len(docs)], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "payload": pa.array([blob], pa.binary())})
    return run


def _read(lengths, with_ids: bool):
    def run(batches):
        table, top = huffman.decode_table(lengths.value)
        for batch in batches:
            for part, chunk, blob in zip(*(batch.column(c).to_pylist()
                                           for c in ("part", "chunk", "payload"))):
                docs, nulls, sizes, ids = huffman.read_block(blob, table, top)
                ends = np.cumsum(sizes).astype(np.int64)
                starts = ends - sizes.astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(docs)
                out = {"doc_id": pa.array(docs, pa.int64(), mask=nulls.astype(bool)),
                       "part": pa.array(np.full(n, part), pa.int32()),
                       "chunk": pa.array(np.full(n, chunk), pa.int32()),
                       "at": pa.array(starts, pa.int64()),
                       "n_tokens": pa.array(ends - starts, pa.int64()),
                       "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.append(starts, ends[-1:]), pa.int32()),
                        pa.array(ids.astype(np.int64), pa.int64()))
                yield pa.RecordBatch.from_pydict(out)
        words.release()
    return run


def _separable(spec: str) -> None:
    """Raise unless pieces between white space encode as they do in a text."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(spec)
    probe = ["It's", "x1y", "(a)--b", "été", "ß", "é", "中文", "'re", "..."]
    whole = tokenizer.encode(" \t\n".join(probe), add_special_tokens=False).ids
    parts = [i for p in probe for i in tokenizer.encode(p, add_special_tokens=False).ids]
    if whole != parts:
        raise ValueError("this tokenizer's tokens depend on white space")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode ``docs`` and write ``path/blocks`` and ``path/code``."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    _separable(spec)
    vocabulary = max(max(Tokenizer.from_str(spec).get_vocab().values()), end_id) + 1
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    ranges = max(spark.sparkContext.defaultParallelism, text_volume(rows, "_text") // RANGE_BYTES)
    ordered = (rows.withColumn("_tie", F.xxhash64("_text"))
               .repartitionByRange(ranges, "_id", "_tie").sortWithinPartitions("_id", "_tie"))
    shipped = spark.sparkContext.broadcast(spec)
    chunks = saved(ordered.select("_id", "_text").mapInArrow(_tokenize(shipped, end_id, width), _CHUNK),
                   "token-chunks")
    # At most one row per id of the vocabulary reaches the driver.
    found = (chunks.select("ids").mapInArrow(_count(width, vocabulary), "id long, n long")
             .groupBy("id").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(vocabulary, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = huffman.code_lengths(counts)
    (spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)],
                           "id long, bits int").coalesce(1).write.parquet(f"{path}/code"))
    sent = spark.sparkContext.broadcast(lengths)
    (chunks.mapInArrow(_blocks(width, sent),
                       "part int, chunk int, n_docs long, n_ids long, payload binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a written corpus: ``doc_id, start, n_tokens,
    ids_crc32`` and, if asked for, ``ids``, all decoded from the blocks."""
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_part_at"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    places = (blocks.select("part", "chunk", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
                            .alias("_chunk_at")).join(parts, "part")
              .select("part", "chunk", (F.col("_part_at") + F.col("_chunk_at")).alias("_start")))
    schema = "doc_id long, part int, chunk int, at long, n_tokens long, ids_crc32 long"
    decoded = blocks.select("part", "chunk", "payload").mapInArrow(
        _read(spark.sparkContext.broadcast(lengths), with_ids),
        schema + ", ids array<long>" * with_ids)
    out = decoded.join(places, ["part", "chunk"])
    return out.select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens",
                      "ids_crc32", *["ids"] * with_ids)


def corpus_path(spark: SparkSession, name: str = "tokens") -> str:
    """A new folder for a written corpus below the shared checkpoint folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
