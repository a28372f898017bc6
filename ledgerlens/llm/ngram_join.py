"""Self-join of documents on the Jaccard similarity of their 5-word shingles.

Exact: two documents link when 100 * intersection >= 75 * union of their
shingle sets (shingles compared by 64-bit hashes), and no link is lost. While
shingles are counted, sets go by half of their 128-bit name.

1. One pass over the texts hashes shingles, folds copies (equal sets travel
   once per task) and deals the shingles out by hash range, packed in blobs.
2. Each hash range counts in how many different sets a shingle occurs. A
   shingle of one set links nothing; the others go back to their sets with
   their frequency, packed by shares of the sets. A set can link only if at
   least three quarters of its shingles come back: for most documents the
   search ends here.
3. The remaining sets are ordered by (frequency, hash), the one global order.
   Linked sets share one of their first ``r - ceil(3n/4) + 1`` shingles
   (prefix filter), so the connected parts of the graph "set - prefix
   shingle" can be joined on their own. Every such family is joined on a
   prefix tree (see :mod:`ledgerlens.llm.trie`), small families many to a
   task. Families of more than a block are first cut where sets share fewer
   prefix shingles than linked sets must; what stays large is joined in blocks
   of bounded size.
4. A family of several blocks: blocks are joined within, then one set per
   component and block stands for it until the representatives fit a block;
   then every set outside the family's largest component is probed against
   all blocks. Sets already known to be connected are never compared.

Result rows are documents; copies and near copies are never expanded into
pairs.

Defined cases: a text that is null or without words has an empty set, size 0,
and is its own component; a text of 1 to 4 words has its whole sequence as its
one shingle; a null ``doc_id`` sorts first and is returned as null; rows that
repeat an id share it as separate documents; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import ship, trie, words
from ledgerlens.llm.common import row_keyed, saved, small_batches, text_of, text_volume
from ledgerlens.llm.components import connected

ship(__name__, words.__name__, trie.__name__)

# Text bytes per hash range (about 2.5 million shingles), shingles a task holds
# before it sends them on, and elements a block of the tree join holds.
RANGE_BYTES = 16 << 20
FLUSH = 750_000
BLOCK_TOKENS = 400_000
MOST_LABELS = 16
_NULL_ID = -(2 ** 63)
_RECORD = np.dtype([("t", "<u8"), ("f", "<u2")])
_SET = np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<u4")])
_DOCUMENT = np.dtype([*_SET.descr, ("id", "<i8")])
# First bytes of the packs of a share.
_DOCS, _SETS, _RECORDS = b"d", b"s", b"r"


def binaries(data: bytes, sizes: np.ndarray) -> pa.Array:
    """Binary array of consecutive pieces of ``data``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes),
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit name of each set, from its distinct hashes in ascending order."""
    out = np.zeros((len(sizes), 2), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        out[full, 0] = np.add.reduceat(words.mixed(hashes ^ words.PLACE[6]), first)
        out[full, 1] = np.add.reduceat(words.mixed(hashes ^ words.PLACE[7]), first)
        out[full] += sizes[full, None].astype(np.uint64)
    return out


def _runs(keys: np.ndarray):
    """(key, begin, end) of each run of equal ``keys``."""
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    return zip(keys[start].tolist(), start.tolist(), np.append(start, len(keys))[1:].tolist())


def _dealt(to: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``to`` in order, and the stable order itself (numbers of 16 bits are
    sorted by radix)."""
    to = to.astype(np.uint16 if most <= 1 << 16 else np.uint32)
    order = np.argsort(to, kind="stable")
    return to[order].astype(np.int64), order


def _entries(names: np.ndarray, counts: np.ndarray, values: np.ndarray) -> bytes:
    """Short names of sets and how many of ``values`` each has, then the values."""
    most = int(counts.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return (struct.pack("<III", len(names), len(values), width) + names.astype("<u8").tobytes()
            + counts.astype(f"<u{width}").tobytes() + values.tobytes())


def _read_entries(blobs: list, at: int, kind):
    """What :func:`_entries` wrote from byte ``at`` of each blob on: names, counts, values."""
    names, counts, values = [], [], []
    for blob in blobs:
        m, t, width = struct.unpack_from("<III", blob, at)
        here = at + 12
        names.append(np.frombuffer(blob, "<u8", m, here))
        counts.append(np.frombuffer(blob, f"<u{width}", m, here + 8 * m).astype(np.int64))
        values.append(np.frombuffer(blob, kind, t, here + (8 + width) * m))
    return (np.concatenate(x) if x else np.empty(0, k)
            for x, k in zip((names, counts, values), (np.uint64, np.int64, kind)))


def _send(ranges: int, shares: int = 1):
    def run(batches):
        hasher, held, held_tokens = words.Hasher(), [], 0

        def flush():
            ids, sizes, tokens, names = (np.concatenate(x) for x in zip(*held))
            docs = np.empty(len(ids), _DOCUMENT)
            docs["a"], docs["b"], docs["n"], docs["id"] = names[:, 0], names[:, 1], sizes, ids
            rows, payloads = [-1 - int(names[0, 0] % np.uint64(shares))], [_DOCS + docs.tobytes()]
            first = np.sort(np.unique(names, axis=0, return_index=True)[1])
            if len(first) < len(names):
                kept = np.zeros(len(names), bool)
                kept[first] = True
                tokens = tokens[np.repeat(kept, sizes)]
            sizes, names = sizes[first], names[first]
            sets = np.empty(len(names), _SET)
            sets["a"], sets["b"], sets["n"] = names[:, 0], names[:, 1], sizes
            share, order = _dealt(names[:, 0] % np.uint64(shares), shares)
            for s, begin, end in _runs(share):
                rows.append(-1 - s)
                payloads.append(_SETS + sets[order[begin:end]].tobytes())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bucket, order = _dealt((tokens >> np.uint64(16)) % np.uint64(ranges), ranges)
            tokens, owner, short = tokens[order], owner[order], names[:, 0]
            # Only the ranges met here: their number grows with the corpus.
            for r, begin, end in _runs(bucket):
                o = owner[begin:end]
                start = np.flatnonzero(np.diff(o, prepend=-1))
                rows.append(r)
                payloads.append(_entries(short[o[start]], np.diff(np.append(start, len(o))),
                                         tokens[begin:end]))
            return pa.RecordBatch.from_pydict({"range": pa.array(rows, pa.int32()),
                                               "payload": pa.array(payloads, pa.binary())})

        for batch in batches:
            ids = batch.column("_id").to_numpy()
            texts = pc.cast(batch.column("_text"), pa.binary()).to_pylist()
            for a, b in words.chunks(texts):
                h, _, _, owner, _ = hasher.words(texts[a:b])
                tokens, sizes = words.distinct_per_text(*words.shingles(h, owner, b - a), b - a)
                held.append((ids[a:b], sizes, tokens, set_names(tokens, sizes)))
                held_tokens += len(tokens)
                if held_tokens >= FLUSH:
                    yield flush()
                    held, held_tokens = [], 0
        if held:
            yield flush()
        held = hasher = None
        words.release()
    return run


def _frequencies(shares: int):
    """Of one hash range: the shingles of several sets, packed by the share that
    their sets belong to; of a share's documents and sets: these."""
    def run(table: pa.Table) -> pa.Table:
        blobs = [b.as_py() for b in table.column("payload").combine_chunks()]
        key = table.column("range")[0].as_py()
        if key < 0:
            packs = [t + b"".join(b[1:] for b in blobs if b[:1] == t) for t in (_DOCS, _SETS)]
            return pa.table({"share": pa.array([-1 - key] * 2, pa.int32()),
                             "payload": pa.array(packs, pa.binary())})
        names, counts, tokens = _read_entries(blobs, 0, "<u8")
        del blobs
        first = ~pd.Series(names).duplicated().to_numpy()
        if not first.all():  # sets that several tasks met
            tokens = tokens[np.repeat(first, counts)]
            names, counts = names[first], counts[first]
        order = np.argsort(tokens)
        ordered = tokens[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        run = np.diff(np.append(start, len(ordered)))
        freq = np.empty(len(tokens), np.int32)
        freq[order] = np.repeat(run.astype(np.int32), run)
        keep = freq > 1
        del order, ordered, run
        # Sets in the order of their shares; a set's shingles stay together.
        share, by_share = _dealt(names % np.uint64(shares), shares)
        rank = np.empty(len(names), np.int32)
        rank[by_share] = np.arange(len(names), dtype=np.int32)
        owner = np.repeat(rank, counts)[keep]
        records = np.empty(len(owner), _RECORD)
        records["t"], records["f"] = tokens[keep], np.minimum(freq[keep], 65535)
        del tokens, freq, keep
        records = records[np.argsort(owner, kind="stable")]
        kept = np.bincount(owner, minlength=len(names))
        ends = np.concatenate([[0], np.cumsum(kept)])
        rows, packs = [], []
        for s, begin, end in _runs(share):
            some = np.flatnonzero(kept[begin:end]) + begin
            if len(some):
                rows.append(s)
                packs.append(_RECORDS + _entries(names[by_share[some]], kept[some],
                                                 records[ends[begin]:ends[end]]))
        out = pa.table({"share": pa.array(rows, pa.int32()), "payload": pa.array(packs, pa.binary())})
        del records, packs
        words.release()
        return out
    return run


def _assemble(table: pa.Table) -> pa.Table:
    """Of one share: its document rows, and its sets of which at least three
    quarters of the shingles came back, these rarest first."""
    packs = {_DOCS: [], _SETS: [], _RECORDS: []}
    for blob in table.column("payload").combine_chunks():
        blob = blob.as_py()
        packs[blob[:1]].append(blob)
    docs, sets = (np.concatenate([np.frombuffer(b, kind, offset=1) for b in packs[tag]]
                                 or [np.empty(0, kind)])
                  for tag, kind in ((_DOCS, _DOCUMENT), (_SETS, _SET)))
    names, counts, records = _read_entries(packs[_RECORDS], 1, _RECORD)
    del packs
    # One row a set, in the order of the short names.
    sets = sets[np.unique(sets["a"], return_index=True)[1]]
    at = np.searchsorted(sets["a"], names)
    r = np.zeros(len(sets), np.int64)
    np.add.at(r, at, counts)
    alive = (r > 0) & (4 * r >= 3 * sets["n"].astype(np.int64))
    owner = np.repeat(at, counts)
    keep = alive[owner]
    owner, records = owner[keep], records[keep]
    records = records[np.lexsort((records["t"], records["f"], owner))]
    sets, r = sets[alive], r[alive]
    m = len(docs)
    out = pa.table({
        "kind": pa.array(np.repeat([0, 1], [m, len(sets)]), pa.int32()),
        "sid": binaries(_full_names(docs) + _full_names(sets), np.full(m + len(sets), 16)),
        "n": pa.array(np.concatenate([docs["n"], sets["n"]]).astype(np.int32), pa.int32()),
        "doc_id": pa.concat_arrays([pa.array(docs["id"], pa.int64()), pa.nulls(len(sets), pa.int64())]),
        "r": pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array(r.astype(np.int32), pa.int32())]),
        "records": pa.concat_arrays([pa.nulls(m, pa.binary()),
                                     binaries(records.tobytes(), r * _RECORD.itemsize)])})
    del records, docs
    words.release()
    return out


def _full_names(rows: np.ndarray) -> bytes:
    return np.stack([rows["a"], rows["b"]], axis=1).tobytes()


def _prefixes(batches):
    for batch in batches:
        tokens, sids = [], []
        for sid, n, r, blob in zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "r", "records"))):
            t = np.frombuffer(blob, _RECORD, r - -(-3 * n // 4) + 1)["t"]
            tokens.append(t)
            sids += [sid] * len(t)
        flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_pydict({"token": pa.array(flat.view(np.int64), pa.int64()),
                                          "sid": pa.array(sids, pa.binary())})


def _least_shared(n: int) -> int:
    """Shingles that the longer prefixes of two linked sets share, the smaller
    of both sizes being ``n``."""
    return 1 + n // 64


def _labelled(batches):
    """Prefix of each set, longer by ``_least_shared``, with the set's label: two
    minima over its shingles, which near copies mostly have in common."""
    for batch in batches:
        tokens, sids, labels, least = [], [], [], []
        for sid, n, r, blob in zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "r", "records"))):
            t, three = np.frombuffer(blob, _RECORD)["t"], -(-3 * n // 4)
            label = struct.pack("<Q", int(words.mixed(words.mixed(t ^ words.PLACE[13]).min(keepdims=True) + np.uint64(1))[0])
                                ^ int(words.mixed(t ^ words.PLACE[14]).min()))
            prefix = t[:r - three + _least_shared(n)]
            tokens.append(prefix)
            sids += [sid] * len(prefix)
            labels += [label] * len(prefix)
            least += [_least_shared(three)] * len(prefix)
        flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_pydict({
            "token": pa.array(flat.view(np.int64), pa.int64()), "sid": pa.array(sids, pa.binary()),
            "label": pa.array(labels, pa.binary()), "least": pa.array(least, pa.int32())})


def _narrowed(sets: DataFrame) -> DataFrame:
    """``sets`` with families of more than a block cut into narrower ones, no
    link being cut.

    One shingle that unrelated sets share by chance is enough to join their
    families, and in a large corpus most families are joined so. Linked sets
    share several shingles of somewhat longer prefixes. So a set is joined to
    the label of other sets if as many of its prefix shingles as linked sets
    share occur in sets of that label; a shingle of more than MOST_LABELS
    labels joins all its sets.
    """
    sizes = sets.groupBy("family").agg(F.sum("r").alias("size")).filter(F.col("size") > BLOCK_TOKENS)
    large = saved(sets.join(sizes.select("family"), "family", "left_semi"), "ngram-large")
    if large.isEmpty():
        return sets
    index = saved(large.mapInArrow(_labelled, "token long, sid binary, label binary, least int"),
                  "ngram-index")
    met = index.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    spread = met.groupBy("token").agg(F.count(F.lit(1)).alias("labels"))
    near = met.join(spread.filter(F.col("labels").between(2, MOST_LABELS)), "token").select(
        "token", F.col("label").alias("other"))
    shared = (index.join(near, "token").filter("label != other").groupBy("sid", "other")
              .agg(F.count(F.lit(1)).alias("shared"), F.first("least").alias("least"))
              .filter("shared >= least"))
    common = index.join(spread.filter(F.col("labels") > MOST_LABELS).select("token"), "token", "left_semi")
    edges = (index.select(F.col("sid").alias("a"), F.col("label").alias("b"))
             .unionByName(shared.select(F.col("sid").alias("a"), F.col("other").alias("b")))
             .unionByName(common.select(F.col("sid").alias("a"), F.concat(
                 F.lit("t"), F.col("token").cast("string")).cast("binary").alias("b"))))
    narrow = connected(edges).select(F.col("node").alias("sid"), F.col("root").alias("narrow"))
    return sets.join(narrow, "sid", "left").withColumn(
        "family", F.coalesce("narrow", "family")).drop("narrow")


def _unpack(blobs):
    records = [np.frombuffer(b, _RECORD) for b in blobs]
    return [r["t"] for r in records], [r["f"] for r in records]


def _join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components within each (family, block) of a task's share."""
    out = []
    for _, group in pdf.groupby(["family", "block"], sort=False):
        group = group.sort_values("sid")
        t, f = _unpack(group["records"])
        label = trie.components(t, f, group["n"].to_numpy(np.int64))
        sid = group["sid"].to_numpy()
        out.append(pd.DataFrame({"a": sid, "b": sid[label]}))
    return pd.concat(out)


def _probe_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the probes and the stored sets of one block, one for
    each component that a probe meets."""
    probes, stored = pdf[pdf["probe"]], pdf[~pdf["probe"]]
    a, b = (( *_unpack(x["records"]), x["n"].to_numpy(np.int64)) for x in (probes, stored))
    ps, ss = probes["sid"].to_numpy(), stored["sid"].to_numpy()
    pr, sr = probes["root"].to_numpy(), stored["root"].to_numpy()
    found = {(ps[i], sr[j]): ss[j] for i, j in trie.links(a, b) if pr[i] != sr[j]} if len(ps) and len(ss) else {}
    return pd.DataFrame({"a": [k[0] for k in found], "b": list(found.values())}, columns=["a", "b"])


_EDGE = "a binary, b binary"


def _blocked(sets: DataFrame, small_tasks: int) -> DataFrame:
    """Deal each family into blocks of about BLOCK_TOKENS elements; families
    of one block share tasks."""
    sizes = sets.groupBy("family").agg(
        F.ceil(F.sum("r") / BLOCK_TOKENS).cast("int").alias("blocks"))
    out = sets.join(sizes, "family").withColumn(
        "block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    return out.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(
        F.xxhash64("family"), F.lit(small_tasks))).otherwise(F.xxhash64("family", "block")))


def _join_families(sets: DataFrame, small_tasks: int) -> DataFrame:
    """``node, root`` of every set of ``sets``, by links within its family."""
    cols = ["sid", "n", "r", "records", "family"]
    dealt = saved(_blocked(sets.select(*cols), small_tasks), "ngram-blocks")
    edges = saved(dealt.groupBy("task").applyInPandas(_join_blocks, _EDGE), "ngram-edges")
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        # Each edge leads to the least set of a whole component.
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # One set per component stands for it until a family's fit one block.
    while True:
        roots = connected(edges)
        stand = (large.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
                 .withColumn("root", F.coalesce("root", "sid")))
        stand = saved(stand.select(*cols, "block", "blocks", "root"), "ngram-standing")
        leaders = _blocked(stand.filter("sid = root").select(*cols), small_tasks)
        more = saved(leaders.groupBy("task").applyInPandas(_join_blocks, _EDGE)
                     .filter("a != b"), "ngram-edges")
        if more.isEmpty():
            break
        edges = edges.unionByName(more)
    # Whatever is not in its family's largest component meets every block.
    sizes = stand.groupBy("family", "root").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    stand = stand.join(main, "family")
    minor = stand.filter("root != main")
    if minor.isEmpty():
        return connected(edges)
    chunked = minor.join(minor.groupBy("family").agg(
        F.ceil(F.sum("r") / BLOCK_TOKENS).cast("int").alias("chunks")), "family")
    chunks = chunked.select("family", "chunks").distinct()
    probes = (chunked.withColumn("chunk", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("chunks")).cast("int"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("probe", F.lit(True)))
    stored = (stand.join(chunks, "family")
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .withColumn("probe", F.lit(False)))
    fields = ["family", "block", "chunk", "probe", "sid", "n", "root", "records"]
    more = (probes.select(*fields).unionByName(stored.select(*fields))
            # A number of tasks by the work in a group, not by the few bytes of it.
            .repartition(small_tasks, "family", "block", "chunk")
            .groupBy("family", "block", "chunk").applyInPandas(_probe_blocks, _EDGE))
    return connected(edges.unionByName(saved(more, "ngram-edges")))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    out = _components(docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_id"),
        text_of(text_col).alias("_text")))
    return out.select(F.nullif("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "n_shingles",
                      F.nullif("component", F.lit(_NULL_ID)).alias("component_id"))


def _components(rows: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_shingles, place, component`` of rows ``_id, _text``. A component
    is named by its least place: ``_id``, or as ``places`` (``doc_id, place``) say."""
    spark = rows.sparkSession
    small_batches(spark)
    least_groups = 8 * spark.sparkContext.defaultParallelism
    ranges = max(least_groups, text_volume(rows, "_text") // RANGE_BYTES)
    shares = max(least_groups, ranges // 4)
    sent = rows.mapInArrow(_send(ranges, shares), "range int, payload binary")
    back = sent.groupBy("range").applyInArrow(_frequencies(shares), "share int, payload binary")
    found = saved(back.groupBy("share").applyInArrow(
        _assemble, "kind int, sid binary, n int, doc_id long, r int, records binary"), "ngram-sets")
    members = found.filter("kind = 0").select("doc_id", "sid", "n")
    if places is None:
        members = members.withColumn("place", F.col("doc_id"))
    else:
        members = members.join(places, "doc_id")
    alive = found.filter("kind = 1").select("sid", "n", "r", "records")

    index = alive.mapInArrow(_prefixes, "token long, sid binary")
    hubs = (index.groupBy("token").agg(F.min("sid").alias("hub"), F.count(F.lit(1)).alias("k"))
            .filter("k > 1").select("token", "hub"))
    families = connected(index.join(hubs, "token").filter("sid != hub")
                         .select(F.col("sid").alias("a"), F.col("hub").alias("b")))
    sets = alive.join(families.select(F.col("node").alias("sid"), F.col("root").alias("family")), "sid")
    roots = _join_families(_narrowed(sets), small_tasks=ranges)

    # Smallest document of each set, then of each component of several sets.
    least = members.groupBy("sid").agg(F.min("place").alias("least"))
    joined = least.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "root", F.coalesce("root", "sid"))
    best = joined.groupBy("root").agg(F.min("least").alias("component"))
    named = saved(joined.join(best, "root").select("sid", "component"), "ngram-components")
    out = members.join(named, "sid")
    component = F.when(F.col("n") == 0, F.col("place")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "place",
                      component.alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null
    first); of rows that share it, the first."""
    keyed = row_keyed(docs, "ngram-rows")
    places = keyed.select(F.col("_row").alias("doc_id"), F.struct(
        F.col(id_col).cast("long").alias("id"), F.col("_row").alias("row")).alias("place"))
    found = _components(keyed.select(F.col("_row").alias("_id"), text_of(text_col).alias("_text")),
                        places)
    gone = found.filter("component.row != doc_id").select(F.col("doc_id").alias("_row"))
    return keyed.join(gone, "_row", "left_anti").select(*docs.columns)
