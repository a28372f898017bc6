"""Language identification by prediction by partial matching.

Training reads a bounded sample of labelled rows (``TRAIN_DOCS`` whole texts a
language): tasks count byte contexts, Spark adds the counts up, and the frozen
models travel to the tasks that score. Scoring reads every whole text and
compares its exact code length under each language's model; the shortest wins.
The models are kept in slices of ``SLICE_LANGUAGES`` and travel
``PASS_LANGUAGES`` at a time, each a pass over the documents, so what a task
holds is bounded whatever the number of languages. A language's tree is its own,
so a text's code length under it does not depend on the other languages.

Defined cases: a null text, a text without a letter, and any text when
nothing could be learned are ``und`` with score 0; ties go to the language
that sorts first; repeated rows are scored alike; an empty table gives no
rows; null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import ppm, ship, words
from ledgerlens.llm.common import least_hashed, row_keyed, saved, small_batches, text_of
from ledgerlens.operators.joins import broadcast_if_small

ship(__name__, ppm.__name__, words.__name__)

UNKNOWN = "und"
TRAIN_DOCS = 400
SLICE_LANGUAGES = 64
# A language's tables take less than 4 MB, those of a pass less than 64 MB.
PASS_LANGUAGES = 16


def _gram_counts(batches):
    for batch in batches:
        labels = np.array(batch.column("_lang").to_pylist(), object)
        texts = pc.cast(batch.column("_text"), pa.binary()).to_pylist()
        for lang in sorted(set(labels)):
            keys, counts = ppm.grams([t for t, l in zip(texts, labels) if l == lang])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(keys), pa.string()),
                "gram": pa.array(keys, pa.int64()), "n": pa.array(counts, pa.int64())})


def train(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang",
          text_col: str = "text", per_language: int = TRAIN_DOCS) -> list[tuple]:
    """(languages, counts) of each slice of models, from at most ``per_language``
    labelled texts a language, chosen by a hash of id and text; rows that repeat
    both are one text."""
    named = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("_lang"), F.xxhash64(id_col, text_col).alias("_mark"),
        F.col(text_col).alias("_text"))
    # Hashes alone are ranked; the chosen texts, few by construction, come after.
    chosen = saved(least_hashed(named, "_lang", "_mark", per_language), "language-sample")
    small_batches(docs.sparkSession)
    sample = (named.join(broadcast_if_small(chosen), ["_lang", "_mark"], "left_semi")
              .groupBy("_lang", "_mark").agg(F.min("_text").alias("_text")))
    counts = (sample.select("_lang", "_text")
              .mapInArrow(_gram_counts, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    table = counts.toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])  # bounded by the sample
    names = table.column("lang").to_numpy()
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1])[:len(names)])
    per = [(grams[a:b], n[a:b]) for a, b in zip(first, np.append(first, len(names))[1:])]
    langs = names[first].tolist()
    return [(langs[k:k + SLICE_LANGUAGES], per[k:k + SLICE_LANGUAGES])
            for k in range(0, max(len(langs), 1), SLICE_LANGUAGES)]


def _score(shipped, keep: int):
    def run(batches):
        model = ppm.Model.restored(shipped.value)
        for batch in batches:
            blobs = pc.cast(batch.column("_text"), pa.binary()).to_pylist()
            bits = [np.zeros((0, len(model.langs)))]
            for a, b in words.chunks(blobs):
                bits.append(model.bits(blobs[a:b]))
            bits = np.concatenate(bits)
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            best = bits.argmin(axis=1) if model.langs else np.zeros(len(bits), int)
            gain = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)) if model.langs else bits
            score = 1 / gain.sum(axis=1) if model.langs else np.zeros(len(bits))
            known = letters & bool(model.langs)
            names = np.array([*model.langs, UNKNOWN], object)
            found = [batch.column("_id"), pa.array(np.where(known, names[best], UNKNOWN), pa.string()),
                     pa.array(np.where(known, score, 0.0), pa.float64()),
                     pa.array(np.where(known, bits.min(axis=1) if model.langs else 0.0, 0.0),
                              pa.float64())]
            kept = [batch.column(f"_keep{k}") for k in range(keep)]
            yield pa.RecordBatch.from_arrays(found + kept, [
                "doc_id", "lang_pred", "score", "bits", *(f"kept{k}" for k in range(keep))])
        model = None
        words.release()
    return run


def _scored(docs: DataFrame, trained: tuple, id_col: str, text_col: str, keep: tuple) -> DataFrame:
    """:func:`predict` with one slice of models."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"),
                       text_of(text_col).rlike(r"\p{L}").alias("_letters"),
                       *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)])
    kinds = "".join(f", kept{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    model = spark.sparkContext.broadcast(vars(ppm.Model(*trained)))
    return rows.mapInArrow(_score(model, len(keep)),
                           "doc_id long, lang_pred string, score double, bits double" + kinds)


def predict(docs: DataFrame, model: list[tuple], id_col: str = "doc_id",
            text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` (posterior of the winner under equal
    priors) and ``bits`` (its code length) for every document, then the
    columns of ``docs`` named in ``keep`` as ``kept0, kept1, ...``."""
    small_batches(docs.sparkSession)
    passes = [(langs[k:k + PASS_LANGUAGES], per[k:k + PASS_LANGUAGES]) for langs, per in model
              for k in range(0, max(len(langs), 1), PASS_LANGUAGES)]
    if len(passes) == 1:
        return _scored(docs, passes[0], id_col, text_col, keep)
    keyed = row_keyed(docs, "language-rows")
    found = None
    for trained in passes:
        part = _scored(keyed, trained, "_row", text_col, ())
        found = part if found is None else found.unionByName(part)
    # The inverse of a pass's score is the sum of 2 ** (least - bits) over it.
    best = found.groupBy("doc_id").agg(
        F.min(F.struct("bits", "lang_pred", "score")).alias("best"),
        F.collect_list(F.struct("bits", "score")).alias("slices"))
    total = F.aggregate("slices", F.lit(0.0), lambda sum_, s: sum_ + F.when(
        s["score"] > 0, F.pow(F.lit(2.0), F.greatest(F.col("best.bits") - s["bits"], F.lit(-1000.0))) / s["score"])
        .otherwise(0.0))
    best = best.select(F.col("doc_id").alias("_row"), F.col("best.lang_pred").alias("_lang"),
                       F.when(total > 0, 1 / total).otherwise(0.0).alias("_score"),
                       F.col("best.bits").alias("_bits"))
    return keyed.withColumnsRenamed({c: f"_doc {c}" for c in docs.columns}).join(best, "_row").select(
        F.col(f"`_doc {id_col}`").cast("long").alias("doc_id"), F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"), F.col("_bits").alias("bits"),
        *[F.col(f"`_doc {c}`").alias(f"kept{k}") for k, c in enumerate(keep)])


def drop_unknown(docs: DataFrame, model: list[tuple], columns: tuple) -> DataFrame:
    """The documents whose language can be told, with ``columns``."""
    found = predict(docs, model, keep=columns).filter(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(f"kept{k}").alias(c) for k, c in enumerate(columns)])
