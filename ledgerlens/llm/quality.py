"""Document quality from preference pairs (Bradley-Terry).

Every labelled good text is preferred to several labelled bad ones. The
probability that document i beats j is the logistic function of the
difference of their scores, scores being linear in shape features; the
weights are fitted by logistic loss on feature differences, without an
intercept. A document's score is then placed on (0, 1) so that the quantile of
training scores above which a share of texts equal to the share of good labels
lies is exactly ``THRESHOLD``.

Training reads every labelled text. A good one meets ``PAIRS`` bad ones, counted
round; where that leaves bad ones out, every bad one meets a good one instead.
The ranks that pair them and the quantile come from distributed passes over all
of them. Scoring reads every whole text.

Defined cases: a null or empty text has all features 0 and a score like any
other; labels that are null, other than 0 or 1, or without a document are not
used; an id that names several texts lends its label to each; without both classes
every score is 0.5; repeated rows score alike and are learned from once; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import features, ship, words
from ledgerlens.llm.common import saved, small_batches, text_of
from ledgerlens.operators.running import position_within
from ledgerlens.operators.selection import order_statistics

ship(__name__, features.__name__, words.__name__)

THRESHOLD = 0.7
PAIRS = 4
REGULARISATION = 1e-3


def _measured(batches):
    hasher = words.Hasher()
    for batch in batches:
        blobs = pc.cast(batch.column("_text"), pa.binary()).to_pylist()
        rows = [features.matrix(blobs[a:b], hasher) for a, b in words.chunks(blobs)]
        flat = np.concatenate(rows or [np.zeros((0, len(features.NAMES)))])
        values = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), len(features.NAMES))
        yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "_mark": batch.column("_mark"),
                                          "_x": values.cast(pa.list_(pa.float64()))})


def _pairs(ranked: DataFrame, good: int, bad: int) -> DataFrame:
    """``_w, _l, _t``: features of a good text and of a bad one that it meets,
    and a number to turn half of the pairs by. ``ranked`` has their ``_r`` in
    their class; every text occurs."""
    winners = ranked.filter("_y = 1").select(F.col("_x").alias("_w"), "_r")
    losers = ranked.filter("_y = 0").select(F.col("_x").alias("_l"), F.col("_r").alias("_k"))
    if bad <= PAIRS * good:
        # Winner r meets losers r * PAIRS + j, counted round: an equi-join.
        winners = winners.select("*", F.explode(F.sequence(F.lit(0), F.lit(PAIRS - 1))).alias("_j"))
        winners = winners.select("_w", (F.col("_r") + F.col("_j")).alias("_t"),
                                 F.pmod(F.col("_r") * PAIRS + F.col("_j"), F.lit(bad)).alias("_k"))
    else:
        losers = losers.select("_l", F.col("_k").alias("_t"), F.pmod("_k", F.lit(good)).alias("_k"))
        winners = winners.withColumnRenamed("_r", "_k")
    return winners.join(losers, "_k")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> dict:
    """``weights``, ``offset`` of the frozen score."""
    small_batches(docs.sparkSession)
    marked = (labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_y"))
              .filter("_y in (0, 1)").select("_id", F.col("_y").cast("int").alias("_y")).distinct())
    # Texts are measured before they meet their labels, so only features move.
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    measured = (texts.filter("_id IS NOT NULL").withColumn("_mark", F.xxhash64("_text"))
                .mapInArrow(_measured, "_id long, _mark long, _x array<double>"))
    seen = saved(measured.join(marked, "_id").dropDuplicates(["_id", "_y", "_mark"]).select(
        "_y", "_x", F.struct(F.xxhash64("_id"), "_id", "_mark").alias("_order")), "quality-train")
    width = len(features.NAMES)
    stats = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("good"),
                     *[F.stddev_pop(F.col("_x")[k]).alias(f"s{k}") for k in range(width)]).first()
    good, bad = stats["good"] or 0, stats["n"] - (stats["good"] or 0)
    if not good or not bad:
        return {"weights": np.zeros(width), "offset": 0.0}
    scale = [1 / s if (s := stats[f"s{k}"]) and s > 1e-9 else 0.0 for k in range(width)]
    ranked = position_within(seen, ["_y"], "_order", prepared=True)
    ranked = ranked.select("_y", "_x", (F.col("position") - 1).alias("_r"))
    factors = F.array(*[F.lit(s) for s in scale])
    gap = F.zip_with(F.zip_with("_w", "_l", lambda w, l: w - l), factors, lambda d, s: d * s)
    # Half of the pairs are turned round, so that both outcomes occur.
    turn = F.when(F.col("_t") % 2 == 0, 1.0).otherwise(-1.0)
    pairs = saved(_pairs(ranked, good, bad).withColumn("_s", turn).select(
        array_to_vector(F.transform(gap, lambda d: d * F.col("_s"))).alias("features"),
        ((F.col("_s") + 1) / 2).alias("label")), "quality-pairs")
    fitted = LogisticRegression(fitIntercept=False, standardization=False,
                                regParam=REGULARISATION, maxIter=100).fit(pairs)
    weights = np.asarray(fitted.coefficients.toArray()) * np.array(scale)
    value = sum((F.col("_x")[k] * float(w) for k, w in enumerate(weights)), F.lit(0.0))
    # The least score of the ``good`` best: the upper rank around half a place below it.
    found = order_statistics(seen.select(value.alias("_v")), "_v", [(bad - 0.5) / (good + bad - 1)])
    return {"weights": weights, "offset": float(found.first()["_hi0"])}


def _scored(model: dict):
    weights, offset = model["weights"], model["offset"]
    shift = math.log(THRESHOLD / (1 - THRESHOLD)) if weights.any() else 0.0

    def run(batches):
        hasher = words.Hasher()
        for batch in batches:
            blobs = pc.cast(batch.column("_text"), pa.binary()).to_pylist()
            raw = [features.matrix(blobs[a:b], hasher) @ weights for a, b in words.chunks(blobs)]
            raw = np.concatenate(raw or [np.zeros(0)])
            z = np.clip(raw - offset + shift, -500, 500)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("_id"), "raw": pa.array(raw),
                "score": pa.array(1 / (1 + np.exp(-z)))})
        hasher = None
        words.release()
    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, raw, score, predicted`` for every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    out = rows.mapInArrow(_scored(model), "doc_id long, raw double, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
