"""Randomised checks of the distributed operators against plain pandas /
single-partition Spark results."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from builders import plain_running_total
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import stats as S
from ledgerlens.operators.running import running_total

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.tuples(st.integers(0, 2), st.integers(1, 40)), min_size=1, max_size=120)


@SETTINGS
@given(rows=values, buckets=st.integers(1, 9), p=st.sampled_from([0.0, 0.25, 0.5, 0.95, 1.0]))
def test_grouped_quantiles_equal_pandas(spark, rows, buckets, p):
    pdf = pd.DataFrame(rows, columns=["g", "v"]).astype({"v": float})
    df = spark.createDataFrame(pdf)
    got = {r.g: r.q for r in
           S.quantiles(df, "v", [p], ["g"], names=["q"], buckets=buckets).collect()}
    want = pdf.groupby("g").v.quantile(p).to_dict()
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


@SETTINGS
@given(units=st.lists(st.integers(1, 12), min_size=1, max_size=150), buckets=st.integers(1, 9))
def test_running_sums_equal_windows(spark, units, buckets):
    df = spark.createDataFrame([(i, float(u)) for i, u in enumerate(units)],
                               "item_id long, units double")
    for frame in ("range", "rows"):
        got = {r.item_id: r.cumsum for r in
               running_total(df, "units", "item_id", frame=frame, buckets=buckets).collect()}
        want = {r.item_id: r.cumsum for r in
                plain_running_total(df, "units", "item_id", frame).collect()}
        assert got == want, frame
    assert max(got.values()) == float(np.sum(units))


def test_position_with_one_hot_value(spark):
    from ledgerlens.operators.running import position_within
    rows = [(7.0 if i % 3 else float(i), i) for i in range(600)]
    df = spark.createDataFrame(rows, "v double, k long")
    got = {r.k: r.pos for r in position_within(df, ["v"], "k", "pos", buckets=16).collect()}
    w = Window.partitionBy("v").orderBy("k")
    want = {r.k: r.pos for r in df.withColumn("pos", F.row_number().over(w)).collect()}
    assert got == want
