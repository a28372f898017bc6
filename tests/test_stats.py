import math
import random

import numpy as np
import pandas as pd

from ledgerlens.operators import stats as S


def _values(spark, n=500, seed=5):
    rnd = random.Random(seed)
    rows = [(i % 3, round(rnd.lognormvariate(5, 1), 2)) for i in range(n)]
    rows += [(0, 42.0)] * 150  # a hot value
    return spark.createDataFrame(rows, "g int, v double"), pd.DataFrame(rows, columns=["g", "v"])


def test_quantiles_match_pandas(spark):
    df, pdf = _values(spark)
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = S.quantiles(df, "v", probs, names=[f"p{i}" for i in range(5)]).first()
    for i, p in enumerate(probs):
        assert abs(got[f"p{i}"] - pdf.v.quantile(p)) < 1e-6


def test_grouped_quantiles_match_pandas(spark):
    df, pdf = _values(spark, seed=6)
    got = {r.g: r.q for r in S.quantiles(df, "v", [0.95], ["g"], names=["q"]).collect()}
    want = pdf.groupby("g").v.quantile(0.95).to_dict()
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_trims(spark):
    df, pdf = _values(spark, seed=7)
    q = pdf.v.quantile(0.95)
    assert S.trim_upper(df, "v").count() == int((pdf.v <= round(q, 6)).sum())
    per = S.trim_upper_per_group(df, "v", ["g"]).count()
    want = sum(int((x.v <= round(x.v.quantile(0.95), 6)).sum()) for _, x in pdf.groupby("g"))
    assert per == want


def test_describe_matches_pandas(spark):
    df, pdf = _values(spark, seed=8)
    r = S.describe(df, "v").first()
    d = pdf.v.describe()
    assert r["count"] == d["count"]
    for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"),
                         ("p25", "25%"), ("p50", "50%"), ("p75", "75%")]:
        assert abs(r[ours] - d[theirs]) < 1e-5, ours


def test_histogram_auto_matches_numpy(spark):
    df, pdf = _values(spark, seed=9)
    got = sorted((r.bin, r["count"]) for r in S.histogram_auto(df, "v").collect())
    counts, edges = np.histogram(pdf.v.to_numpy(), bins="auto")
    want = [(i, int(c)) for i, c in enumerate(counts) if c]
    assert got == want


def test_histogram_fixed_width(spark):
    df, pdf = _values(spark, seed=10)
    got = {r.bin: r["count"] for r in S.histogram(df, "v", 100).collect()}
    lo = pdf.v.min()
    want = pdf.groupby(((pdf.v - lo) // 100).astype(int)).size().to_dict()
    assert got == want


def test_kernel_density_matches_formula(spark):
    df, pdf = _values(spark, n=120, seed=11)
    out = {(r.g, r.point): r.density for r in
           S.kernel_density(df, "v", ["g"], grid_size=20).collect()}
    for g, x in pdf.groupby("g"):
        v = x.v.to_numpy()
        h = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 20)
        dens = [np.exp(-0.5 * ((p - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
                for p in grid]
        for i, d in enumerate(dens):
            assert abs(out[(g, i)] - d) < 1e-9


def test_null_groups_and_groups_without_spread_stay(spark):
    from ledgerlens.operators import stats
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), ("b", 2.0)],
                               "g string, v double")
    q = {r.g: r.q for r in stats.quantiles(df, "v", [0.5], ["g"], names=["q"]).collect()}
    assert q == {"a": 2.0, None: 6.0, "b": 2.0}
    d = {r.g: r.p50 for r in stats.describe(df, "v", ["g"]).collect()}
    assert d == q
    trimmed = stats.trim_upper_per_group(df, "v", ["g"], 0.5).collect()
    assert {(r.g, r.v) for r in trimmed} == {("a", 1.0), (None, 5.0), ("b", 2.0)}
    k = stats.kernel_density(df, "v", ["g"], grid_size=5).collect()
    assert {r.g for r in k} == {"a", "b", None}
    assert all(r.density is None for r in k if r.g == "b")


def test_money_is_exact_below_a_cent_and_below_zero(spark):
    from ledgerlens.functions.numeric import amount_to_double, sum_amount
    from ledgerlens.operators.aggregates import mean_price_by
    rows = [(1, 0.004, 1000.0), (2, 1.125, 1.0), (3, -1.0, 1.0), (3, -1.01, 1.0), (3, -1.01, 1.0),
            (4, 874.666667, 2.5), (5, None, 1.0), (6, 123456789.123456, 1e6), (7, 133.38, -3.0)]
    df = spark.createDataFrame(rows, "item_id long, item_price double, item_cnt_day double")
    total = {r.item_id: r.a for r in df.groupBy("item_id").agg(
        amount_to_double(sum_amount("item_price", "item_cnt_day")).alias("a")).collect()}
    assert total == {1: 4.0, 2: 1.125, 3: -3.02, 4: 2186.6666675, 5: None,
                     6: 123456789123456.0, 7: -400.14}
    mean = {r.item_id: r.mean_price for r in mean_price_by(df, "item_id").collect()}
    assert mean == {1: 0.004, 2: 1.125, 3: -1.0067, 4: 874.6667, 5: None,
                    6: 123456789.1235, 7: 133.38}


def test_zero_filled_variance_keeps_small_spread_of_large_units(spark):
    from ledgerlens.operators.aggregates import demand_stats
    rows = [(1, 1e9), (1, 1e9 + 1), (2, 5.0)]
    df = spark.createDataFrame(rows, "item_id long, item_cnt_month double")
    from pyspark.sql import functions as F
    got = {r.item_id: (r.mean, r.std) for r in demand_stats(df, periods=F.lit(2)).collect()}
    assert abs(got[1][1] - 0.5) < 1e-9 and got[1][0] == 1e9 + 0.5
    assert got[2] == (2.5, 2.5)


# Selection
def _exact(values, p):
    return float(np.quantile(np.array(values, float), p))


def test_selection_narrows_again_and_again(spark, monkeypatch):
    from ledgerlens.operators import selection
    monkeypatch.setattr(selection, "FINISH", 3)
    rnd = random.Random(11)
    rows = [(i % 3 if i % 10 else None, round(rnd.lognormvariate(3, 2), 3)) for i in range(4000)]
    rows += [(1, 7.25)] * 3000 + [(2, None)] * 20
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.731, 0.95, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    one = S.quantiles(df, "v", probs, names=names).first()
    every = [v for _, v in rows if v is not None]
    assert [one[n] for n in names] == [round(_exact(every, p), 6) for p in probs]
    got = {r.g: [r[n] for n in names] for r in S.quantiles(df, "v", probs, ["g"], names=names).collect()}
    for g in (None, 0, 1, 2):
        mine = [v for h, v in rows if h == g and v is not None]
        assert got[g] == [round(_exact(mine, p), 6) for p in probs]


def test_selection_of_few_equal_or_no_values(spark):
    for values in ([5.0], [5.0, 6.0], [2.0] * 50, [1.0, 1.0, 9.0], [float(i) for i in range(7)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = S.quantiles(df, "v", [0.0, 0.3, 0.5, 0.95, 1.0]).first()
        assert list(got) == [round(_exact(values, p), 6) for p in (0.0, 0.3, 0.5, 0.95, 1.0)]
    none = spark.createDataFrame([(None,)], "v double")
    assert [tuple(r) for r in S.quantiles(none, "v", [0.5]).collect()] == [(None,)]
    assert S.trim_upper(none, "v").count() == 0 and S.above_quantile(none, "v").count() == 0


def test_selection_of_whole_numbers_and_decimals(spark):
    df = spark.range(1, 1002).selectExpr("id AS k", "CAST(id AS DECIMAL(20,2)) AS d")
    assert S.quantiles(df, "k", [0.5, 0.123]).first()[:] == (501, 124)
    assert float(S.quantiles(df, "d", [0.5]).first()[0]) == 501


def test_trim_is_a_pushed_filter_over_one_written_table(spark):
    df = spark.range(1000).selectExpr("id AS k", "CAST(id AS DOUBLE) AS v")
    trimmed = S.trim_upper(df, "v", 0.5)
    assert "LessThanOrEqual(v,499.5)" in trimmed._jdf.queryExecution().executedPlan().toString()
    assert trimmed.count() == 500


def test_density_of_narrow_kernels_spreads_to_few_points(spark):
    rnd = random.Random(13)
    values = [rnd.gauss(0, 1) for _ in range(3000)] + [9_000.0]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    out = S.kernel_density(df, "v", ["g"])
    got = {r.point: (r.x, r.density) for r in out.collect()}
    v = np.array(values)
    h = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 200)
    want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert sorted(got) == list(range(200))
    for k in range(200):
        assert abs(got[k][0] - grid[k]) < 1e-6 and abs(got[k][1] - want[k]) < 1e-9
