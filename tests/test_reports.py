from builders import make_categories, make_items, make_log

from ledgerlens.plans import reports


def _model(spark):
    log = make_log(spark, [
        ("2014-12-30", 1, 10.0, 1),
        ("2014-12-30", 2, 5.0, 2),
        ("2014-12-30", 4, 7.0, 1),     # sold only the day before the last
        ("2014-12-31", 1, 10.0, 3),
        ("2014-12-31", 1, 10.0, -1),   # a return on the last day
        ("2014-12-31", 2, 5.0, 1),
        ("2014-12-31", 3, 2499.5, 1),  # sold only on the last day
        ("2014-12-31", 5, 1.0, 1),
        ("2014-12-31", 5, 1.0, 1),
    ])
    items = make_items(spark, [(1, 'Set "A" + "B", x', 10), (2, "b", 10), (3, "c", 20),
                               (4, "d", 20), (5, "e", 30)])
    cats = make_categories(spark, [(10, "ten"), (20, "twenty"), (30, "thirty"), (40, "unsold")])
    return log, items, cats


def test_by_category_includes_returns_and_sorts_ascending(spark):
    log, items, cats = _model(spark)
    rows = reports.report_by_category(log, items, cats).collect()
    assert [r.item_category_id for r in rows] == [30, 10, 20]
    by_id = {r.item_category_id: r for r in rows}
    assert by_id[10].num_sold == 3 + (-1) + 1
    assert by_id[10].sales == 30.0 - 10.0 + 5.0
    assert by_id[20].sales == 2499.5
    assert 40 not in by_id  # a category without sales disappears (inner joins)


def test_top_goods_counts_rows_with_id_tie_break(spark):
    log, items, _ = _model(spark)
    rows = reports.report_top_goods(log, items, k=2).collect()
    # items 1 and 5 both have two rows on the last day; id breaks the tie
    assert [(r.item_id, r.daily_count) for r in rows] == [(1, 2), (5, 2)]


def test_top_goods_sale(spark):
    log, items, _ = _model(spark)
    rows = reports.report_top_goods_sale(log, items).collect()
    assert [(r.item_id, r.sale) for r in rows] == [(3, 2499.5), (1, 20.0), (2, 5.0), (5, 2.0)]


def test_top_difference_inner_and_outer(spark):
    log, items, _ = _model(spark)
    inner = reports.report_top_difference(log, items).collect()
    assert {r.item_id: r.difference for r in inner} == {1: 1.0, 2: 1.0}
    assert all(str(r.sale_date) == "2014-12-31" for r in inner)
    outer = {r.item_id: r.difference
             for r in reports.report_top_difference(log, items, how="outer").collect()}
    assert outer == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0}


def test_sql_form_equals_dataframe_form(spark):
    log, items, cats = _model(spark)
    reports.register_model(spark, log, items, cats)
    pairs = [("by_category", reports.report_by_category(log, items, cats)),
             ("top_goods", reports.report_top_goods(log, items)),
             ("top_goods_sale", reports.report_top_goods_sale(log, items)),
             ("top_difference", reports.report_top_difference(log, items))]
    for name, df in pairs:
        assert reports.run_report_sql(spark, name).collect() == df.collect(), name


def test_month_pruned_reports_equal_full_scan(spark):
    log, items, cats = _model(spark)
    a = reports.report_top_difference(log, items, month_col="month_num").collect()
    b = reports.report_top_difference(log, items).collect()
    assert a == b
    assert (reports.report_by_category(log, items, cats, month_col="month_num").collect()
            == reports.report_by_category(log, items, cats).collect())


def test_complete_periods_drops_only_a_cut_off_quarter(spark):
    from ledgerlens.operators.filters import complete_periods
    log = make_log(spark, [("2014-09-30", 1, 1, 1), ("2014-10-01", 2, 1, 1),
                           ("2014-11-04", 3, 1, 1)])
    assert sorted(r.item_id for r in complete_periods(log, "quarter").collect()) == [1]
    full = make_log(spark, [("2014-09-30", 1, 1, 1), ("2014-12-31", 2, 1, 1)])
    assert complete_periods(full, "quarter").count() == 2


def test_sql_reports_leave_the_users_views_alone(spark):
    log = make_log(spark, [("2014-01-01", 1, 2.0, 3), ("2014-01-02", 1, 2.0, 5)])
    spark.sql("SELECT 42 AS mine").createOrReplaceTempView("items")
    reports.register_model(spark, log, make_items(spark, [(1, "one", 1)]), make_categories(spark, [(1, "c")]))
    assert reports.run_report_sql(spark, "top_difference").first()["difference"] == 2
    assert spark.table("items").first()["mine"] == 42
    spark.catalog.dropTempView("items")
