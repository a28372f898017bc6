import datetime as dt

from builders import make_categories, make_items, make_log
from pyspark.sql import functions as F

from ledgerlens.plans import calendar as K


def _log(spark):
    rows = []
    d = dt.date(2013, 12, 29)
    while d <= dt.date(2014, 1, 5):
        rows.append((d.isoformat(), 1, 10.5, 2))
        rows.append((d.isoformat(), 2, 2499.5, 1))
        d += dt.timedelta(days=1)
    return make_log(spark, rows)


def test_iso_weeks_merge_years(spark):
    cal = {str(r.sale_date): r for r in K.sales_calendar(_log(spark)).collect()}
    assert cal["2013-12-30"].week_of_the_year == 1  # Monday of ISO week 1 of 2014
    assert cal["2013-12-29"].week_of_the_year == 52
    assert cal["2013-12-29"].day_of_the_week == 6  # Sunday
    assert cal["2013-12-29"].week_num == 0 and cal["2013-12-30"].week_num == 1
    assert cal["2014-01-05"].day_num == 7
    assert str(cal["2014-01-01"].week_monday) == "2013-12-30"


def test_totals_agree(spark):
    log = _log(spark)
    day_total = sum(r.total_daily_sale for r in K.daily_revenue(log).collect())
    assert day_total == 8 * (21.0 + 2499.5)
    assert sum(r.weekly_sale for r in K.weekly_sales(log).collect()) == day_total
    assert sum(r.monthly_sale for r in K.monthly_sales(log).collect()) == day_total
    for kind in K.SEASONAL:
        assert sum(r.total_daily_sale for r in K.seasonal_sales(log, kind).collect()) == day_total
    weekly = {r.week_num: r for r in K.weekly_sales(log).collect()}
    assert str(weekly[0].week_start_date) == "2013-12-29"  # first sale day, not Monday
    names = {r.day_of_the_week: r.day_name for r in K.seasonal_sales(log, "weekday").collect()}
    assert names[0] == "Monday" and names[6] == "Sunday"


def test_top_categories_calendar(spark):
    log = _log(spark)
    items = make_items(spark, [(1, "a", 7), (2, "b", 8)])
    cats = make_categories(spark, [(7, "seven"), (8, "eight"), (9, "none")])
    top = K.top_categories(log, items, cats, n=1).collect()
    assert [r.item_category_id for r in top] == [7]
    cal = K.category_sales_calendar(log, items, cats, n=1)
    assert cal.select("item_category_name").distinct().collect()[0][0] == "seven"
    assert cal.agg(F.sum("total_daily_sale")).first()[0] == 8 * 21.0


def test_category_days_do_not_depend_on_the_size_of_items(spark, monkeypatch):
    from ledgerlens.plans import calendar
    log = make_log(spark, [("2014-01-01", 1, 1.5, 2), ("2014-01-01", 1, 0.004, 10),
                           ("2014-01-01", 2, 3.0, 1), ("2014-01-02", 3, 7.0, 1)])
    items = make_items(spark, [(1, "a", 1), (2, "b", 1), (3, "c", 2)])
    cats = make_categories(spark, [(1, "one"), (2, "two")])
    small = sorted(calendar.category_daily(log, items, cats).drop("_daily_amount").collect())
    monkeypatch.setattr(calendar, "BROADCAST_BYTES", 0)
    assert sorted(calendar.category_daily(log, items, cats).drop("_daily_amount").collect()) == small
    assert sorted(r.total_daily_sale for r in small) == [6.04, 7.0]
