"""Registered queries: price statistics (R10-R12, A4-A6, A28-A36, F7-F9,
O4, O5) on mapping A (positive sales only)."""

from __future__ import annotations

from ledgerlens.catalog import register
from ledgerlens.operators import stats as S
from ledgerlens.operators.filters import positive_sales
from ledgerlens.plans import prices as P
from ledgerlens.sources.fixtures import BULK_CTE, bulk_categories, bulk_items, bulk_log

W = "WITH " + BULK_CTE


def sales(spark, sf):
    return positive_sales(bulk_log(spark, sf))


def item_prices(spark, sf):
    return P.mean_product_prices(sales(spark, sf), bulk_items(spark, sf))


def cat_item_prices(spark, sf):
    return P.top_category_item_prices(sales(spark, sf), bulk_items(spark, sf),
                                      bulk_categories(spark, sf))


def cat_prices(spark, sf):
    return P.mean_category_prices(sales(spark, sf), bulk_items(spark, sf),
                                  bulk_categories(spark, sf))


# Mean of prices (6 decimals) rounded half up to 4 places, in integer arithmetic
# so that exact ties round the same way as a decimal quotient.
_MEAN = ("CAST((sum(CAST(CAST(item_price AS DECIMAL(18,6)) * 1000000 AS HUGEINT)) * 2"
         " + 100 * count(item_price)) // (200 * count(item_price)) AS DOUBLE) / 10000.0")

_PRICES = W + """,
mp AS (SELECT item_id, {mean} AS mean_price FROM bulk_sales GROUP BY item_id),
prices AS (SELECT mp.item_id, mp.mean_price, i.item_name, i.item_category_id
           FROM mp JOIN bulk_items i ON mp.item_id = i.item_id),
q95 AS (SELECT round(quantile_cont(mean_price, 0.95), 6) AS q FROM prices),
trimmed AS (SELECT * FROM prices WHERE mean_price <= (SELECT q FROM q95))""".replace("{mean}", _MEAN)

_TOP5 = """,
per_item AS (SELECT item_id, sum(item_cnt_day) AS u FROM bulk_sales GROUP BY item_id),
top5 AS (SELECT c.item_category_id, c.item_category_name, sum(p.u) AS sales_sum
         FROM per_item p JOIN bulk_items i ON p.item_id = i.item_id
         JOIN bulk_categories c ON c.item_category_id = i.item_category_id
         GROUP BY c.item_category_id, c.item_category_name
         ORDER BY sales_sum DESC, c.item_category_id LIMIT 5),
cprices AS (SELECT m.item_id, t.item_category_id, t.item_category_name, i.item_name, m.mean_price
            FROM mp m JOIN bulk_items i ON m.item_id = i.item_id
            JOIN top5 t ON t.item_category_id = i.item_category_id),
cq AS (SELECT item_category_id, round(quantile_cont(mean_price, 0.95), 6) AS q
       FROM cprices GROUP BY item_category_id),
ctrim AS (SELECT p.* FROM cprices p JOIN cq ON p.item_category_id = cq.item_category_id
          WHERE p.mean_price <= cq.q)"""

_CATS = W + """,
per_item AS (SELECT item_id, sum(CAST(CAST(item_price AS DECIMAL(18,6)) * 1000000 AS HUGEINT)) AS ps,
                    count(item_price) AS pn
             FROM bulk_sales GROUP BY item_id),
catp AS (SELECT c.item_category_id, c.item_category_name,
                CAST((sum(p.ps) * 2 + 100 * sum(p.pn)) // (200 * sum(p.pn)) AS DOUBLE) / 10000.0 AS mean_price
         FROM per_item p JOIN bulk_items i ON p.item_id = i.item_id
         JOIN bulk_categories c ON c.item_category_id = i.item_category_id
         GROUP BY c.item_category_id, c.item_category_name)"""


def _describe_sql(src, groups=""):
    g = f"{groups}, " if groups else ""
    gb = f"GROUP BY {groups}" if groups else ""
    return f"""
SELECT {g}count(mean_price) AS count, round(avg(mean_price), 6) AS mean,
       round(stddev_samp(mean_price), 6) AS std, min(mean_price) AS min, max(mean_price) AS max,
       round(quantile_cont(mean_price, 0.25), 6) AS p25, round(quantile_cont(mean_price, 0.5), 6) AS p50,
       round(quantile_cont(mean_price, 0.75), 6) AS p75
FROM {src} {gb}"""


def _hist_sql(src, width):
    return f""",
h0 AS (SELECT min(mean_price) AS lo FROM {src})
SELECT CAST(floor((mean_price - lo) / {float(width)}) AS INTEGER) AS bin,
       round(lo + CAST(floor((mean_price - lo) / {float(width)}) AS INTEGER) * {float(width)}, 6) AS bin_start,
       round(lo + (CAST(floor((mean_price - lo) / {float(width)}) AS INTEGER) + 1) * {float(width)}, 6) AS bin_end,
       count(*) AS count
FROM {src}, h0 GROUP BY 1, 2, 3"""


@register("mean_product_prices", _PRICES + "\nSELECT * FROM prices")
def q_mean_prices(spark, sf):
    return item_prices(spark, sf)


@register("top_mean_price_items", _PRICES + """
SELECT item_id, item_name, round(mean_price, 2) AS mean_price FROM prices
ORDER BY prices.mean_price DESC, item_id LIMIT 10""")
def q_top_prices(spark, sf):
    return P.top_mean_price_items(item_prices(spark, sf))


@register("price_quantile", _PRICES + "\nSELECT q AS quantile FROM q95")
def q_quantile(spark, sf):
    return P.price_quantile(item_prices(spark, sf))


@register("trimmed_prices", _PRICES + "\nSELECT * FROM trimmed")
def q_trimmed(spark, sf):
    return P.trimmed_prices(item_prices(spark, sf))


@register("price_outliers", _PRICES + """
SELECT * FROM prices WHERE mean_price > (SELECT q FROM q95)
ORDER BY mean_price DESC, item_id LIMIT 20""")
def q_outliers(spark, sf):
    return P.price_outliers(item_prices(spark, sf))


@register("describe_trimmed_prices", _PRICES + _describe_sql("trimmed"))
def q_describe(spark, sf):
    return P.describe_trimmed_prices(item_prices(spark, sf))


@register("describe_quantity", W + """
SELECT count(item_cnt_day) AS count, round(avg(item_cnt_day), 6) AS mean,
       round(stddev_samp(item_cnt_day), 6) AS std, min(item_cnt_day) AS min,
       max(item_cnt_day) AS max
FROM bulk_sales""")
def q_describe_qty(spark, sf):
    return S.describe(sales(spark, sf), "item_cnt_day", with_quartiles=False)


@register("item_price_histogram", _PRICES + _hist_sql("trimmed", P.ITEM_BIN_WIDTH))
def q_hist(spark, sf):
    return P.item_price_histogram(item_prices(spark, sf))


@register("item_price_histogram_auto", _PRICES + """,
qs AS (SELECT count(mean_price) AS n, min(mean_price) AS lo, max(mean_price) AS hi,
              round(quantile_cont(mean_price, 0.75), 6) - round(quantile_cont(mean_price, 0.25), 6) AS iqr
       FROM prices),
w0 AS (SELECT n, lo, hi, 2.0 * iqr * pow(n, -1.0 / 3) AS fd, (hi - lo) / (log2(n) + 1.0) AS st,
              (hi - lo) / sqrt(n) AS sq FROM qs),
w1 AS (SELECT n, lo, hi, least(greatest(fd, sq / 2.0), st) AS w FROM w0),
w2 AS (SELECT lo, CAST(CASE WHEN w > 0 THEN ceil((hi - lo) / w) ELSE 1 END AS INTEGER) AS bins, hi FROM w1),
w3 AS (SELECT lo, bins, CASE WHEN bins > 0 THEN (hi - lo) / bins END AS width FROM w2),
b AS (SELECT least(CAST(floor((mean_price - lo) / CASE WHEN width > 0 THEN width ELSE 1.0 END) AS INTEGER),
                   bins - 1) AS bin, lo, width
      FROM prices, w3)
SELECT bin, round(lo + bin * width, 6) AS bin_start, round(lo + (bin + 1) * width, 6) AS bin_end,
       count(*) AS count
FROM b GROUP BY bin, lo, width""")
def q_hist_auto(spark, sf):
    return P.item_price_histogram_auto(item_prices(spark, sf))


@register("top_category_item_prices", _PRICES + _TOP5 + "\nSELECT * FROM cprices")
def q_cat_item_prices(spark, sf):
    return cat_item_prices(spark, sf)


@register("price_quantile_by_category", _PRICES + _TOP5
          + "\nSELECT item_category_id, q AS quantile FROM cq")
def q_cat_quantile(spark, sf):
    return S.quantiles(cat_item_prices(spark, sf), "mean_price", [0.95],
                       ["item_category_id"], names=["quantile"])


@register("top_category_trimmed", _PRICES + _TOP5 + "\nSELECT * FROM ctrim")
def q_cat_trim(spark, sf):
    return P.top_category_trimmed(cat_item_prices(spark, sf))


@register("describe_category_prices", _PRICES + _TOP5
          + _describe_sql("ctrim", "item_category_id, item_category_name"))
def q_cat_describe(spark, sf):
    return P.describe_category_prices(cat_item_prices(spark, sf))


@register("category_price_density", _PRICES + _TOP5 + """,
st AS (SELECT item_category_id, item_category_name, count(*) AS n, min(mean_price) AS lo,
              max(mean_price) AS hi, stddev_samp(mean_price) * pow(count(*), -0.2) AS h
       FROM ctrim GROUP BY item_category_id, item_category_name),
st2 AS (SELECT * FROM st WHERE h > 0),
vc AS (SELECT item_category_id, mean_price AS v, count(*) AS c FROM ctrim
       GROUP BY item_category_id, mean_price),
g AS (SELECT CAST(range AS INTEGER) AS point FROM range(0, 200)),
pts AS (SELECT st2.*, g.point,
               (lo - 3.0 * h) + g.point * ((hi - lo + 6.0 * h) / 199) AS x FROM st2, g)
SELECT p.item_category_id, p.item_category_name, p.point, round(p.x, 10) AS x,
       round(sum(vc.c * exp(-0.5 * ((p.x - vc.v) / p.h) * ((p.x - vc.v) / p.h)))
             / (p.n * p.h * sqrt(2 * pi())), 10) AS density
FROM pts p JOIN vc ON p.item_category_id = vc.item_category_id
GROUP BY p.item_category_id, p.item_category_name, p.point, p.x, p.n, p.h""")
def q_density(spark, sf):
    return P.category_price_density(cat_item_prices(spark, sf))


@register("mean_category_prices", _CATS + "\nSELECT * FROM catp")
def q_cat_prices(spark, sf):
    return cat_prices(spark, sf)


@register("top_mean_price_categories", _CATS + """
SELECT * FROM catp ORDER BY mean_price DESC, item_category_id LIMIT 10""")
def q_top_cat_prices(spark, sf):
    return P.top_mean_price_categories(cat_prices(spark, sf))


@register("category_price_histogram", _CATS + _hist_sql("catp", P.CATEGORY_BIN_WIDTH))
def q_cat_hist(spark, sf):
    return P.category_price_histogram(cat_prices(spark, sf))
