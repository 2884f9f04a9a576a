"""Seed rows of the modelled system as a Tables bundle (test fixture).

Fixed values: the five categories, 17 products, 15 customers, 20 orders
and 30 order items of the seed script, and the ten-row sample feed.
"""

from __future__ import annotations

from decimal import Decimal as D

from tillpoint.operators.contracts import with_generated
from tillpoint.sources.tables import Tables, conform

# ---------------------------------------------------------------------------
# Fixed values (seed data)
# ---------------------------------------------------------------------------
CATEGORIES = [
    (1, "Electronics", "Phones, laptops, accessories, and gadgets"),
    (2, "Clothing", "Apparel for men, women, and children"),
    (3, "Home & Kitchen", "Cookware, furniture, and home decor"),
    (4, "Books", "Fiction, non-fiction, and educational titles"),
    (5, "Sports", "Fitness equipment and outdoor gear"),
]
PRODUCTS = [
    (1, 1, "ELEC-001", "Wireless Noise-Cancelling Headphones", "89.99", 142),
    (2, 1, "ELEC-002", "USB-C Charging Hub (7-Port)", "34.99", 305),
    (3, 1, "ELEC-003", "Mechanical Keyboard (TKL)", "119.00", 88),
    (4, 1, "ELEC-004", '27" 1440p Monitor', "329.00", 47),
    (5, 1, "ELEC-005", "Portable SSD 1TB", "79.99", 200),
    (6, 2, "CLTH-001", "Classic Cotton T-Shirt", "19.99", 600),
    (7, 2, "CLTH-002", "Running Jacket (Waterproof)", "64.99", 130),
    (8, 2, "CLTH-003", "Slim-Fit Chinos", "44.99", 215),
    (9, 3, "HOME-001", "Stainless Steel Cookware Set (10pc)", "129.99", 75),
    (10, 3, "HOME-002", "Bamboo Cutting Board Set", "27.99", 310),
    (11, 3, "HOME-003", "Pour-Over Coffee Maker", "39.99", 180),
    (12, 4, "BOOK-001", "Designing Data-Intensive Applications", "42.00", 500),
    (13, 4, "BOOK-002", "Clean Code", "36.00", 450),
    (14, 4, "BOOK-003", "The Pragmatic Programmer", "40.00", 380),
    (15, 5, "SPRT-001", "Adjustable Dumbbell Set (5-25kg)", "189.00", 60),
    (16, 5, "SPRT-002", "Yoga Mat (Non-Slip, 6mm)", "24.99", 290),
    (17, 5, "SPRT-003", "Resistance Bands Set", "18.99", 400),
]
CUSTOMERS = [
    (1, "ana.silva@email.com", "Ana", "Silva", "Portugal", "Lisbon", "2023-01-15 09:00:00"),
    (2, "joao.ferreira@email.com", "João", "Ferreira", "Portugal", "Porto", "2023-02-03 14:30:00"),
    (3, "maria.costa@email.com", "Maria", "Costa", "Portugal", "Braga", "2023-03-11 11:15:00"),
    (4, "carlos.mendes@email.com", "Carlos", "Mendes", "Spain", "Madrid", "2023-03-25 08:45:00"),
    (5, "sophie.martin@email.com", "Sophie", "Martin", "France", "Paris", "2023-04-02 16:00:00"),
    (6, "thomas.müller@email.com", "Thomas", "Müller", "Germany", "Berlin", "2023-04-18 10:30:00"),
    (7, "laura.rossi@email.com", "Laura", "Rossi", "Italy", "Milan", "2023-05-07 13:00:00"),
    (8, "james.wilson@email.com", "James", "Wilson", "United Kingdom", "London", "2023-05-22 09:15:00"),
    (9, "sara.ahmed@email.com", "Sara", "Ahmed", "Netherlands", "Amsterdam", "2023-06-10 15:45:00"),
    (10, "pedro.santos@email.com", "Pedro", "Santos", "Portugal", "Coimbra", "2023-06-28 12:00:00"),
    (11, "nina.petrov@email.com", "Nina", "Petrov", "Germany", "Munich", "2023-07-14 08:00:00"),
    (12, "lucas.dupont@email.com", "Lucas", "Dupont", "France", "Lyon", "2023-08-01 17:30:00"),
    (13, "emma.johnson@email.com", "Emma", "Johnson", "United Kingdom", "Manchester", "2023-08-19 11:00:00"),
    (14, "rafael.garcia@email.com", "Rafael", "Garcia", "Spain", "Barcelona", "2023-09-05 14:15:00"),
    (15, "yuki.tanaka@email.com", "Yuki", "Tanaka", "Netherlands", "Rotterdam", "2023-09-23 09:45:00"),
]
ORDERS = [
    (1, 1, "delivered", "124.98", "2023-10-05 10:00:00", "2023-10-06 08:00:00", "2023-10-08 14:00:00"),
    (2, 2, "delivered", "34.99", "2023-10-12 11:30:00", "2023-10-13 09:00:00", "2023-10-15 13:00:00"),
    (3, 3, "delivered", "129.99", "2023-10-20 14:00:00", "2023-10-21 10:00:00", "2023-10-23 16:00:00"),
    (4, 4, "delivered", "208.00", "2023-11-01 09:15:00", "2023-11-02 07:30:00", "2023-11-04 12:00:00"),
    (5, 5, "delivered", "64.99", "2023-11-10 13:00:00", "2023-11-11 08:00:00", "2023-11-13 10:00:00"),
    (6, 1, "delivered", "119.00", "2023-11-20 15:30:00", "2023-11-21 09:00:00", "2023-11-23 14:00:00"),
    (7, 6, "delivered", "329.00", "2023-11-25 10:45:00", "2023-11-26 08:00:00", "2023-11-28 15:00:00"),
    (8, 7, "delivered", "84.98", "2023-12-02 12:00:00", "2023-12-03 07:00:00", "2023-12-05 11:00:00"),
    (9, 8, "delivered", "189.00", "2023-12-10 09:00:00", "2023-12-11 08:30:00", "2023-12-13 13:00:00"),
    (10, 9, "delivered", "79.98", "2023-12-15 16:00:00", "2023-12-16 09:00:00", "2023-12-18 14:00:00"),
    (11, 10, "delivered", "42.00", "2024-01-08 10:00:00", "2024-01-09 08:00:00", "2024-01-11 12:00:00"),
    (12, 11, "delivered", "213.98", "2024-01-15 14:30:00", "2024-01-16 09:00:00", "2024-01-18 15:00:00"),
    (13, 12, "delivered", "58.98", "2024-01-22 11:00:00", "2024-01-23 08:00:00", "2024-01-25 13:00:00"),
    (14, 13, "delivered", "36.00", "2024-02-05 09:30:00", "2024-02-06 07:30:00", "2024-02-08 11:00:00"),
    (15, 14, "delivered", "169.98", "2024-02-14 13:00:00", "2024-02-15 08:00:00", "2024-02-17 14:00:00"),
    (16, 1, "delivered", "27.99", "2024-02-20 10:00:00", "2024-02-21 08:30:00", "2024-02-23 12:00:00"),
    (17, 15, "delivered", "214.98", "2024-03-05 15:00:00", "2024-03-06 09:00:00", "2024-03-08 13:00:00"),
    (18, 2, "shipped", "89.99", "2024-03-10 11:00:00", "2024-03-11 08:00:00", None),
    (19, 5, "confirmed", "159.00", "2024-03-14 09:00:00", None, None),
    (20, 3, "pending", "24.99", "2024-03-15 14:00:00", None, None),
]
ORDER_ITEMS = [  # (order_id, product_id, quantity, unit_price); ids 1..30 in this order
    (1, 1, 1, "89.99"), (1, 2, 1, "34.99"), (2, 2, 1, "34.99"), (3, 9, 1, "129.99"),
    (4, 4, 1, "329.00"), (4, 13, 1, "36.00"), (5, 7, 1, "64.99"), (6, 3, 1, "119.00"),
    (7, 4, 1, "329.00"), (8, 6, 2, "19.99"), (8, 8, 1, "44.99"), (9, 15, 1, "189.00"),
    (10, 12, 1, "42.00"), (10, 14, 1, "40.00"), (11, 12, 1, "42.00"), (12, 1, 1, "89.99"),
    (12, 5, 1, "79.99"), (12, 2, 1, "34.99"), (13, 16, 1, "24.99"), (13, 17, 1, "18.99"),
    (13, 6, 1, "19.99"), (14, 13, 1, "36.00"), (15, 3, 1, "119.00"), (15, 7, 1, "64.99"),
    (16, 10, 1, "27.99"), (17, 4, 1, "329.00"), (18, 1, 1, "89.99"), (19, 3, 1, "119.00"),
    (19, 11, 1, "39.99"), (20, 16, 1, "24.99"),
]
SAMPLE_FEED = """order_id,customer_email,product_sku,quantity,unit_price,order_date,status
EXT-001,ana.silva@email.com,ELEC-001,1,89.99,2024-03-01,delivered
EXT-002,joao.ferreira@email.com,BOOK-001,2,42.00,2024-03-02,delivered
EXT-003,maria.costa@email.com,HOME-003,1,39.99,2024-03-03,shipped
EXT-004,carlos.mendes@email.com,SPRT-002,3,24.99,2024-03-04,delivered
EXT-005,sophie.martin@email.com,ELEC-003,1,119.00,2024-03-05,confirmed
EXT-006,thomas.müller@email.com,CLTH-001,2,19.99,2024-03-06,pending
EXT-007,laura.rossi@email.com,BOOK-002,1,36.00,2024-03-07,delivered
EXT-008,james.wilson@email.com,ELEC-002,1,34.99,2024-03-08,delivered
EXT-009,sara.ahmed@email.com,SPRT-003,2,18.99,2024-03-09,shipped
EXT-010,pedro.santos@email.com,HOME-001,1,129.99,2024-03-10,delivered
"""
# ---------------------------------------------------------------------------

NOW = "2023-01-01 00:00:00"


def ts(s):
    """Timestamps travel as text and are cast in the session zone (UTC), so
    the fixture does not depend on the Python process's local zone."""
    return s


def _cast_ts(df, *cols):
    from pyspark.sql import functions as F
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def seed_tables(spark, orders=None, items=None, customers=None, products=None, categories=None) -> Tables:
    cats = _cast_ts(spark.createDataFrame([(i, n, d, NOW) for i, n, d in (categories or CATEGORIES)],
                                          "id long, name string, description string, created_at string"),
                    "created_at")
    prods = spark.createDataFrame(
        [(i, c, s, n, None, D(p), st, True, NOW) for i, c, s, n, p, st in (products or PRODUCTS)],
        "id long, category_id long, sku string, name string, description string, unit_price decimal(10,2), "
        "stock int, is_active boolean, created_at string")
    prods = _cast_ts(prods, "created_at")
    custs = spark.createDataFrame(
        [(i, e, f, l, co, ci, ts(c), True) for i, e, f, l, co, ci, c in (customers or CUSTOMERS)],
        "id long, email string, first_name string, last_name string, country string, city string, "
        "created_at string, is_active boolean")
    custs = _cast_ts(custs, "created_at")
    ords = spark.createDataFrame(
        [(i, c, s, D(a), "USD", ts(p), ts(sh), ts(de)) for i, c, s, a, p, sh, de in (orders or ORDERS)],
        "id long, customer_id long, status string, total_amount decimal(12,2), currency string, "
        "placed_at string, shipped_at string, delivered_at string")
    ords = _cast_ts(ords, "placed_at", "shipped_at", "delivered_at")
    its = spark.createDataFrame(
        [(n + 1, o, p, q, D(u)) for n, (o, p, q, u) in enumerate(items or ORDER_ITEMS)],
        "id long, order_id long, product_id long, quantity int, unit_price decimal(10,2)")
    return Tables(customers=conform(custs, "customers"), categories=conform(cats, "categories"),
                  products=conform(prods, "products"), orders=conform(ords, "orders"),
                  order_items=conform(with_generated(its), "order_items"))
