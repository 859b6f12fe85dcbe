"""A small marketplace with every edge case planted once."""

from __future__ import annotations

from ledgerloom.plans import facts, marts, order_grain, staging
from ledgerloom.sources.schemas import raw_schema

WINDOW = ("2017-01-01", "2018-01-01")

ORDERS = [
    # id, account, status, purchased, approved, carrier, delivered, estimated
    ("o01", "a1", "delivered", "2017-01-05 10:00:00", None, None, "2017-01-20 23:59:00", "2017-01-20 00:00:00"),  # on the day
    ("o02", "a2", "delivered", "2017-01-06 10:00:00", None, None, "2017-01-21 00:01:00", "2017-01-20 00:00:00"),  # one minute late
    ("o03", "a3", "delivered", "2017-01-07 10:00:00", None, None, None, "2017-01-20 00:00:00"),  # never dated
    ("o04", "a4", "canceled", "2017-02-01 10:00:00", None, None, "2017-03-09 00:00:00", "2017-02-20 00:00:00"),  # late but cancelled
    ("o05", "a5", "unavailable", "2017-03-01 10:00:00", None, None, None, "2017-03-20 00:00:00"),  # month without items
    ("o06", "a6", "delivered", "2017-02-03 10:00:00", None, None, "2017-02-10 00:00:00", "2017-02-20 00:00:00"),
    ("o07", "a7", "delivered", "2016-09-04 10:00:00", None, None, "2016-09-10 00:00:00", "2016-09-20 00:00:00"),  # pilot
    ("o08", "a8", "shipped", "2018-01-01 00:00:00", None, None, None, "2018-01-20 00:00:00"),  # end is exclusive
    ("o09", "a9", "delivered", "2017-02-04 10:00:00", None, None, "2017-02-09 00:00:00", "2017-02-20 00:00:00"),
]
ITEMS = [
    ("o01", 1, "p1", "s1", None, 10.00, 1.10), ("o01", 2, "p2", "s2", None, 20.00, 2.20), ("o01", 3, "p1", "s1", None, 10.00, 0.00),
    ("o02", 1, "p3", "s1", None, 5.55, 0.45), ("o03", 1, "p1", "s2", None, 7.00, 3.00), ("o04", 1, "p2", "s1", None, 9.99, 0.01),
    ("o06", 1, "p4", "s1", None, 100.00, 10.00), ("o07", 1, "p1", "s1", None, 1.00, 1.00), ("o08", 1, "p1", "s1", None, 2.00, 1.00),
    ("o09", 1, "p1", "s1", None, 4.00, 1.00),
]
PAYMENTS = [
    ("o01", 1, "voucher", 1, 21.65), ("o01", 2, "credit_card", 3, 21.65),  # exact tie: alphabetical winner
    ("o02", 1, "boleto", 1, 6.00), ("o03", 1, "credit_card", 1, 4.00), ("o03", 2, "voucher", 2, 3.00), ("o03", 3, "voucher", 1, 3.00),
    ("o04", 1, "not_defined", 1, 0.00), ("o06", 1, "credit_card", 10, 110.00), ("o07", 1, "boleto", 1, 2.00), ("o08", 1, "boleto", 1, 3.00),
]  # o05 and o09 have no payment
REVIEWS = [
    ("r1", "o01", 5, None, None, "2017-01-22 00:00:00", "2017-01-23 00:00:00"), ("r2", "o01", 1, None, None, "2017-01-25 00:00:00", "2017-01-26 00:00:00"),
    ("r3", "o02", 2, None, None, "2017-01-22 00:00:00", None), ("r3", "o03", 4, None, None, "2017-01-22 00:00:00", "2017-01-23 00:00:00"),
    ("r4", "o02", 4, None, None, "2017-01-20 00:00:00", "2017-01-21 00:00:00"),  # answered beats unanswered
    ("r5", "o06", 3, None, None, "2017-02-12 00:00:00", "2017-02-13 00:00:00"),
]
CUSTOMERS = [
    ("a1", "u1", "01001", "x", "sp"), ("a2", "u1", "02002", "y", "rj"), ("a3", "u2", "01001", "x", "sp"), ("a4", "u3", "09999", "z", "mg"),
    ("a5", "u4", "01001", "x", "sp"), ("a6", "u5", "01001", "x", "sp"), ("a7", "u1", "03003", "w", "ba"), ("a8", "u6", "01001", "x", "sp"),
    ("a9", "u7", "01001", "x", "sp"),
]
PRODUCTS = [("p1", "casa", 1, 1, 1, 100, 2, 3, 4), ("p2", "pet", 1, 1, 1, 100, 2, 3, 4), ("p3", None, 1, 1, None, None, None, 3, 4), ("p4", "arte", 1, 1, 1, 1, 1, 1, 1)]
CATEGORIES = [("casa", "house"), ("pet", "pet_shop")]
SELLERS = [("s1", "01001", "x", "sp"), ("s2", "77777", "q", "pr")]
POINTS = [
    ("01001", -23.5, -46.6, "sao paulo", "SP"), ("01001", -23.7, -46.4, "sao paulo", "SP"), ("01001", -23.6, -46.5, "são paulo", "SP"),
    ("01001", 80.0, 10.0, "são paulo", "SP"), ("02002", -22.9, -43.2, "rio", "RJ"),
]

RAW = {"orders": ORDERS, "order_items": ITEMS, "order_payments": PAYMENTS, "order_reviews": REVIEWS, "customers": CUSTOMERS,
       "products": PRODUCTS, "product_categories": CATEGORIES, "sellers": SELLERS, "geolocation": POINTS}


def text_frame(spark, role, data=None):
    """Raw rows the way a CSV delivers them: typed by the declared schema from text."""
    schema = raw_schema(role)
    names = schema.fieldNames()
    data = RAW[role] if data is None else data
    text = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in data], ", ".join(f"{n} string" for n in names))
    return text.selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in schema.fields])


class Market:
    def __init__(self, spark, **overrides):
        raw = {role: text_frame(spark, role, overrides.get(role)) for role in RAW}
        self.staged = staging.stage_all(raw)
        s = self.staged
        self.items = order_grain.items_agg(s["order_items"])
        self.payments = order_grain.payments_agg(s["order_payments"])
        self.reviews = order_grain.reviews_agg(s["order_reviews"])
        self.centroid = order_grain.zip_centroid(s["geolocation"])
        self.enriched = order_grain.orders_enriched(s["orders"], s["customers"], self.items, self.payments, self.reviews)
        self.products = facts.dim_products(s["products"], s["product_categories"])
        self.people = facts.dim_customers(s["customers"], self.enriched)
        self.fct_orders = facts.fct_orders(self.enriched, facts.dim_geography(self.centroid), WINDOW)
        self.fct_lines = facts.fct_order_items(s["order_items"], facts.spine_heads(s["orders"], s["customers"]), self.products)
        self.monthly = marts.monthly_performance(self.fct_orders)
        self.category = marts.category_performance(self.fct_lines, WINDOW)
        self.state = marts.state_performance(self.fct_orders)
        self.payment = marts.payment_performance(self.fct_orders)
