"""The six-table order data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# Table and column names of the data model.
ORDERS = _schema(
    ("order_id", T.LongType()),
    ("user_id", T.LongType()),
    ("eval_set", T.StringType()),
    ("order_number", T.IntegerType()),
    ("order_dow", T.IntegerType()),
    ("order_hour_of_day", T.IntegerType()),
    ("days_since_prior_order", T.DoubleType()),
)
PRODUCTS = _schema(
    ("product_id", T.LongType()),
    ("product_name", T.StringType()),
    ("aisle_id", T.IntegerType()),
    ("department_id", T.IntegerType()),
)
AISLES = _schema(("aisle_id", T.IntegerType()), ("aisle", T.StringType()))
DEPARTMENTS = _schema(("department_id", T.IntegerType()), ("department", T.StringType()))
ORDER_PRODUCTS = _schema(
    ("order_id", T.LongType()),
    ("product_id", T.LongType()),
    ("add_to_cart_order", T.IntegerType()),
    ("reordered", T.IntegerType()),
)

# name -> (schema, columns in which a missing value is an error)
TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "orders": (
        ORDERS,
        ("order_id", "user_id", "order_number", "order_dow", "order_hour_of_day"),
    ),
    "products": (PRODUCTS, ("product_id", "aisle_id", "department_id")),
    "aisles": (AISLES, ("aisle_id",)),
    "departments": (DEPARTMENTS, ("department_id",)),
    "order_products__prior": (ORDER_PRODUCTS, tuple(ORDER_PRODUCTS.fieldNames())),
    "order_products__train": (ORDER_PRODUCTS, tuple(ORDER_PRODUCTS.fieldNames())),
}

# The seven per-user features, in order.
FEATURES = (
    "total_max_orders",
    "average_days_btw_orders",
    "reorder_mean",
    "average_hour_of_day",
    "average_order_dow",
    "unique_products",
    "average_add_to_cart_order",
)
