"""Parquet scans and role views.

A role view names what a column means (``shipping_mode``, ``promised_days``), so that
operators run on any order-line table. Only the joins that the asked roles need are
planned, and only their columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# role -> (SQL expression, tables it needs besides the line table)
_ROLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "order_id": ("l_orderkey", ()),
    "line_no": ("l_linenumber", ()),
    "part_id": ("l_partkey", ()),
    "supplier_id": ("l_suppkey", ()),
    "quantity": ("l_quantity", ()),
    "sales": ("l_extendedprice", ()),
    "discount_rate": ("l_discount", ()),
    "discount": ("l_extendedprice * l_discount", ()),
    "tax": ("l_tax", ()),
    "profit_ratio": ("l_tax * 10 - l_discount * 5", ()),
    "payment_type": ("l_returnflag", ()),
    "line_status": ("l_linestatus", ()),
    "ship_date": ("l_shipdate", ()),
    "order_ts": ("o_orderdate", ("orders",)),
    "shipping_mode": ("o_orderpriority", ("orders",)),
    "customer_id": ("o_custkey", ("orders",)),
    "order_state": ("o_orderstatus", ("orders",)),
    "promised_days": (
        "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1"
        " WHEN '3-MEDIUM' THEN 2 ELSE 4 END",
        ("orders",),
    ),
    "actual_days": ("pmod(datediff(l_shipdate, o_orderdate), 7)", ("orders",)),
    "shipping_ts": (
        "o_orderdate + make_dt_interval(pmod(datediff(l_shipdate, o_orderdate), 7))",
        ("orders",),
    ),
    "order_status": (
        "CASE WHEN o_orderstatus = 'P' AND l_returnflag = 'R' THEN 'CANCELED'"
        " WHEN o_orderstatus = 'P' AND l_returnflag = 'A' THEN 'SUSPECTED_FRAUD'"
        " WHEN o_orderstatus = 'O' AND l_returnflag = 'N' THEN 'PENDING_PAYMENT'"
        " WHEN o_orderstatus = 'F' AND l_returnflag = 'R' THEN 'PAYMENT_REVIEW'"
        " ELSE 'COMPLETE' END",
        ("orders",),
    ),
    "segment": ("c_mktsegment", ("orders", "customer")),
    "city": ("concat(n_name, '-', pmod(o_custkey, 3))", ("orders", "customer", "nation")),
    "country": ("n_name", ("orders", "customer", "nation")),
    "market": ("r_name", ("orders", "customer", "nation", "region")),
    "product": ("p_name", ("part",)),
    "category": ("p_type", ("part",)),
    "department": ("p_brand", ("part",)),
    "price": ("p_retailprice", ("part",)),
}

_DELAY = "pmod(datediff(l_shipdate, o_orderdate), 7) - (" + _ROLES["promised_days"][0] + ")"
_ROLES["official_late"] = (f"({_DELAY}) > 0 AND o_orderstatus <> 'P'", ("orders",))
_ROLES["delivery_status"] = (
    f"CASE WHEN o_orderstatus = 'P' THEN 'Shipping canceled' WHEN ({_DELAY}) > 0 THEN 'Late delivery'"
    f" WHEN ({_DELAY}) = 0 THEN 'Shipping on time' ELSE 'Advance shipping' END",
    ("orders",),
)

_JOINS = {
    "orders": "l_orderkey = o_orderkey",
    "customer": "o_custkey = c_custkey",
    "nation": "c_nationkey = n_nationkey",
    "region": "n_regionkey = r_regionkey",
    "part": "l_partkey = p_partkey",
}

ROLES = tuple(_ROLES)

# Total order of lines: (order_id, line_no) repeats, the longer key does not.
LINE_KEY = ["order_id", "line_no", "part_id", "supplier_id", "quantity", "sales", "discount_rate", "tax"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_lines(spark: SparkSession, folder: str, roles: Sequence[str], per_customer: DataFrame | None = None) -> DataFrame:
    """Order lines with the asked roles, and the other columns of ``per_customer``, which has a row per customer_id.

    A line keeps its row when a lookup table has no match (left join). No broadcast is
    forced: Spark broadcasts a lookup only when its measured size is under the session's
    threshold, and shuffles it otherwise.
    """
    unknown = [r for r in roles if r not in _ROLES]
    if unknown:
        raise ValueError(f"unknown roles: {unknown}")
    df = read_table(spark, folder, "lineitem")
    needed = {table for r in roles for table in _ROLES[r][1]}
    if "part" in needed:
        df = df.join(read_table(spark, folder, "part"), F.expr(_JOINS["part"]), "left")
    more = [c for c in per_customer.columns if c != "customer_id"] if per_customer is not None else []
    if "orders" in needed or more:
        # Customers and places join the orders, so the lines are shuffled once for all of them.
        orders = read_table(spark, folder, "orders")
        for table in ("customer", "nation", "region"):
            if table in needed:
                orders = orders.join(read_table(spark, folder, table), F.expr(_JOINS[table]), "left")
        if more:
            orders = orders.join(per_customer, F.col("o_custkey") == F.col("customer_id"), "left")
        df = df.join(orders, F.expr(_JOINS["orders"]))
    return df.select(*[F.expr(_ROLES[r][0]).alias(r) for r in dict.fromkeys(roles)], *more)


def web_events(spark: SparkSession, folder: str) -> DataFrame:
    """Access-log events: time, category, product bucket, the hour the log claims."""
    return read_table(spark, folder, "events").select(
        F.col("ts").alias("access_ts"),
        F.col("event_type").alias("category"),
        F.get_json_object("props", "$.k").cast("long").alias("product_bucket"),
        F.pmod(F.col("user_id"), F.lit(24)).alias("claimed_hour"),
    )
