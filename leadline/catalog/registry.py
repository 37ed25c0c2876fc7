"""Registry of queries and the shared line view in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; it runs with UTC clocks."""

    def register(run):
        @wraps(run)
        def with_utc(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, folder)

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = with_utc
        if sql is not None:
            SQL[name] = sql
        return run

    return register


# Means of cent amounts often lie exactly between two roundings, where the order of the sum
# decides. Both forms of a query shift such means by this much before they round.
OFF_TIE = 3e-7


def rounded(df: DataFrame, digits: int = 6, off_tie: Sequence[str] = (), **special: int) -> DataFrame:
    """Round floating columns, so that the order of a sum cannot show in the result."""

    def cell(c: str):
        value = F.col(f"`{c}`") + F.lit(OFF_TIE) if c in off_tie else F.col(f"`{c}`")
        return F.round(value, special.get(c, digits)).alias(c)

    return df.select(*[cell(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])


# The role view of leadline.sources.tables, said in SQL.
LINES = """
base AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supplier_id,
    l_quantity AS quantity, l_extendedprice AS sales, l_discount AS discount_rate,
    l_extendedprice * l_discount AS discount, l_tax AS tax, l_tax * 10 - l_discount * 5 AS profit_ratio,
    l_returnflag AS payment_type, l_linestatus AS line_status, l_shipdate AS ship_date,
    o_orderdate AS order_ts, o_orderpriority AS shipping_mode, o_custkey AS customer_id, o_orderstatus AS order_state,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 4 END AS promised_days,
    CAST(((date_diff('day', o_orderdate, l_shipdate) % 7) + 7) % 7 AS INTEGER) AS actual_days,
    c_mktsegment AS segment, n_name || '-' || CAST(o_custkey % 3 AS VARCHAR) AS city, n_name AS country,
    r_name AS market, p_name AS product, p_type AS category, p_brand AS department, p_retailprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey
),
lines AS (
  SELECT *, actual_days - promised_days AS delay, order_ts + to_days(actual_days) AS shipping_ts,
    actual_days > promised_days AND order_state <> 'P' AS official_late,
    CASE WHEN order_state = 'P' THEN 'Shipping canceled' WHEN actual_days > promised_days THEN 'Late delivery'
      WHEN actual_days = promised_days THEN 'Shipping on time' ELSE 'Advance shipping' END AS delivery_status,
    CASE WHEN order_state = 'P' AND payment_type = 'R' THEN 'CANCELED'
      WHEN order_state = 'P' AND payment_type = 'A' THEN 'SUSPECTED_FRAUD'
      WHEN order_state = 'O' AND payment_type = 'N' THEN 'PENDING_PAYMENT'
      WHEN order_state = 'F' AND payment_type = 'R' THEN 'PAYMENT_REVIEW' ELSE 'COMPLETE' END AS order_status
  FROM base
)
"""

LINE_KEY_SQL = "order_id, line_no, part_id, supplier_id, quantity, sales, discount_rate, tax"


def with_lines(body: str) -> str:
    """A query over ``lines``; the body may begin with more common tables."""
    return f"WITH {LINES}{body}"
