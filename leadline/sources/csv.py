"""CSV scans of the raw exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the raw order-line export, by type.
_TEXT = (
    "Type|Delivery Status|Category Name|Customer City|Customer Country|Customer Email|Customer Fname|"
    "Customer Lname|Customer Password|Customer Segment|Customer State|Customer Street|Department Name|"
    "Market|Order City|Order Country|order date (DateOrders)|Order Region|Order State|Order Status|"
    "Product Image|Product Name|shipping date (DateOrders)|Shipping Mode"
).split("|")
_LONG = (
    "Days for shipping (real)|Days for shipment (scheduled)|Late_delivery_risk|Category Id|Customer Id|"
    "Department Id|Order Customer Id|Order Id|Order Item Cardprod Id|Order Item Id|Order Item Quantity|"
    "Product Card Id|Product Category Id|Product Status"
).split("|")
_DOUBLE = (
    "Benefit per order|Sales per customer|Customer Zipcode|Latitude|Longitude|Order Item Discount|"
    "Order Item Discount Rate|Order Item Product Price|Order Item Profit Ratio|Sales|Order Item Total|"
    "Order Profit Per Order|Order Zipcode|Product Description|Product Price"
).split("|")

ORDER_LINE_TYPES: dict[str, T.DataType] = {
    **{c: T.StringType() for c in _TEXT},
    **{c: T.LongType() for c in _LONG},
    **{c: T.DoubleType() for c in _DOUBLE},
}
ACCESS_LOG_TYPES: dict[str, T.DataType] = {
    "Product": T.StringType(), "Category": T.StringType(), "Date": T.StringType(),
    "Month": T.StringType(), "Hour": T.LongType(), "Department": T.StringType(),
    "ip": T.StringType(), "url": T.StringType(),
}

_REPLACEMENT = "�"


def _scan(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return spark.read.csv(path, header=True, encoding=encoding, quote='"', escape='"')


def read_csv(spark: SparkSession, path: str, types: dict[str, T.DataType] | None = None) -> DataFrame:
    """Header CSV as UTF-8 (a byte-order mark is dropped); if any text does not decode, as Latin-1.

    Columns are matched by name: those in ``types`` are cast, bad numbers become null, and
    columns that the file lacks stay absent.
    """
    df = _scan(spark, path, "UTF-8")
    broken = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(f"`{c}`").contains(_REPLACEMENT), F.lit(False)) for c in df.columns],
    )
    if any(_REPLACEMENT in c for c in df.columns) or not df.filter(broken).isEmpty():
        df = _scan(spark, path, "ISO-8859-1")
    if types:
        df = df.select(
            *[
                F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
                for c in df.columns
            ]
        )
    return df
