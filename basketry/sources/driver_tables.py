"""The retail tables derived from the order tables used for tests and benchmarks.

Lineitem, orders and supplier give purchase lines; part gives products; customer gives
households. A day is counted from 1995-01-01, a week has seven days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_DAY = "1995-01-01"
LAST_FULL_WEEK = 343

# Columns read; an explicit schema saves the job that would infer it.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE"
    ),
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str, product_id: Column) -> DataFrame:
    """Purchase lines; ``product_id`` is computed from the part key."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit(FIRST_DAY).cast("date")) + 1
    orders = _table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("household_key"), day.alias("day")
    )
    suppliers = _table(spark, folder, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("store_id")
    )
    lines = _table(spark, folder, "lineitem")
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
        .select(
            "household_key",
            F.col("l_orderkey").alias("basket_id"),
            "day",
            product_id.alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sales_value"),
            "store_id",
            F.expr("(day - 1) div 7 + 1").cast("int").alias("week_no"),
        )
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, F.col("l_partkey"))


def products(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("department"),
        F.col("p_brand").alias("commodity_desc"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("sub_commodity_desc"),
    )


def demographics(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes of every customer; those in debt state no segment, as part of a panel does not.

    The last attribute has gaps of its own.
    """
    key = F.col("c_custkey")
    nation = _table(spark, folder, "nation")
    region = _table(spark, folder, "region")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        "n_nationkey", "n_name", "r_name"
    )
    customers = _table(spark, folder, "customer")
    return customers.join(places, customers["c_nationkey"] == places["n_nationkey"]).select(
        key.alias("household_key"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("classification_1"),
        F.col("n_name").alias("classification_2"),
        F.col("r_name").alias("classification_3"),
        F.when(F.col("c_acctbal") < 5000, "low").otherwise("high").alias("classification_4"),
        (key % 4).cast("string").alias("classification_5"),
        F.when(key % 2 == 0, "owner").otherwise("renter").alias("homeowner_desc"),
        F.when(key % 5 != 0, (key % 7).cast("string")).alias("kid_category_desc"),
    )


# --- promotion tables: a product is a part name, because single parts sell too rarely --------


def name_id(name: Column) -> Column:
    """A product number that every engine computes alike, row by row."""
    return F.conv(F.substring(F.md5(name), 1, 6), 16, 10).cast("int")


def promo_products(spark: SparkSession, folder: str) -> DataFrame:
    sub = F.split_part("p_name", F.lit(" "), F.lit(2))
    return (
        _table(spark, folder, "part")
        .select("p_name")
        .distinct()
        .select(
            name_id(F.col("p_name")).alias("product_id"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("department"),
            F.when(sub.isin("bolt", "ring", "rod", "plate"), "STOCK")
            .otherwise("MACHINE")
            .alias("commodity_desc"),
            sub.alias("sub_commodity_desc"),
        )
    )


def promo_transactions(
    spark: SparkSession, folder: str, lines: DataFrame | None = None
) -> DataFrame:
    """``lines`` are ready ``transactions``, if they are at hand."""
    lines = transactions(spark, folder) if lines is None else lines
    names = _table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"), name_id(F.col("p_name")).alias("name_id")
    )
    return (
        lines.join(names, "product_id")
        .withColumn("product_id", F.col("name_id"))
        .select(*lines.columns)
    )


def promo_causal(spark: SparkSession, folder: str) -> DataFrame:
    """Placements by product, store (nation of a supplier) and week.

    The nations are at most the rows of the nation table, the weeks are the calendar, so both
    unfold from short arrays.
    """
    stores = _table(spark, folder, "supplier").agg(F.collect_set("s_nationkey")).scalar()
    product, store, week = F.col("product_id"), F.col("store_id"), F.col("week_no")
    placed = (
        (product.cast("bigint") * 5 + week) % 23 == 0
    ) & (product % 2 == 0) & F.col("sub_commodity_desc").isin("gear", "bolt", "widget", "rod")
    in_mailer = placed & ((store + product) % 4 != 0)
    on_display = (in_mailer & (store % 2 == 0)) | (
        (product.cast("bigint") * 3 + week + store) % 7 == 0
    )
    return (
        promo_products(spark, folder)
        .select("product_id", "sub_commodity_desc", stores.alias("stores"))
        .withColumn("store_id", F.explode("stores"))
        .withColumn("week_no", F.explode(F.sequence(F.lit(1), F.lit(LAST_FULL_WEEK))))
        .select(
            "product_id",
            "store_id",
            "week_no",
            F.when(on_display, "1").otherwise("0").alias("display"),
            F.when(in_mailer, "A").otherwise("0").alias("mailer"),
        )
    )


# --- dirty tables for cleaning and checks -----------------------------------------------------


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with second copies, zero and negative quantities, zero sales, lost households."""
    basket = F.col("basket_id")
    copies = F.sequence(F.lit(1), F.when(basket % 101 == 0, 2).otherwise(1))
    quantity = (
        F.when(basket % 97 == 0, 0)
        .when(basket % 83 == 0, -F.col("quantity"))
        .otherwise(F.col("quantity"))
    )
    return (
        transactions(spark, folder)
        .withColumn("copy", F.explode(copies))
        .drop("copy")
        .withColumns(
            {
                "household_key": F.when(basket % 1009 != 0, F.col("household_key")),
                "quantity": quantity,
                "sales_value": F.when(basket % 89 == 0, 0.0).otherwise(F.col("sales_value")),
            }
        )
    )


def raw_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products with gaps, padded text, and never-sold rows without any category."""
    key = F.col("product_id")
    known = (
        products(spark, folder)
        .where(key % 211 != 0)
        .withColumns(
            {
                "department": F.when(key % 53 == 0, "  ").otherwise(F.col("department")),
                "commodity_desc": F.when(
                    key % 7 == 0, F.concat(F.lit("  "), F.col("commodity_desc"), F.lit(" "))
                ).otherwise(F.col("commodity_desc")),
            }
        )
    )
    missing = F.lit(None).cast("string")
    never_sold = (
        products(spark, folder)
        .where(key % 400 == 0)
        .select(
            (key + 1_000_000_000).alias("product_id"),
            missing.alias("department"),
            missing.alias("commodity_desc"),
            missing.alias("sub_commodity_desc"),
        )
    )
    return known.unionByName(never_sold)
