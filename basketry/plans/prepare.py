"""Raw CSV files to clean Parquet tables, their row counts, and the product-week table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketry.operators import clean, quality
from basketry.operators.promo import promo_product_week
from basketry.params import PlacementCodes, QualityParams
from basketry.sources.schemas import PARTITION_COLUMN, RAW_SCHEMAS
from basketry.sources.tables import read_raw, write_table

COUNTS = (
    "rows_raw bigint, duplicates_removed bigint, zero_quantity_removed bigint, "
    "non_positive_sales_removed bigint, null_value_removed bigint, rows_clean bigint"
)


def read_stats(spark: SparkSession, processed_dir: str) -> DataFrame:
    """The row counts as ``prepare`` stored them."""
    shares = "removed_share_of_distinct double, removed_share_of_raw double"
    schema = f"table_name string, {COUNTS}, {shares}"
    return spark.read.schema(schema).json(f"{processed_dir}/prepare_stats")


def read_measures(
    spark: SparkSession, processed_dir: str, params: QualityParams = QualityParams()
) -> dict[str, DataFrame]:
    """One row of ``quality.measures`` by table, as the writing job observed them."""
    stored = spark.read.schema("table_name string, measure string, value bigint").json(
        f"{processed_dir}/measures"
    )
    found = {(r["table_name"], r["measure"]): r["value"] for r in stored.collect()}
    out = {}
    for table in {name for name, _ in found}:
        names = [f"null_{column}" for column in params.key_columns.get(table, ())]
        names += ["low", "high"] if table in quality.WEEKLY else []
        if all((table, name) in found for name in names):
            schema = ", ".join(f"{name} bigint" for name in names)
            out[table] = spark.createDataFrame([tuple(found[table, n] for n in names)], schema)
    return out


def write_clean(
    raw: DataFrame, table: str, processed_dir: str, params: QualityParams | None = None
) -> dict[str, int | None]:
    """Deduplicate, drop invalid lines, write, and count, with one evaluation of ``raw``.

    With ``params``, what the quality checks measure of the written rows is counted, too.

    The counts are observed in the stage that writes the files, behind the last shuffle: only
    there does each row count once even if tasks are repeated after a lost executor.
    """
    kept = clean.with_reason(clean.distinct_rows(raw), table)
    partition_by = PARTITION_COLUMN[table]
    spread = kept if partition_by is None else kept.hint("rebalance", partition_by)
    counts = Observation(f"counts_{table}")
    measures = quality.measures(table, params, F.col("reason").isNull()) if params else []
    observed = spread.observe(
        counts, *clean.count_columns(table == "transaction_data"), *measures
    )
    writer = observed.where("reason IS NULL").drop("copies", "reason").write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{processed_dir}/{table}")
    return counts.get


def prepare(
    spark: SparkSession,
    raw_dir: str,
    processed_dir: str,
    codes: PlacementCodes,
    params: QualityParams = QualityParams(),
) -> DataFrame:
    """Clean every raw table, build the product-week table, return and store the counts.

    What the checks need to know of the written rows is observed on the way and stored, too.
    """
    frames, observed = [], []
    for table in RAW_SCHEMAS:
        counts = write_clean(read_raw(spark, raw_dir, table), table, processed_dir, params)
        own = [name for name in counts if name.startswith("null_") or name in ("low", "high")]
        observed += [(table, name, counts[name]) for name in own if name != "null_value_removed"]
        schema = f"table_name string, {COUNTS}"
        row = (table, *(counts[name.split()[0]] for name in COUNTS.split(", ")))
        frames.append(spark.createDataFrame([row], schema))
    stats = clean.add_removed_shares(reduce(DataFrame.unionByName, frames))
    stats.write.mode("overwrite").json(f"{processed_dir}/prepare_stats")
    rows = spark.createDataFrame(observed, "table_name string, measure string, value bigint")
    # A missing value is no field of JSON unless nulls are kept.
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{processed_dir}/measures")

    causal, transactions, products = (
        spark.read.parquet(f"{processed_dir}/{table}")
        for table in ("causal_data", "transaction_data", "product")
    )
    write_table(
        promo_product_week(causal, transactions, products, codes),
        f"{processed_dir}/promo_product_week",
    )
    return stats
