"""CSV tables in and out, and Parquet copies laid out for range and map filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geomarket.operators import cells, clean


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header; a declared schema saves the extra pass that inference takes."""
    reader = spark.read.option("header", True).option("enforceSchema", schema is None)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def load_data(
    spark: SparkSession,
    path: str,
    *,
    schema: StructType | None = None,
    cell_from: tuple[str, str] | None = None,
    wrangle_sales: bool = False,
    add_month: bool = False,
) -> DataFrame:
    """Read a CSV table and prepare it; ``cell_from`` names the latitude and longitude columns.

    Unlike a bare column list, wrangling keeps a cell column that was asked for.
    """
    df = read_csv(spark, path, schema)
    if cell_from:
        df = cells.with_cell(df, *cell_from)
    if wrangle_sales:
        columns = list(clean.schema.SALES_REPORT_COLUMNS)
        df = clean.prepare_sales(df, columns + (["cell"] if cell_from else []))
    if add_month:
        df = clean.with_year_month(df.drop("year_month"))
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column."""
    df.write.option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, cluster_by: Sequence[str] = ()) -> None:
    """Parquet, optionally clustered, so that filters on those columns skip files and row groups.

    The source partition breaks ties between ranges: rows that share their
    cluster columns, however many, still spread over several tasks.
    """
    if cluster_by:
        spread = df.withColumn("_from", F.spark_partition_id())
        df = spread.repartitionByRange(*cluster_by, "_from").drop("_from").sortWithinPartitions(*cluster_by)
    df.write.parquet(path)
