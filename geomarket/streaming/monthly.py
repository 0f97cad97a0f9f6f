"""Monthly sales counts and medians kept current as sales land."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomarket.operators import clean
from geomarket.operators.quantiles import Total, exact_quantiles

SECONDS_PER_DAY = 86_400


def daily_counts(sales: DataFrame, lateness: str) -> DataFrame:
    """Sales per day; calendar months are not a window length, so months are added up later.

    Rows older than the watermark are dropped; the query's progress counts them
    under ``numRowsDroppedByWatermark``.
    """
    # Days start at midnight UTC, as windows do, whatever the session's time zone.
    midnight = F.timestamp_seconds(F.unix_date("sale_date").cast("bigint") * SECONDS_PER_DAY)
    day = F.date_from_unix_date((F.unix_seconds("window.start") / SECONDS_PER_DAY).cast("int"))
    return (
        sales.select(midnight.alias("sold_at"), "sqft")
        .withWatermark("sold_at", lateness)
        .groupBy(F.window("sold_at", "1 day"))
        .agg(F.count("*").alias("sales"), F.count("sqft").alias("observations"))
        .select(day.alias("day"), "sales", "observations")
    )


def start_daily_counts(sales: DataFrame, table: str, checkpoint: str, *, lateness: str):
    """Append each batch's updated days under a folder named after the batch."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        daily_counts(sales, lateness).writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def daily_totals(spark: SparkSession, table: str) -> DataFrame:
    """Months added up from each day's latest state."""
    layout = "day date, sales bigint, observations bigint, batch bigint"
    latest = (
        spark.read.schema(layout).parquet(table).groupBy("day")
        .agg(F.max_by("sales", "batch").alias("sales"), F.max_by("observations", "batch").alias("observations"))
    )
    days = clean.with_year_month(latest, "day").select("year_month", "sales", "observations")
    return days.groupBy("year_month").agg(F.sum("sales").alias("sales"), F.sum("observations").alias("observations"))


def value_counts(sales: DataFrame) -> DataFrame:
    """How often each price per area occurs in each month: counts that can be added up, and medians read from.

    Sales without a date or price are values like any other.
    """
    priced = clean.with_year_month(clean.with_price_per_sqft(sales))
    return priced.groupBy("year_month", "price_per_sqft").agg(
        F.count("*").alias("sales"), F.count("sqft").alias("observations"))


def start_value_counts(sales: DataFrame, table: str, checkpoint: str, *, fold_every: int = 16):
    """Add each batch's counts to the table; every batch reads its own sales once, and no history.

    Late sales count like others. A retried batch overwrites its own folder. Every
    ``fold_every`` batches the counts so far are added up into one folder, so that a reader opens
    one fold and at most that many batches.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        value_counts(batch).write.mode("overwrite").parquet(f"{table}/batches/batch={batch_id}")
        if (batch_id + 1) % fold_every == 0:
            _added_up(_parts(batch.sparkSession, table, batch_id)).write.mode("overwrite").parquet(f"{table}/folds/upto={batch_id}")

    return (
        sales.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


_COUNTS = "year_month int, price_per_sqft double, sales bigint, observations bigint"


def _added_up(parts: DataFrame) -> DataFrame:
    return parts.groupBy("year_month", "price_per_sqft").agg(
        F.sum("sales").alias("sales"), F.sum("observations").alias("observations"))


def _parts(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """The latest fold before ``upto`` and the batches after it."""
    batches = spark.read.schema(f"{_COUNTS}, batch bigint").parquet(f"{table}/batches")
    try:
        folds = spark.read.schema(f"{_COUNTS}, upto bigint").parquet(f"{table}/folds")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return (batches if upto is None else batches.where(F.col("batch") <= upto)).drop("batch")
    known = folds if upto is None else folds.where(F.col("upto") < upto)
    last = known.agg(F.max("upto")).first()[0]
    last = -1 if last is None else last
    after = batches.where(F.col("batch") > last)
    after = after if upto is None else after.where(F.col("batch") <= upto)
    return folds.where(F.col("upto") == last).drop("upto").unionByName(after.drop("batch"))


def monthly_counts(spark: SparkSession, table: str) -> DataFrame:
    """Sales and observations per month; the month null has the sales without a date."""
    return _parts(spark, table).groupBy("year_month").agg(
        F.sum("sales").alias("sales"), F.sum("observations").alias("observations"))


def monthly_medians(spark: SparkSession, table: str) -> DataFrame:
    """Exact median per month, read from the counts of its values."""
    return exact_quantiles(
        _added_up(_parts(spark, table)), "price_per_sqft", {"median_price_per_sqft": 0.5}, by=["year_month"], weight="sales",
        extra=[Total("observations", "sum", "observations")], bounded_groups=True)
