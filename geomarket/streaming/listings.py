"""Listings kept current from landed JSON pages.

A micro-batch writes only its own records, one per listing, to a folder named
after the batch; the table as it stands is the first record per listing over all
of them. Every so many batches the folders are folded into one, so a reader
meets one compacted folder and a few recent ones. Rewriting hash buckets instead
would rewrite nearly the whole table with every batch, because the listings of a
batch are spread over all buckets.

A batch that is retried overwrites its own folder with the same records.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from geomarket import schema
from geomarket.operators.clean import first_per_key
from geomarket.sources.pages import normalize_pages

ORDER = ["page", "pos"]


def _stored(spark: SparkSession, path: str, layout: StructType) -> DataFrame:
    """A folder of Parquet partitions, empty while nothing is there."""
    try:
        return spark.read.schema(layout).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], layout)


def _folded_upto(spark: SparkSession, table: str) -> int:
    """Last batch inside the newest finished compaction, or -1."""
    done = _stored(spark, f"{table}/folds", StructType([StructField("upto", LongType())]))
    return done.agg(F.max("upto")).first()[0] if not done.isEmpty() else -1


def _records(spark: SparkSession, table: str, layout: StructType, upto: int | None = None) -> DataFrame:
    """The compacted records and those of later batches; both reads prune whole folders."""
    folded = _folded_upto(spark, table)
    recent = _stored(spark, f"{table}/batches", StructType([*layout.fields, StructField("batch", LongType())]))
    recent = recent.where(F.col("batch") > folded)
    if upto is not None:
        recent = recent.where(F.col("batch") <= upto)
    if folded < 0:
        return recent.drop("batch")
    return recent.drop("batch").unionByName(spark.read.schema(layout).parquet(f"{table}/folded/upto={folded}"))


def current_listings(spark: SparkSession, table: str, layout: StructType) -> DataFrame:
    """One row per listing id: the first record in page order."""
    return first_per_key(_records(spark, table, layout), ["zpid"], ORDER)


def compact(spark: SparkSession, table: str, layout: StructType, upto: int) -> None:
    """Fold all batches up to one into a single folder, then mark it as finished."""
    if _folded_upto(spark, table) >= upto:
        return
    folded = first_per_key(_records(spark, table, layout, upto), ["zpid"], ORDER)
    folded.write.mode("overwrite").parquet(f"{table}/folded/upto={upto}")
    marker = spark.range(1).select(F.lit(upto).cast("bigint").alias("upto"))
    marker.write.mode("overwrite").parquet(f"{table}/folds/mark={upto}")


def store_batch(batch: DataFrame, batch_id: int, table: str, compact_every: int = 50) -> None:
    """Write a micro-batch of normalised records; compact from time to time."""
    layout = batch.schema
    first_per_key(batch, ["zpid"], ORDER).write.mode("overwrite").parquet(f"{table}/batches/batch={batch_id}")
    if (batch_id + 1) % compact_every == 0:
        compact(batch.sparkSession, table, layout, batch_id)


def ingest_listings(spark: SparkSession, pages: str, table: str, checkpoint: str, *,
                    files_per_batch: int | None = None, compact_every: int = 50):
    """Start the job on a folder of landed pages; it ends when all present files are in."""
    reader = spark.readStream.schema(schema.PAGES_PAYLOAD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        normalize_pages(reader.json(pages))
        .writeStream.foreachBatch(lambda batch, batch_id: store_batch(batch, batch_id, table, compact_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
