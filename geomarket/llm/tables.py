"""Tables written once to the shared folder, and bit sets of a fixed size."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomarket.session import scratch_path

BLOOM_BITS = 1 << 23
# The setting of Spark that deletes the shuffle files of a job when it ends.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The setting for the bytes after which an Arrow batch ends; only the number of rows bounds it otherwise.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, label: str, by: list[str] | None = None, arrow_bytes: int | None = None) -> DataFrame:
    """The same rows, read back from the shared folder: cuts the lineage and survives lost executors.

    With ``arrow_bytes`` Python workers get batches of about so many bytes, or one longer row, while they are made.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(*by) if by else df.write
    # What was shuffled goes with the job that wrote the table, not when the driver next collects garbage.
    conf, meanwhile = df.sparkSession.conf, {SHUFFLES_END: "true"}
    if arrow_bytes:
        meanwhile[ARROW_BYTES] = str(arrow_bytes)
    before = {name: conf.get(name, None) for name in meanwhile}
    try:
        for name, value in meanwhile.items():
            conf.set(name, value)
        writer.parquet(path)
    finally:
        for name, value in before.items():
            conf.set(name, value) if value is not None else conf.unset(name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made (not those written ``by`` a column), once nothing reads them any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for file in table.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if not re.fullmatch(r".+-[0-9a-f]{32}", folder.getName()):
                raise ValueError(f"{folder} is no scratch table")
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def collected_bits(df: DataFrame, key: Column) -> np.ndarray:
    """Bits at ``key`` modulo ``BLOOM_BITS`` as longs: 1 MB, whatever the number of rows.

    A clear bit proves that a key is absent. When the set is full, filtering by it
    only stops saving work; what it lets through is joined exactly afterwards.
    """
    at = F.pmod(key, F.lit(BLOOM_BITS))
    words = (
        df.select((at / 64).cast("int").alias("word"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("bit"))
        .select("word", F.expr("shiftleft(one, bit)").alias("mask"))
        .groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    )
    bits = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    rows = words.toArrow()
    bits[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return bits


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key, an unsigned 64-bit hash, may be in the set; the low bits are those ``collected_bits`` uses."""
    at = keys & np.uint64(BLOOM_BITS - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def maybe_rows(df: DataFrame, key: Column, bits: np.ndarray) -> DataFrame:
    """The rows whose key may be in the set; the set is broadcast, 2 MB at most."""
    words = np.flatnonzero(bits)
    table = df.sparkSession.createDataFrame(
        list(zip(words.tolist(), bits[words].view(np.int64).tolist(), strict=True)), "bloom_word int, bloom_mask long")
    at = F.pmod(key, F.lit(BLOOM_BITS))
    found = df.withColumns({"bloom_word": (at / 64).cast("int"), "bloom_bit": (at % 64).cast("int")})
    return found.join(F.broadcast(table), "bloom_word").where(
        F.expr("shiftrightunsigned(bloom_mask, bloom_bit) & 1L") == 1).drop("bloom_word", "bloom_bit", "bloom_mask")
