"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that a join may broadcast, in units of some 50 bytes: about 10 MB.
BROADCAST_UNITS = 200_000


def local_session(app: str = "geomarket", cpus: int | str = "*", memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Executors on other machines must see what is written there, so a
    machine-local folder is used only when Spark itself runs in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="geomarket-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a reduced table once to the shared folder and read it back.

    For results that several later steps read: it cuts the lineage, survives the
    loss of executors, and lets the engine pick joins by the table's real size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_side(df: DataFrame, label: str, units: Column) -> DataFrame:
    """The smaller side of a join, broadcast only if its measured size allows.

    For tables that a cover or neighbour copies have multiplied: neither the
    size of the source nor compressed files tell how much they hold. Above the
    limit the join is a merge join, where both sides are shuffled and spill, and
    the adaptive skew join splits a crowded key.
    """
    stored = written(df, label)
    held = stored.agg(F.sum(units)).first()[0] or 0
    return F.broadcast(stored) if held <= BROADCAST_UNITS else stored.hint("merge")
