"""Extendible hashing: shards are hash prefixes, split on another bit only where they exceed a byte limit.

A key's 60 hash bits decide its shard; the directory of prefixes finds it. Rows that share
all bits, as repeats of one key do, go on by bits of their own row number, so that a key
with a third of all rows is split as well. Only sums per prefix are shuffled; the prefixes
in use number a small multiple of total bytes over the limit. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomarket.llm.tables import written

BITS = 60
LIMIT = 16 << 20
# Bits by which prefixes that are still too large grow in the next round.
STRIDE = 8
_NODE = ["depth", "high", "low"]


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's digest; null is a key like any other."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | str, high: str = "hash", low: str = "salt") -> list[Column]:
    """The node at a depth: bits of the key, then bits of the row."""
    depth = f"({depth})"
    return [
        F.expr(f"cast({depth} as int)").alias("depth"),
        F.expr(f"shiftright({high}, greatest(0, {BITS} - {depth}))").alias("high"),
        F.expr(f"case when {depth} > {BITS} then shiftright({low}, {2 * BITS} - {depth}) else 0L end").alias("low"),
    ]


def _leaves(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a node that is small enough, and these nodes with their sums."""
    total, count = rows.agg(F.sum("n_bytes"), F.count("*")).first()
    depth = max(0, math.ceil(math.log2(max(1, (total or 0) / limit))) + 3) if count else 0
    placed, nodes = [], []
    left = rows
    while True:
        here = left.select(*rows.columns, *_prefix(str(min(depth, 2 * BITS))))
        sums = written(here.groupBy(_NODE).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")), "nodes")
        large = sums.where((F.col("bytes") > limit) & (F.col("rows") > 1)) if depth < 2 * BITS else sums.limit(0)
        nodes.append(sums.join(large, _NODE, "left_anti"))
        placed.append(here.join(large.select(_NODE), _NODE, "left_anti"))
        if large.isEmpty():
            break
        left = written(here.join(large.select(_NODE), _NODE, "left_semi").select(rows.columns), "oversized")
        depth += STRIDE
    all_rows, all_nodes = placed[0], nodes[0]
    for more_rows, more_nodes in zip(placed[1:], nodes[1:], strict=True):
        all_rows, all_nodes = all_rows.unionByName(more_rows), all_nodes.unionByName(more_nodes)
    return all_rows, all_nodes


def directory(nodes: DataFrame, limit: int) -> DataFrame:
    """For each small node the shard that holds it: the shortest prefix that fits the limit."""
    leaf = [F.col(c).alias(f"leaf_{c}") for c in _NODE]
    up = nodes.select(*leaf, "bytes", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d"))
    # A node's prefix at depth d: its own bits, shortened.
    up = up.select(
        "leaf_depth", "leaf_high", "leaf_low", "bytes", F.col("d").alias("depth"),
        F.expr(f"shiftright(leaf_high, least(leaf_depth, {BITS}) - least(d, {BITS}))").alias("high"),
        F.expr(f"case when d > {BITS} then shiftright(leaf_low, leaf_depth - d) else 0L end").alias("low"))
    up = written(up, "prefixes")
    fits = up.groupBy(_NODE).agg(F.sum("bytes").alias("shard_bytes")).where(
        F.col("shard_bytes") <= limit)
    # The only way not to fit is one row above the limit: it is a shard at its own depth.
    best = up.join(fits, _NODE).groupBy("leaf_depth", "leaf_high", "leaf_low").agg(
        F.min(F.struct("depth", "high", "low")).alias("shard"))
    shard = F.coalesce("shard", F.struct("depth", "high", "low"))
    return nodes.select(_NODE).join(
        best.select(F.col("leaf_depth").alias("depth"), F.col("leaf_high").alias("high"),
                    F.col("leaf_low").alias("low"), "shard"), _NODE, "left").select(*_NODE, shard.alias("shard"))


def shard_name(shard: str = "shard") -> Column:
    """The prefix as a string of bits; the only shard of a small table has none."""
    return F.expr(f"""
        case when {shard}.depth = 0 then ''
          when {shard}.depth <= {BITS} then lpad(bin({shard}.high), {shard}.depth, '0')
          else concat(lpad(bin({shard}.high), {BITS}, '0'), lpad(bin({shard}.low), {shard}.depth - {BITS}, '0')) end""")


def _placed(docs: DataFrame, limit: int, key: str, text: str, carried: list[Column]) -> DataFrame:
    """Per row: key, n_bytes, its shard's node and the carried columns."""
    rows = written(docs.select(
        F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        hash_bits(F.col(key)).alias("hash"),
        # Frozen by writing: the row number may differ when computed again.
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS).alias("salt"), *carried), "sizes")
    placed, nodes = _leaves(rows, limit)
    nodes = written(nodes.select(*_NODE, "bytes"), "leaves")
    return placed.join(written(directory(nodes, limit), "directory"), _NODE)


def shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_bytes, shard, shard_depth and oversized.

    A null text has 0 bytes and a null key is a key of its own; repeated rows are placed
    each. ``oversized`` marks a single row above the limit, which no split can mend. An
    empty table gives no rows. Other columns are ignored.
    """
    return _placed(docs, limit, key, text, []).select(
        F.col("key").alias(key), "n_bytes", shard_name().alias("shard"),
        F.col("shard.depth").cast("int").alias("shard_depth"), (F.col("n_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write the rows to one folder for each shard; all rows of a key below the limit are in one shard.

    Each row goes where its own bits put it, so a key above the limit is spread over many
    shards. A shard that is large all the same, by its other columns or by rows without
    text, is written by several tasks.
    """
    found = _placed(docs, limit, key, text, [F.struct("*").alias("document")])
    named = found.select(
        *[F.col("document").getField(c).alias(c) for c in docs.columns], shard_name().alias("shard"))
    named.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
