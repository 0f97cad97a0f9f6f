"""Prefix tree of conversations by whole-sequence collapse: what many conversations share is one weighted sequence.

Turns become 122-bit keys; a prefix's key is the sum of its turns' keys, each mixed with its
place, so keys of all prefixes are running sums. Conversations with the same whole sequence
collapse into one with a weight and a list of ends. Sequences that are proper prefixes of
others are found by anti-join; the rest are leaves. Only the distinct sequences are then spread
into their prefixes, and the weights of equal prefixes added up: these are the nodes.

A sum over a node's subtree needs no walk. Its nodes' bytes times members are each sequence's
weight times the bytes from the node on. Each node's bytes once are found by giving every node
to the sequence of its smallest member: along a sequence, that member only grows, so a sequence
owns its nodes from some depth on.

Running sums and turn numbers come from rows sorted by range, with one offset for each
partition that a conversation goes on into, so that a conversation with a third of all turns is
shared by many tasks. Weights, minima and counts are combined before they are shuffled.
Two of n different prefixes are taken for one with a chance of about n * n / 2 ** 123.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomarket.llm.tables import written
from geomarket.llm.tasks import arrow_schema, fields, rows_from

# Conversations of a family share the beginning of its first one.
FAMILY, SHARED = 5, 9
# Ids that are joined to one string before the list of a node is put together.
CHUNK = 8192
# Sums are kept below this, so that two of them can be added as longs.
MODULUS = 1 << 61
_NODE = ["depth", "key1", "key2"]


def running(df: DataFrame, group: str, order: list[str], sums: list[str]) -> DataFrame:
    """Add ``place``, from 1, and running sums (modulo 2^61, replacing the columns) within each group, in order.

    Rows are dealt by ranges of group and order, so a large group is shared by many tasks; a
    task knows only its own rows, and adds what earlier tasks counted of a group from a table
    with one row a task.
    """
    names = [group, *[c for c in df.columns if c != group]]
    dealt = df.select(names).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    made = [T.StructField("place", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType())]
    wanted = arrow_schema(made)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before: tuple | None = None  # group, place and sums of the last row so far
        held: list | None = None  # arrays of the last batch, not yet given on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield pa.RecordBatch.from_arrays(held, names=[*names, *wanted.names])
            ids = batch[group].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            at = np.repeat(starts, np.diff(np.append(starts, len(ids))))
            goes_on = before is not None and before[0] == ids[0]
            here = at == 0
            place = np.arange(len(ids)) - at + 1 + (here * before[1] if goes_on else 0)
            arrays = dict(zip(names, batch.columns, strict=True))
            ends = []
            for c in sums:
                value = arrays[c].to_numpy(zero_copy_only=False).view(np.uint64)
                total = np.cumsum(value)
                total = total - (total[at] - value[at])
                if goes_on:
                    total = np.where(here, total + before[2][len(ends)], total)
                total &= np.uint64(MODULUS - 1)
                ends.append(total[-1])
                arrays[c] = pa.array(total.view(np.int64))
            before = ids[-1], int(place[-1]), ends
            held = [*arrays.values(), pa.array(place), pa.array(np.full(len(ids), part, dtype=np.int32)),
                    pa.array(np.zeros(len(ids), dtype=bool))]
        if held:
            flags = np.zeros(len(held[-1]), dtype=bool)
            flags[-1] = True
            held[-1] = pa.array(flags)
            yield pa.RecordBatch.from_arrays(held, names=[*names, *wanted.names])

    counted = written(dealt.mapInArrow(number, T.StructType([*dealt.schema.fields, *made])), "running")
    return _with_offsets(counted, group, sums)


def _with_offsets(counted: DataFrame, group: str, sums: list[str]) -> DataFrame:
    """Add to each row what earlier tasks counted of its group: one row for each task, by the driver."""
    # Only the last group of a task can go on in the next one that has rows.
    ends = sorted(map(tuple, counted.where("last").select("part", group, "place", *sums).collect()))
    rows: list[tuple] = []
    for (part, key, *counts), (following, *_) in zip(ends, ends[1:], strict=False):
        if rows and rows[-1][:2] == (part, key):
            counts = [a + b for a, b in zip(rows[-1][2:], counts, strict=True)]
        rows.append((following, key, counts[0], *(c % MODULUS for c in counts[1:])))
    earlier = counted.sparkSession.createDataFrame(
        rows, ", ".join(["part int", f"{group} long", "_place long", *(f"_{c} long" for c in sums)]))
    found = counted.drop("last").join(F.broadcast(earlier), ["part", group], "left")

    def both(c: str) -> Column:
        return F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))

    return found.withColumns({"place": both("place"), **{c: both(c).bitwiseAND(MODULUS - 1) for c in sums}}).drop(
        "part", "_place", *(f"_{c}" for c in sums))


def _key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(MODULUS - 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of all rebuilt conversations, one row for each turn, and all conversations with their length.

    A prefix has ``depth``, its keys, ``up_to``, the bytes of its texts, and of its last turn
    ``bytes`` and what it added to the keys (``own1``, ``own2``).
    """
    slim = written(turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).select("conv_id", "turn", F.xxhash64(F.lit(1), "role", "text").alias("turn1"),
             F.xxhash64(F.lit(2), "text", "role").alias("turn2"), F.octet_length("text").cast("long").alias("bytes"),
             # Equal turns may be dealt to different tasks.
             F.monotonically_increasing_id().alias("row")), "turns")
    placed = written(running(slim, "conv_id", ["turn", "turn1", "turn2", "row"], []).drop("turn", "row"), "places")
    sizes = placed.groupBy("conv_id").agg(F.max("place").alias("own")).withColumns({
        "base": F.expr(f"conv_id - conv_id % {FAMILY}"),
        "skipped": F.expr(f"crc32(cast(cast(conv_id as string) as binary)) % {SHARED}")})
    sizes = written(sizes, "sizes")
    families = written(sizes.join(
        sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left",
    ).withColumn("shared", F.expr("least(skipped, coalesce(base_own, 0L))")).select(
        "conv_id", "base", "skipped", "shared", F.expr("shared + greatest(own - skipped, 0L)").alias("length")), "families")
    own = placed.join(families, "conv_id").where("place > skipped").withColumn(
        "depth", F.expr("shared + place - skipped"))
    # At most eight turns of the first conversation for each one of its family.
    begun = placed.where(F.col("place") < SHARED).withColumnRenamed("conv_id", "base").join(families, "base").where(
        "place <= shared").withColumn("depth", F.col("place"))
    columns = ["conv_id", "length", "depth", "turn1", "turn2", "bytes"]
    keyed = own.select(columns).unionByName(begun.select(columns)).select(
        "conv_id", "length", "depth", "bytes", F.col("bytes").alias("up_to"),
        _key(3, "depth", "turn1", "turn2").alias("own1"), _key(4, "depth", "turn2", "turn1").alias("own2"))
    prefixes = running(written(keyed.withColumns({"key1": F.col("own1"), "key2": F.col("own2")}), "rebuilt"),
                       "conv_id", ["depth"], ["key1", "key2", "up_to"]).drop("place")
    return written(prefixes, "prefixes"), families


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Strings of up to ``CHUNK`` ids from rows sorted by node and id; a run goes on over batches."""
    node, ids, made = None, [], []

    def out() -> dict:
        return dict(zip([*_NODE, "first", "ids"], map(list, zip(*made, strict=True)), strict=True))

    for batch in batches:
        columns = [batch[c].to_pylist() for c in [*_NODE, "conv_id"]]
        for *here, conv_id in zip(*columns, strict=True):
            if here != node or len(ids) == CHUNK:
                if ids:
                    made.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = here, []
            ids.append(conv_id)
        if len(made) >= 1024:
            yield out()
            made = []
    if ids:
        made.append((*node, ids[0], ",".join(map(str, ids))))
    if made:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """SHA-256 of each node's list from its pieces in order; only one piece is held."""
    node, state, made = None, None, []

    def out() -> dict:
        return dict(zip([*_NODE, "ends_sha256"], map(list, zip(*made, strict=True)), strict=True))

    for batch in batches:
        for *here, ids in zip(*(batch[c].to_pylist() for c in [*_NODE, "ids"]), strict=True):
            if here == node:
                state.update(b",")
            else:
                if node is not None:
                    made.append((*node, state.hexdigest()))
                node, state = here, hashlib.sha256()
            state.update(ids.encode())
        if len(made) >= 4096:
            yield out()
            made = []
    if node is not None:
        made.append((*node, state.hexdigest()))
    if made:
        yield out()


def end_lists(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of its conv_ids, ascending and joined by commas.

    The ids are sorted and joined by many tasks; the digest alone runs through a list in one
    go, by strings of thousands of ids.
    """
    node = dict.fromkeys(_NODE, "long")
    pieces = rows_from(ends.select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(
        *_NODE, "conv_id"), _joined_ids, fields(**node, first="long", ids="string"))
    return rows_from(pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first"), _hashed,
                     fields(**node, ends_sha256="string"))


def trie(turns: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty. Turns are ordered by their number, null first, equal ones
    by a hash of role and text; repeated rows are turns each. Rows without a conv_id belong to
    no conversation and are left out. Without conversations there are no nodes, not even the
    root. Texts of any length count by hash and bytes. Other columns are ignored.
    """
    prefixes, families = rebuilt(turns)
    root = [F.lit(0).cast("long").alias(c) for c in _NODE]
    zero = F.lit(0).cast("long")
    ends = written(prefixes.where("depth = length").select("conv_id", *_NODE, "up_to").unionByName(
        families.where("length = 0").select("conv_id", *root, zero.alias("up_to"))), "ends")
    sequences = written(ends.groupBy(_NODE).agg(
        F.min("conv_id").alias("sequence"), F.count("*").alias("weight"), F.max("up_to").alias("total")), "sequences")
    kept = sequences.select("sequence", "weight", "total", F.col("depth").alias("length"))
    spread = prefixes.drop("length").join(kept, prefixes["conv_id"] == kept["sequence"]).drop("conv_id")
    # The textless root begins every sequence.
    spread = written(spread.unionByName(kept.select("*", *root, *(zero.alias(c) for c in ["bytes", "up_to", "own1", "own2"])))
                     .withColumn("before", F.expr("up_to - bytes")), "spread")
    leaves = sequences.join(spread.where("depth < length").select(_NODE).distinct(), _NODE, "left_anti").select(
        "sequence", F.lit(1).alias("leaf"))
    smallest = spread.groupBy(_NODE).agg(F.min("sequence").alias("sequence"), F.max("before").alias("before"))
    owned = smallest.groupBy("sequence").agg(F.min(F.struct("depth", "before")).alias("since"))
    marks = written(sequences.select("sequence").join(leaves, "sequence", "left").join(owned, "sequence", "left"), "marks")
    nodes = written(spread.join(marks, "sequence").groupBy(_NODE).agg(
        F.min("sequence").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.expr("weight * (total - before)")).alias("by_members"),
        F.sum(F.expr("if(since is null, 0L, total - greatest(before, since.before))")).alias("once"),
        # What the last turn added: taken off again, it leaves the parent's key.
        F.max("own1").alias("own1"), F.max("own2").alias("own2"),
    ).withColumns({"up1": F.expr(f"(key1 - own1 + {MODULUS}L) & {MODULUS - 1}L"),
                   "up2": F.expr(f"(key2 - own2 + {MODULUS}L) & {MODULUS - 1}L")}), "nodes")
    children = nodes.where("depth > 0").groupBy(F.expr("depth - 1").alias("depth"), F.col("up1").alias("key1"),
                                                 F.col("up2").alias("key2")).agg(F.count("*").alias("n_children"))
    parents = nodes.where("depth > 0").select(F.expr("depth + 1").alias("depth"), F.col("key1").alias("up1"),
                                              F.col("key2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    # Half of all nodes may be children of the root, which needs no join.
    top = nodes.where("depth = 0").select("conv_id").first()
    found = nodes.join(parents, ["depth", "up1", "up2"], "left").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(top[0] if top else None).cast("long")).otherwise(F.col("parent_conv_id")))
    return found.join(children, _NODE, "left").join(end_lists(ends), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves", F.expr("by_members - once").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
