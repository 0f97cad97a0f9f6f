"""Running a function over Arrow batches, and state that a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Columns = Callable[[pa.RecordBatch], dict[str, pa.Array]]


def process_state(name: str) -> dict:
    """A dictionary that a Python worker keeps between tasks, until one of another name is asked for.

    A worker outlives its stage: what an earlier operator remembered would stay beside a later one's.
    """
    holder = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if getattr(holder, "name", None) != name:
        holder.name, holder.state = name, {}
    return holder.state


def give_back() -> None:
    """Return memory that nothing holds any more to the machine; a worker would keep it through all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # other C libraries have none
        trim(0)


def arrow_schema(fields: list[T.StructField]) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])


def with_columns(df: DataFrame, compute: Columns, fields: list[T.StructField]) -> DataFrame:
    """Add columns that ``compute`` makes from each Arrow batch; a column of the same name is replaced."""
    new = {f.name.lower() for f in fields}
    kept = df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in new])
    old = kept.columns
    wanted = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch)
            arrays = [*batch.columns, *(made[f.name].cast(f.type) for f in wanted)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*old, *wanted.names])
            del batch, made, arrays
        give_back()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def rows_from(df: DataFrame, produce: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
              fields: list[T.StructField]) -> DataFrame:
    """Replace a table by the column dictionaries that ``produce`` yields for each partition."""
    wanted = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in produce(batches):
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in
                      ((made[f.name], f) for f in wanted)]
            yield pa.RecordBatch.from_arrays(arrays, schema=wanted)
            del made, arrays
        give_back()

    return df.mapInArrow(run, T.StructType(fields))


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if " " in kind or "<" in kind else _SIMPLE[kind])


_SIMPLE = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType()),
    "ints": T.ArrayType(T.IntegerType()), "strings": T.ArrayType(T.StringType()),
}


def fields(**kinds: str) -> list[T.StructField]:
    return [field(name, kind) for name, kind in kinds.items()]
