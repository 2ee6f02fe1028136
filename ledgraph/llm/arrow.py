"""Row generators as mapInArrow functions."""

from __future__ import annotations

import pyarrow as pa

KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def values(column: pa.Array) -> list:
    """The values of a column; lists of numbers without a scalar object for each number."""
    if pa.types.is_list(column.type) and not column.null_count and pa.types.is_integer(column.type.value_type):
        flat = column.flatten()
        if not flat.null_count:
            ends, nums = column.offsets.to_pylist(), flat.to_numpy().tolist()
            return [nums[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]
    return column.to_pylist()


def rows(schema: str, make):
    """(function, schema) for mapInArrow: `make` gets the columns of a batch as lists and gives rows."""
    out = pa.schema([(n, KINDS[k]) for n, k in (f.split() for f in schema.split(", "))])

    def run(batches):
        for b in batches:
            got = list(make(*map(values, b.columns)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), out)], schema=out)

    return run, schema
