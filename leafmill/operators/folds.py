"""Folds over the rows of a group, in order, without materialising more than one group per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def in_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Apply a fold to the rows of each group in order, streaming through sorted Arrow partitions; one group is held at a time."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flow() -> Iterator[dict]:
            for b in batches:
                yield from b.to_pylist()

        out: list[tuple] = []
        for _, rows in groupby(flow(), key=lambda r: tuple(r[k] for k in keys)):
            out += work(list(rows))
            if len(out) >= 2000:
                yield _batch(out, names, kinds)
                out = []
        yield _batch(out, names, kinds)

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], names=names)
