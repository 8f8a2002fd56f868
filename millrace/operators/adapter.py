"""The record-function surface: plain Python functions as operators, Arrow batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Operator(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


def from_record_fn(fn: Callable[[dict], dict | None], schema: str | None = None) -> Operator:
    """An operator of a function on one record; None leaves the record out. ``schema`` is the result's, else the input's."""

    def operator(df: DataFrame) -> DataFrame:
        kind = schema or df.schema
        names = df.columns if schema is None else df.sparkSession.createDataFrame([], schema).columns
        types = df.sparkSession.createDataFrame([], kind).toArrow().schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [out for row in batch.to_pylist() if (out := fn(row)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in kept], types.field(n).type) for n in names], schema=types)

        return df.mapInArrow(run, kind)

    return operator


def chain(*operators: Operator) -> Operator:
    def run(df: DataFrame) -> DataFrame:
        for op in operators:
            df = op(df)
        return df

    return run
