"""Rows that are carried whole beside what is computed from them, so that no column's name can clash."""

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows of a slice.
SLICE = 1024


def row_and(docs: DataFrame, more: str) -> T.StructType:
    """The schema of a struct `row` with the columns of docs, followed by the fields of a DDL string."""
    return T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL(more).fields])


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it new to docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that what is made of a batch doesn't stand in memory at once. After each batch, freed memory goes back to the system: Python workers live on from
    task to task, beside others."""
    for batch in batches:
        for lo in range(0, max(batch.num_rows, 1), SLICE):
            yield batch.slice(lo, SLICE)
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
