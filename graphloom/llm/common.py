"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.sources.store import written  # noqa: F401


_tables: dict = {}


def table(key, make):
    """A worker process's table under ``key``, made once. A worker serves one operator after another, so a new operator's table takes
    the place of those that others left behind."""
    if key not in _tables:
        if any(k[0] != key[0] for k in _tables):
            forget()
        _tables[key] = make()
    return _tables[key]


def release() -> None:
    """Gives memory that a worker process no longer uses back to the machine, as its workers share an executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Drops the tables that other operators have left in a worker process."""
    _tables.clear()
    release()


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names, null texts as empty ones; other columns never travel."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


#: Rows and bytes of a slice of an Arrow batch that becomes Python objects at one time; a single row may be larger.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def slices(batch: pa.RecordBatch):
    """An Arrow batch in slices of bounded rows and bytes."""
    step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def rows(batches, *names):
    """Row blocks of Arrow batches as tuples of Python lists, small enough that long texts stay bounded."""
    for batch in batches:
        for part in slices(batch):
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)
    release()


def arrow(fields: dict[str, pa.DataType], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))
