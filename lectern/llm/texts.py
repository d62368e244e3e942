"""Reading text columns out of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes that one step works on together; bounds what a task holds beside Arrow's own batch.
STEP_BYTES = 8 << 20


def _tidy() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # no glibc here
    _TRIM = None


def with_text(batch: pa.RecordBatch, text_col: str) -> pa.RecordBatch:
    """The batch with the text of its carried rows as a column of its own; nothing is copied."""
    if "text" in batch.schema.names:
        return batch
    text = batch.column("row").field(text_col)
    return batch.append_column("text", text if pa.types.is_string(text.type) else text.cast(pa.string()))


def utf8(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def steps(batch: pa.RecordBatch, column: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about step_bytes of one column's text, a row at least."""
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1] if len(offsets) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + step_bytes, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
    _tidy()


def schema_of(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of columns written as in DDL."""
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def arrow(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    """A batch of the schema from arrays or lists by name."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)
