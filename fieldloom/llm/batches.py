"""Adding columns that numpy computes from a text column, batch by batch, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb

#: Documents from which models learn: crc32 of the doc_id's text modulo 5 is not 0.
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that no model learns from; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS != 0, F.lit(False))


def with_text_columns(docs: DataFrame, added: list[T.StructField], compute: Callable[[np.ndarray, np.ndarray], list[pa.Array]], text: str = "text", most: int = 1 << 20) -> DataFrame:
    """``docs`` with columns that ``compute`` makes from the bytes and row offsets of the text column.

    An added column replaces one of the same name.  Rows are computed in slices of at most ``most`` bytes.
    """
    names = [f.name for f in added]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            data, offsets = tb.text_bytes(batch.column(batch.schema.get_field_index(text)))
            for low, high in tb.slices(offsets, most):
                new = compute(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([c.slice(low, high - low) for c in own] + new, names=schema.names)

    return docs.mapInArrow(work, schema)
