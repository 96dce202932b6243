"""A filter of ids of fixed size, by which tasks keep the few rows that a later join can want.

The filter has ``FILTER_BITS`` (as a power of 2) bits, 1 MB, whatever the number of ids: that bounds what is sent to
the driver and to all tasks.  With very many ids it keeps more rows than needed, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb

FILTER_BITS, PART_BITS = 23, 14
#: Rows that are filtered at once: whole texts, so not too many.
ROWS = 1024


def _cells(ids: np.ndarray) -> np.ndarray:
    return (tb.mix(ids.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """The bits of the ids (longs, not null) in the first column."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.unique(np.concatenate([np.zeros(0, np.int64), *[_cells(b.column(0).to_numpy()) for b in batches]]))
        yield pa.RecordBatch.from_arrays([pa.array(cells >> PART_BITS, pa.int32()), pa.array(cells & ((1 << PART_BITS) - 1), pa.int32())], names=["part", "cell"])

    def gather(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PART_BITS, np.uint8)
        bits[table.column("cell").to_numpy()] = 1
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()])})

    out = np.zeros((1 << (FILTER_BITS - PART_BITS), 1 << (PART_BITS - 3)), np.uint8)
    for r in ids.mapInArrow(mark, "part int, cell int").distinct().groupBy("part").applyInArrow(gather, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be among those of the filter."""
    cells = _cells(ids)
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)


def only_wanted(df: DataFrame, bits: np.ndarray, column: str = "doc_id") -> DataFrame:
    """Rows whose id may be among those of the filter; nulls go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                yield part.filter(pa.array(passes(bits, part.column(part.schema.get_field_index(column)).to_numpy())))

    return df.filter(f"`{column}` is not null").mapInArrow(work, df.schema)
