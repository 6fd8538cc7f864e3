"""Work on blocks of rows that belong together, in Arrow, one block at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame


def map_blocks(rows: DataFrame, place: Sequence[str], order: Sequence, work: Callable[[pa.Table, np.ndarray], Iterable[pa.Table]], schema) -> DataFrame:
    """Deals rows by ``place`` and hands them on in ``order``, several whole blocks at a time with the rows at which
    each begins. A task holds a block and a batch of rows at most. Null places are a block too."""
    placed = rows.repartition(*place).sortWithinPartitions(*place, *order)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            begins = block_begins(held, place)
            if len(begins) > 1:
                yield from _batches(work(held.slice(0, begins[-1]).combine_chunks(), begins[:-1]))
                held = held.slice(begins[-1])
        if held is not None:
            yield from _batches(work(held.combine_chunks(), np.zeros(1, int)))

    return placed.mapInArrow(run, schema)


def _batches(tables: Iterable[pa.Table]):
    for table in tables:
        yield from table.combine_chunks().to_batches()


def block_begins(rows: pa.Table, place: Sequence[str]) -> np.ndarray:
    """Rows with which a block begins; there is one at least."""
    change = np.zeros(len(rows), bool)
    change[0] = True
    for c in place:
        own = rows.column(c).combine_chunks()
        same = pa.compute.equal(own[1:], own[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        none = own.is_null().to_numpy(zero_copy_only=False)
        change[1:] |= ~(same | (none[1:] & none[:-1]))
    return np.flatnonzero(change)
