"""Streaming over sorted Arrow batches inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds): groups of equal keys, never cut, from batches that are sorted by them. Group k of the rows is
    bounds[k] to bounds[k + 1]. Held in memory are one batch and the group that it ends in."""
    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        columns = [np.asarray(table.column(c)) for c in keys]
        changes = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
        cut = int(changes[-1]) if len(changes) else 0
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut), np.r_[0, changes]
    if held is not None and len(held):
        yield held, np.array([0, len(held)])
