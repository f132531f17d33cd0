"""Conversations as streams: sorted rows of a partition, cut where the conversation changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def by_conversation(rows: DataFrame, *order) -> DataFrame:
    """Rows of each conversation in one partition and in order, NULL conversation first; nothing is held in memory for that."""
    return rows.repartition("conv").sortWithinPartitions(rows["conv"].asc_nulls_first(), *order)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, pa.RecordBatch]]:
    """``(conversation, whether it begins here, its rows in this batch)``; a conversation may go on over many batches."""
    last, any_yet = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv")
        null = conv.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1
        for start, end in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            key = None if null[start] else int(ids[start])
            yield key, not any_yet or key != last, batch.slice(start, end - start)
            last, any_yet = key, True
