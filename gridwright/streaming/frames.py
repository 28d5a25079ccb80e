"""Slices of a stack as they arrive: one function of grids, batch by batch.

A stream of cells with their slice number along the last axis is worked off in
micro-batches; every batch holds whole slices (a slice is one file or one
message of its source), so operators that act within slices give what they give
on the whole stack.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridwright.operators.grid import Grid


def per_slice(cells: DataFrame, size: Sequence[int], f: Callable[[Grid], Grid], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``f`` (which must keep slices apart) to arriving slices; the cells go to Parquet at ``out``, partitioned by ``batch``.

    A batch that is tried again overwrites its own folder, so no cell comes twice.
    """
    last = "xyz"[len(size) - 1]

    def work(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        g = Grid(batch, (*size[:-1], size[-1]))
        f(g).cells.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return cells.select(*"xyz"[: len(size)], "v").where(F.col(last).isNotNull()).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
