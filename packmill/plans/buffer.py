"""A write buffer before an engine: ids at once, rows visible when they are flushed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packmill.operators import packs as P
from packmill.sources.shared import written


class WriteBuffer:
    """Collects batches of packs and appends them in one go.

    enqueue() gives ids at once; nothing is read back before flush(), which happens by itself as soon as
    max_batch_size packs wait. Flushing an empty buffer does nothing. What waits when the driver ends is lost,
    as is said to callers of such a buffer; ids are then given again.
    """

    def __init__(self, engine, max_batch_size: int = 100):
        if max_batch_size < 1:
            raise ValueError("a batch has at least one pack")
        self.engine, self.max_batch_size = engine, max_batch_size
        self.waiting: list[DataFrame] = []
        self.size, self._next = 0, None

    def enqueue(self, rows: DataFrame) -> DataFrame:
        """Packs as Engine.write_packs takes them; gives (row_no, pack_id)."""
        if self._next is None:
            self._next = self.engine.next_pack()
        placed = written(P.number(rows, "pack_id", ["row_no"], self._next), "waiting")
        n = placed.count()
        self._next += n
        self.size += n
        self.waiting.append(placed)
        if self.size >= self.max_batch_size:
            self.flush()
        return placed.select("row_no", "pack_id")

    def flush(self) -> int:
        """Appends what waits; how many packs."""
        if not self.waiting:
            return 0
        n, waiting = self.size, self.waiting
        self.engine.append_packs(reduce(DataFrame.unionByName, waiting).withColumn("pack_id", F.col("pack_id")))
        self.waiting, self.size, self._next = [], 0, None
        return n
