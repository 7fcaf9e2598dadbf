"""Periodic work on an engine: sweeps, compaction and consolidation by the clock, with counters.

The clock is given, so a stream of ticks, a scheduler or a test drives it; run() takes a stream whose
micro-batches carry times. What was done is written down before the next turn, so a turn that is
repeated after a failure does nothing twice: evictions and compaction find nothing more to do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packmill.functions import texts as X
from packmill.sources.shared import new_dir


@dataclass
class Status:
    sweeps: int = 0
    compactions: int = 0
    consolidations: int = 0
    packs_evicted: int = 0
    rows_dropped: int = 0
    views_added: int = 0
    last: dict = field(default_factory=dict)


class Maintenance:
    """Sweeps every `sweep_every` seconds of the given clock (an hour of decay each), compacts and consolidates likewise; 0 leaves a kind out."""

    def __init__(self, engine, sweep_every: int = 3600, compact_every: int = 21600, consolidate_every: int = 0, threshold: float = 15.0, hours: float = 1.0):
        self.engine, self.every = engine, {"sweep": sweep_every, "compact": compact_every, "consolidate": consolidate_every}
        self.threshold, self.hours, self.status = threshold, hours, Status()

    def _due(self, kind: str, now: int) -> bool:
        last = self.status.last.setdefault(kind, now)
        if self.every[kind] and now - last >= self.every[kind]:
            self.status.last[kind] = now
            return True
        return False

    def tick(self, now: int) -> Status:
        """Does what is due at `now`; the first tick only starts the clock."""
        s = self.status
        if self._due("sweep", now):
            s.sweeps += 1
            s.packs_evicted += self.engine.sweep_now(self.hours, self.threshold)
        if self._due("compact", now):
            s.compactions += 1
            s.rows_dropped += sum(r["rows_dropped"] for r in self.engine.compact().values())
        if self._due("consolidate", now):
            s.consolidations += 1
            s.views_added += consolidate(self.engine)
        return s

    def run(self, ticks: DataFrame) -> Status:
        """Drives the clock by a stream with a column now (seconds), micro-batch by micro-batch."""

        def turn(rows: DataFrame, _: int) -> None:
            at = rows.agg(F.max("now")).first()[0]
            if at is not None:
                self.tick(at)

        query = ticks.writeStream.foreachBatch(turn).option("checkpointLocation", new_dir(ticks.sparkSession, "ticks")).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.status


def consolidate(engine, key=None) -> int:
    """Views of the validated packs that have a text and no view yet: three framings of it, each with a key of its own; how many were added.

    key is a capture function (text column to vector column); without one keys come from the text alone. Framings that are equal count once.
    """
    from packmill.functions.support import text_key

    key = key or text_key
    views = engine.store.live("cells").filter("is_view").select("pack_id").distinct()
    packs = engine.packs().filter("tier >= 1").join(views, "pack_id", "left_anti").join(engine.store.texts().filter("trim(text) <> ''"), "pack_id")
    text = F.col("text")
    framed = packs.select("pack_id", F.posexplode(F.array_distinct(F.filter(F.array(X.summary(text), X.question(text), X.paraphrase(text)), lambda t: t.isNotNull()))).alias("n", "view"))
    return engine.add_view_keys(framed.select("pack_id", (F.col("n") + 1).alias("view_no"), F.array(key(F.col("view"))).alias("tokens")))
