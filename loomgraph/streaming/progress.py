"""Progress lines of running jobs: a stream that hands on new lines and keeps the last ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEPT_LINES = 200


class LastLines:
    """The last lines of a stream of (seq, line), in order; a batch that is run again changes nothing."""

    def __init__(self, kept: int = KEPT_LINES):
        self.kept, self.lines, self.batch = kept, deque(maxlen=kept), -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.batch:
            return
        newest = batch.orderBy(F.desc("seq")).limit(self.kept).collect()  # bounded by what is kept
        self.lines.extend((row["seq"], row["line"]) for row in reversed(newest))
        self.batch = number


def follow(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start handing batches of a stream to a sink."""
    writer = lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
