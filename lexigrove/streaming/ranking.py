"""An extension for streams: rank arriving declarations against a fixed catalogue, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.ranking import LEXICAL, Config, rank


def rank_stream(queries: DataFrame, docs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, config: Config = LEXICAL) -> StreamingQuery:
    """Start a query that hands each micro-batch's ranking and its number to ``write``.

    ``write`` must be idempotent by batch number, as a batch may be replayed after a failure.
    """

    def each(batch: DataFrame, number: int) -> None:
        write(rank(batch, docs, config), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
