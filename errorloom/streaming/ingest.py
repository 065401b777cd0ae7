"""Ingesting requests as they arrive."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from errorloom.config import Config
from errorloom.plans.ingest import run_batch
from errorloom.sources.tables import SealedBatch


# Micro-batches are numbered from here, so that a stream never takes the place of batches loaded before.
FIRST_BATCH = 1 << 40


def start_stream(
    raw: DataFrame, config: Config, checkpoint: str, trigger: dict | None = None, first_batch: int = FIRST_BATCH
) -> StreamingQuery:
    """Runs every micro-batch of ``raw`` through ``run_batch``.

    A second stream into the same tables, or one with a new checkpoint, needs a ``first_batch`` of its own.

    The browser dimension is the only state, and it is a table. Requests that cannot become reports
    go to the reject log and never stop the query.
    """

    def ingest(batch, batch_id):
        try:
            run_batch(batch, config, first_batch + batch_id)
        except SealedBatch:
            pass  # committed, and merged with others, before the stream could note that it was done

    return (
        raw.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
