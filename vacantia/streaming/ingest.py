"""Ingest as a stream of landed postings: each micro-batch adds what is new, so that redelivery changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from vacantia.operators.relation import Relation


def start_ingest(landed: DataFrame, jobs: Relation, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Add new postings of a stream to a relation; every = an interval, or all there is, once.

    A micro-batch reads ids and hashes of the relation and writes what it adds, as the version of its number.
    """
    writer = landed.writeStream.foreachBatch(lambda batch, number: jobs.add(number + 1, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
