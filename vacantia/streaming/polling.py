"""Polling as a stream: each micro-batch holds what a poll of some sources gave, and moves the stored relations on.

A micro-batch writes the postings that came and the ids that went, of its own sources only (`operators.relation`), and the
sources whose status changed. Its number is the version it makes, so a batch that is run again after a failure changes
nothing that it had written. Every so many batches the relations are compacted and what is out of date is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vacantia.operators.ingest import changed_only, met_sources, synced
from vacantia.operators.relation import Relation

#: Minutes between polls: the least, the most, and what is usual.
LEAST_MINUTES, MOST_MINUTES, MINUTES = 1, 1440, 30
STATUS = ["sync_status", "last_synced_at"]


def interval(minutes: int) -> str:
    """A trigger's interval; raises ValueError beyond a day or below a minute."""
    if not LEAST_MINUTES <= minutes <= MOST_MINUTES:
        raise ValueError(f"polls are {LEAST_MINUTES} to {MOST_MINUTES} minutes apart")
    return f"{minutes} minutes"


def take_in(batch: DataFrame, version: int, jobs: Relation, sources: Relation) -> None:
    """One poll. The last answer of a source counts; those of sources that are gone or inactive don't."""
    batch = batch.persist()
    try:
        known = sources.read(below=version)
        last = batch.groupBy("source_id").agg(F.max_by(F.struct("provider", "ok", "postings"), "at").alias("a"), F.max("at").alias("at"))
        met = met_sources(last.select("source_id", "a.provider", "a.ok", "a.postings", "at"), known)
        fetched = met.where("ok").select(F.explode("postings").alias("p")).select("p.*")
        jobs.poll(version, met.where("ok").select("provider", F.col("name").alias("company")), fetched)
        at = batch.agg(F.max("at")).first()[0]
        asked = known.join(met.select(F.col("source_id").alias("id")), "id", "left_semi")
        marked = synced(asked, met.select("source_id", "ok"), F.lit(at).cast("timestamp"))
        sources.update(version, changed_only(asked, marked, STATUS).drop(*STATUS), STATUS)
    finally:
        batch.unpersist()


def start_polling(answers: DataFrame, jobs: Relation, sources: Relation, checkpoint: str, every_minutes: int | None = None, compact_after: int = 16, keep: int = 3) -> StreamingQuery:
    """Answers have source_id, provider, ok, at and postings (an array of structs: all columns of the jobs' relation).

    One answer is one source's complete snapshot. An answer that isn't ok marks its source and removes nothing. The
    relation of sources must have been filled, as version 0. Without an interval, the answers that are there are taken in.
    """

    def step(batch: DataFrame, number: int) -> None:
        take_in(batch, number + 1, jobs, sources)
        if (number + 1) % compact_after == 0:
            for relation in (jobs, sources):
                relation.compact()
                relation.expire(keep)

    writer = answers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every_minutes is None else {"processingTime": interval(every_minutes)}
    return writer.trigger(**trigger).start()
