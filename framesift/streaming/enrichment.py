"""Incremental enrichment: files arrive, are worked on in small commits, and can be stopped and gone on with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Files that one commit takes at most.
CHUNK_FILES = 100


def arrivals(spark: SparkSession, folder: str, schema: str, chunk: int = CHUNK_FILES) -> DataFrame:
    """A stream of the rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", chunk).parquet(folder)


def enrich(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply ``work`` to a stream, chunk by chunk, and append the results below ``out``.

    Each chunk is written to a folder of its own number, which a repeat replaces; so a stop at any time loses the
    open chunk only, and a restart with the same checkpoint repeats none that was committed.
    """

    def commit(chunk: DataFrame, number: int) -> None:
        work(chunk).write.mode("overwrite").parquet(f"{out}/chunk={number}")

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress(query: StreamingQuery) -> dict:
    """What a running query has done: phase, commits and rows of the last one, and its error if it failed."""
    last = query.lastProgress
    failed = query.exception()
    phase = "error" if failed else "running" if query.isActive else "complete"
    return {"phase": phase, "chunk": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0, "error": str(failed) if failed else None}


class Runs:
    """Named jobs of a session: one at a time for each name, and any can be stopped."""

    def __init__(self, spark: SparkSession):
        self.context, self.names = spark.sparkContext, set()

    def run(self, name: str, job: Callable[[], object]) -> object:
        """Run a job under its name; raises if one of that name is running."""
        if name in self.names:
            raise RuntimeError(f"{name} is running")
        self.names.add(name)
        self.context.addJobTag(name)
        try:
            return job()
        finally:
            self.context.removeJobTag(name)
            self.names.discard(name)

    def stop(self, name: str) -> None:
        """Stop what runs under a name; nothing if nothing does."""
        self.context.cancelJobsWithTag(name)
