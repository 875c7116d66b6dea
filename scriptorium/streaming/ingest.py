"""Incremental ingestion with the batch operators: each new document is structured once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scriptorium.operators import sections as S


def ingest(
    spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, to_papers: Callable[[DataFrame], DataFrame],
    structure: Callable[[DataFrame], DataFrame] = S.sections, files_per_trigger: int = 1000,
) -> int:
    """Structure the Parquet files below ``source`` that no earlier call has seen, and stop.

    A paper is whole within one file, so no state is kept between batches.  Each batch goes
    to a partition of its own, which a repeated batch replaces: results appear once even
    if a run is cut short.  Returns the number of batches.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    done = []

    def write(batch: DataFrame, epoch: int) -> None:
        structure(to_papers(batch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        done.append(epoch)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)
