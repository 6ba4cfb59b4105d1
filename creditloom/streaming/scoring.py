"""Stateless stream scoring with the same scorer as batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from creditloom.operators.jobs import Scorer


def score_stream(
    spark: SparkSession,
    source: str,
    schema: StructType,
    scorer: Scorer,
    sink: str,
    checkpoint: str,
    keep: list[str],
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Score files as they arrive.  Nothing is kept between batches, so no watermark is needed; the
    checkpoint makes the file sink exactly-once over restarts."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    scored: DataFrame = scorer.score(rows).select(*keep, "pd", "score")
    return (
        scored.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
