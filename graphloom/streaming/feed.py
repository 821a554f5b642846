"""Change feeds: debounced batches of events, and continuous synchronisation with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Gap without events after which a change is acted upon.
DEBOUNCE = "2 seconds"


def debounce(events: DataFrame, keys: list[str], time_col: str, gap: str = DEBOUNCE) -> DataFrame:
    """Bursts of events of a key: (*keys, started, ended, events). A burst ends after a gap without events.

    Works on batches and, with a watermark on time_col, on streams. Rows with a null time do not count.
    """
    rows = events.filter(F.col(time_col).isNotNull())
    burst = rows.groupBy(*keys, F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("events"), F.max(time_col).alias("ended"))
    return burst.select(*keys, F.col("w.start").alias("started"), "ended", "events")


def watch(spark: SparkSession, folder: str, schema: StructType, ignore: str = r"(^|/)\.", path_col: str = "path", per_batch: int = 1000) -> DataFrame:
    """Stream of the change rows that arrive as Parquet files in a folder; ignored paths never come through."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return rows.filter(~F.coalesce(F.col(path_col).rlike(ignore), F.lit(True)))


def synchronise(changes: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs on_batch(changes, batch id) for each micro-batch, one at a time; changes that arrive meanwhile form the next.

    A failed batch is run again with the same id after a restart, so on_batch must be idempotent (an upsert is).
    """
    writer = changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=DEBOUNCE).start()


def latest_changes(batch: DataFrame, key: str = "path", time_col: str = "at") -> DataFrame:
    """The last change of each key in a batch."""
    columns = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(time_col, F.xxhash64(*columns))).alias("own")).select(key, "own.*")
