"""Structured Streaming operators: status counters, routed handlers, a per-path debounce, and file arrivals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.runtime import scratch_folder

# Scan statuses, and the pause after which a path's changes count as one.
STATUSES = ["RAW", "UNCHANGED", "CHANGED", "DELETED", "DUPLICATE"]
PAUSE = "2 seconds"


def status_counts(events: DataFrame, status: str = "status") -> DataFrame:
    """Running counters by status; NULL is a status of its own."""
    return events.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def debounced(events: DataFrame, key: str, ts: str, pause: str = PAUSE, late: str = "1 minute") -> DataFrame:
    """key, first_ts, last_ts, n of each burst: events of a key less than `pause` apart are one. Rows later than `late` are dropped by the watermark in append mode.

    Works on streams and on batches alike; NULL times belong to no burst.
    """
    timed = events.where(F.col(ts).isNotNull())
    timed = timed.withWatermark(ts, late) if timed.isStreaming else timed
    return timed.groupBy(F.col(key), F.session_window(F.col(ts), pause)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")).drop("session_window")


class Router:
    """Handlers by status over the micro-batches of a stream. A handler that fails is noted and the others go on."""

    def __init__(self) -> None:
        self.handlers: list[tuple[frozenset[str] | None, Callable[[DataFrame], None]]] = []
        self.failures: list[str] = []

    def subscribe(self, handler: Callable[[DataFrame], None], statuses: list[str] | None = None) -> None:
        self.handlers.append((frozenset(statuses) if statuses else None, handler))

    def dispatch(self, batch: DataFrame, _: int = 0) -> None:
        batch = batch.persist()
        try:
            for statuses, handler in self.handlers:
                try:
                    handler(batch if statuses is None else batch.where(F.col("status").isin(*statuses)))
                except Exception as e:  # noqa: BLE001
                    self.failures.append(str(e))
        finally:
            batch.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Works off what there is and stops."""
        return stream.writeStream.foreachBatch(self.dispatch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files of a folder as a stream: path, modificationTime, length, content. Changed and deleted files need the batch diff."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its file or files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def worked_off(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a bounded stream after all its input, written to a folder of its own beside the checkpoints and read back.

    Complete mode writes the whole result anew with each micro-batch; an endless stream takes append mode and a sink that grows.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
