"""Watch events as a stream: once each, resolved as soon as their item is known, counted by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Events by tumbling or sliding window; the watermark gives the state's bound. Times without a zone count as UTC."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width, slide), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, by: str) -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = timed.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def ingest(events: DataFrame, root: str, identities: Callable[[], DataFrame], checkpoint: str) -> StreamingQuery:
    """Appends each event once to root/plays with its item; those without one wait in root/pending/<batch>.

    Identities are read anew for each batch, and events that waited are tried again, for ever. Batch n
    writes under its own number, so that a batch that runs twice writes the same again.
    """

    def batch(new: DataFrame, n: int) -> None:
        spark = new.sparkSession
        waiting = _read(spark, f"{root}/pending/{n - 1}", new.schema) if n else new.limit(0)
        done = _read(spark, f"{root}/plays", StructType.fromDDL("history_key string, batch bigint")).where(F.col("batch") < n).select("history_key")
        todo = new.unionByName(waiting).dropDuplicates(["history_key"]).join(done, "history_key", "left_anti")
        known = identities().select("rating_key", "item_id")
        joined = todo.join(known, "rating_key", "left").persist()
        joined.where("item_id IS NOT NULL").write.mode("overwrite").parquet(f"{root}/plays/batch={n}")
        joined.where("item_id IS NULL").select(*new.columns).write.mode("overwrite").parquet(f"{root}/pending/{n}")
        joined.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
