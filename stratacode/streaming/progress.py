"""Progress messages as a stream: the latest state of each task, and counts per time window.

The stream's state and checkpoint lie in the shared folder, so a restarted query goes on where it ended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import work_dir

MESSAGE = "task_id long, status string, progress_percent int, current_step string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema: T.StructType = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet*")


def messages(events: DataFrame) -> DataFrame:
    """Progress messages as JSON text from events: the task is the user, the step the kind of event."""
    percent = F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value"))).cast("int")
    body = F.to_json(F.struct(F.col("user_id").alias("task_id"), F.when(percent >= 100, "completed").otherwise("running").alias("status"), percent.alias("progress_percent"), F.col("event_type").alias("current_step")))
    return events.select("event_id", "ts", body.alias("message"))


def parse_messages(stream: DataFrame) -> DataFrame:
    """Messages with their four fields; what is no JSON object drops out."""
    return stream.select("event_id", "ts", F.from_json("message", MESSAGE).alias("m")).where("m.task_id is not null").select("event_id", "ts", "m.*")


def run_to_end(df: DataFrame, mode: str) -> DataFrame:
    """Runs an aggregating stream over all that is there and returns its last result."""
    spark = df.sparkSession
    base = f"{work_dir(spark)}/stream_{uuid.uuid4().hex}"
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        seen.append(number)

    query = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.parquet(f"{base}/out/{max(seen)}") if seen else spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{base}/out/{n}" for n in seen]) if seen else spark.createDataFrame([], df.schema)


def latest_progress(stream: DataFrame) -> DataFrame:
    """The newest message of each task, by time and then by id."""
    m = parse_messages(stream)
    newest = F.max_by(F.struct("status", "progress_percent", "current_step"), F.struct("ts", "event_id"))
    return m.groupBy("task_id").agg(newest.alias("x"), F.count(F.lit(1)).alias("messages")).select("task_id", "x.*", "messages")


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Messages per step and tumbling window; with a watermark, so that the state stays bounded."""
    m = parse_messages(stream).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = m.groupBy(F.window("ts", width), "current_step").agg(F.count(F.lit(1)).alias("messages"), F.max("progress_percent").alias("most"))
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "current_step", "messages", "most")


QUERIES = {
    "progress_stream": lambda s, d: run_to_end(latest_progress(messages(event_stream(s, d))), "complete"),
    "progress_windows": lambda s, d: run_to_end(windowed_counts(messages(event_stream(s, d))), "complete"),
}
_M = "m AS (SELECT event_id, ts, user_id AS task_id, event_type AS current_step, CAST(least(100, greatest(0, floor(value))) AS INTEGER) AS progress_percent FROM events WHERE user_id IS NOT NULL)"
ORACLE_SQL = {
    "progress_stream": f"WITH {_M} SELECT task_id, arg_max(CASE WHEN progress_percent >= 100 THEN 'completed' ELSE 'running' END, (ts, event_id)) AS status, arg_max(progress_percent, (ts, event_id)) AS progress_percent, arg_max(current_step, (ts, event_id)) AS current_step, count(*) AS messages FROM m GROUP BY 1",
    "progress_windows": f"WITH {_M} SELECT date_trunc('hour', ts) AS start, current_step, count(*) AS messages, max(progress_percent) AS most FROM m GROUP BY 1, 2",
}
