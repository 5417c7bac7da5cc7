"""Streaming: event windows, traces, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import scratch_root


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per key and window; works on streams and tables."""
    df = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark("_ts", late)
    return df.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def run_available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there into a table of the shared folder, and return that table."""
    import uuid

    root = f"{scratch_root(spark)}/granary/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def parse_capture(lines: DataFrame, value: str = "value") -> DataFrame:
    """Captured lines as events: JSON objects with a known type, `data:` lines of the same, and free text as assistant.delta."""
    known = ("assistant.delta", "assistant.tool_call", "tool.result", "assistant.final")
    body = F.regexp_replace(F.trim(F.col(value)), r"^data:\s*", "")
    kind = F.get_json_object(body, "$.type")
    parsed = F.try_parse_json(body).isNotNull() & body.startswith("{")
    rows = lines.where(F.trim(F.col(value)) != "").select("*", body.alias("body"), F.when(parsed, kind).otherwise("assistant.delta").alias("type"), F.when(parsed, F.get_json_object(body, "$.text")).otherwise(body).alias("text"))
    return rows.where(F.col("type").isin(*known))


def alerts(points: DataFrame, limits: dict[str, float], name: str = "event_type", value: str = "value") -> DataFrame:
    """Points above the limit of their name."""
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(name)]
    return points.withColumn("limit", limit).where(F.col(value) > F.col("limit"))
