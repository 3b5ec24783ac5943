"""Streams: materialized views kept up to date batch by batch, sources, and the windows that Spark adds."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.engines import Engine
from tessera.plans.views import MaterializedView
from tessera.sources.external import schema_of


def maintain(view: MaterializedView, stream: DataFrame, checkpoint: str, available_now: bool = True, interval: str | None = None) -> StreamingQuery:
    """Apply every micro-batch to the view. A batch is written under its number, so one that runs again after a failure
    replaces itself and counts once."""

    def batch(rows: DataFrame, number: int) -> None:
        view.apply(rows, number)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=interval or "10 seconds")).start()


def file_stream(spark: SparkSession, path: str, columns: Any, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    made = spark.readStream.format(format).schema(schema_of(columns))
    return (made.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else made).load(path)


def rate_stream(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def kafka_options(engine: Engine, max_offsets: int | None = None, start: str = "earliest") -> dict[str, str]:
    out = {"kafka.bootstrap.servers": engine.option("brokers"), "subscribe": engine.option("topics"), "kafka.group.id": engine.option("group"), "startingOffsets": start}
    return {**out, "maxOffsetsPerTrigger": str(max_offsets)} if max_offsets else out


def messages(raw: DataFrame, columns: Any, format: str = "JSONEachRow", value: str = "value") -> DataFrame:
    """Rows of a column of messages, one a message: JSON objects or arrays, lines of CSV or TSV, Avro records (with Spark's Avro
    package; ``columns`` is then its schema in JSON) or the text itself in one column. A message that can't be read gives
    a row of nulls."""
    text = F.col(value).cast("string")
    if format in ("RawBLOB", "LineAsString", "Text"):
        kind = schema_of(columns)
        return raw.select(text.cast(kind.fields[0].dataType).alias(kind.fields[0].name))
    if format == "Avro":
        from pyspark.sql.avro.functions import from_avro

        return raw.select(from_avro(F.col(value), columns, {"mode": "PERMISSIVE"}).alias("row")).select("row.*")
    kind = schema_of(columns)
    if format == "JSONEachRow":
        return raw.select(F.from_json(text, kind).alias("row")).select("row.*")
    if format in ("JSONCompactEachRow", "JSONCompact"):
        given = raw.select(F.from_json(text, "array<string>").alias("v"))
        return given.select(*[F.get("v", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(kind.fields)])
    separators = {"CSV": ",", "TSV": "\t", "TabSeparated": "\t"}
    if format not in separators:
        raise ValueError(f"unknown message format {format}")
    return raw.select(F.from_csv(text, kind.simpleString()[7:-1].replace(":", " "), {"sep": separators[format]}).alias("row")).select("row.*")


def kafka_stream(spark: SparkSession, engine: Engine, columns: Any, **options: Any) -> DataFrame:
    """The rows of a topic's messages in the engine's format. Needs Spark's Kafka connector on the classpath."""
    raw = spark.readStream.format("kafka").options(**kafka_options(engine, **options)).load()
    return messages(raw, columns, engine.option("format"))


def tumbling(df: DataFrame, time: str, size: str, by: list[str], aggregates: dict[str, Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by window of time, tumbling or sliding; ``late`` is how long a stream waits for late rows."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    out = rows.groupBy(F.window(time, size, slide), *by).agg(*[e.alias(k) for k, e in aggregates.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, by: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates by session: rows of a key with no gap of that length between them."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    out = rows.groupBy(F.session_window(time, gap), *by).agg(*[e.alias(k) for k, e in aggregates.items()])
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, *aggregates)


def distinct_within(df: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key; a stream forgets keys after the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
