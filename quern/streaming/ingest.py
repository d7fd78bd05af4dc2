"""Streams: files dropped into a folder are ingested per micro-batch; events are summed in windows with late data cut off.

The batch operators have no streaming counterpart in what they were modelled on; these are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.plans.service import Engine

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(engine: Engine, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Ingest files as they appear. A batch that is repeated after a failure finds its documents unchanged."""
    spark: SparkSession = engine.spark
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    base = "/" + folder.removeprefix("file:").strip("/") + "/"
    files = stream.select(F.element_at(F.split("path", base), -1).alias("source"), "content")
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: engine.ingest(batch))
    return writer.trigger(availableNow=True).start() if once else writer.start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Number and sum of events (ts, event_type, value) per window and type; works on streams and on tables."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return own.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions per user: start, end and number of events."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
