"""Streams: incremental uploads, usage by window, admission with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.limits import Gate, Spec
from loomspan.session import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """The Parquet table ``name`` of a folder as a stream of its files.

    All files there are make one micro-batch, as a table's rows are in no order of
    time: in several, the watermark of the first would drop rows of the others.
    ``files_at_once`` is for files that come in order of time.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    reader = reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(f"{folder}/{name}.parque[t]")


def drained(stream: DataFrame, *, mode: str = "append", at: str | None = None) -> DataFrame:
    """All a stream has at the moment, run to its end in micro-batches, as a table in the shared folder.

    With ``at``, a folder of an earlier run, the stream goes on from that run's
    checkpoint, and the table holds what both have written.
    """
    spark = stream.sparkSession
    at = at or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").start(f"{at}/table").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


def usage_by_window(events: DataFrame, at: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; a window is written once the watermark has passed it."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, window), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
    )


def fresh_uploads(uploads: DataFrame, at: str, late: str = "30 days") -> DataFrame:
    """Uploads once each, however often a page brings them within the watermark."""
    return uploads.withWatermark(at, late).dropDuplicatesWithinWatermark(["video_id"])


def admission(requests: DataFrame, specs: dict[str, Spec], bucket: str = "bucket") -> DataFrame:
    """Requests admitted or refused as they come: id, bucket, admitted. The state of a bucket is what its longest window holds.

    The requests of a bucket in one micro-batch are put in order of time together, however many Arrow batches bring them.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate(specs[key[0]])
        if state.exists:
            times, costs, gate.busy_until = state.get
            gate.times, gate.costs = list(times), list(costs)
        out = []
        rows = pd.concat([pdf[["id", "us", "cost"]] for pdf in batches]).sort_values(["us", "id"])
        for i, us, cost in zip(rows["id"], rows["us"], rows["cost"]):
            free = gate.free_at(int(us), int(cost)) == int(us)
            if free:
                gate.admit(int(us), int(cost), 0)
            out.append((i, key[0], free))
        state.update((gate.times, gate.costs, gate.busy_until))
        yield pd.DataFrame(out, columns=["id", bucket, "admitted"])

    return requests.groupBy(bucket).applyInPandasWithState(
        run, f"id long, {bucket} string, admitted boolean", "times array<long>, costs array<long>, busy long", "append", GroupStateTimeout.NoTimeout
    )
