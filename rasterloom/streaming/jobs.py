"""Job events as a stream: JSON lines in a folder, folded into one state for each job.

The wire format is one JSON object in a line with a type, a job and a sequence number. Lines that
aren't JSON, or have no type, become error events; the stream goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Event types that are understood. Fixed values.
TYPES = ("ready", "discovered", "inspecting", "inspected", "started", "progress", "performance", "file_done", "log", "completed", "cancelled", "failed", "error")
#: Types after which a job's state stays as it is. Fixed values.
TERMINAL = ("completed", "cancelled", "failed")
SCHEMA = "seq bigint, ts timestamp, job string, type string, value double, file string, _corrupt_record string"
STATE = "percent double, files_done long, status string, last_seq long, peak double"
PROGRESS = f"job string, {STATE}"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all files of a folder, as a stream; broken lines become events of type error."""
    lines = spark.readStream.schema(SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").option("mode", "PERMISSIVE").json(folder)
    good = F.col("_corrupt_record").isNull() & F.col("type").isin(*TYPES)
    return lines.withColumn("type", F.when(good, F.col("type")).otherwise("error")).withColumn("job", F.coalesce("job", F.lit(""))).drop("_corrupt_record")


def folded(state: tuple, rows: pd.DataFrame) -> tuple:
    """A job's state after more events, in order of their number: progress never falls, stale events
    and events after the end don't count."""
    percent, done, status, last, peak = state
    for r in rows.sort_values("seq").itertuples():
        if pd.isna(r.seq) or r.seq <= last:
            continue
        last = int(r.seq)
        if status in TERMINAL:
            continue
        value = 0.0 if pd.isna(r.value) else float(r.value)
        if r.type == "progress":
            percent, status = max(percent, min(99.9, max(0.0, value))), "running"
        elif r.type == "performance":
            peak = max(peak, value)
        elif r.type == "file_done":
            done += 1
        elif r.type in TERMINAL:
            status = r.type
            percent = 100.0 if r.type == "completed" else percent
        elif r.type == "started":
            status = "running"
    return percent, done, status, last, peak


START = (0.0, 0, "idle", -1, 0.0)


def fold_stream(events: DataFrame) -> DataFrame:
    """The state of each job whenever it changes; use it in update mode. State is five numbers for a job."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        now = folded(tuple(now), pd.concat(list(parts)))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["job", "percent", "files_done", "status", "last_seq", "peak"])

    return events.groupBy("job").applyInPandasWithState(step, PROGRESS, STATE, "update", GroupStateTimeout.NoTimeout)


def fold_batch(events: DataFrame) -> DataFrame:
    """The same states from a table, by aggregates alone: no group is brought together in one task."""
    end = F.min(F.when(F.col("type").isin(*TERMINAL), F.struct("seq", "type")))
    ends = events.groupBy("job").agg(end.alias("end"), F.max("seq").alias("last_seq"))
    live = events.join(ends, "job").where(F.col("end").isNull() | (F.col("seq") < F.col("end.seq")) | F.col("type").isin(*TERMINAL))
    value = F.coalesce("value", F.lit(0.0))
    kind = F.col("type")
    out = live.groupBy("job").agg(
        F.coalesce(F.max(F.when(kind == "progress", F.least(F.lit(99.9), F.greatest(F.lit(0.0), value)))), F.lit(0.0)).alias("percent"),
        F.count_if(kind == "file_done").alias("files_done"),
        F.max(F.when(kind.isin("progress", "started"), 1)).alias("ran"),
        F.first("end").alias("end"),
        F.first("last_seq").alias("last_seq"),
        F.coalesce(F.max(F.when(kind == "performance", value)), F.lit(0.0)).alias("peak"),
    )
    status = F.coalesce(F.col("end.type"), F.when(F.col("ran") == 1, "running").otherwise("idle"))
    return out.select("job", F.when(F.col("end.type") == "completed", 100.0).otherwise(F.col("percent")).alias("percent"), "files_done", status.alias("status"), "last_seq", "peak")


def windowed_samples(events: DataFrame, *, width: str = "1 second", delay: str = "1 minute") -> DataFrame:
    """Performance samples by event time, for streams with late rows."""
    rows = events.where("type = 'performance'").withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", width), "job").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"), F.avg("value").alias("mean"))


def states_of(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Run the fold over all files that are there now; the last state of each job."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/states/batch={number}")

    stream = fold_stream(read_events(spark, folder)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    states = spark.read.schema(PROGRESS).parquet(f"{out}/states/*")
    return states.groupBy("job").agg(F.max(F.struct("last_seq", "percent", "files_done", "status", "peak")).alias("s")).select("job", "s.percent", "s.files_done", "s.status", "s.last_seq", "s.peak")
