"""Stream results over events: users stand for jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.jobs import fold_batch, states_of
from .registry import Registry, table
from .session import ship, store_path

registry = Registry()
query = registry.query

SQL = """WITH e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS job, CASE WHEN event_type = 'view' THEN 'progress' WHEN event_type = 'click' THEN 'performance' WHEN event_type = 'purchase' THEN 'file_done' WHEN event_type = 'signup' THEN 'log' WHEN value > 30 AND user_id % 2 = 0 THEN 'completed' WHEN value > 25 THEN 'failed' ELSE 'error' END AS type, value FROM events),
 t AS (SELECT job, min(seq) AS end_seq FROM e WHERE type IN ('completed', 'failed') GROUP BY job),
 l AS (SELECT e.*, t.end_seq FROM e LEFT JOIN t ON t.job = e.job)
 SELECT job, CASE WHEN max(CASE WHEN seq = end_seq THEN type END) = 'completed' THEN 100.0 ELSE coalesce(max(least(99.9, greatest(0.0, value))) FILTER (WHERE type = 'progress' AND (end_seq IS NULL OR seq < end_seq)), 0.0) END AS percent,
   count(*) FILTER (WHERE type = 'file_done' AND (end_seq IS NULL OR seq < end_seq)) AS files_done,
   coalesce(max(CASE WHEN seq = end_seq THEN type END), CASE WHEN count(*) FILTER (WHERE type = 'progress') > 0 THEN 'running' ELSE 'idle' END) AS status, max(seq) AS last_seq,
   coalesce(max(value) FILTER (WHERE type = 'performance' AND (end_seq IS NULL OR seq < end_seq)), 0.0) AS peak FROM l GROUP BY job"""


def job_events(spark, sf_dir) -> DataFrame:
    e, v = F.col("event_type"), F.col("value")
    kind = F.when(e == "view", "progress").when(e == "click", "performance").when(e == "purchase", "file_done").when(e == "signup", "log").when((v > 30) & (F.col("user_id") % 2 == 0), "completed").when(v > 25, "failed").otherwise("error")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("job"), kind.alias("type"), "value")


@query(SQL)
def job_states(spark, sf_dir):
    return fold_batch(job_events(spark, sf_dir))


@query(SQL)
def stream_job_states(spark, sf_dir):
    folder = store_path(ship(spark), "events")
    job_events(spark, sf_dir).repartition(3).write.json(f"{folder}/in")
    return states_of(spark, f"{folder}/in", f"{folder}/out")
