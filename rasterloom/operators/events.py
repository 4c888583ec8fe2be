"""Job events: progress, phases, logs and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def monotone_progress(events: DataFrame) -> DataFrame:
    """seq, job, file_progress, batch_progress: progress never falls, and a batch stays below 100 until it ends."""
    w = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value")))).over(w)
    return events.select("seq", "job", F.round(best, 6).alias("file_progress"), F.round(F.least(F.lit(99.9), best), 6).alias("batch_progress"))


def phase_matrix(events: DataFrame, phases: tuple[str, ...]) -> DataFrame:
    """For each phase how many files are past it and how many are in it, by each file's latest phase.

    Files are counted by phase first, so the small matrix is made from as many rows as there are phases."""
    number = F.array_position(F.array(*map(F.lit, phases)), F.col("phase")) - 1
    # the latest phase of a file is a maximum, which needs no sort
    now = events.groupBy("file").agg(F.max(F.struct("seq", number.alias("at"))).getField("at").alias("at"))
    counts = now.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("at", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(phases) - 1).cast("bigint"))).alias("phase_no"))
    one = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return rows.groupBy("phase_no").agg(one(F.col("at") > F.col("phase_no")).alias("n_passed"), one(F.col("at") == F.col("phase_no")).alias("n_active"))


def log_tail(events: DataFrame, seq: str, n: int) -> DataFrame:
    """The last n lines: a top-n, which keeps n rows of each partition."""
    return events.orderBy(F.desc(seq)).limit(n)


def job_timing(events: DataFrame) -> DataFrame:
    return events.groupBy("job", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total_s"), F.max("value").alias("peak"), F.round(F.avg("value"), 6).alias("mean"))


def progress_fields(events: DataFrame) -> DataFrame:
    """Percent within bounds, remaining seconds by the share done, and a phase's plain name."""
    done = F.col("done")
    eta = F.when((done > 0) & (done < 100), F.round(F.col("elapsed") * (F.lit(100.0) - done) / done, 0).cast("bigint"))
    phase = F.when(F.contains("event_type", F.lit("view")), "reading").when(F.contains("event_type", F.lit("click")), "writing").otherwise("finishing")
    return events.select("event_id", F.least(F.lit(100), F.greatest(F.lit(0), done)).alias("percent"), eta.alias("eta_s"), phase.alias("phase"))
