"""The batch planner: discovery, preflight, eligibility, overrides and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import col

#: Output formats in the order in which they are offered. Fixed values.
OUTPUTS = ("ome_tiff", "svs", "fluorescence_svs", "afi")


def without_referenced(files: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Files that no file set refers to."""
    return files.join(referenced, key, "left_anti")


def compatibility(*, changed: Column, error: Column, allowed: Column) -> Column:
    """Status of a file, by precedence."""
    return F.when(changed, "changed").when(error, "inspection_error").when(~allowed, "not_allowed").otherwise("compatible")


def refusal(output: str) -> Column:
    """Why a slide (modality, native_planes, bit_depth, n_field, n_z, n_t, n_channels) can't become an
    output; the first rule that fails counts, null if none does."""
    modality = F.col("modality")
    if output == "ome_tiff":
        return F.lit(None).cast("string")
    if output == "svs":
        return F.when(modality == "fluorescence", "fluorescence").when(modality != "brightfield", "unknown modality")
    # single-channel slides and sets of them
    out = F.when(modality == "brightfield", "not fluorescence").when((modality != "fluorescence") | ~F.col("native_planes"), "no independent planes")
    out = out.when(F.col("bit_depth") != 8, "bit depth").when((F.col("n_field") != 1) | (F.col("n_z") != 1) | (F.col("n_t") != 1), "axes")
    return out.when(F.col("n_channels") != 1, "channels") if output == "fluorescence_svs" else out


def allowed_outputs(slides: DataFrame) -> DataFrame:
    """slide_id, format, allowed, reason for every output of every slide."""
    offers = F.array(*(F.struct(F.lit(o).alias("format"), refusal(o).alias("reason")) for o in OUTPUTS))
    rows = slides.select("slide_id", F.explode(offers).alias("o"))
    return rows.select("slide_id", "o.format", F.col("o.reason").isNull().alias("allowed"), F.coalesce("o.reason", F.lit("")).alias("reason"))


def batch_counts(results: DataFrame) -> DataFrame:
    """Counters of a batch: successes count the flag, the others the status."""
    status = F.col("status")
    return results.agg(
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(status == "failed").alias("failed_count"),
        F.count_if(status.isin("skipped_incompatible", "not_started")).alias("skipped_count"),
        F.count_if(status == "cancelled").alias("cancelled_count"),
    )


def codec_summary(codec: str) -> Column:
    """The codec of a group, or 'mixed'. Least and greatest say whether there are several, without a distinct count."""
    c = F.col(codec)
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise("mixed")


def channel_overrides(channels: DataFrame, given: DataFrame, key: list[str], fields: list[str], defaults: dict[str, str]) -> DataFrame:
    """Channels with what was given for them; both must name the same channels, and check_ says where they don't."""
    a = channels.select(*key, F.struct(*fields).alias("__own"))
    b = given.select(*key, F.struct(*fields).alias("__given"))
    rows = a.join(b, key, "full_outer")
    own = lambda f: F.coalesce(F.col(f"__given.{f}"), F.col(f"__own.{f}"), col(F.lit(defaults[f])) if f in defaults else F.lit(None))
    check = F.when(F.col("__own").isNull(), "unknown channel").when(F.col("__given").isNull(), "missing override").otherwise("ok")
    return rows.select(*key, *(own(f).alias(f) for f in fields), check.alias("check_"))


def omitted_planes() -> Column:
    """What a plain colour output of a slide leaves out; null if nothing."""
    more = (F.col("modality") == "fluorescence") | (F.col("n_field") > 1) | (F.col("n_channels") > 1) | (F.col("n_z") > 1) | (F.col("n_t") > 1) | (F.col("bit_depth") > 8)
    text = F.format_string("fields=%d, C=%d, Z=%d, T=%d, bit_depth=%d", *(F.col(c).cast("int") for c in ("n_field", "n_channels", "n_z", "n_t", "bit_depth")))
    return F.when(more, text)


def resolved_resources(*sources: DataFrame, key: list[str]) -> DataFrame:
    """Associated images by slide and name from several places; the first place that has one counts."""
    every = None
    for rank, s in enumerate(sources):
        s = s.withColumn("__rank", F.lit(rank))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    value = [c for c in every.columns if c not in (*key, "__rank")]
    best = every.groupBy(*key).agg(F.min_by(F.struct(*value), F.col("__rank")).alias("__v"))
    return best.select(*key, "__v.*")


def stale(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files whose size or time differs from the snapshot's; one that the snapshot lacks counts as changed."""
    s = snapshot.select("path", F.col("file_size").alias("__size"), F.col("mtime_ns").alias("__time"))
    same = F.col("file_size").eqNullSafe(F.col("__size")) & F.col("mtime_ns").eqNullSafe(F.col("__time"))
    return files.join(s, "path", "left").withColumn("changed", ~same).drop("__size", "__time")


def modality(tiles: DataFrame) -> DataFrame:
    """Modality of each slide by structure alone: independent planes with a channel directory are
    fluorescence, three or more packed samples are brightfield, anything else is unknown."""
    facts = tiles.groupBy("slide_id").agg(F.max("n_channels").alias("c"), F.count_distinct("channel").alias("planes"), F.max("samples").alias("samples"))
    return facts.select("slide_id", F.when((F.col("c") > 0) & (F.col("planes") == F.col("c")) & (F.col("samples") == 1), "fluorescence").when(F.col("samples") >= 3, "brightfield").otherwise("unknown").alias("modality"))


def found_by_text(files: DataFrame, path: str, text: str) -> DataFrame:
    """Files whose path holds a text, whatever the case; blanks around it don't count, and a blank text finds all."""
    wanted = text.strip().lower()
    return files.where(F.contains(F.lower(path), F.lit(wanted))) if wanted else files


def with_unknown_channel(channels: str) -> Column:
    """Whether any channel of a list has no known identity."""
    return F.exists(channels, lambda c: c["identity_source"] == "unknown")


def capability_columns(*, levels: Column, planes: Column) -> list[Column]:
    """What a slide's container offers: its own levels for one field, those as 8-bit output, and planes
    of several channels whose encoded tiles can pass."""
    native = levels & (F.col("n_field") == 1)
    eight = F.col("bit_depth") == 8
    return [native.alias("native_source"), (native & eight).alias("native_output_ready"), (planes & eight & (F.col("n_channels") > 1)).alias("plane_passthrough")]


def work_units(*, segments: Column, label: Column, macro: Column, finalise: Column, validate: Column) -> dict[str, Column]:
    """Units of a file's work by stage: a segment, an associated page and a step of the tail are one each."""
    one = lambda c: c.cast("int")
    return {"segments": segments, "associated": one(label) + one(macro), "tail": F.lit(1) + one(finalise) + one(validate)}
