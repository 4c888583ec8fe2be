"""Queries over files, options, preflight, reports and job events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arithmetic import bounded_int
from ..functions.text import (
    LENGTH_UNITS,
    MAGNIFICATION_KEYS,
    OUTPUT_SUFFIX,
    TIME_UNITS,
    aperio_associated_description,
    aperio_description,
    aperio_level_description,
    aperio_thumbnail_description,
    blank_zero,
    channel_suffix,
    converted,
    description_property,
    file_format,
    objective_power,
    output_path,
    parent_folder,
    pixel_size,
    safe_component,
    suffix,
)
from ..operators.events import job_timing as timing_of, log_tail as tail_of, monotone_progress, phase_matrix as matrix_of, progress_fields
from ..operators.planner import allowed_outputs, batch_counts as counts_of, capability_columns, channel_overrides, codec_summary, compatibility, found_by_text, omitted_planes, resolved_resources, with_unknown_channel, without_referenced, work_units
from ..operators.windows import greedy_names, latest, numbered, suffixed_names
from ..sources.slide_pages import CLASSIC_LIMIT, bytes_per_pixel, estimated_bytes
from .registry import Registry, table

registry = Registry()
query = registry.query

SUFFIXES = (".ibl", ".KFB", ".kfbf", ".image", ".svs", ".tif", ".TIFF", ".afi", ".txt", ".ome.tif", "")
FILES = "files AS (SELECT p_partkey AS idx, 'in/' || p_brand || '/slide_' || p_size || CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END AS path, p_partkey, p_size, p_brand FROM part)"
SUFFIX = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
FORMAT = f"CASE WHEN {SUFFIX} = '.ibl' THEN 'ibl' WHEN {SUFFIX} IN ('.kfb', '.kfbl', '.kfbf', '.kfba', '.kfbx') THEN 'kfb' WHEN {SUFFIX} = '.image' THEN 'image' WHEN {SUFFIX} = '.svs' THEN 'svs' WHEN {SUFFIX} IN ('.tif', '.tiff') THEN 'generic_tiff' WHEN {SUFFIX} = '.afi' THEN 'afi' ELSE 'unsupported' END"


def files_of(spark, sf_dir):
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*map(F.lit, SUFFIXES)), (k % 11 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("idx"), F.concat(F.lit("in/"), "p_brand", F.lit("/slide_"), F.col("p_size").cast("string"), ending).alias("path"), "p_partkey", "p_size", "p_brand")


@query(rf"WITH {FILES} SELECT idx, path, {FORMAT} AS format, 'out/' || regexp_replace(path, '([^/])\.[^./]*$', '\1') || '.ome.tif' AS out_path FROM files")
def format_dispatch(spark, sf_dir):
    return files_of(spark, sf_dir).select("idx", "path", file_format("path").alias("format"), output_path(F.lit("out"), "path", F.lit(OUTPUT_SUFFIX["ome_tiff"])).alias("out_path"))


@query(f"WITH {FILES} SELECT {SUFFIX} AS suffix, count(*) AS n_files, CAST(count_if({FORMAT} <> 'unsupported') AS BIGINT) AS n_known FROM files GROUP BY 1")
def candidate_counts(spark, sf_dir):
    return files_of(spark, sf_dir).groupBy(suffix("path").alias("suffix")).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(file_format("path") != "unsupported").alias("n_known"))


@query("SELECT page_id, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY string_split(url, '/'), page_id) AS place FROM pages")
def path_component_order(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("host", F.split_part("url", F.lit("/"), F.lit(3)))
    return numbered(pages, "place", by=["host"], order=[F.split("url", "/"), "page_id"]).select("page_id", "place")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def anti_referenced(spark, sf_dir):
    referenced = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return without_referenced(table(spark, sf_dir, "customer"), referenced, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_selected(spark, sf_dir):
    chosen = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(chosen, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query(
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NULL AS inspected_again, d.n_chars % 7 IS DISTINCT FROM CAST(l.toxic AS BIGINT) AS changed
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id"""
)
def snapshot_fallback(spark, sf_dir):
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"), F.lit(True).alias("known"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("known").isNull().alias("inspected_again"), (~(F.col("n_chars") % 7).eqNullSafe(F.col("toxic").cast("bigint"))).alias("changed"))


SLIDES = """s AS (SELECT p_partkey AS slide_id, CASE p_partkey % 3 WHEN 0 THEN 'brightfield' WHEN 1 THEN 'fluorescence' ELSE 'unknown' END AS modality, p_size % 2 = 0 AS native_planes, CASE WHEN p_size % 5 = 0 THEN 16 ELSE 8 END AS bit_depth,
  1 + CAST(p_size % 7 = 0 AS INT) AS n_field, 1 + CAST(p_size % 6 = 0 AS INT) AS n_z, 1 AS n_t, 1 + p_partkey % 4 AS n_channels FROM part)"""


def slides_of(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("slide_id"),
        F.when(k % 3 == 0, "brightfield").when(k % 3 == 1, "fluorescence").otherwise("unknown").alias("modality"),
        (s % 2 == 0).alias("native_planes"),
        F.when(s % 5 == 0, 16).otherwise(8).alias("bit_depth"),
        (F.lit(1) + (s % 7 == 0).cast("int")).alias("n_field"),
        (F.lit(1) + (s % 6 == 0).cast("int")).alias("n_z"),
        F.lit(1).alias("n_t"),
        (F.lit(1) + k % 4).alias("n_channels"),
    )


@query(
    f"""WITH {SLIDES}, f AS (SELECT slide_id, unnest(['ome_tiff', 'svs', 'fluorescence_svs', 'afi']) AS format, * EXCLUDE (slide_id) FROM s)
 SELECT slide_id, format, reason IS NULL AS allowed, coalesce(reason, '') AS reason FROM (SELECT slide_id, format, CASE
   WHEN format = 'ome_tiff' THEN NULL
   WHEN format = 'svs' THEN CASE WHEN modality = 'fluorescence' THEN 'fluorescence' WHEN modality <> 'brightfield' THEN 'unknown modality' END
   WHEN modality = 'brightfield' THEN 'not fluorescence' WHEN modality <> 'fluorescence' OR NOT native_planes THEN 'no independent planes'
   WHEN bit_depth <> 8 THEN 'bit depth' WHEN n_field <> 1 OR n_z <> 1 OR n_t <> 1 THEN 'axes'
   WHEN format = 'fluorescence_svs' AND n_channels <> 1 THEN 'channels' END AS reason FROM f)"""
)
def eligibility_matrix(spark, sf_dir):
    return allowed_outputs(slides_of(spark, sf_dir))


@query(
    """WITH o AS (SELECT *, CASE WHEN o_totalprice > 400000 THEN 'changed' WHEN o_orderstatus = 'P' THEN 'inspection_error' WHEN o_orderpriority = '5-LOW' THEN 'not_allowed' ELSE 'compatible' END AS status FROM orders)
 SELECT status, count(*) AS n, CAST(sum(CASE WHEN place <= 5 THEN o_orderkey END) AS BIGINT) AS first_five FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY o_orderkey) AS place FROM o) GROUP BY status"""
)
def compatibility_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", compatibility(changed=F.col("o_totalprice") > 400000, error=F.col("o_orderstatus") == "P", allowed=F.col("o_orderpriority") != "5-LOW").alias("status"))
    placed = numbered(rows, "place", by=["status"], order=["o_orderkey"])
    return placed.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("place") <= 5, F.col("o_orderkey"))).alias("first_five"))


@query("SELECT CAST(count_if(o_totalprice > 100000) AS BIGINT) AS success_count, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS failed_count, CAST(count_if(o_orderstatus IN ('O', 'X')) AS BIGINT) AS skipped_count, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS cancelled_count FROM orders")
def batch_counts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "skipped_incompatible").when(F.col("o_orderstatus") == "X", "not_started").otherwise("cancelled")
    return counts_of(table(spark, sf_dir, "orders").select((F.col("o_totalprice") > 100000).alias("success"), status.alias("status")))


@query("SELECT p_partkey, p_name || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.svs' AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS n FROM part)")
def name_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("suffix", F.lit(".svs"))
    return greedy_names(rows.select("p_partkey", "p_brand", "p_name", "suffix"), folder="p_brand", stem="p_name", suffix="suffix", order="p_partkey").select("p_partkey", "name")


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.afi' AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS n FROM part)")
def name_numbering(spark, sf_dir):
    """Names whose stems no suffix can collide with, numbered by a window without bringing a folder to one task."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("stem"), F.lit(".afi").alias("suffix"))
    return suffixed_names(rows, folder="p_brand", stem="stem", suffix="suffix", order=["p_partkey"]).select("p_partkey", "name")


@query("SELECT o_orderkey AS idx, 'converted' AS status, o_totalprice AS size FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'skipped_incompatible', NULL FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'not_started', NULL FROM orders WHERE o_orderstatus = 'P'")
def result_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    part = lambda letter, status, *more: orders.where(F.col("o_orderstatus") == letter).select(F.col("o_orderkey").alias("idx"), F.lit(status).alias("status"), *more)
    rows = part("F", "converted", F.col("o_totalprice").alias("size")).unionByName(part("O", "skipped_incompatible"), allowMissingColumns=True)
    return rows.unionByName(part("P", "not_started"), allowMissingColumns=True).orderBy("idx")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE CAST(o_custkey % 10 AS VARCHAR) END AS level_cell, CASE WHEN o_totalprice = 0 THEN '' ELSE printf('%.3f', o_totalprice / 7) END AS seconds_cell, o_custkey || 'x' || o_orderkey || '|' || o_custkey // 2 || 'x' || o_orderkey // 2 AS levels_cell FROM orders")
def report_format(spark, sf_dir):
    w, h = F.col("o_custkey"), F.col("o_orderkey")
    half = lambda c: F.call_function("div", c, F.lit(2).cast("bigint"))
    levels = F.array(F.struct(w.alias("w"), h.alias("h")), F.struct(half(w).alias("w"), half(h).alias("h")))
    joined = F.array_join(F.transform(levels, lambda s: F.concat(s.getField("w").cast("string"), F.lit("x"), s.getField("h").cast("string"))), "|")
    return table(spark, sf_dir, "orders").select("o_orderkey", blank_zero(w % 10).alias("level_cell"), blank_zero(F.col("o_totalprice") / 7, "%.3f").alias("seconds_cell"), joined.alias("levels_cell"))


@query("SELECT conv_id, text AS first_text, turn AS first_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n = 1")
def first_resource(spark, sf_dir):
    rows = latest(table(spark, sf_dir, "conversations"), key=["conv_id"], order=["turn", "role", "text"])
    return rows.select("conv_id", F.col("text").alias("first_text"), F.col("turn").alias("first_turn"))


@query("SELECT o_custkey AS item FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def required_items(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    need = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("item"))
    return need.subtract(orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("item")))


@query("SELECT p_brand, p_size, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE 'mixed' END AS codec, count(*) AS n FROM part GROUP BY p_brand, p_size")
def codec_mixed(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(codec_summary("p_type").alias("codec"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT conv_id, turn, min(role) AS name, min(length(text)) AS exposure FROM conversations GROUP BY 1, 2),
 o AS (SELECT conv_id, turn + CAST(conv_id % 3 = 0 AS BIGINT) AS turn, CASE WHEN turn % 2 = 0 THEN 'named ' || turn END AS name, turn % 4 = 1 AS has_color FROM c)
 SELECT coalesce(c.conv_id, o.conv_id) AS conv_id, coalesce(c.turn, o.turn) AS turn, CASE WHEN o.name IS NOT NULL THEN o.name ELSE c.name END AS name,
        CASE WHEN coalesce(o.has_color, false) THEN '#00FF00' ELSE '#FFFFFF' END AS color, CASE WHEN c.conv_id IS NULL THEN 'unknown channel' WHEN o.conv_id IS NULL THEN 'missing override' ELSE 'ok' END AS check_
 FROM c FULL JOIN o ON c.conv_id = o.conv_id AND c.turn = o.turn"""
)
def channel_override(spark, sf_dir):
    turn = F.col("turn")
    channels = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("name"), F.lit("#FFFFFF").alias("color"))
    given = channels.select("conv_id", (turn + (F.col("conv_id") % 3 == 0).cast("bigint")).alias("turn"), F.when(turn % 2 == 0, F.concat(F.lit("named "), turn.cast("string"))).alias("name"), F.when(turn % 4 == 1, "#00FF00").alias("color"))
    return channel_overrides(channels, given, ["conv_id", "turn"], ["name", "color"], {"color": "#FFFFFF"})


UNIT = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(("m", "cm", "mm", "um", "nm", "pm"))) + " END"


@query(
    f"SELECT p_partkey, unit, round(p_size * CASE unit WHEN 'm' THEN 1e6 WHEN 'cm' THEN 1e4 WHEN 'mm' THEN 1e3 WHEN 'um' THEN 1.0 WHEN 'nm' THEN 1e-3 ELSE 1e-6 END, 9) AS micrometres, round(p_size * CASE p_partkey % 3 WHEN 0 THEN 1e-3 WHEN 1 THEN 60.0 ELSE 1.0 END, 9) AS seconds FROM (SELECT *, {UNIT} AS unit FROM part)"
)
def unit_convert(spark, sf_dir):
    k = F.col("p_partkey")
    unit = F.element_at(F.array(*map(F.lit, ("m", "cm", "mm", "um", "nm", "pm"))), (k % 6 + 1).cast("int"))
    time = F.element_at(F.array(*map(F.lit, ("ms", "min", "s"))), (k % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", unit.alias("unit"), time.alias("time"))
    return rows.select("p_partkey", "unit", F.round(converted("p_size", "unit", LENGTH_UNITS), 9).alias("micrometres"), F.round(converted("p_size", "time", TIME_UNITS), 9).alias("seconds"))


@query(
    f"""WITH d AS (SELECT p_partkey, p_size, 'Lib v1' || chr(10) || 'size|AppMag = ' || printf('%.1f', p_size / 2.0) || '|Dye=' || p_name || '|mpp = 0.' || p_size AS text FROM part)
 SELECT p_partkey, trim(regexp_extract(text, '(?i)(?:^|[|\n])\\s*MPP\\s*=\\s*([^|\\r\\n]+)', 1)) AS mpp, trim(regexp_extract(text, '(?i)(?:^|[|\n])\\s*Dye\\s*=\\s*([^|\\r\\n]+)', 1)) AS dye,
   CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS magnification, CAST('0.' || p_size AS DOUBLE) AS pixel_size FROM d"""
)
def description_properties(spark, sf_dir):
    s = F.col("p_size")
    key = F.element_at(F.array(*map(F.lit, MAGNIFICATION_KEYS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("Lib v1\nsize|"), key, F.lit(" = "), F.format_string("%.1f", s / F.lit(2.0)), F.lit("|Dye="), "p_name", F.lit("|mpp = 0."), s.cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", description_property("text", "MPP").alias("mpp"), description_property("text", "Dye").alias("dye"), objective_power("text").alias("magnification"), pixel_size("text").alias("pixel_size"))


@query(
    r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(source || ' <' || lang || '>: ' || coalesce(text, ''), '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '\s+', '_', 'g') AS name FROM documents)
 SELECT doc_id, md5(regexp_replace(regexp_replace(name, '^[._]+', ''), '[._]+$', '')) AS name_md5, 'C' || printf('%02d', CAST(doc_id % 100 + 1 AS INT)) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '_' || source END AS channel FROM d JOIN documents USING (doc_id)"""
)
def safe_component_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    raw = F.concat("source", F.lit(" <"), "lang", F.lit(">: "), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.md5(safe_component(raw).cast("binary")).alias("name_md5"), channel_suffix(F.col("doc_id") % 100, F.concat(F.lit(" ."), "source", F.lit("_ ")), F.when(F.col("doc_id") % 3 == 0, "unknown").otherwise("source_metadata")).alias("channel"))


@query("SELECT p_partkey, greatest(1, least(8, coalesce(TRY_CAST(v AS BIGINT), 1))) AS parallel, greatest(1024, least(65536, coalesce(TRY_CAST(v || '00' AS BIGINT), 6144))) AS memory_mb FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'many' WHEN p_partkey % 7 = 0 THEN '-' || p_size ELSE CAST(p_size AS VARCHAR) END AS v FROM part)")
def clamp_option(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 == 0, "many").when(k % 7 == 0, F.concat(F.lit("-"), s)).otherwise(s).alias("v"))
    return rows.select("p_partkey", bounded_int("v", 1, 1, 8).alias("parallel"), bounded_int(F.concat("v", F.lit("00")), 6144, 1024, 65536).alias("memory_mb"))


@query("SELECT event_id, event_type, CAST(props->>'k' AS BIGINT) AS k, CAST(event_id * 1000003 AS VARCHAR) AS mtime_ns FROM events")
def json_round_trip(spark, sf_dir):
    made = F.to_json(F.struct(F.col("event_type").alias("type"), (F.col("event_id") * 1000003).cast("string").alias("mtime_ns"), F.from_json("props", "k bigint").getField("k").alias("k")))
    back = F.from_json("line", "type string, mtime_ns string, k bigint")
    rows = table(spark, sf_dir, "events").select("event_id", made.alias("line")).select("event_id", back.alias("r"))
    return rows.select("event_id", F.col("r.type").alias("event_type"), "r.k", "r.mtime_ns")


SIZES = "printf('%dx%d', p_size * 100, p_size * 80)"
PARTS = "printf('AppMag = %d|Filename = %s|MPP = %.6f|DisplayColor = 0|OriginalWidth = %d|OriginalHeight = %d|ICC Profile = sRGB', p_size % 3 * 20, p_name, (p_size % 4) / 8.0, p_size * 100, p_size * 80)"


@query(
    f"""SELECT p_partkey, 'Image Library ' || chr(13) || chr(10) || {SIZES} || ' [0,0 ' || {SIZES} || '] (240x240) JPEG/RGB Q=90|' || {PARTS} AS main,
  'Image Library ' || chr(13) || chr(10) || {SIZES} || ' [0,0 ' || {SIZES} || '] (240x240) -> ' || printf('%dx%d', p_size * 25, p_size * 20) || ' JPEG/RGB Q=90' AS level,
  'Image Library ' || chr(10) || {SIZES} || ' -> ' || printf('%dx%d', p_size, p_size) || ' - |' || {PARTS} AS thumbnail, 'Image Library ' || chr(10) || 'label ' || p_size || 'x100' AS label, 'Image Library ' || chr(10) || 'macro 100x' || p_size AS macro FROM part"""
)
def description_build(spark, sf_dir):
    """Descriptions of every kind of page."""
    s, library = F.col("p_size"), "Image Library"
    w, h, tile, codec = s * 100, s * 80, F.lit(240), F.lit("JPEG/RGB Q=90")
    named = ((s % 3) * 20, F.col("p_name"), (s % 4) / F.lit(8.0), F.lit("sRGB"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        aperio_description(library, w, h, tile, codec, *named).alias("main"),
        aperio_level_description(library, w, h, tile, codec, s * 25, s * 20).alias("level"),
        aperio_thumbnail_description(library, w, h, s, s, *named).alias("thumbnail"),
        aperio_associated_description(library, "label", s, F.lit(100)).alias("label"),
        aperio_associated_description(library, "macro", F.lit(100), s).alias("macro"),
    )


# ---------------------------------------------------------------- events

PROGRESS = "e AS (SELECT event_id AS seq, user_id AS job, event_type AS phase, value, least(100.0, greatest(0.0, value)) AS pct FROM events)"


@query(f"WITH {PROGRESS} SELECT seq, job, round(max(pct) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS file_progress, round(least(99.9, max(pct) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS batch_progress FROM e")
def progress_monotone(spark, sf_dir):
    return monotone_progress(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("job"), "value"))


@query(
    """WITH l AS (SELECT user_id AS file, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1)
 SELECT p AS phase_no, CAST(count_if(place > p) AS BIGINT) AS n_passed, CAST(count_if(place = p) AS BIGINT) AS n_active FROM l, range(0, 5) AS r(p) GROUP BY p"""
)
def phase_matrix(spark, sf_dir):
    order = ("signup", "view", "click", "purchase", "error")
    return matrix_of(table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.col("event_type").alias("phase")), order)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), key=["user_id"], order=[F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, event_type, left(props, 240) AS line FROM events ORDER BY event_id DESC LIMIT 300")
def log_tail(spark, sf_dir):
    return tail_of(table(spark, sf_dir, "events"), "event_id", 300).select("event_id", "event_type", F.left("props", F.lit(240)).alias("line"))


@query("SELECT user_id AS job, event_type AS stage, count(*) AS n, round(sum(value), 6) AS total_s, max(value) AS peak, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def job_timing(spark, sf_dir):
    return timing_of(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), "value"))


@query(
    "WITH e AS (SELECT event_id, floor(value)::BIGINT % 120 AS done, event_type FROM events) SELECT event_id, least(100, greatest(0, done)) AS percent, CASE WHEN done > 0 AND done < 100 THEN CAST(round(event_id % 1000 * (100.0 - done) / done, 0) AS BIGINT) END AS eta_s, CASE WHEN event_type LIKE '%view%' THEN 'reading' WHEN event_type LIKE '%click%' THEN 'writing' ELSE 'finishing' END AS phase FROM e"
)
def progress_display(spark, sf_dir):
    done = F.floor("value").cast("bigint") % 120
    return progress_fields(table(spark, sf_dir, "events").select("event_id", done.alias("done"), (F.col("event_id") % 1000).alias("elapsed"), "event_type"))


@query(
    """SELECT d.lang, count(*) AS n_files, CAST(count_if(l.doc_id IS NULL) AS BIGINT) AS n_uninspected, CAST(count_if(l.quality = 0) AS BIGINT) AS n_failed, coalesce(CAST(sum(l.toxic) AS BIGINT), 0) AS n_unknown_channels FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang"""
)
def inspection_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("known")), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("known").isNull()).alias("n_uninspected"), F.count_if(F.col("quality") == 0).alias("n_failed"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_unknown_channels"))


@query(r"SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n_files, min(page_id) AS first_page, CAST(count_if(contains(lower(url), 'blog')) AS BIGINT) AS n_found FROM pages GROUP BY 1")
def folder_groups(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(parent_folder("url").alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.min("page_id").alias("first_page"), F.count_if(F.contains(F.lower("url"), F.lower(F.trim(F.lit(" BLOG "))))).alias("n_found"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'a') AND NOT contains(url, 'zz')")
def path_search(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return found_by_text(pages, "url", "  A ").exceptAll(found_by_text(pages, "url", "zz"))


@query(
    """SELECT conv_id, count(*) AS n_channels, CAST(count_if(role = 'system') AS BIGINT) AS n_unknown FROM conversations GROUP BY conv_id HAVING count_if(role = 'system') > 0 OR count(*) > 6"""
)
def unknown_channels(spark, sf_dir):
    """Slides with a channel whose identity isn't known, or with many channels."""
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.when(F.col("role") == "system", "unknown").otherwise("source_metadata").alias("identity_source"))).alias("channels"))
    unknown = F.size(F.filter("channels", lambda c: c["identity_source"] == "unknown"))
    return listed.where(with_unknown_channel("channels") | (F.size("channels") > 6)).select("conv_id", F.size("channels").cast("bigint").alias("n_channels"), unknown.cast("bigint").alias("n_unknown"))


@query(
    f"""WITH {SLIDES} SELECT slide_id, modality = 'brightfield' AND native_planes AND n_field = 1 AS native_source, modality = 'brightfield' AND native_planes AND n_field = 1 AND bit_depth = 8 AS native_output_ready, native_planes AND bit_depth = 8 AND n_channels > 1 AS plane_passthrough FROM s"""
)
def capabilities(spark, sf_dir):
    return slides_of(spark, sf_dir).select("slide_id", *capability_columns(levels=(F.col("modality") == "brightfield") & F.col("native_planes"), planes=F.col("native_planes")))


@query(
    """WITH s AS (SELECT p_partkey AS slide_id, 20000 + p_size * 3000 AS w, 15000 + (p_partkey % 70) * 1300 AS h, 60 + p_partkey % 40 AS q, p_partkey % 2 = 0 AS j2k FROM part),
 l AS (SELECT *, unnest([1, 4, 16, 32]) AS f FROM s),
 b AS (SELECT slide_id, sum(ceil((w // f) / 240.0) * ceil((h // f) / 240.0) * 57600 * (CASE WHEN j2k THEN 0.50::DOUBLE + 0.035::DOUBLE * q ELSE 0.15::DOUBLE + 0.010::DOUBLE * q END)) + 67108864 AS b FROM l GROUP BY slide_id)
 SELECT slide_id, CAST(round(b / 1000000) AS BIGINT) AS megabytes, b > 3.2e9 AS big FROM b"""
)
def bigtiff_decision(spark, sf_dir):
    """Whether a file needs 64-bit offsets, by codec and quality of its tiles."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    slides = table(spark, sf_dir, "part").select(k.alias("slide_id"), (size * 3000 + 20000).alias("w"), ((k % 70) * 1300 + 15000).alias("h"), (k % 40 + 60).alias("q"))
    levels = slides.withColumn("f", F.explode(F.array(*(F.lit(x).cast("bigint") for x in (1, 4, 16, 32))))).select("slide_id", "q", F.call_function("div", "w", "f").alias("width"), F.call_function("div", "h", "f").alias("height"))
    density = F.when(F.col("slide_id") % 2 == 0, bytes_per_pixel("j2k", F.col("q"))).otherwise(bytes_per_pixel("jpeg", F.col("q")))
    sized = estimated_bytes(levels, 240, density)
    return sized.select("slide_id", F.round(F.col("bytes") / 1000000).cast("bigint").alias("megabytes"), (F.col("bytes") > CLASSIC_LIMIT).alias("big"))


@query(
    f"""WITH {SLIDES}, f AS (SELECT s.*, f.format, CAST(n_channels * 100 + 50 AS BIGINT) AS segments, CASE WHEN f.format = 'svs' THEN CAST(n_z = 2 AS BIGINT) + CAST(n_field = 2 AS BIGINT) ELSE 0 END AS associated, 1 + CAST(native_planes AS BIGINT) AS tail FROM s, (VALUES ('svs'), ('ome_tiff')) f(format))
 SELECT slide_id, format, segments, associated, tail, round(100.0::DOUBLE * (n_channels * 50) / (segments + associated + tail), 6) AS percent FROM f"""
)
def progress_units(spark, sf_dir):
    """Weighted units of a file's work, and the share done when half of its first segments are."""
    slides = slides_of(spark, sf_dir).withColumn("format", F.explode(F.array(F.lit("svs"), F.lit("ome_tiff"))))
    svs = F.col("format") == "svs"
    units = work_units(segments=F.col("n_channels") * 100 + 50, label=svs & (F.col("n_z") == 2), macro=svs & (F.col("n_field") == 2), finalise=F.col("native_planes"), validate=F.lit(False))
    rows = slides.select("slide_id", "format", "n_channels", *(v.cast("bigint").alias(k) for k, v in units.items()))
    return rows.select("slide_id", "format", "segments", "associated", "tail", F.round(F.lit(100.0) * (F.col("n_channels") * 50) / (F.col("segments") + F.col("associated") + F.col("tail")), 6).alias("percent"))


@query(
    f"""WITH {SLIDES} SELECT slide_id, CASE WHEN modality = 'fluorescence' OR n_field > 1 OR n_channels > 1 OR n_z > 1 OR n_t > 1 OR bit_depth > 8
  THEN printf('fields=%d, C=%d, Z=%d, T=%d, bit_depth=%d', n_field, n_channels, n_z, n_t, bit_depth) ELSE '' END AS omitted FROM s"""
)
def omitted_data(spark, sf_dir):
    return slides_of(spark, sf_dir).select("slide_id", F.coalesce(omitted_planes(), F.lit("")).alias("omitted"))


@query(
    """WITH a AS (SELECT doc_id % 500 AS slide_id, source AS name, min(doc_id) AS ref FROM documents WHERE lang = 'fr' GROUP BY 1, 2), b AS (SELECT doc_id % 500 AS slide_id, source AS name, min(doc_id) AS ref FROM documents WHERE lang = 'en' GROUP BY 1, 2)
 SELECT coalesce(a.slide_id, b.slide_id) AS slide_id, coalesce(a.name, b.name) AS name, coalesce(a.ref, b.ref) AS ref FROM a FULL JOIN b ON a.slide_id = b.slide_id AND a.name = b.name"""
)
def associated_resolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("slide_id"), F.col("source").alias("name"), "lang", "doc_id")
    place = lambda lang: docs.where(F.col("lang") == lang).groupBy("slide_id", "name").agg(F.min("doc_id").alias("ref"))
    return resolved_resources(place("fr"), place("en"), key=["slide_id", "name"])


@query("SELECT p_brand, array_to_string(list(p_type ORDER BY first), ',') AS kinds FROM (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY 1, 2) GROUP BY p_brand")
def ordered_distinct(spark, sf_dir):
    firsts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "p_type")))
    return firsts.groupBy("p_brand").agg(F.array_join(F.transform(listed, lambda s: s.getField("p_type")), ",").alias("kinds"))
