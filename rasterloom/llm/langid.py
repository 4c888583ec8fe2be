"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to 3 lower-cased characters, words set off by a blank) of all
rows with a non-null ``lang``: each task adds counts in dense arrays of fixed size and emits their
non-zero cells, Spark sums them. The model is a log-probability matrix with 2**bits rows and a column
for each language. A batch is scored as a sparse matrix: hashed n-grams of all its texts gather rows
of the matrix and are summed by text.

What is broadcast at once is a block of at most ``block`` languages. A corpus with more labels is
scored block by block, each pass carrying on the best language so far and the sum that makes the
posterior, so results don't depend on the size of blocks.

Cases: null text or a text without any letter: ``und`` with score 0; empty training set: ``und``
everywhere; ties: the first language in order of its name; texts of any length: whole, by slices of
several texts; repeated rows: each gets its own result; empty table: no rows; extra columns, whatever
their names: ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, code_points, extended, framed, has_text, mix64, prepare, stored, text_of, text_slices

ORDERS = (1, 2, 3)
SPACE = 32


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # 2**bits x languages
    prior: np.ndarray
    bits: int


def hashed_ngrams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the text of each, and which texts have a letter."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lettered = pc.match_substring_regex(lowered, r"\pL").to_numpy(zero_copy_only=False)
    points, at = code_points(framed(lowered, " ", " "))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))
    points = np.where((points >= 9) & (points <= 13), np.uint32(SPACE), points)
    points = np.where((points >= 48) & (points <= 57), np.uint32(48), points).astype(np.uint64)
    hashes, docs = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        rolling = rolling[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            inside = doc[: len(doc) - n + 1] == doc[n - 1 :]
            hashes.append((mix64(rolling[inside]) >> np.uint64(64 - bits)).astype(np.int32))
            docs.append(doc[: len(doc) - n + 1][inside])
    return np.concatenate(hashes), np.concatenate(docs), lettered


def fit_language_models(train: DataFrame, *, bits: int = 17, smoothing: float = 0.1, block: int = 256) -> list[LanguageModel]:
    """Learn from columns text and lang (rows with a null in either don't count): a model for each block
    of languages, in order of their names, with priors over all of them."""
    spark = prepare(train.sparkSession)
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each label
    languages = sorted(found)
    size, order, total = 1 << bits, {x: i for i, x in enumerate(languages)}, sum(found.values())
    if not languages:
        return []

    def count(parts):
        cells = {}

        def emit():
            for k, c in cells.items():
                hit = np.flatnonzero(c)
                yield batches(("k", np.full(len(hit), k, np.int32)), ("h", hit.astype(np.int32)), ("c", c[hit].astype(np.int64)))
            cells.clear()

        for batch in parts:
            text, lang = batch.column(0), batch.column(1)
            for a, b in text_slices(text, 1 << 20):
                h, doc, _ = hashed_ngrams(text.slice(a, b - a), bits)
                label = np.array([order[x] for x in lang.slice(a, b - a).to_pylist()], np.int32)[doc]
                for k in np.unique(label):
                    cells[k] = cells.get(k, 0) + np.bincount(h[label == k], minlength=size)
                    if len(cells) >= 64:  # 64 MB of counts
                        yield from emit()
        yield from emit()

    cells = stored(rows.mapInArrow(count, "k int, h int, c long").groupBy("k", "h").agg(F.sum("c").alias("c")), "ngrams")
    models = []
    for first in range(0, len(languages), block):
        names = languages[first : first + block]
        # at most 2**bits cells for each language of a block reach the driver, whatever the corpus
        own = cells.where(F.col("k").between(first, first + len(names) - 1)).toArrow()
        c = np.full((size, len(names)), smoothing)
        c[own["h"].to_numpy(), own["k"].to_numpy() - first] += own["c"].to_numpy()
        prior = np.log(np.array([found[x] for x in names], float) / total)
        models.append(LanguageModel(names, np.log(c / c.sum(0)).astype(np.float32), prior, bits))
    return models


STATE = "__best string, __value double, __most double, __sum double, __lettered boolean"


def score_texts(model: LanguageModel, texts: pa.Array, before: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Best language and its log-joint, and what makes the posterior: the greatest evenly weighted
    log-joint and the sum of all relative to it. ``before`` is the same from earlier blocks of languages.

    The posterior is of the mean evidence of an n-gram, raised to the root of their number, so that
    long texts don't all end at 1."""
    h, doc, lettered = hashed_ngrams(texts, model.bits)
    n = np.bincount(doc, minlength=len(texts)).astype(float)
    total = np.stack([np.bincount(doc, weights=model.log_prob[:, k][h], minlength=len(texts)) for k in range(len(model.languages))], 1) + model.prior
    best = total.argmax(1)
    value, names = total[np.arange(len(total)), best], np.array(model.languages, object)[best]
    even = total / np.sqrt(np.maximum(n, 1))[:, None]
    most = even.max(1)
    share = np.exp(even - most[:, None]).sum(1)
    if before is not None:
        old_names, old_value, old_most, old_share, _ = before
        keep = old_value >= value
        names, value = np.where(keep, old_names, names), np.where(keep, old_value, value)
        high = np.maximum(most, old_most)
        share, most = share * np.exp(most - high) + old_share * np.exp(old_most - high), high
    return names, value, most, share, lettered


def predict_language(docs: DataFrame, models: list[LanguageModel], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with lang_pred and score for its text."""
    if not models:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sc = docs.sparkSession.sparkContext
    added = [] if has_text(keep) else [F.col("text").alias("__text")]
    carried_on = [*keep, *(["__text"] if added else [])]
    rows = docs.select(*keep, *added)
    for number, model in enumerate(models):
        shared = sc.broadcast(model)

        def score(parts, shared=shared, first=number == 0):
            for batch in parts:
                text = text_of(batch, carried_on, len(keep))
                for a, b in text_slices(text, 1 << 20):
                    own = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns)]
                    old = None if first else tuple(x.to_numpy(zero_copy_only=False) for x in own[len(carried_on) :])
                    made = score_texts(shared.value, text.slice(a, b - a), old)
                    state = [pa.array(made[0], pa.string()), *(pa.array(x) for x in made[1:])]
                    yield pa.RecordBatch.from_arrays([*own[: len(carried_on)], *state], names=[*carried_on, *STATE_NAMES])

        rows = rows.mapInArrow(score, extended(rows, carried_on, STATE))
    lettered = F.col("__lettered")
    return rows.select(*keep, F.when(lettered, F.col("__best")).otherwise("und").alias("lang_pred"), F.when(lettered, 1 / F.col("__sum")).otherwise(0.0).alias("score"))


STATE_NAMES = [x.split()[0] for x in STATE.split(", ")]


def held_out(modulus: int, remainder: int):
    """Whether a document is held out: crc32 of its id as text, mod ``modulus``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify_languages(docs: DataFrame, keep: list[str] | None = None, *, block: int = 256) -> DataFrame:
    """Columns keep (doc_id), held_out, lang_pred, score of every row; learns from the rows that aren't held out."""
    prepare(docs.sparkSession)
    keep = keep or ["doc_id"]
    marked = docs.withColumn("held_out", held_out(4, 2))
    models = fit_language_models(marked.where(~F.col("held_out")), block=block)
    return predict_language(marked, models, [*keep, "held_out"])
