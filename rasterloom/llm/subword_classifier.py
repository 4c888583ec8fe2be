"""Quality classifier: supervised subword embeddings.

A document is the average, over its words, of learned vectors for hashed features: the word
itself, its character 3- to 5-grams, and the pair it makes with a word that repeats it. A softmax
over two classes sits on top; vectors and softmax are trained by stochastic gradient descent in
numpy. Training takes at most ``max_train`` labelled documents (by a hash of the id), which a
single task reads; scoring runs over all documents and looks up each distinct word of a slice once.

Cases: null or empty text: the score of the bias alone; no labelled training document or only one
class: every score is that class's share (0.5 without any); ties at 0.5: predicted 1; texts of any
length: whole, by slices of several texts (training texts add up to at most ``max_bytes``, whole ones
in order of the hash); repeated rows: each gets its own result; labels that occur twice for a document:
each counts; empty tables: no rows; extra columns, whatever their names: ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Words, code_points, framed, hash_forms, mix64, prepare, text_slices

GRAMS = (3, 4, 5)


@dataclass
class SubwordModel:
    bits: int
    vectors: np.ndarray  # 2**bits x dim
    out: np.ndarray  # dim x 2
    bias: np.ndarray  # 2


def features_of_forms(forms: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and where each word's begin (one more at the end)."""
    shift = np.uint64(64 - bits)
    points, at = code_points(framed(forms, "<", ">"))
    points = points.astype(np.uint64)
    owner = np.repeat(np.arange(len(forms)), np.diff(at))
    feature, word = [(hash_forms(forms) >> shift).astype(np.int32)], [np.arange(len(forms))]
    rolling = np.zeros(len(points) + 1, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling = rolling[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
            feature.append((mix64(rolling[inside]) >> shift).astype(np.int32))
            word.append(owner[: len(owner) - n + 1][inside])
    feature, word = np.concatenate(feature), np.concatenate(word)
    order = np.argsort(word, kind="stable")
    return feature[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(forms)))])


def repeats(words: Words) -> np.ndarray:
    """For each text, how many words repeat the word before."""
    same = np.zeros(len(words.codes), np.int64)
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return words.per_doc(same)


def repeat_feature(bits: int) -> int:
    return int(mix64(np.array([7], np.uint64))[0] >> np.uint64(64 - bits))


def document_matrix(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse average features of texts: feature, weight, text, sorted by text."""
    feature, at = features_of_forms(words.forms, bits)
    size = np.diff(at)
    pair, n = np.unique(words.doc.astype(np.int64) * len(words.forms) + words.codes, return_counts=True)
    doc, form = pair // max(1, len(words.forms)), pair % max(1, len(words.forms))
    weight = n / size[form] / words.counts[doc]
    reach = size[form]
    index = np.repeat(at[form] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
    f, w, d = feature[index], np.repeat(weight, reach), np.repeat(doc, reach)
    again = repeats(words)
    has = np.flatnonzero(again)
    f, w, d = np.concatenate([f, np.full(len(has), repeat_feature(bits), f.dtype)]), np.concatenate([w, again[has] / words.counts[has]]), np.concatenate([d, has])
    key, inverse = np.unique(d.astype(np.int64) << bits | f, return_inverse=True)
    return (key & ((1 << bits) - 1)).astype(np.int32), np.bincount(inverse, weights=w).astype(np.float32), key >> bits


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_model(texts: pa.Array, labels: np.ndarray, *, bits: int = 16, dim: int = 8, epochs: int = 6, rate: float = 2.0, batch: int = 32, seed: int = 5) -> SubwordModel:
    rng = np.random.default_rng(seed)
    size = 1 << bits
    model = SubwordModel(bits, rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32), np.zeros((dim, 2), np.float32), np.zeros(2, np.float32))
    share = np.bincount(labels, minlength=2) / max(1, len(labels)) if len(labels) else np.array([0.5, 0.5])
    model.bias[:] = np.log(np.clip(share, 1e-6, 1))
    if len(np.unique(labels)) < 2:
        return model
    docs = []
    for a, b in text_slices(texts):
        f, w, d = document_matrix(Words(texts.slice(a, b - a)), bits)
        ends = np.searchsorted(d, np.arange(b - a + 1))
        docs += [(f[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]) for i in range(b - a)]
    weight = 0.5 / share[labels]  # both classes count alike
    steps, done = epochs * -(-len(docs) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            lr = rate * (1 - done / steps)
            done += 1
            f = np.concatenate([docs[j][0] for j in own])
            w = np.concatenate([docs[j][1] for j in own])
            n = [len(docs[j][0]) for j in own]
            d = np.repeat(np.arange(len(own)), n)
            part = model.vectors[f] * w[:, None]
            hidden = np.stack([np.bincount(d, weights=part[:, k], minlength=len(own)) for k in range(dim)], 1).astype(np.float32)
            p = softmax(hidden @ model.out + model.bias)
            p[np.arange(len(own)), labels[own]] -= 1
            p *= weight[own][:, None] / len(own)
            back = p @ model.out.T
            model.out -= lr * (hidden.T @ p)
            model.bias -= lr * p.sum(0)
            # gradient of each feature's vector; a feature that several documents share adds up
            step = (back[d] * w[:, None]) * (lr * len(own))
            u, inverse = np.unique(f, return_inverse=True)
            model.vectors[u] -= np.stack([np.bincount(inverse, weights=step[:, k]) for k in range(dim)], 1).astype(np.float32)
    # the classes were weighted alike; the bias takes their shares back in part, which keeps 0.5 a fair line
    return model


def score_texts(model: SubwordModel, texts: pa.Array) -> np.ndarray:
    """Probability of class 1 for each text of a slice."""
    words = Words(texts)
    hidden = np.zeros((len(texts), model.vectors.shape[1]))
    if len(words.codes):
        feature, at = features_of_forms(words.forms, model.bits)
        size = np.diff(at)
        again = repeats(words)
        extra = model.vectors[repeat_feature(model.bits)]
        n = np.maximum(words.counts, 1)
        for k in range(hidden.shape[1]):
            form = np.add.reduceat(model.vectors[:, k][feature], at[:-1]) / size
            hidden[:, k] = (words.per_doc(form[words.codes]) + again * extra[k]) / n
    return softmax(hidden @ model.out + model.bias)[:, 1]


def fit_classifier(labelled: DataFrame) -> SubwordModel:
    """Train on all rows of labelled (text, label), which the caller bounded; one task does it, so that
    texts don't come to the driver."""
    prepare(labelled.sparkSession)

    def train(parts):
        tables = [pa.Table.from_batches([b]) for b in parts]
        table = pa.concat_tables(tables) if tables else None
        texts = pc.fill_null(table["text"].combine_chunks(), "") if table else pa.array([], pa.string())
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        labels = table["label"].to_numpy().astype(np.int64) if table else np.zeros(0, np.int64)
        order = np.argsort(hash_forms(texts), kind="stable")  # alike, however rows arrive
        model = train_model(texts.take(pa.array(order)), labels[order])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = labelled.select("text", "label").repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else train_model(pa.array([], pa.string()), np.zeros(0, np.int64))


def classify(docs: DataFrame, model: SubwordModel, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def score(parts):
        for batch in parts:
            text = batch.column(len(keep))
            for a, b in text_slices(text):
                p = score_texts(shared.value, text.slice(a, b - a))
                own = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(score, f"{kinds}, score double, predicted int")


def bounded_sample(docs: DataFrame, labels: DataFrame, max_train: int, max_bytes: int) -> DataFrame:
    """doc_id, label of the first max_train labelled rows by a hash of the id, as far as their texts add
    up to at most max_bytes. Only ids, labels and sizes take part in the choice."""
    chosen = labels.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "label").limit(max_train)
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    sizes = sizes.groupBy("doc_id").agg(F.sum("n").alias("n"))
    # at most max_train rows
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chosen.join(sizes, "doc_id").withColumn("n", F.sum("n").over(order)).where(F.col("n") <= max_bytes).select("doc_id", "label")


def score_quality(docs: DataFrame, labels: DataFrame, *, max_train: int = 6000, max_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by labels.quality of those that aren't held out."""
    from .langid import held_out

    marked = docs.select("doc_id", "text", held_out(3, 1).alias("held_out"))
    known = labels.where(~held_out(3, 1) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    learned = marked.where(~F.col("held_out"))
    # at most max_train rows
    train = learned.join(F.broadcast(bounded_sample(learned, known, max_train, max_bytes)), "doc_id")
    return classify(marked, fit_classifier(train), ["doc_id", "held_out"])
