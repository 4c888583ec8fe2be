"""Quality rules: perplexity under a modified Kneser-Ney model of character n-grams.

Word, symbol, line and repetition counts give the base rule. The verdict proper comes from a
character model for each language: Spark counts n-grams of all reference texts (those which pass
simple shape rules); discounts, continuation counts, totals and interpolated probabilities are
relational, over every n-gram and every language, with no bound on either. N-grams that occur only
in other texts are carried along with a count of zero, so that each n-gram of any text ends with its
probability, back-off included. A text is rejected if its log-perplexity lies outside its language's
band, below (machine-like) or above (noise). Bands are the middle of the reference texts plus or
minus a width that grows for short texts; reference texts are judged by a model that has seen them.

Probabilities come to the texts in sorted hash arrays. Up to ``BROADCAST_NGRAMS`` n-grams they are one
broadcast array; beyond that the array lies in shards by ranges of the hash: texts are dealt into
chunks of bounded size, each chunk asks every shard for its distinct n-grams once, and answers come
back in the order asked. Both ways give the same scores.

Cases: null or empty text: no words, base_failed; null lang: language ``und``; a language without
reference texts: its texts aren't rejected by a band (their log_ppl is that of equal chances); texts
of any length: read in whole, by slices of several texts; ties: a text at a band's very edge is kept;
repeated rows: each is judged; a table without rows: no rows; extra columns, whatever their names:
ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ROW, Words, batches, code_points, extended, framed, has_text, mix64, plain, prepare, stored, text_of, text_slices

ORDER = 5
CODE_BITS, CODE_MASK, CODE_POINTS = 21, (1 << 21) - 1, 0x110000
BASE = np.uint64(0x9E3779B97F4A7C15)
BROADCAST_NGRAMS, SHARD_NGRAMS, CHUNK_BYTES = 4_000_000, 1_000_000, 16 << 20
#: Bytes of text that a task works on at once, n-grams it lets lie before it merges them with those it holds, and
#: n-grams it holds at most before it emits them. Two workers share what an executor's heap leaves them.
SLICE_BYTES, LOOSE_NGRAMS, HELD_NGRAMS = 1 << 19, 400_000, 1_200_000
START = 1  # stands before a text; no text has it as a code point of its own but \x01


# ---------------------------------------------------------------- counts of a text


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a slice, and
    n_upper and n_letters for the reference rule."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = Words(texts)
    length = pc.utf8_length(words.forms).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"n_words": words.counts.astype(np.int64), "word_chars": words.per_doc(length[words.codes])}
    out["n_symbols"] = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    out["n_dup_lines"] = repeated_lines(texts)
    out["n_repeat_words"] = words_in_repeats(words)
    points, at = code_points(words.forms)
    kind = letter_kinds()[np.minimum(points, 0xFFFF)]
    for name, bit in (("n_upper", 1), ("n_letters", 2)):
        run = np.concatenate([[0], np.cumsum(kind & bit > 0)])
        out[name] = words.per_doc((run[at[1:]] - run[at[:-1]])[words.codes])
    return out


@lru_cache(maxsize=1)
def letter_kinds() -> np.ndarray:
    """For each code point of the basic plane: 1 for a capital, plus 2 for a letter; others count as the last one's kind."""
    return np.array([chr(i).isupper() + 2 * chr(i).isalpha() for i in range(1 << 16)], np.uint8)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    lists = pc.split_pattern(texts, "\n")
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    lines = lists.flatten().dictionary_encode()
    solid = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    keep = solid[code] if len(code) else np.zeros(0, bool)
    code, doc = code[keep], doc[keep]
    first = np.unique(doc * len(lines.dictionary) + code) // max(1, len(lines.dictionary))
    return np.bincount(doc, minlength=len(texts)) - np.bincount(first, minlength=len(texts))


def words_in_repeats(words: Words, size: int = 5) -> np.ndarray:
    """Words covered by a window of ``size`` words that occurs at least twice in its text."""
    n = len(words.codes)
    covered = np.zeros(n + 1, np.int64)
    if n >= size:
        # a polynomial over the mixed numbers of a window's words; the text's number is mixed in last
        code = mix64(np.arange(len(words.forms), dtype=np.uint64))[words.codes]
        key = code[: n - size + 1].copy()
        for k in range(1, size):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += code[k : n - size + 1 + k]
        key += mix64(np.arange(len(words.counts), dtype=np.uint64) + np.uint64(1))[words.doc[: n - size + 1]]
        inside = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
        key = key[inside]
        order = np.argsort(key)
        sorted_key = key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        start = inside[order[twice]]
        np.add.at(covered, start, 1)
        np.add.at(covered, start + size, -1)
    return words.per_doc((np.cumsum(covered[:-1]) > 0).astype(np.int64))


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def is_reference(c: dict[str, np.ndarray]) -> np.ndarray:
    """Texts the model learns from: base rule passed, at most one symbol for ten words, at most 30 % capitals."""
    return ~base_failed(c) & (10 * c["n_symbols"] <= c["n_words"]) & (10 * c["n_upper"] <= 3 * c["n_letters"])


# ---------------------------------------------------------------- n-grams


@lru_cache(maxsize=1)
def symbol_numbers() -> np.ndarray:
    """A mixed number for each code point."""
    return mix64(np.arange(CODE_POINTS, dtype=np.uint64) + np.uint64(1))


def numbers_of_grams(high: np.ndarray, low: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Hash of each n-gram of a language from its packed code points (see ``text_grams``)."""
    symbols, mask, bits = symbol_numbers(), np.int64(CODE_MASK), np.int64(CODE_BITS)
    out = symbols[high >> bits] * BASE + symbols[high & mask]
    for part in (low >> (2 * bits), (low >> bits) & mask, low & mask):
        out = out * BASE + symbols[part]
    return mix64(out + lang.astype(np.uint64))


def text_grams(texts: pa.Array, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each character of the texts: hash of the n-gram of the highest order that ends there, its
    place in the returned code points, and its text. ORDER - 1 start symbols stand before a text."""
    points, at = code_points(framed(texts, chr(START) * (ORDER - 1)))
    n = len(points) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), points
    symbols = symbol_numbers()[points]
    key = symbols[:n].copy()
    for k in range(1, ORDER):
        key *= BASE
        key += symbols[k : n + k]
    # n-grams that end in the start symbols of a text are left out
    real = np.ones(n, bool)
    for k in range(ORDER - 1):
        ends = at[:-1] + k - (ORDER - 1)
        real[ends[(ends >= 0) & (ends < n)]] = False
    place = np.flatnonzero(real)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at) - (ORDER - 1))
    return mix64(key[place] + lang.astype(np.uint64)[doc]), place, doc, points


def packed_points(points: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the n-grams at ``place``: the first two in one number, the last three in another."""
    p = [points[place + i].astype(np.int64) for i in range(ORDER)]
    return p[0] << CODE_BITS | p[1], p[2] << (2 * CODE_BITS) | p[3] << CODE_BITS | p[4]


class HashArray:
    """Sorted hashes with values beside them; an index over the upper bits bounds each search."""

    def __init__(self, hashes: np.ndarray, *values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], [v[order] for v in values]
        self.bits = max(1, int(np.ceil(np.log2(max(2, len(hashes))))) + 1)
        top = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(top, minlength=1 << self.bits))]).astype(np.int32)

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashed), -1, np.int32)
        top = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        # most stand first in their range
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashed
        out = np.where(hit, at, np.int32(-1))
        live = np.flatnonzero(~hit & (at + 1 < end))
        at, end, hashed = at[live] + 1, end[live], hashed[live]
        while len(live):
            hit = self.hashes[at] == hashed
            out[live[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            live, at, end, hashed = live[more], at[more], end[more], hashed[more]
        return out


# ---------------------------------------------------------------- the model, in Spark


def language() -> F.Column:
    return F.coalesce(F.col("lang"), F.lit("und"))


def slice_grams(text: pa.Array, lang: np.ndarray) -> list[np.ndarray]:
    """key, k, hi, lo, c of the n-grams of a slice of texts, each once; nothing if there are none."""
    good = is_reference(text_counts(text))
    key, place, doc, points = text_grams(text, lang)
    if not len(key):
        return []
    unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    c = np.bincount(inverse, weights=good[doc], minlength=len(unique)).astype(np.int64)
    return [unique, lang[doc[first]], *packed_points(points, place[first]), c]


def counted_grams(parts):
    """k, hi, lo, c of the n-grams of a task's texts; mostly each once."""
    held: list[list[np.ndarray]] = []  # key, k, hi, lo, c; the first ones are merged

    def merge() -> None:
        """One array for each column; a column at a time, so that little lies in memory twice."""
        columns = [list(x) for x in zip(*held)]
        held.clear()
        _, first, inverse = np.unique(np.concatenate(columns[0]), return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(columns.pop()), minlength=len(first)).astype(np.int64)
        del inverse
        made = []
        for _ in range(len(columns)):
            made.append(np.concatenate(columns.pop(0))[first])
        held.append([*made, total])

    def rows():
        merge()
        _, k, hi, lo, c = held.pop()
        for a in range(0, len(k), 1 << 16):
            own = slice(a, a + (1 << 16))
            yield batches(("k", k[own]), ("hi", hi[own]), ("lo", lo[own]), ("c", c[own]))

    loose = 0
    for batch in parts:
        text, lang = batch.column(0), batch.column(1).to_numpy()
        for a, b in text_slices(text, SLICE_BYTES):
            found = slice_grams(text.slice(a, b - a), lang[a:b])
            if not found:
                continue
            held.append(found)
            loose += len(found[0])
            if loose > LOOSE_NGRAMS:
                merge()
                loose = 0
                if len(held[0][0]) > HELD_NGRAMS:
                    yield from rows()
    if held:
        yield from rows()
    pa.default_memory_pool().release_unused()


def count_grams(docs: DataFrame) -> DataFrame:
    """k (hash of the language), hi, lo (code points), c: how often each n-gram of any text occurs in
    reference texts, zero for those which occur in other texts only. Tasks sum before they emit."""

    found = docs.select("text", F.xxhash64(language()).alias("k")).mapInArrow(counted_grams, "k long, hi long, lo long, c long")
    return found.groupBy("k", "hi", "lo").agg(F.sum("c").alias("c"))


def discount(n1, n2, n3, n4) -> list[F.Column]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, from the numbers of
    n-grams that occur once, twice, three and four times; fixed ones where there are none."""
    y = n1 / (n1 + 2 * n2)
    bounded = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    made = [bounded(1 - 2 * y * n2 / n1, 0.05, 0.95), bounded(2 - 3 * y * n3 / n2, 0.1, 1.9), bounded(3 - 4 * y * n4 / F.greatest(n3, F.lit(1)), 0.15, 2.85)]
    return [F.when((n1 > 0) & (n2 > 0), d).otherwise(F.lit(x)) for d, x in zip(made, (0.5, 0.75, 1.0))]


def gram_log_probabilities(docs: DataFrame) -> DataFrame:
    """k, hi, lo, logp (natural) of each n-gram of the highest order that occurs in any text."""
    levels = {ORDER: stored(count_grams(docs), "ngrams")}
    mask = lambda n: F.col("lo").bitwiseAND(F.lit((1 << (CODE_BITS * n)) - 1))
    #: an n-gram without its first symbol, and without its last
    shorter = lambda n: [F.col("k"), F.col("hi").bitwiseAND(F.lit(CODE_MASK)).alias("hi") if n == 4 else F.lit(0).cast("long").alias("hi"), mask(min(n, 3)).alias("lo")]
    for n in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols that stand before
        level = levels[n + 1].select(*shorter(n), "c").groupBy("k", "hi", "lo").agg(F.count_if(F.col("c") > 0).alias("c"))
        levels[n] = stored(level, "ngrams")  # each step is a small plan of its own, which the driver soon forgets
    below = None
    for n in range(1, ORDER + 1):
        level = levels[n]
        ones = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        # a row for each language, read from a file whose size decides whether it is broadcast
        told = stored(level.groupBy("k").agg(*ones).select("k", *(d.alias(f"d{i}") for i, d in enumerate(discount(*(F.col(f"n{i}") for i in (1, 2, 3, 4))), 1))), "discounts")
        each = level.withColumn("h", F.shiftright("lo", CODE_BITS)).join(told, "k")
        # sums of whole numbers, so that no order of rows changes a bit
        by = [F.count_if(F.col("c") == 1).alias("m1"), F.count_if(F.col("c") == 2).alias("m2"), F.count_if(F.col("c") > 2).alias("m3")]
        context = level.withColumn("h", F.shiftright("lo", CODE_BITS)).groupBy("k", "hi", "h").agg(F.sum("c").alias("total"), *by)
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.when(F.col("c") > 0, (F.col("c") - cut) / F.col("total")).otherwise(0.0)
        left = F.col("m1") * F.col("d1") + F.col("m2") * F.col("d2") + F.col("m3") * F.col("d3")
        gamma = F.when(F.col("total") > 0, left / F.col("total")).otherwise(1.0)
        made = each.join(context, ["k", "hi", "h"]).select("k", "hi", "lo", own.alias("own"), gamma.alias("gamma"))
        if below is None:
            p = F.col("own") + F.col("gamma") / F.lit(float(CODE_POINTS))
        else:
            key = [x.alias(f"b_{c}") for x, c in zip(shorter(n - 1), ("k", "hi", "lo"))]
            made = made.select("*", *key[1:]).join(below, ["k", "b_hi", "b_lo"])
            p = F.col("own") + F.col("gamma") * F.col("b_p")
        made = stored(made.select("k", "hi", "lo", p.alias("p")), "chances")
        below = made.select("k", F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), F.col("p").alias("b_p"))
    return made.select("k", "hi", "lo", F.log("p").cast("float").alias("logp"))


# ---------------------------------------------------------------- scores


def judged_slice(text: pa.Array, lang: np.ndarray, log_p) -> list[np.ndarray]:
    """Columns COUNTS and VERDICT of a slice; log_p tells the log-probability of hashed n-grams."""
    c = text_counts(text)
    key, _, doc, _ = text_grams(text, lang)
    n = np.bincount(doc, minlength=len(text))
    total = np.bincount(doc, weights=log_p(key), minlength=len(text)) if len(key) else np.zeros(len(text))
    return [c[x] for x in COUNTS] + [base_failed(c), is_reference(c), n.astype(np.int64), -total / np.maximum(n, 1)]


def looked_up(table: HashArray):
    def log_p(key: np.ndarray) -> np.ndarray:
        at = table.find(key)
        if len(at) and at.min() < 0:
            raise ValueError("an n-gram of a text wasn't counted")
        return table.values[0][at]

    return log_p


def score_documents(docs: DataFrame, keep: list[str], *, broadcast_ngrams: int = BROADCAST_NGRAMS, chunk_bytes: int = CHUNK_BYTES, shard_ngrams: int = SHARD_NGRAMS) -> DataFrame:
    """Columns keep of docs with the counts and the log-perplexity of each text under the model of all of docs."""
    prepare(docs.sparkSession)
    grams = gram_log_probabilities(docs)
    kinds = extended(docs, keep, ", ".join([*(f"{x} long" for x in COUNTS), "base_failed boolean, reference boolean, n_scored long, log_ppl double, model string"]))
    more = [] if has_text(keep) else [F.col("text").alias("__text")]
    wide = docs.select(*keep, language().alias("__lang"), F.xxhash64(language()).alias("__k"), *more)
    n = grams.count()
    if n <= broadcast_ngrams:
        return whole_scores(wide, grams, keep, kinds)
    return sharded_scores(wide, grams, keep, kinds, max(1, -(-n // shard_ngrams)), chunk_bytes)


def hashed_grams(grams: DataFrame) -> DataFrame:
    """key, logp of each n-gram."""

    def hashed(parts):
        for batch in parts:
            k, hi, lo = (batch.column(i).to_numpy() for i in range(3))
            yield batches(("key", numbers_of_grams(hi, lo, k).view(np.int64)), ("logp", batch.column(3)))

    return grams.select("k", "hi", "lo", "logp").mapInArrow(hashed, "key long, logp float")


def whole_scores(wide: DataFrame, grams: DataFrame, keep: list[str], kinds) -> DataFrame:
    """With one array for all n-grams, whose number the caller checked."""
    t = hashed_grams(grams).toArrow()
    shared = wide.sparkSession.sparkContext.broadcast(HashArray(t["key"].to_numpy().view(np.uint64), t["logp"].to_numpy()))
    del t

    def score(parts):
        log_p = looked_up(shared.value)
        for batch in parts:
            text, lang = text_of(batch, keep, len(keep) + 2), batch.column(len(keep) + 1).to_numpy()
            for a, b in text_slices(text, SLICE_BYTES):
                made = judged_slice(text.slice(a, b - a), lang[a:b], log_p)
                own = [batch.column(i).slice(a, b - a) for i in range(len(keep) + 1)]
                yield pa.RecordBatch.from_arrays([*own[:-1], *map(pa.array, made), own[-1].cast(pa.string())], names=[*keep, *COUNTS, *VERDICT])

    return wide.mapInArrow(score, kinds)


def sharded_scores(wide: DataFrame, grams: DataFrame, keep: list[str], kinds, shards: int, chunk_bytes: int) -> DataFrame:
    """With arrays in shards by ranges of the hash, of which each chunk of texts asks what it needs."""
    text_column = F.col(f"{ROW}.text") if ROW in keep else F.col("text" if "text" in keep else "__text")
    size = wide.agg(F.sum(F.octet_length(text_column) + 64).alias("b")).first()["b"] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(1, -(-chunks // 64))  # the asks of at most about 64 chunks meet a shard in one task
    width = len(wide.columns)
    cuts = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
    names = wide.columns
    keyed = wide.withColumn("__chunk", F.pmod(F.xxhash64(text_column, *(F.col(c) for c in keep if c != ROW), F.col("__k"), *([F.col(f"{ROW}.doc_id")] if ROW in keep else [])), F.lit(chunks)))
    keyed = keyed.repartition(min(chunks, 1 << 14), "__chunk")

    def deal(parts_of_grams):
        for batch in parts_of_grams:
            shard = np.searchsorted(cuts, batch.column(0).to_numpy().view(np.uint64), side="right")
            yield batches(("shard", shard.astype(np.int64)), ("key", batch.column(0)), ("logp", batch.column(1)))

    def pack(t: pa.Table) -> pa.Table:
        key, logp = t["key"].to_numpy().view(np.uint64), t["logp"].to_numpy()
        order = np.argsort(key)
        return pa.table({"shard": t["shard"].slice(0, 1), "keys": pa.array([key[order].astype("<u8").tobytes()], pa.binary()), "logps": pa.array([logp[order].astype("<f4").tobytes()], pa.binary())})

    arrays = hashed_grams(grams).mapInArrow(deal, "shard long, key long, logp float").groupBy("shard").applyInArrow(pack, "shard long, keys binary, logps binary")
    arrays = stored(arrays, "shards").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def texts_of(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
        columns = [plain(t[c].combine_chunks()) for c in names]
        batch = pa.RecordBatch.from_arrays(columns, names=names)
        return text_of(batch, keep, width - 1), t["__k"].to_numpy()

    def distinct(text: pa.Array, lang: np.ndarray) -> np.ndarray:
        held = [np.unique(text_grams(text.slice(a, b - a), lang[a:b])[0]) for a, b in text_slices(text, SLICE_BYTES)]
        return np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)

    def ask(t: pa.Table) -> pa.Table:
        key, chunk = distinct(*texts_of(t)), t["__chunk"][0].as_py()
        ends = np.concatenate([[0], np.searchsorted(key, cuts), [len(key)]])
        rows = [(chunk, i, key[a:b].astype("<u8").tobytes()) for i, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
        c, i, x = zip(*rows) if rows else ((), (), ())
        return pa.table({"chunk": pa.array(c, pa.int64()), "shard": pa.array(i, pa.int64()), "part": pa.array([v % parts for v in c], pa.int64()), "keys": pa.array(x, pa.binary())})

    asks = keyed.groupBy("__chunk").applyInArrow(ask, "chunk long, shard long, part long, keys binary")

    def answer(arrays: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            key, logp = np.frombuffer(arrays["keys"][0].as_buffer(), "<u8"), np.frombuffer(arrays["logps"][0].as_buffer(), "<f4")
            for x in asked["keys"]:
                want = np.frombuffer(x.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                if not (key[at] == want).all():
                    raise ValueError("an n-gram of a text wasn't counted")
                out.append(logp[at].astype("<f4").tobytes())
        return pa.table({"__chunk": asked["chunk"], "shard": asked["shard"], "logps": pa.array(out, pa.binary())})

    answers = arrays.groupBy("shard", "part").cogroup(asks.groupBy("shard", "part")).applyInArrow(answer, "__chunk long, shard long, logps binary")

    def score(t: pa.Table, told: pa.Table) -> pa.Table:
        text, lang = texts_of(t)
        key = distinct(text, lang)
        turn = pc.sort_indices(told["shard"]) if told.num_rows else None
        logp = np.concatenate([np.frombuffer(x.as_buffer(), "<f4") for x in told["logps"].take(turn)]) if told.num_rows else np.zeros(0, np.float32)
        log_p = looked_up(HashArray(key, logp))
        made = [judged_slice(text.slice(a, b - a), lang[a:b], log_p) for a, b in text_slices(text, SLICE_BYTES)]
        columns = [pa.array(np.concatenate(x)) for x in zip(*made)]
        return pa.Table.from_arrays([*(t[c] for c in keep), *columns, t["__lang"].cast(pa.string())], names=[*keep, *COUNTS, *VERDICT])

    return keyed.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(score, kinds)


# ---------------------------------------------------------------- bands


def fit_bands(scored: DataFrame) -> DataFrame:
    """For each language (model) the middle and the spread of the reference texts' log-perplexity, and
    how far one character strays, from all reference texts. Exact percentiles of values rounded to a
    thousandth, whose numbers are added up first, so the result doesn't depend on partitions."""
    n = F.col("n_scored")
    size = F.when(n < 400, "short").when(n >= 1000, "long").otherwise("other")
    inverse = (1 / n).cast("decimal(20,12)")
    tally = scored.where("reference and n_scored > 0").groupBy("model", F.round("log_ppl", 3).alias("x"), size.alias("size")).agg(F.count(F.lit(1)).alias("f"), F.sum(inverse).alias("inverse"))
    of = lambda name: F.when(F.col("size") == name, F.col("x"))
    sums = tally.groupBy("model").agg(
        F.percentile("x", F.lit(0.5), F.col("f")).alias("mid"),
        F.percentile(of("long"), F.array(F.lit(0.16), F.lit(0.84)), F.col("f")).alias("long"),
        F.percentile(of("short"), F.array(F.lit(0.16), F.lit(0.84)), F.col("f")).alias("short"),
        (F.sum(F.when(F.col("size") == "short", F.col("inverse"))) / F.sum(F.when(F.col("size") == "short", F.col("f")))).cast("double").alias("inverse"),
    )
    half = lambda q: F.coalesce((F.col(q)[1] - F.col(q)[0]) / 2, F.lit(0.0))
    one = F.sqrt(F.greatest(half("short") ** 2 - half("long") ** 2, F.lit(0.25)) / F.col("inverse"))
    return sums.select("model", "mid", F.greatest(half("long"), F.lit(0.005)).alias("spread"), F.coalesce(one, F.lit(3.0)).alias("one"))


def judge(scored: DataFrame, bands: DataFrame, *, width: float = 3.0) -> DataFrame:
    """The verdict: outside the band of its language, which is wider for short texts, a text is rejected."""
    reach = width * F.sqrt(F.pow("spread", 2) + F.pow("one", 2) / F.greatest("n_scored", F.lit(1)))
    # a row for each language, read from a file whose size decides whether it is broadcast
    out = scored.join(bands, "model", "left").withColumns({"band_low": F.col("mid") - reach, "band_high": F.col("mid") + reach})
    inside = F.coalesce(F.col("log_ppl").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop("mid", "spread", "one")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


VERDICT = ("base_failed", "reference", "n_scored", "log_ppl", "model")


def apply_quality_rules(docs: DataFrame, keep: list[str] | None = None, **limits: int) -> DataFrame:
    """Fit on all of docs, score every row once, set the bands by the scores, and judge every row."""
    scored = stored(score_documents(docs, keep or ["doc_id"], **limits), "scored")
    return judge(scored, stored(fit_bands(scored), "bands"))
