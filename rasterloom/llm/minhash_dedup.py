"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

Equal texts collapse first into one node (by digest). A node's shingles are runs of five words,
lower-cased and stripped of marks, weighted by count and by a damped inverse document frequency.
Consistent weighted sampling draws ``bands * rows`` samples from each node, so that two nodes share
a sample with the probability of their weighted Jaccard similarity; equal bands of samples make
nodes candidates, and candidates are verified by the similarity itself.

A shingle's inverse document frequency depends on the share of texts that hold it, down to one in
``1 / LEAST_SHARE``; rarer ones weigh alike. So weights are the same for a corpus of any size, and a
sketch of fixed size, whose error is a share of the texts, too, tells them (its mean load is taken
off). The frequency is damped: in a group of near copies that makes a third of the corpus, undamped
weights (ln 3 for what copies share, ln of a million for what differs) would bring two copies with 85 %
of their shingles in common down to a similarity of 0.31, so they would no longer be found.

Within a bucket of candidates not all pairs are formed. Small buckets are compared throughout. In a
large one two leaders are compared with the rest, which makes one component of true copies. Where
that leaves several components (texts that resemble each other less than the threshold), the bucket's
nodes are packed into blocks of bounded number and weight, and blocks meet blocks: a task compares the
nodes of two blocks by one matrix product over the shingles they share and emits only the links it
verified. Blocks of nodes that are one component already don't meet each other. So every similar pair
of a bucket ends in one component, and no bucket is capped. Joins by bucket are salted: a bucket of
many nodes is dealt over as many tasks as its size asks for. Components of up to ``FEW_EDGES`` edges are
made in the driver's arrays at once; those of more come from alternating star contractions, whose
edges and labels stay distributed. Both ways give the same labels.

What is broadcast is of fixed size: the sketch, a Bloom filter that keeps texts without candidates
from being shuffled (an exact join follows it), and a table of at most ``CELLS`` salts.

Cases: null text: a class of its own; a text without words: near to none, equal texts are copies;
fewer than five words: one shingle of all; texts of any length: whole, one at a time; ties: the
smallest doc_id names a class; repeated rows: copies of each other; empty table: no rows; extra
columns, whatever their names: ignored.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Words, hash_forms, mix64, plain, prepare, stored, text_slices

SHINGLE = 5
SKETCH_BITS, SKETCH_ROWS, BLOCK = 18, 2, 4096
#: Weights of shingles range from 1 to 1 + DAMPED between shingles of all texts and rare ones.
DAMPED, LEAST_SHARE = 0.25, 1 / 256
DRAW_BITS = 14
#: Rows of a bucket in one task, and classes of buckets that share a number of salts.
HOT_ROWS, CELLS = 512, 1 << 16
BLOOM_BITS = 25
#: Buckets of up to SMALL nodes are compared throughout; larger ones by blocks of about BLOCK_NODES.
SMALL, BLOCK_NODES, BLOCK_WEIGHT = 9, 128, 1 << 18
#: Edges (32 bytes each) that may come to the driver: each round of stars writes two tables, which cost more than few edges.
FEW_EDGES = 400_000


def node_key() -> Column:
    """Digest of a text; a null text gets one of its own."""
    own = F.concat(F.lit("\x00null"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.unhex(F.md5(F.coalesce(F.col("text"), own).cast("binary")))


# ---------------------------------------------------------------- shingles


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, their counts, and where each text's begin (one more at the end)."""
    words = Words(texts)
    bare = pc.replace_substring_regex(pc.utf8_lower(words.forms), r"[^\pL\pN]+", "")
    hashed = hash_forms(bare)
    solid = pc.not_equal(bare, "").to_numpy(zero_copy_only=False)[words.codes] if len(words.codes) else np.zeros(0, bool)
    token, doc = hashed[words.codes][solid], words.doc[solid]
    counts = np.bincount(doc, minlength=len(texts))
    n = len(token)
    key, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= SHINGLE:
        key = np.full(n - SHINGLE + 1, SHINGLE, np.uint64)
        for k in range(SHINGLE):
            key = mix64(key * np.uint64(3) + token[k : n - SHINGLE + 1 + k])
        inside = doc[: n - SHINGLE + 1] == doc[SHINGLE - 1 :]
        key, owner = key[inside], doc[: n - SHINGLE + 1][inside]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            h = np.uint64(counts[d])
            for t in token[start[d] : start[d] + counts[d]]:
                h = mix64(np.array([h]) * np.uint64(3) + t)[0]
            extra[i] = h
        key, owner = np.concatenate([key, extra]), np.concatenate([owner, short])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return key[first], np.diff(np.append(first, len(key))), np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(texts)))])


def sketch_slots(key: np.ndarray) -> list[np.ndarray]:
    return [(mix64(key + np.uint64(i + 1)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) + (i << SKETCH_BITS) for i in range(SKETCH_ROWS)]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Sketch of the number of texts that hold each shingle, and the number of texts. Each task adds
    up an array of fixed size; blocks of the arrays are summed in two steps, by task group, then over all."""
    size = SKETCH_ROWS << SKETCH_BITS

    def count(parts):
        from pyspark import TaskContext

        total, n = np.zeros(size, np.int64), 0
        for batch in parts:
            text = batch.column(0)
            n += len(text) - text.null_count
            for a, b in text_slices(text, 1 << 21):
                key, _, _ = shingles(text.slice(a, b - a))
                for slots in sketch_slots(key):
                    total += np.bincount(slots, minlength=size)
        if n:
            task = TaskContext.get().partitionId()
            blocks = total.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(np.full(len(blocks), task, np.int32)), pa.array([x.astype("<i8").tobytes() for x in blocks], pa.binary()), pa.array(np.full(len(blocks), n))],
                names=["block", "task", "c", "n"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in table["c"])
        return pa.table({"block": table["block"].slice(0, 1), "task": table["task"].slice(0, 1), "c": pa.array([total.astype("<i8").tobytes()], pa.binary()), "n": pa.array([pc.sum(table["n"]).as_py()], pa.int64())})

    kind = "block int, task int, c binary, n long"
    cells = docs.select("text").mapInArrow(count, kind)
    groups = max(1, int(cells.rdd.getNumPartitions() ** 0.5))
    cells = cells.withColumn("task", F.col("task") % groups).groupBy("block", "task").applyInArrow(add, kind)
    cells = cells.withColumn("task", F.lit(0)).groupBy("block").applyInArrow(add, kind)
    total, n = np.zeros(size, np.int64), 0
    for r in cells.collect():  # a fixed number of rows of fixed size
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["c"], "<i8")
        n = r["n"]
    return total, n


def weights(key: np.ndarray, counts: np.ndarray, sketch: np.ndarray, n: int) -> np.ndarray:
    """Count times damped inverse document frequency."""
    if not len(key):
        return np.zeros(0)
    load = sketch.reshape(SKETCH_ROWS, -1).sum(1)
    width = (1 << SKETCH_BITS) - 1
    # what a cell holds of other shingles is about the mean of all other cells
    df = np.minimum.reduce([sketch[s] - (t - sketch[s]) / width for s, t in zip(sketch_slots(key), load)])
    return counts * (1 + DAMPED * inverse_frequency(df / max(n, 1)))


def inverse_frequency(share: np.ndarray) -> np.ndarray:
    """From 0 for shingles of all texts to 1 for those of at most LEAST_SHARE of them."""
    return np.clip(np.log(np.clip(share, LEAST_SHARE, 1)) / np.log(LEAST_SHARE), 0, 1)


# ---------------------------------------------------------------- samples


@lru_cache(maxsize=2)
def draws(samples: int, seed: int) -> tuple[np.ndarray, ...]:
    """Random numbers for each sample in three tables: r and c are gamma (2, 1), beta is uniform. A
    shingle has a place of its own in each table, so a triple is drawn for each shingle out of 2**(3 * DRAW_BITS)."""
    rng = np.random.default_rng(seed)
    shape = (1 << DRAW_BITS, samples)
    r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
    return r, (1 / r).astype(np.float32), rng.uniform(0, 1, shape).astype(np.float32), np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)


def sample_bands(key: np.ndarray, weight: np.ndarray, bands: int, rows: int, seed: int = 41) -> np.ndarray:
    """Hash of each band of consistent weighted samples of one text."""
    samples = bands * rows
    r, inverse, beta, log_c = draws(samples, seed)
    places = [((key >> np.uint64(64 - DRAW_BITS * (i + 1))) & np.uint64((1 << DRAW_BITS) - 1)).astype(np.int64) for i in range(3)]
    b, step = beta[places[1]], r[places[0]]
    t = np.floor(np.log(weight).astype(np.float32)[:, None] * inverse[places[0]] + b)
    cost = log_c[places[2]] - step * (t - b + 1)
    best = cost.argmin(0)
    at = np.arange(samples)
    token = mix64(key[best] + mix64((t[best, at].astype(np.int64) + (at << 32)).astype(np.uint64)))
    out = np.full(bands, 1, np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        out = mix64(out * np.uint64(3) + token[i::rows])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts given as sorted shingles and weights."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = np.minimum(a[1][same], b[1][at[same]]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high > 0 else 0.0


COLUMNS = 1 << 16  # of a matrix of shared shingles
BLOCKS = "bucket long, block int, first int, blocks int, data binary"


def pack_block(table: pa.Table) -> pa.Table:
    """The nodes of a block with their roots, shingles and weights in one row."""
    data = tuple(table[c].to_pylist() for c in ("node", "root", "keys", "w", "n"))
    one = table.slice(0, 1).select(["bucket", "block", "first", "blocks"])
    return one.append_column("data", pa.array([pickle.dumps(data)], pa.binary()))


def block_links(a: tuple, b: tuple, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between nodes of two blocks that are of different components, by one matrix product; of
    links that would join the same components only the first is returned.

    A shingle that occurs n times is n shingles, each with its share of the weight, so the common
    weight of two texts is a product of 0/1 matrices with the weights between them."""

    def expanded(block: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for keys, w, n in zip(*block[2:]):
            k, w, n = np.frombuffer(keys, "<u8"), np.frombuffer(w, "<f4").astype(float), np.frombuffer(n, "<u4").astype(np.int64)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((mix64(np.repeat(k, n) + step.astype(np.uint64)), np.repeat(w / n, n)))
        return out

    one, two = expanded(a), expanded(b)
    # only shingles that two texts share count, a slice of them at a time
    if a[0] == b[0]:
        every, n = np.unique(np.concatenate([k for k, _ in one]), return_counts=True)
        every = every[n > 1]
    else:
        every = np.intersect1d(np.concatenate([k for k, _ in one]), np.concatenate([k for k, _ in two]))
    common = np.zeros((len(one), len(two)), np.float32)
    for start in range(0, len(every), COLUMNS):
        part = every[start : start + COLUMNS]
        sides = []
        for side, value in ((one, None), (two, 1)):
            dense = np.zeros((len(side), len(part)), np.float32)
            for i, (k, w) in enumerate(side):
                at = np.searchsorted(part, k)
                at[at == len(part)] = 0
                hit = part[at] == k
                dense[i, at[hit]] = w[hit] if value is None else value
            sides.append(dense)
        common += sides[0] @ sides[1].T
    sum_a, sum_b = (np.array([w.sum() for _, w in x]) for x in (one, two))
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = common / (sum_a[:, None] + sum_b[None, :] - common)
    above: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while x in above:
            x = above[x]
        return x

    out = []
    for i, j in np.argwhere(sim >= threshold - 1e-3):
        x, y = top(a[1][i]), top(b[1][j])
        if x != y:
            exact = similarity(*((np.frombuffer(t[2][n], "<u8"), np.frombuffer(t[3][n], "<f4").astype(float)) for t, n in ((a, i), (b, j))))
            if exact >= threshold:
                above[max(x, y)] = min(x, y)
                out.append((max(a[0][i], b[0][j]), min(a[0][i], b[0][j])))
    return out


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, root: the least node of each component of edges (a, b) for every other node of it."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    if edges.count() > FEW_EDGES:
        return star_components(both, name)
    return edges.sparkSession.createDataFrame(array_components(both.toArrow()))


def array_components(edges: pa.Table) -> pa.Table:
    """node, root of the components of a table of distinct edges (a, b), a above b."""
    a, b = (plain(edges[c]) for c in ("a", "b"))
    names = pc.unique(pa.concat_arrays([a, b]))
    names = names.take(pc.sort_indices(names))  # so that numbers are in the order of names
    x, y = (pc.index_in(c, names).to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b))
    root = np.arange(len(names))
    while len(x):  # the greater of two roots hangs below the lesser one, then all paths are cut short
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pa.table({"node": names.take(pa.array(moved)), "root": names.take(pa.array(root[moved]))})


def star_components(both: DataFrame, name: str) -> DataFrame:
    """The same by alternating large and small stars."""
    known = None
    while True:
        # large star: neighbours above a node move to its least neighbour
        sides = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted_join(sides.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b").distinct(), name)
        # small star: neighbours below a node, and the node, move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        both = stored(small.where("a != b").distinct(), name)
        state = both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if known == (state["n"], state["h"]):
            return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = (state["n"], state["h"])


# ---------------------------------------------------------------- the operator


def bloom_words(nodes: DataFrame) -> np.ndarray:
    """Bloom filter of 2**BLOOM_BITS bits over nodes."""
    spots = F.array(*(F.pmod(F.xxhash64("node", F.lit(s)), F.lit(1 << BLOOM_BITS)) for s in (1, 2)))
    rows = nodes.select(F.explode(spots).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def hot_cells(rows: DataFrame, key: str) -> DataFrame:
    """cell, salts of the classes of keys that have many rows; keys fall into CELLS classes, so at most as
    many rows are broadcast."""
    total = F.sum("n").over(Window.partitionBy())
    room = F.greatest(F.lit(HOT_ROWS), 4 * total / CELLS, total / 8192)
    counts = rows.groupBy(cell_of(key)).agg(F.count(F.lit(1)).alias("n")).withColumn("room", room)
    return F.broadcast(counts.where("n > room").select("cell", F.ceil(F.col("n") / F.col("room")).cast("int").alias("salts")))


def cell_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).alias("cell")


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: str, hot: DataFrame | None = None) -> DataFrame:
    """Rows with what table, which has one row for a key, says of their key. Rows of a frequent key are
    dealt by column ``spread`` over as many tasks as their number asks for."""
    hot = hot_cells(rows, key) if hot is None else hot
    salts = F.coalesce("salts", F.lit(1))
    left = rows.withColumn("cell", cell_of(key)).join(hot, "cell", "left").withColumn("salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("cell", "salts")
    right = table.withColumn("cell", cell_of(key)).join(hot, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("cell", "salts")
    return left.join(right, [key, "salt"]).drop("salt")


def shared_buckets(banded: DataFrame) -> DataFrame:
    """bucket, node, m (nodes of the bucket) of buckets with several nodes; no bucket comes to one task."""
    hot = F.broadcast(stored(hot_cells(banded, "bucket"), "salts"))
    counts = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return salted_join(banded, counts, "bucket", "node", hot).select("bucket", "node", "m")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (bucket, node, m) with a salt by their bucket's size."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / HOT_ROWS)).cast("int"))


def everywhere(buckets: DataFrame) -> DataFrame:
    """Rows for whole buckets (bucket, m), once for each salt of ``dealt``."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / HOT_ROWS) - 1).cast("int"))))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, bands: int = 9, rows: int = 3) -> DataFrame:
    """doc_id, class_id (the least doc_id of all that are near, through others if need be), copy_of
    (the least doc_id with the same text), class_size, of every row of docs."""
    named = node_classes(docs, threshold=threshold, bands=bands, rows=rows)
    rows = docs.select("doc_id", node_key().alias("node"))
    return salted_join(rows, named, "node", "doc_id").select("doc_id", "class_id", "copy_of", "class_size")


def without_near_duplicates(docs: DataFrame, *, threshold: float = 0.8, bands: int = 9, rows: int = 3) -> DataFrame:
    """One row of each class, that of its least doc_id, with all its columns."""
    named = node_classes(docs, threshold=threshold, bands=bands, rows=rows)
    # one key for the join and for what drops repeated rows, so that texts are shuffled once
    row_key = lambda node, doc_id: F.md5(F.concat(node, F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")))
    keepers = named.where("keeper").select(row_key(F.col("node"), "copy_of").alias("__key"))
    kept = docs.withColumn("__key", row_key(node_key(), "doc_id")).join(keepers, "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def node_classes(docs: DataFrame, *, threshold: float, bands: int, rows: int) -> DataFrame:
    """node, copy_of, class_id, class_size, keeper (the node that stands for its class) of every distinct text."""
    spark = prepare(docs.sparkSession)
    sc = spark.sparkContext
    nodes = docs.select("doc_id", "text", node_key().alias("node"))
    sketch = sc.broadcast(document_frequencies(docs))

    def sign(parts):
        seen: set[bytes] = set()
        for batch in parts:
            node, text = batch.column(0), batch.column(1)
            for a, b in text_slices(text, 1 << 21):
                key, counts, at = shingles(text.slice(a, b - a))
                w = weights(key, counts, *sketch.value)
                out_node, out = [], []
                for i, x in enumerate(node.slice(a, b - a).to_pylist()):
                    if at[i] < at[i + 1] and x not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(x)  # copies within a task are signed once
                        out_node.append(x)
                        out.append(sample_bands(key[at[i] : at[i + 1]], w[at[i] : at[i + 1]], bands, rows))
                if out:
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * bands), pa.array(np.concatenate(out)))
                    yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.binary()), flat], names=["node", "bands"])

    signed = nodes.select("node", "text").mapInArrow(sign, "node binary, bands array<bigint>")
    banded = stored(signed.groupBy("node").agg(F.first("bands").alias("bands")), "bands").select("node", F.explode("bands").alias("bucket"))
    members = stored(shared_buckets(banded), "members")
    candidates = members.select("node").distinct()
    bloom = sc.broadcast(bloom_words(candidates))

    def vectors(parts):
        seen: set[bytes] = set()
        for batch in parts:
            p = np.stack([batch.column(i).to_numpy() for i in (2, 3)])
            maybe = np.logical_and.reduce((bloom.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1)
            batch = batch.filter(pa.array(maybe))
            node, text = batch.column(0), batch.column(1)
            for a, b in text_slices(text, 1 << 21):
                key, counts, at = shingles(text.slice(a, b - a))
                w = weights(key, counts, *sketch.value).astype("<f4")
                made = []
                for i, x in enumerate(node.slice(a, b - a).to_pylist()):
                    if at[i] < at[i + 1] and x not in seen:
                        seen.add(x)
                        mine = w[at[i] : at[i + 1]]
                        made.append((x, key[at[i] : at[i + 1]].astype("<u8").tobytes(), mine.tobytes(), counts[at[i] : at[i + 1]].astype("<u4").tobytes(), float(mine.sum(dtype=float))))
                if made:
                    node_, keys, w_, n_, total = zip(*made)
                    yield pa.RecordBatch.from_arrays([pa.array(node_, pa.binary()), pa.array(keys, pa.binary()), pa.array(w_, pa.binary()), pa.array(n_, pa.binary()), pa.array(total)], names=["node", "keys", "w", "n", "total"])

    spots = [F.pmod(F.xxhash64("node", F.lit(s)), F.lit(1 << BLOOM_BITS)) for s in (1, 2)]
    vector = nodes.select("node", "text", *spots).mapInArrow(vectors, "node binary, keys binary, w binary, n binary, total double")
    vector = vector.join(candidates, "node", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in ("keys", "w", "n", "total")))
    vector = stored(vector, "vectors")

    def compare(parts):
        for batch in parts:
            cols = [batch.column(i) for i in range(2, 6)]
            load = lambda c, i, kind: np.frombuffer(c[i].as_buffer(), kind)
            sims = [similarity((load(cols[0], i, "<u8"), load(cols[1], i, "<f4").astype(float)), (load(cols[2], i, "<u8"), load(cols[3], i, "<f4").astype(float))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    def verified(pairs: DataFrame) -> DataFrame:
        one = vector.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("w").alias("wa"))
        two = vector.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("w").alias("wb"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "ka", "wa", "kb", "wb").mapInArrow(compare, "a binary, b binary, sim double")

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    sized = stored(members.join(vector.select("node", "total"), "node").select("bucket", "node", "m", "total"), "sized")
    like = lambda x, y: F.least(x, y) >= (threshold - 1e-6) * F.greatest(x, y)
    # nodes of a small bucket meet each other, those of a large one its least and its greatest
    small, large = sized.where(F.col("m") <= SMALL), sized.where(F.col("m") > SMALL)
    other = small.select("bucket", F.col("node").alias("leader"), F.col("total").alias("leader_total"))
    within = small.join(other, "bucket").where((F.col("node") > F.col("leader")) & like(F.col("total"), F.col("leader_total")))
    ends = F.explode(F.array(F.min(F.struct("node", "total")), F.max(F.struct("node", "total"))))
    lead = large.groupBy("bucket", "m").agg(ends.alias("l")).select("bucket", "m", F.col("l.node").alias("leader"), F.col("l.total").alias("leader_total"))
    led = dealt(large).join(everywhere(lead).drop("m"), ["bucket", "salt"]).where((F.col("node") != F.col("leader")) & like(F.col("total"), F.col("leader_total")))
    meet = within.select("node", "leader").unionByName(led.select("node", "leader"))
    sims = verified(meet.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct())
    links = stored(sims.where(F.col("sim") >= threshold).select("a", "b"), "links")
    roots = components(links)

    # large buckets that aren't one component, by blocks; those of the most frequent component come first
    large = rooted(large)
    by_root = large.groupBy("bucket", "m", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t"))
    top = F.max(F.struct("n", "root", "t"))
    main = by_root.groupBy("bucket", "m").agg(top.alias("top"), F.sum("n").alias("n"), F.sum("t").alias("t")).where("n > top.n")
    blocks = lambda n, t: F.ceil(F.greatest(n / F.lit(BLOCK_NODES), t / F.lit(BLOCK_WEIGHT))).cast("int")
    main = main.select("bucket", "m", F.col("top.root").alias("main"), blocks(F.col("top.n"), F.col("top.t")).alias("first"), blocks(F.col("n") - F.col("top.n"), F.col("t") - F.col("top.t")).alias("rest"))
    main = main.withColumn("rest", F.greatest("rest", F.lit(1)))
    large = dealt(large).join(everywhere(main).drop("m"), ["bucket", "salt"])
    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    block = F.when(F.col("root") != F.col("main"), F.col("first") + spread("rest")).otherwise(spread("first"))
    placed = large.select("bucket", "node", "root", "first", (F.col("first") + F.col("rest")).alias("blocks"), block.alias("block"))
    packed = stored(placed.join(vector, "node").groupBy("bucket", "block").applyInArrow(pack_block, BLOCKS), "blocks")
    other = packed.select("bucket", F.col("block").alias("with"), F.col("data").alias("other"))
    pairs = packed.withColumn("with", F.explode(F.expr("sequence(greatest(block, first), blocks - 1)"))).join(other, ["bucket", "with"])

    def meet_blocks(parts):
        for batch in parts:
            for a, b in zip(batch.column(0), batch.column(1)):
                found = block_links(pickle.loads(a.as_py()), pickle.loads(b.as_py()), threshold)
                if found:
                    x, y = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b"])

    more = stored(pairs.select("data", "other").mapInArrow(meet_blocks, "a binary, b binary").distinct(), "links")
    roots = components(links.unionByName(more))

    alike = nodes.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n"))
    named = alike.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a root isn't among the contracted edges' first ends, so it names itself
    first = F.min(F.struct(F.col("copy_of").isNull(), "copy_of", "node"))
    classes = named.groupBy("root").agg(first.alias("first"), F.sum("n").alias("class_size"))
    out = salted_join(named, classes, "root", "node")
    return out.select("node", "copy_of", F.col("first.copy_of").alias("class_id"), "class_size", (F.col("node") == F.col("first.node")).alias("keeper"))
