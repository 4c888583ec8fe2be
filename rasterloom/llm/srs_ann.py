"""Nearest neighbours by stable random projections in a kd-tree.

Vectors are lifted so that the largest inner product becomes the least Euclidean distance, and
projected to a few dimensions by a Gaussian (2-stable) matrix: squared projected distance over
squared distance then follows a chi-square law with as many degrees of freedom. A query takes rows
one after the other by their own projected distance, verifies each on the original vectors, and
stops when the test holds: with x = (projected distance of the next row)^2 / (distance of the k-th
found)^2, the chi-square distribution at x is at least ``confidence``. A true neighbour not yet met
would have had to be projected farther than all seen, which has at most the remaining probability.

The kd-tree has two parts. Its upper cuts come from at most ``SAMPLE`` rows (by a hash) and make at
most ``MOST_CELLS`` cells; every row is indexed in its cell, and a cell of many rows is dealt over
shards. Within a shard the tree goes on down to leaves, whose boxes give the incremental order: a
row's turn comes when its projected distance is below that of every leaf not yet opened. A query
searches one shard of its own cell first; the distance reached there tells which other cells the
test still admits, and only those get the query. Rows are shuffled once for each of the two steps
(once for each ``PART_QUERIES`` queries of a cell), queries once for each shard they search. On data
without clusters the test admits every cell, and the work is queries times rows times the share that
is verified (column ``verified``), as any search of this kind.

Cases: vectors that are null, zero, of another length than most (the most frequent length counts,
the longer of two), or hold null or non-finite components, and rows without an id take no part; ties
go to the smaller vec_id; fewer candidates than k: all of them; repeated rows (same id and vector)
are one row; an id with several vectors: each is a query and a candidate, and a row is no candidate
of its own id; empty table: no rows; extra columns, whatever their names: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import mix64, plain, prepare, stored

SHARD_ROWS, PART_QUERIES, SAMPLE, MOST_CELLS = 16384, 65536, 16384, 1024
LEAF, CHUNK, BLOCK = 64, 128, 128
FOUND = "place long, query_id long, vec_id long, score double, verified long"


def usable(column: str = "embedding") -> Column:
    v = F.col(column)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half = np.minimum(x, 1e4) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def chi_square_point(share: float, degrees: int) -> float:
    """Where the distribution function reaches ``share``, by bisection."""
    low, high = 0.0, 1e3
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array([middle]), degrees)[0] < share else (low, middle)
    return high


class Cells:
    """Upper cuts of the tree: a complete binary tree over the projected sample, cut at the median of the widest side."""

    def __init__(self, points: np.ndarray, cells: int):
        self.depth = max(0, cells - 1).bit_length()
        self.side, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        groups = {1: points}
        for i in range(1, 1 << self.depth):
            own = groups.pop(i)
            if len(own):
                side = int(np.argmax(own.max(0) - own.min(0)))
                self.side[i], self.cut[i] = side, np.median(own[:, side])
            right = own[:, self.side[i]] >= self.cut[i]
            groups[2 * i], groups[2 * i + 1] = own[~right], own[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (points[np.arange(len(points)), self.side[at]] >= self.cut[at])
        return at - (1 << self.depth)


def box_distances(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distance from each query to each box."""
    out = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        q = queries[:, d : d + 1]
        out += np.maximum(0, np.maximum(low[:, d] - q, q - high[:, d])) ** 2
    return out


class ProjectedTree:
    """kd-tree of a shard's projected points, cut at the median of the widest side; a leaf's points lie side by side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            own = points[order[a:b]]
            if b - a <= leaf:
                bounds.append((a, b))
                continue
            side = int(np.argmax(own.max(0) - own.min(0)))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.order, self.points, self.bounds = order, points[order], sorted(bounds)
        self.low = np.stack([self.points[a:b].min(0) for a, b in self.bounds])
        self.high = np.stack([self.points[a:b].max(0) for a, b in self.bounds])


class Search:
    """Incremental search of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, k: int, point: float):
        self.tree = ProjectedTree(projected)
        self.ids, self.vectors, self.k, self.point = ids[self.tree.order], vectors[self.tree.order], k, point

    def block(self, queries: np.ndarray, query_ids: np.ndarray, projected: np.ndarray, square: np.ndarray, reached: np.ndarray):
        """For each query the best rows, their scores, and how many rows were verified.

        square: squared length of the lifted query plus that of lifted rows; reached: squared
        distance of the k-th row found elsewhere."""
        tree, n = self.tree, len(queries)
        bound = box_distances(tree.low, tree.high, projected)
        path = np.argsort(bound, axis=1, kind="stable")
        near = np.full((n, len(self.ids)), np.inf)
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in range(n)]
        verified, reached = np.zeros(n, np.int64), reached.copy()
        live, opened, leaves = np.arange(n), 0, len(tree.bounds)
        while len(live) and opened < leaves:
            until = min(leaves, opened + max(1, leaves // 8))
            leaf, owner = path[live, opened:until].T.ravel(), np.tile(live, until - opened)
            turn = np.argsort(leaf, kind="stable")
            starts = np.flatnonzero(np.diff(leaf[turn], prepend=-1))
            for s, e in zip(starts, np.append(starts[1:], len(turn))):
                a, b = tree.bounds[leaf[turn[s]]]
                own, p = owner[turn[s:e]], tree.points[a:b]
                near[own, a:b] = np.maximum(0, (projected[own] ** 2).sum(1)[:, None] + (p**2).sum(1) - 2 * projected[own] @ p.T)
            opened = until
            frontier = bound[live, path[live, opened]] if opened < leaves else np.full(len(live), np.inf)
            stay = []
            for i, edge in zip(live, frontier):
                if not self._advance(i, edge, near[i], queries[i], query_ids[i], square[i], best, verified, reached):
                    stay.append(i)
            live = np.array(stay, np.int64)
        return best, verified

    def _advance(self, i, edge, near, query, query_id, square, best, verified, reached) -> bool:
        """Verify the rows whose turn has come; whether the test holds."""
        ready = np.flatnonzero(near < edge)
        ready = ready[np.argsort(near[ready], kind="stable")]
        scores, rows = best[i]
        for a in range(0, len(ready), CHUNK):
            own = ready[a : a + CHUNK]
            if near[own[0]] >= self.point * reached[i]:
                best[i] = scores, rows
                return True
            s = self.vectors[own] @ query
            verified[i] += len(own)
            good = self.ids[own] != query_id
            if len(scores) >= self.k:
                good &= s >= scores[-1]
            if good.any():
                scores, rows = np.concatenate([scores, s[good]]), np.concatenate([rows, own[good]])
                turn = np.lexsort((self.ids[rows], -scores))[: self.k]
                scores, rows = scores[turn], rows[turn]
                if len(scores) >= self.k:
                    reached[i] = min(reached[i], max(square - 2 * scores[-1], 1e-300))
        near[ready] = np.inf
        best[i] = scores, rows
        return edge >= self.point * reached[i]


def matrix_of(column, dim: int) -> np.ndarray:
    return plain(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, degrees: int = 16, confidence: float = 0.9, seed: int = 17, shard_rows: int = SHARD_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """The k nearest rows of vectors (vec_id, embedding) for each of queries, by inner product, and
    how many rows were verified for it."""
    spark = prepare(vectors.sparkSession)
    wide = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    shape = vectors.where(usable()).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).orderBy(F.desc("n"), F.desc("d")).first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    dim, top_norm = shape["d"], shape["m"]
    fit = usable() & (F.size("embedding") == dim) & F.col("vec_id").isNotNull()
    row = F.col("vec_id").cast("long").alias("vec_id"), wide.alias("embedding")
    # repeated rows collapse before they are dealt, so none makes a shard hot
    base = stored(vectors.where(fit).select(*row).distinct(), "vectors")
    asked = stored(queries.where(fit).select(*row).distinct().withColumn("place", F.monotonically_increasing_id()), "queries")
    rows = base.count()
    matrix = np.random.default_rng(seed).standard_normal((dim + 1, degrees))
    point = chi_square_point(confidence, degrees)

    def project(x: np.ndarray, lifted: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(0, top_norm**2 - (x**2).sum(1))) if lifted else np.zeros(len(x))
        return np.column_stack([x, extra]) @ matrix

    count = 1
    while count < MOST_CELLS and count * shard_rows < rows:
        count *= 2
    sample = np.zeros((0, degrees))
    if count > 1:  # at most SAMPLE rows
        held = base.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").toArrow()
        sample = project(matrix_of(held["embedding"], dim), True)
    cells = Cells(sample, count)

    def measure(parts):
        low, high, n = np.full((count, degrees), np.inf), np.full((count, degrees), -np.inf), np.zeros(count, np.int64)
        for batch in parts:
            p = project(matrix_of(batch.column(0), dim), True)
            own = cells.of(p)
            np.minimum.at(low, own, p)
            np.maximum.at(high, own, p)
            n += np.bincount(own, minlength=count)
        c = np.flatnonzero(n)
        lists = [pa.array([x.astype("<f8").tobytes() for x in side[c]], pa.binary()) for side in (low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(c), *lists, pa.array(n[c])], names=["cell", "low", "high", "n"])

    def together(table: pa.Table) -> pa.Table:
        side = lambda name, f: pa.array([f([np.frombuffer(x.as_py(), "<f8") for x in table[name]]).astype("<f8").tobytes()], pa.binary())
        return pa.table({"cell": table["cell"].slice(0, 1), "low": side("low", np.minimum.reduce), "high": side("high", np.maximum.reduce), "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    kind = "cell long, low binary, high binary, n long"
    low, high, subs = np.full((count, degrees), np.inf), np.full((count, degrees), np.inf), np.zeros(count, np.int64)
    for r in base.select("embedding").mapInArrow(measure, kind).groupBy("cell").applyInArrow(together, kind).collect():  # at most MOST_CELLS rows
        low[r["cell"]], high[r["cell"]] = np.frombuffer(r["low"], "<f8"), np.frombuffer(r["high"], "<f8")
        subs[r["cell"]] = -(-r["n"] // shard_rows)
    shared = spark.sparkContext.broadcast((cells, low, high, subs))

    def home_of(place: np.ndarray, own: np.ndarray, subs: np.ndarray) -> np.ndarray:
        return (mix64(place.astype(np.uint64)) % np.maximum(subs[own], 1).astype(np.uint64)).astype(np.int64)

    def point_rows(each: np.ndarray):
        """Rows with their shard, once for each part of the queries that come there."""

        def deal(parts):
            cells, _, _, subs = shared.value
            for batch in parts:
                ids, x = batch.column(0).to_numpy(), matrix_of(batch.column(1), dim)
                own = cells.of(project(x, True))
                key = mix64(ids.astype(np.uint64)) + mix64(np.ascontiguousarray(x[:, 0]).view(np.uint64))
                salt = (mix64(key) % np.maximum(subs[own], 1).astype(np.uint64)).astype(np.int64)
                at = np.repeat(np.arange(len(ids)), each[own])
                part = np.arange(len(at)) - np.repeat(np.cumsum(each[own]) - each[own], each[own])
                for a in range(0, len(at), 8192):
                    i = pa.array(at[a : a + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(own).take(i), pa.array(salt).take(i), pa.array(part[a : a + 8192]), batch.column(0).take(i), batch.column(1).take(i)], names=["cell", "salt", "part", "vec_id", "embedding"])

        return base.select("vec_id", "embedding").mapInArrow(deal, "cell long, salt long, part long, vec_id long, embedding array<double>")

    def search(points: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if points.num_rows and asked.num_rows:
            ids, x = points["vec_id"].to_numpy(), matrix_of(points["embedding"].combine_chunks(), dim)
            turn = np.lexsort((x[:, 0], ids))  # alike, however rows arrive
            ids, x = ids[turn], x[turn]
            shard = Search(ids, x, project(x, True), k, point)
            q_ids, q, place, reached = asked["vec_id"].to_numpy(), matrix_of(asked["embedding"].combine_chunks(), dim), asked["place"].to_numpy(), asked["reached"].to_numpy()
            for a in range(0, len(q), BLOCK):
                own = slice(a, a + BLOCK)
                square = (q[own] ** 2).sum(1) + top_norm**2  # lifted squared distance = |q|^2 + M^2 - 2 q.x
                best, verified = shard.block(q[own], q_ids[own], project(q[own], False), square, reached[own])
                size = np.array([len(r) for _, r in best])
                i = np.repeat(np.arange(len(best)), size)
                table = pa.table([place[own][i], q_ids[own][i], shard.ids[np.concatenate([r for _, r in best])], np.concatenate([s for s, _ in best]), np.zeros(len(i), np.int64)], names=["place", "query_id", "vec_id", "score", "verified"])
                tally = pa.table([pa.array(place[own]), pa.array(q_ids[own]), pa.nulls(len(best), pa.int64()), pa.nulls(len(best), pa.float64()), pa.array(verified)], names=table.column_names)
                found += [table, tally]
        return pa.concat_tables(found) if found else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())], names=["place", "query_id", "vec_id", "score", "verified"])

    def meet(routed: DataFrame) -> DataFrame:
        """Routed queries (cell, salt, vec_id, embedding, place, reached) against the rows of their shards."""
        each = np.zeros(count, np.int64)
        for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MOST_CELLS rows
            each[r["cell"]] = -(-r["n"] // (part_queries * max(1, int(subs[r["cell"]]))))
        parts = F.element_at(F.lit(each.tolist()), (F.col("cell") + 1).cast("int"))
        left = point_rows(each).groupBy("cell", "salt", "part")
        return left.cogroup(routed.withColumn("part", F.pmod(F.xxhash64("place"), parts)).groupBy("cell", "salt", "part")).applyInArrow(search, FOUND)

    routed_kind = "cell long, salt long, vec_id long, embedding array<double>, place long, reached double"

    def to_home(parts):
        cells, low, high, subs = shared.value
        for batch in parts:
            p = project(matrix_of(batch.column(1), dim), False)
            # the cell of the nearest box, as no query need lie where rows lie
            own = np.argmin(box_distances(low, high, p), axis=1)
            place = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(home_of(place, own, subs)), batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(own), np.inf))], names=["cell", "salt", "vec_id", "embedding", "place", "reached"])

    first = stored(meet(asked.select("vec_id", "embedding", "place").mapInArrow(to_home, routed_kind)), "home")
    if int(subs.sum()) == 1:
        found = first
    else:
        # the score of the k-th found at home; null where there are fewer
        kth = first.where("vec_id is not null").groupBy("place").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        told = asked.join(kth, "place", "left").select("vec_id", "embedding", "place", "s")

        def to_others(parts):
            cells, low, high, subs = shared.value
            every = np.repeat(np.arange(count), subs)
            salts = np.arange(len(every)) - np.repeat(np.cumsum(subs) - subs, subs)
            for batch in parts:
                for a in range(0, batch.num_rows, 256):
                    own = batch.slice(a, 256)
                    q, place = matrix_of(own.column(1), dim), own.column(2).to_numpy()
                    s = own.column(3).to_numpy(zero_copy_only=False)
                    reached = np.where(np.isnan(s), np.inf, np.maximum((q**2).sum(1) + top_norm**2 - 2 * s, 1e-300))
                    bound = box_distances(low, high, project(q, False))
                    home = np.argmin(bound, axis=1)
                    admitted = (bound < point * reached[:, None])[:, every]
                    admitted &= (every[None, :] != home[:, None]) | (salts[None, :] != home_of(place, home, subs)[:, None])
                    i, j = np.nonzero(admitted)
                    for b in range(0, len(i), 8192):
                        x, y = pa.array(i[b : b + 8192]), j[b : b + 8192]
                        yield pa.RecordBatch.from_arrays([pa.array(every[y]), pa.array(salts[y]), own.column(0).take(x), own.column(1).take(x), own.column(2).take(x), pa.array(reached).take(x)], names=["cell", "salt", "vec_id", "embedding", "place", "reached"])

        found = first.unionByName(meet(told.mapInArrow(to_others, routed_kind)))
    # place tells apart queries of one id; each shard returns at most k rows for a query
    best = Window.partitionBy("place").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    total = F.sum("verified").over(Window.partitionBy("place"))
    out = found.withColumns({"rank": F.row_number().over(best), "verified": total}).where((F.col("rank") <= k) & F.col("vec_id").isNotNull())
    return out.select("query_id", "rank", "vec_id", "score", "verified")


def nearest_of_every_20th(vectors: DataFrame) -> DataFrame:
    """The 20 nearest rows of each row whose vec_id is divisible by 20."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
