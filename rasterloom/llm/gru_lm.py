"""Language-model scores: a gated recurrent network over words, trained and run in numpy.

Spark counts every word of all training texts. The most frequent words have outputs of their own,
the rest fall into kinds by their shape (length, last mark, alphabet); within a kind a word has its
share of the kind's count, plus one, so the model gives every text a probability. The output
softmax is factored: classes of about equal size, then members of the class.

Training is truncated backpropagation over lanes of running text, with the state carried on from
window to window and set to zero at a text's end. It runs where the data are: in each of ``rounds``
rounds every task trains from the same weights on the training texts it reads (one part of them by a
hash of the id), and Spark averages the weights by the number of words; the rounds' parts together
are all training texts. Scoring carries the state over a whole text, however long.

Word counts come to the scorer by joins: texts are dealt into chunks of bounded size, each chunk
asks for its distinct words once, and the answers meet the chunk's texts again by its number.

Cases: null or empty text: the end token alone; no training text: every count is zero and the
network is as it began; ties among frequent words: the first in order of the alphabet; texts of any
length: scored in windows with the state carried on; repeated rows: each gets its own result; empty
table: no rows; extra columns, whatever their names: ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .shared import Words, batches, mix64, plain, prepare, quantity, stored, text_slices

END = "\n"  # no word is a line end
KINDS = 18
CHUNK_BYTES = 16 << 20
MOST_PARTITIONS = 1 << 14
WEIGHTS = 4096  # of the network, in one row
STATES = 1 << 14  # held at a time when texts are scored
BLOCK = 1 << 13  # states whose outputs are told apart at a time


def lower_words(texts: pa.Array) -> Words:
    """Words with A-Z in lower case.

    Distinct words are lowered, not texts: a cast slice of texts can have offsets that don't begin at 0, and
    ascii_lower (pyarrow 23) keeps such offsets beside bytes that do, so that its texts are cut elsewhere."""
    words = Words(texts)
    lowered = pc.ascii_lower(words.forms).dictionary_encode()
    code = lowered.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    words.codes, words.forms = code[words.codes], lowered.dictionary
    words.blank = int(code[words.blank]) if words.blank >= 0 else -1
    return words


def kinds_of(forms: pa.Array) -> np.ndarray:
    """Kind of each word by length (up to 5, up to 9, more), last mark (full stop, comma, none) and alphabet."""
    size = pc.utf8_length(forms).to_numpy(zero_copy_only=False)
    stop = pc.ends_with(forms, ".").to_numpy(zero_copy_only=False)
    comma = pc.ends_with(forms, ",").to_numpy(zero_copy_only=False)
    wide = pc.match_substring_regex(forms, r"[^\x00-\x7F]").to_numpy(zero_copy_only=False)
    return ((size > 5).astype(np.int64) + (size > 9)) * 6 + np.where(stop, 1, np.where(comma, 2, 0)) * 2 + wide


# ---------------------------------------------------------------- counts


def count_words(texts: DataFrame) -> DataFrame:
    """word, c: counts of all words and of text ends in column text; tasks sum before they emit."""

    def count(parts):
        held, size, ends = [], 0, 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("w").aggregate([("c", "sum")]).rename_columns(["w", "c"])

        def out(t: pa.Table):
            for b in t.to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([b.column("w").cast(pa.string()), b.column("c")], names=["word", "c"])

        for batch in parts:
            text = batch.column(0)
            ends += len(text)
            for a, b in text_slices(text):
                words = lower_words(text.slice(a, b - a))
                n = np.bincount(words.codes, minlength=len(words.forms))
                hit = np.flatnonzero(n)
                held.append(pa.table({"w": words.forms.take(pa.array(hit)), "c": pa.array(n[hit])}))
                size += len(hit)
            if size > 1_500_000:
                held = [merged()]
                size = held[0].num_rows
                if size > 1_000_000:
                    yield from out(held[0])
                    held, size = [], 0
        if held:
            yield from out(merged())
        if ends:
            yield batches(("word", pa.array([END])), ("c", pa.array([ends], pa.int64())))

    return texts.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What the network tells apart: frequent words, kinds of other words, the end."""

    words: list[str]
    kind_total: np.ndarray  # training tokens of each kind, without frequent words
    kind_forms: np.ndarray  # distinct such words
    frequency: np.ndarray  # of each output
    tokens: int
    forms: int
    slot: np.ndarray  # output -> place, class * members + member
    classes: int
    members: int

    @property
    def end(self) -> int:
        return len(self.words) + KINDS

    def outputs(self, forms: pa.Array) -> np.ndarray:
        """Output of each word."""
        known = pc.index_in(forms, pa.array(self.words, forms.type)).to_numpy(zero_copy_only=False)
        return np.where(np.isnan(known), len(self.words) + kinds_of(forms), known).astype(np.int64)


def fit_vocabulary(counts: DataFrame, size: int) -> Vocabulary:
    """size: frequent words, part of the model's form."""
    top = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(size).collect()
    frequent = [r["word"] for r in top]
    shared = counts.sparkSession.sparkContext.broadcast(frozenset(frequent))

    def kinds(parts):
        total, forms = np.zeros(KINDS + 1, np.int64), np.zeros(KINDS + 1, np.int64)
        for batch in parts:
            word, c = batch.column(0), batch.column(1).to_numpy()
            mine = pc.invert(pc.is_in(word, pa.array(sorted(shared.value) or [""], pa.string()))).to_numpy(zero_copy_only=False)
            kind = np.where(pc.equal(word, END).to_numpy(zero_copy_only=False), KINDS, kinds_of(word))
            total += np.bincount(kind[mine], weights=c[mine], minlength=KINDS + 1).astype(np.int64)
            forms += np.bincount(kind[mine], minlength=KINDS + 1)
        yield batches(("k", np.arange(KINDS + 1, dtype=np.int32)), ("c", total), ("v", forms))

    rows = counts.mapInArrow(kinds, "k int, c long, v long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    total, forms = np.zeros(KINDS + 1, np.int64), np.zeros(KINDS + 1, np.int64)
    for r in rows:
        total[r["k"]], forms[r["k"]] = r["c"], r["v"]
    frequency = np.concatenate([np.array([r["c"] for r in top], np.int64), total])
    n = len(frequency)
    classes = int(np.ceil(np.sqrt(n)))
    members = -(-n // classes)
    slot = np.empty(n, np.int64)
    slot[np.argsort(-frequency, kind="stable")] = np.arange(n)
    return Vocabulary(frequent, total[:KINDS], forms[:KINDS], frequency, int(frequency.sum()), int(forms.sum()) + len(top), slot, classes, members)


# ---------------------------------------------------------------- network


@dataclass
class Network:
    """Gated recurrent units; embed has a row for each output, which is also what is read."""

    embed: np.ndarray  # outputs x d
    w: np.ndarray  # d x 3h: update, reset, new
    u: np.ndarray  # h x 3h
    b: np.ndarray  # 3h
    class_w: np.ndarray  # classes x h
    class_b: np.ndarray
    member_w: np.ndarray  # classes x members x h
    member_b: np.ndarray  # classes x members; -1e9 where there is no member

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.w, self.u, self.b, self.class_w, self.class_b, self.member_w, self.member_b]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> "Network":
        out, at = [], 0
        for x in self.arrays():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*out)


def new_network(v: Vocabulary, hidden: int, embed: int, seed: int) -> Network:
    """Small random weights; biases begin as the logarithms of the training frequencies."""
    rng = np.random.default_rng(seed)
    f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    share = np.zeros(v.classes * v.members)
    share[v.slot] = v.frequency + 1.0
    share = share.reshape(v.classes, v.members)
    by_class = share.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        member = np.where(share > 0, np.log(share / by_class[:, None]), -1e9)
        klass = np.where(by_class > 0, np.log(by_class / by_class.sum()), -1e9)
    return Network(
        f(len(v.slot), embed, s=0.3), f(embed, 3 * hidden, s=0.3), f(hidden, 3 * hidden, s=0.3), np.zeros(3 * hidden, np.float32),
        f(v.classes, hidden, s=0.01), klass.astype(np.float32), f(v.classes, v.members, hidden, s=0.01), member.astype(np.float32),
    )


def by_gates(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the update and reset gates, halved for ``opened``, and those of the new state."""
    k = x.shape[1] // 3
    return x[:, : 2 * k] * np.float32(0.5), np.ascontiguousarray(x[:, 2 * k :])


def opened(half: np.ndarray) -> None:
    """Logistic function of twice the values, in place."""
    np.tanh(half, out=half)
    half += np.float32(1)
    half *= np.float32(0.5)


def with_bias(state: np.ndarray) -> np.ndarray:
    """Rows of states and a one, which meets the bias in one product with the weights."""
    out = np.ones((len(state), state.shape[1] + 1), np.float32)
    out[:, :-1] = state
    return out


def in_order(numbers: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers below ``most``; small types are sorted by radix."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


class Outputs:
    """Logits of classes and members for sorted states; arrays lie outputs by states, so that sums over outputs are sums of rows."""

    def __init__(self, net: Network, v: Vocabulary, state: np.ndarray, target: np.ndarray):
        slot = v.slot[target]
        klass = slot // v.members
        self.order = in_order(klass, v.classes)
        self.state, self.klass, self.member = with_bias(state)[self.order], klass[self.order], (slot % v.members)[self.order]
        self.ends = np.searchsorted(self.klass, np.arange(v.classes + 1))
        self.used = np.flatnonzero(np.diff(self.ends))
        self.class_w = np.concatenate([net.class_w, net.class_b[:, None]], 1)
        self.member_w = np.concatenate([net.member_w, net.member_b[:, :, None]], 2)
        self.place = np.arange(len(slot))

    def classes(self) -> np.ndarray:
        return self.class_w @ self.state.T

    def members(self) -> np.ndarray:
        z = np.empty((self.member_w.shape[1], len(self.state)), np.float32)
        for c in self.used:
            a, b = self.ends[c], self.ends[c + 1]
            np.matmul(self.member_w[c], self.state[a:b].T, out=z[:, a:b])
        return z


def log_share(z: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax over each column of z, at one row for each; z is overwritten."""
    z -= z.max(0)
    own = z[row, place]
    return own - np.log(np.exp(z, out=z).sum(0))


def shared_out(z: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The softmax over each column times the column's share, in place."""
    z -= z.max(0)
    np.exp(z, out=z)
    z *= share / z.sum(0)
    return z


def log_prob(net: Network, v: Vocabulary, state: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p of each target output given the state before it."""
    out = np.empty(len(state), np.float32)
    for a in range(0, len(state), BLOCK):
        o = Outputs(net, v, state[a : a + BLOCK], target[a : a + BLOCK])
        out[a + o.order] = log_share(o.classes(), o.klass, o.place) + log_share(o.members(), o.member, o.place)
    return out


def score_streams(net: Network, v: Vocabulary, outputs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int = 64) -> np.ndarray:
    """Natural log-probability of each text; a text's outputs lie in outputs from its start on.

    All texts advance together, longest first, so those still running are always the first ones. Where
    many run, fewer steps are held at a time."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    total = np.zeros(len(sizes))
    h = np.zeros((len(sizes), net.u.shape[0]), np.float32)
    k = net.u.shape[0]
    read_gates, read_new, u_gates, u_new = *by_gates(net.embed @ net.w + net.b), *by_gates(net.u)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest + 1), side="right")  # texts longer than t
    end = 0
    while end < longest:
        begin, end = end, min(end + max(1, min(window, STATES // int(alive[end]))), longest)
        steps = range(begin, end)
        counts = [int(alive[t]) for t in steps]
        at = np.concatenate([starts[:n] + t for t, n in zip(steps, counts)])
        before = outputs[np.maximum(at - 1, 0)]
        if begin == 0:
            before[: counts[0]] = v.end
        gates, new = read_gates[before], read_new[before]
        states = np.empty((len(at), k), np.float32)
        place = 0
        for n in counts:
            own, gate, fresh = h[:n], gates[place : place + n], new[place : place + n]
            gate += own @ u_gates
            opened(gate)
            back = own @ u_new
            back *= gate[:, k:]
            fresh += back
            np.tanh(fresh, out=fresh)
            own -= fresh
            own *= gate[:, :k]
            own += fresh
            states[place : place + n] = own
            place += n
        owner = np.concatenate([np.arange(n) for n in counts])
        total += np.bincount(owner, weights=log_prob(net, v, states, outputs[at]), minlength=len(total))
    back = np.empty(len(total))
    back[order] = total
    return back


def train_stream(net: Network, v: Vocabulary, stream: np.ndarray, *, lanes: int = 256, window: int = 20, rate: float = 0.02, updates: int = 150) -> Network:
    """Truncated backpropagation over one long stream of outputs, cut into lanes that run side by side;
    short streams get fewer lanes, so that they make about ``updates`` steps."""
    lanes = max(1, min(lanes, max(len(stream) // (updates * window), 16), len(stream) // (2 * window)))
    length = -(-len(stream) // lanes)
    filled = np.concatenate([stream, np.full(lanes * length - len(stream), v.end)])  # the filling isn't learned
    # time by lanes, so that a step's rows lie side by side
    target = np.ascontiguousarray(filled.reshape(lanes, length).T)
    source = np.ascontiguousarray(np.concatenate([np.full(1, v.end), filled[:-1]]).reshape(lanes, length).T)
    learned = np.ascontiguousarray((np.arange(lanes * length) < len(stream)).reshape(lanes, length).T)
    params = [x.copy() for x in net.arrays()]
    net = Network(*params)
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    k = net.u.shape[0]
    h = np.zeros((lanes, k), np.float32)
    real = net.member_b > -1e8
    for update, begin in enumerate(range(0, length, window), 1):
        src, dst = source[begin : begin + window], target[begin : begin + window]
        steps = len(src)
        rows = src.reshape(-1)
        read = net.embed[rows]
        gates, new = (x[rows].reshape(steps, lanes, -1) for x in by_gates(net.embed @ net.w + net.b))
        u_gates, u_new = by_gates(net.u)
        before, states, back_new, d_new = (np.empty((steps, lanes, k), np.float32) for _ in range(4))
        fresh_text = src == v.end
        fresh_any = fresh_text.any(1)
        for t in range(steps):
            if fresh_any[t]:
                h[fresh_text[t]] = 0  # a new text begins
            before[t] = h
            gate, fresh, back = gates[t], new[t], back_new[t]
            gate += h @ u_gates
            opened(gate)
            np.matmul(h, u_new, out=back)
            fresh += gate[:, k:] * back
            np.tanh(fresh, out=fresh)
            h -= fresh
            h *= gate[:, :k]
            h += fresh
            states[t] = h
        # outputs: what each state is told by its target, class by class
        s = states.reshape(-1, k)
        share = learned[begin : begin + window].reshape(-1).astype(np.float32)
        share /= max(share.sum(), 1)
        o = Outputs(net, v, s, dst.reshape(-1))
        share = share[o.order]
        p = shared_out(o.classes(), share)
        p[o.klass, o.place] -= share
        grads = [np.zeros_like(y) for y in params]
        g = Network(*grads)
        both = p @ o.state
        g.class_w[...], g.class_b[...] = both[:, :k], both[:, k]
        own = p.T @ net.class_w
        q = shared_out(o.members(), share)
        q[o.member, o.place] -= share
        for c in o.used:
            a, b = o.ends[c], o.ends[c + 1]
            both = q[:, a:b] @ o.state[a:b]
            g.member_w[c], g.member_b[c] = both[:, :k], both[:, k]
            own[a:b] += q[:, a:b].T @ net.member_w[c]
        ds = np.empty_like(own)
        ds[o.order] = own
        ds = ds.reshape(steps, lanes, k)
        # how a change of the new state reaches each gate, for all steps at once
        z, r = gates[:, :, :k], gates[:, :, k:]
        to_new = (1 - z) * (1 - new**2)
        slope = gates * (1 - gates)
        to_z = (before - new) * slope[:, :, :k]
        to_r = back_new * slope[:, :, k:]
        dback = np.empty((steps, lanes, 3 * k), np.float32)
        dh = np.zeros((lanes, k), np.float32)
        ut = np.ascontiguousarray(net.u.T)
        for t in range(steps - 1, -1, -1):
            dh += ds[t]
            np.multiply(dh, to_new[t], out=d_new[t])
            np.multiply(dh, to_z[t], out=dback[t, :, :k])
            np.multiply(d_new[t], to_r[t], out=dback[t, :, k : 2 * k])
            np.multiply(d_new[t], r[t], out=dback[t, :, 2 * k :])
            dh *= z[t]
            dh += dback[t] @ ut
            if fresh_any[t]:
                dh[fresh_text[t]] = 0
        flat = dback.reshape(-1, 3 * k)
        g.u[...] = before.reshape(-1, k).T @ flat
        dback[:, :, 2 * k :] = d_new  # from here on, what reaches the words that are read
        g.b[...] = flat.sum(0)
        g.w[...] = read.T @ flat
        turn = in_order(rows, len(net.embed))
        at = np.flatnonzero(np.diff(rows[turn], prepend=-1))
        g.embed[rows[turn[at]]] = np.add.reduceat((flat @ net.w.T)[turn], at, axis=0)
        norm = np.sqrt(sum(float(np.vdot(y, y)) for y in grads))
        clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        scale = np.float32(rate * np.sqrt(1 - 0.999**update) / (1 - 0.9**update))
        for y, dy, m1, m2 in zip(params, grads, first, second):
            dy *= clip
            m1 += np.float32(0.1) * (dy - m1)
            m2 += np.float32(0.001) * (dy * dy - m2)
            y -= scale * m1 / (np.sqrt(m2) + np.float32(1e-8))
        net.member_b[~real] = -1e9
    return net


@dataclass
class Recurrent:
    vocabulary: Vocabulary
    network: Network


def averaged(sums: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Weights by block from rows of tasks (block, task, w: sums of weight times words, n: words), added up in a tree of two steps."""

    def add(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("task", "ascending")])  # alike, however rows arrive
        total = sum(np.frombuffer(x.as_py(), "<f8") for x in table["w"].take(order))
        one = {"block": table["block"].slice(0, 1), "task": pa.array([pc.min(table["task"]).as_py()], pa.int32())}
        return pa.table(one | {"w": pa.array([total.tobytes()], pa.binary()), "n": pa.array([float(np.sum(table["n"].take(order).to_numpy()))])})

    kind = "block int, task int, w binary, n double"
    groups = max(1, int(sums.rdd.getNumPartitions() ** 0.5))
    part = sums.withColumn("part", F.col("task") % groups).groupBy("block", "part").applyInArrow(lambda t: add(t.drop_columns(["part"])), kind)
    rows = part.groupBy("block").applyInArrow(add, kind).orderBy("block").collect()  # one row for each block of the model
    return [(r["block"], np.frombuffer(r["w"], "<f8") / r["n"]) for r in rows]


def fit_network(train: DataFrame, v: Vocabulary, *, rounds: int = 2, hidden: int = 24, embed: int = 16, seed: int = 23) -> Recurrent:
    """Train on every text once, one part of them in each round; weights are averaged over tasks."""
    net = new_network(v, hidden, embed, seed)
    sc = train.sparkSession.sparkContext
    for r in range(rounds):
        shared = sc.broadcast((net, v))

        def learn(parts, shared=shared):
            from pyspark import TaskContext

            net, v = shared.value
            ids, size, seen = [], 0, 0

            def step():
                nonlocal net, seen
                stream = np.concatenate(ids)
                net = train_stream(net, v, stream)
                seen += len(stream)
                ids.clear()

            for batch in parts:
                text = batch.column(0)
                for a, b in text_slices(text):
                    words = lower_words(text.slice(a, b - a))
                    out = np.insert(v.outputs(words.forms)[words.codes], words.starts + words.counts, v.end)
                    ids.append(out)
                    size += len(out)
                    if size > 2_000_000:
                        step()
                        size = 0
            if ids:
                step()
            if seen:
                flat, task = net.flat() * seen, TaskContext.get().partitionId()
                own = [flat[a : a + WEIGHTS].astype("<f8").tobytes() for a in range(0, len(flat), WEIGHTS)]
                n = np.full(len(own), float(seen))
                yield batches(("block", np.arange(len(own), dtype=np.int32)), ("task", np.full(len(own), task, np.int32)), ("w", pa.array(own, pa.binary())), ("n", n))

        chosen = train.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(rounds)) == r).select("text")
        found = averaged(chosen.mapInArrow(learn, "block int, task int, w binary, n double"))
        if found:
            net = net.filled(np.concatenate([w for _, w in found]))
    return Recurrent(v, net)


# ---------------------------------------------------------------- scores


def score_chunk(model: Recurrent, texts: pa.Array, told: pa.Table) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score (base 10) of each text; told has the counts of its known words but frequent ones.

    Words are split slice by slice; the network then reads all texts together."""
    v = model.vocabulary
    asked, counted = told["word"].combine_chunks().cast(pa.large_string()), told["c"].to_numpy()
    ends = float(v.frequency[v.end])
    smooth = v.tokens + v.forms + 1.0
    made = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
    streams = []
    for a, b in text_slices(texts):
        words = lower_words(texts.slice(a, b - a))
        forms = words.forms.cast(pa.large_string())
        place = pc.index_in(forms, asked) if told.num_rows else pa.nulls(len(forms), pa.int32())
        c = np.zeros(len(forms))
        known = place.is_valid().to_numpy(zero_copy_only=False)
        c[known] = counted[place.drop_null().to_numpy()]
        out = v.outputs(forms)
        kind = out - len(v.words)
        rare = kind >= 0
        c[~rare] = v.frequency[out[~rare]]
        # summed text by text, so that it doesn't hang on the texts beside it
        base = np.bincount(words.doc, np.log10((c + 1) / smooth)[words.codes], len(words.counts)) + np.log10((ends + 1) / smooth)
        inner = np.zeros(len(forms))
        k = kind[rare]
        inner[rare] = np.log((c[rare] + 1) / (v.kind_total[k] + v.kind_forms[k] + 1.0))
        streams.append(np.insert(out[words.codes], words.starts + words.counts, v.end).astype(np.int32))
        made["n_tokens"].append(words.counts + 1)
        made["n_known"].append(words.per_doc((c > 0).astype(np.int64)[words.codes]) + int(ends > 0))
        made["base_score"].append(base)
        made["score"].append(words.per_doc(inner[words.codes]))
    made = {k: np.concatenate(x) if x else np.zeros(0) for k, x in made.items()}
    if streams:
        sizes = made["n_tokens"]
        made["score"] = (made["score"] + score_streams(model.network, v, np.concatenate(streams), np.cumsum(sizes) - sizes, sizes)) / np.log(10)
    return made


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, *, frequent: int = 2000) -> DataFrame:
    """Count, train and score; learns from rows whose crc32(doc_id) mod 7 is not 2."""
    spark = prepare(docs.sparkSession)
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(7, 2).alias("held_out"))
    train = marked.where(~F.col("held_out"))
    counts = stored(count_words(train), "words")
    vocabulary = fit_vocabulary(counts, frequent)
    shared = spark.sparkContext.broadcast(fit_network(train, vocabulary))
    rows, size = quantity(marked)
    chunks = max(1, -(-size // CHUNK_BYTES), -(-rows // 50_000))
    keyed = marked.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")).repartition(min(chunks, MOST_PARTITIONS), "chunk")

    def ask(table: pa.Table) -> pa.Table:
        text = plain(table["text"].combine_chunks())
        forms = [lower_words(text.slice(a, b - a)).forms.cast(pa.string()) for a, b in text_slices(text)]
        words = pc.unique(pa.chunked_array(forms, pa.string()))
        # the model knows the counts of its frequent words, which every chunk would ask for
        words = words.filter(pc.invert(pc.is_in(words, pa.array(["", *shared.value.vocabulary.words]))))
        return pa.table({"chunk": pa.array(np.full(len(words), table["chunk"][0].as_py(), np.int64)), "word": words})

    told = keyed.groupBy("chunk").applyInArrow(ask, "chunk long, word string").join(counts, "word").select("chunk", "word", "c")

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        model = shared.value
        text = plain(texts["text"].combine_chunks())
        made = score_chunk(model, text, told)
        n = np.full(texts.num_rows, model.vocabulary.tokens, np.int64)
        cols = [texts["doc_id"], texts["held_out"], pa.array(made["n_tokens"], pa.int64()), pa.array(made["n_known"], pa.int64()), pa.array(n), pa.array(made["base_score"], pa.float64()), pa.array(made["score"], pa.float64())]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return keyed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, RESULT)
