"""Operators of the llm package against brute force, libraries, held-out labels, and odd tables."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from rasterloom.llm import gru_lm, html_extract, langid, licenses, minhash_dedup, packing, perplexity_rules, sentencepiece_bpe, srs_ann, subword_classifier
from rasterloom.llm.queries import BYTE_BPE, PIECE_BPE, token_file
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", "   \n", "one", "a b c", "x" * 70_000, "word " * 3000, "tab\tand\x0bvt nbsp em 中文 😀 \x00 end", "same text here again and again\n" * 3, "same text here again and again\n" * 3]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, ["en", None, "fr"][i % 3], None if i == 4 else "s", None, "x", 1.5, True, "n") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[6], (None, "no id here but a text of several words and more", "en", "s", 1, "x", 0.5, False, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, score double, kept boolean, lang_pred string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def tokens(text):
    return WORD.findall(text or "")


# ---------------------------------------------------------------- near-duplicates


def shingle_set(text):
    w = [x for x in (re.sub(r"[\W_]+", "", y.lower()) for y in tokens(text)) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def planted(spark):
    """Copies, near copies with few edits, families around an original, and unlike texts that share a passage."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for family in range(12):
        base = [word() for _ in range(150)]
        rows.append((n, " ".join(base)))
        rows.append((n + 1, " ".join(base)))
        n += 2
        for edits in [1, 2, 3, 4, 6, 9, 14] * (6 if family == 0 else 1):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(len(near))] = word()
            rows.append((n, " ".join(near)))
            n += 1
    for _ in range(30):
        rows.append((n, " ".join(passage + [word() for _ in range(25)])))
        n += 1
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_near_duplicates_equal_brute_force(spark):
    df, rows = planted(spark)
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    sure, maybe = [], []
    for x in ids:
        for y in ids[:x]:
            j = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
            if j >= 0.83:
                sure.append((y, x))
            if j >= 0.78:
                a, b = top(x), top(y)
                parent[max(a, b)] = min(a, b)
                maybe.append((y, x))
    # weights shift a similarity by a few hundredths: what is clearly near is together, what is clearly not is apart
    assert all(got[a]["class_id"] == got[b]["class_id"] for a, b in sure)
    assert all(top(i) == top(got[i]["class_id"]) for i in ids)
    assert len(sure) > 100


def weighted_by_hand(texts):
    """doc_id -> shingle -> weight with exact document frequencies over all texts."""
    bags = {}
    for i, t in texts.items():
        w = [x for x in (re.sub(r"[\W_]+", "", y.lower()) for y in tokens(t)) if x]
        bags[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or (collections.Counter([tuple(w)]) if w else collections.Counter())
    df = collections.Counter(x for bag in bags.values() for x in bag)
    idf = lambda x: 1 + minhash_dedup.DAMPED * float(minhash_dedup.inverse_frequency(np.array([df[x] / len(texts)]))[0])
    weight = {x: idf(x) for x in df}
    return {i: {x: n * weight[x] for x, n in bag.items()} for i, bag in bags.items()}


def test_classes_equal_brute_force_with_the_same_weights(spark):
    """All pairs of the documents of sf0.01 by weighted Jaccard similarity: links are together, classes are chains of links."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    bags = weighted_by_hand(texts)
    holders = collections.defaultdict(list)
    for i, bag in bags.items():
        for x in bag:
            holders[x].append(i)
    common = collections.Counter()
    for x, own in holders.items():
        for j, b in enumerate(own):
            for a in own[:j]:
                common[a, b] += min(bags[a][x], bags[b][x])
    total = {i: sum(bag.values()) for i, bag in bags.items()}
    sim = {p: c / (total[p[0]] + total[p[1]] - c) for p, c in common.items()}
    links = [p for p, x in sim.items() if x >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(df).collect()}
    assert len(links) > 90 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    parent = {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [p for p, x in sim.items() if x >= 0.795]:  # the sketch's error moves a similarity a little
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert all(top(i) == top(c) for i, c in got.items() if texts[i] != texts[c])


def test_weights_are_the_same_at_every_size(spark):
    """Rare shingles weigh 1 + DAMPED, those of a share of texts what the share says, whatever the number of texts."""
    rng = np.random.default_rng(6)
    for n in (300, 4000):
        rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 60)) + (" one two three four five" if i % 4 == 0 else "")) for i in range(n)]
        sketch, found = minhash_dedup.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string"))
        assert found == n
        key, counts, at = minhash_dedup.shingles(pa.array([rows[1][1], "one two three four five"], pa.large_string()))
        w = minhash_dedup.weights(key, counts, sketch, n)
        assert abs(w[: at[1]].mean() - 1.25) < 0.003
        assert abs(w[at[1]] - (1 + 0.25 * math.log(4) / math.log(256))) < 0.003


def test_large_buckets_are_dealt_over_tasks(spark, monkeypatch):
    """A bucket of many nodes gets its number on every row and no piece of it is large."""
    rows = [(7, bytes([i % 256, i // 256])) for i in range(3000)] + [(i, bytes([1, 1, i % 256])) for i in range(100, 2000)] + [(i, bytes([2, 1, i % 256])) for i in range(100, 900)]
    banded = spark.createDataFrame(rows, "bucket long, node binary")
    got = minhash_dedup.shared_buckets(banded).collect()
    n = collections.Counter(b for b, _ in rows)
    assert collections.Counter((r["bucket"], r["node"]) for r in got) == collections.Counter((b, bytes(x)) for b, x in rows if n[b] > 1)
    assert all(r["m"] == n[r["bucket"]] for r in got)
    pieces = collections.Counter((r["bucket"], r["salt"]) for r in minhash_dedup.dealt(minhash_dedup.shared_buckets(banded)).collect())
    assert max(pieces.values()) < 1.5 * minhash_dedup.HOT_ROWS
    each = minhash_dedup.everywhere(spark.createDataFrame([(7, 3000)], "bucket long, m long")).collect()
    assert {r["salt"] for r in each} >= {s for b, s in pieces if b == 7}


def test_blocks_of_long_texts_stay_small():
    """128 texts of 20,000 words, some of them near copies, in one bucket."""
    import tracemalloc

    rng = np.random.default_rng(8)
    node, keys, w, n = [], [], [], []
    for i in range(128):
        k = np.sort(rng.integers(0, 1 << 62, 20_000).astype(np.uint64)) if i % 32 else None
        if k is None or i % 32 == 1:
            k = base = np.sort(rng.integers(0, 1 << 62, 20_000).astype(np.uint64)) if k is None else np.sort(np.concatenate([base[:19_000], rng.integers(0, 1 << 62, 1000).astype(np.uint64)]))
        node.append(bytes([i]))
        keys.append(k.astype("<u8").tobytes())
        w.append(np.ones(len(k), "<f4").tobytes())
        n.append(np.ones(len(k), "<u4").tobytes())
    block = (node, node, keys, w, n)
    tracemalloc.start()
    found = minhash_dedup.block_links(block, block, 0.8)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sorted(found) == [(bytes([i + 1]), bytes([i])) for i in range(0, 128, 32)] and peak < 500e6


def test_similarity_and_samples():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    a, b = keys[:340], keys[60:]
    w = lambda k: np.ones(len(k))
    want = 280 / 400
    assert abs(minhash_dedup.similarity((a, w(a)), (b, w(b))) - want) < 1e-9
    same = np.mean(minhash_dedup.sample_bands(a, w(a), 2000, 1) == minhash_dedup.sample_bands(b, w(b), 2000, 1))
    assert abs(same - want) < 0.04
    minhash_dedup.draws.cache_clear()
    blocks = [([bytes([i])], [bytes([i])], [k.astype("<u8").tobytes()], [np.ones(len(k), "<f4").tobytes()], [np.ones(len(k), "<u4").tobytes()]) for i, k in enumerate((a, b))]
    assert minhash_dedup.block_links(*blocks, 0.69) == [(b"\x01", b"\x00")] and minhash_dedup.block_links(*blocks, 0.71) == []


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 9)] + [(20, 22), (22, 21), (31, 30)]
    got = dict(map(tuple, minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 10)}, 21: 20, 22: 20, 31: 30}


def test_components_of_few_edges_write_no_tables(spark, monkeypatch):
    """Few edges make no table of stars, and both ways name the same roots."""
    rng = random.Random(5)
    edges = [(bytes([rng.randrange(256), rng.randrange(3)]), bytes([rng.randrange(256), rng.randrange(3)])) for _ in range(350)] + [(b"\xff" * 3, b"\xff" * 3)]
    df = spark.createDataFrame(edges, "a binary, b binary")
    written, stored = [], minhash_dedup.stored
    monkeypatch.setattr(minhash_dedup, "stored", lambda df, name: (written.append(name), stored(df, name))[1])
    labels = lambda x: sorted((bytes(r["node"]), bytes(r["root"])) for r in x.collect())
    got = labels(minhash_dedup.components(df))
    assert not written and len(got) > 200 and labels(minhash_dedup.components(df.limit(0))) == []
    monkeypatch.setattr(minhash_dedup, "FEW_EDGES", 0)
    assert labels(minhash_dedup.components(df)) == got and written


# ---------------------------------------------------------------- html


def test_html_regions():
    w = html_extract.fit_weights(html_extract.labelled_pages())
    for page in html_extract.labelled_pages():
        runs = html_extract.runs_of(page)
        a, b = w.region(runs)
        assert all((a <= i < b) == r.gold for i, r in enumerate(runs) if r.words)
    text = html_extract.main_text("<body><nav><a>Home</a></nav><div class='ad'>Buy this now</div><article><h1>T &amp; U</h1><p>One  <b>t</b>wo\nthree &copy; four<p>five six seven<script>var x='</p>'</script></article><div id='comments'>" + "<p>I think so too</p>" * 40 + "</div>", w)
    assert text == "T & U\nOne two three © four\nfive six seven"
    assert html_extract.main_text(None, w) == html_extract.main_text("", w) == html_extract.main_text("<p></p>", w) == ""
    assert html_extract.main_text("just words <b", w) == "just words"


SAY = "The council met on Tuesday evening and agreed to repair the old bridge before winter sets in."


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<p title="hidden gem">A gem here.</p>', "A gem here."),
        ("<p data-hidden=false data-class='sidebar'>Not hidden.</p>", "Not hidden."),
        ("<p class='meta-analysis'>A meta-analysis.</p>", "A meta-analysis."),
        ("<p id='reply-speech'>He replied.</p>", "He replied."),
        ("<div id='ad-hoc-rules'>Rules for once.</div>", "Rules for once."),
        ("<section class='legal-background'><p>The law.</p></section>", "The law."),
        ("<p>Tick the <label>first box</label> of <span class='share'>your share</span> now.</p>", "Tick the first box of your share now."),
        ("<p>Yes.</p><table><tr><td>Year</td><td>Cost</td></tr></table>", "Yes.\nYear\nCost"),
        ("<div class='ad-box'>Buy!</div><div class='share-buttons'>Mail</div><div id='newsletter-signup'>Sign up</div><p>Kept.</p>", "Kept."),
        ("<p hidden>secret</p><p style='display: none'>secret</p><span class='ad'>Buy!</span><form><label>Name</label></form><p>Kept.</p>", "Kept."),
    ],
)
def test_html_marks_within_an_article(inner, want):
    w = html_extract.fit_weights(html_extract.labelled_pages())
    page = f"<body><nav><a href='/'>Home</a></nav><article><h1>Bridge</h1>{inner}<p>{SAY}</p></article><footer>Imprint</footer></body>"
    assert html_extract.main_text(page, w) == f"Bridge\n{want}\n{SAY}"
    short_first = f"<body><article>{inner}<p>{SAY}</p><p>{SAY}</p></article></body>"
    assert html_extract.main_text(short_first, w) == f"{want}\n{SAY}\n{SAY}"


def test_html_comments_and_menus_without_names():
    w = html_extract.fit_weights(html_extract.labelled_pages())
    menu = "<div class='z1'><ul>" + "<li><a href='/x'>Sport and games</a></li>" * 8 + "</ul></div>"
    body = f"<h1>Bridge</h1><p>Yes.</p><table><tr><td>2020</td><td>12</td></tr></table><p>{SAY}</p><p>{SAY} {SAY}</p>"
    want = f"Bridge\nYes.\n2020\n12\n{SAY}\n{SAY} {SAY}"
    remarks = f"<div class='z3'><p>I think so too, and so do all my friends. {SAY}</p></div><div class='z3'><p>No. {SAY}</p></div>"
    for page in (
        f"{menu}<article class='z2'>{body}</article>{remarks}{menu}",
        f"{menu}<main><div class='z2'>{body}</div></main>{remarks}",
        f"{menu}<div class='z2'>{body}</div><div class='z4'><h3>2 comments</h3>{remarks}</div>{menu}",
        f"{menu}<article class='z2'>{body}<section><h2>Leave a reply</h2>{remarks}</section></article>",
        f"{menu}<div class='z2'>{body}</div>{menu}",
    ):
        assert html_extract.main_text(f"<html><body>{page}</body></html>", w) == want, page


def test_html_tags_of_any_length():
    """Tags with a long value or many values are tags, and what only a value says isn't an attribute."""
    w = html_extract.fit_weights(html_extract.labelled_pages())
    say = "<p>The council met on Tuesday evening and agreed to repair the old bridge.</p>"
    plain = html_extract.main_text(f"<body><article>{say}{say}</article></body>", w)
    long = "x" * 100_000
    many = " ".join(f'data-a{i}="v > {i}"' for i in range(100))
    for more in (f"data-x='{long}'", f'data-x="{long}"', many, """data-x='{"hidden": true, "class": "sidebar"}'""", "title=it's"):
        page = f"<body><article {more}>{say}<img {more}><div class='sidebar' {more}>left out</div><script {more}>var x = 1;</script>{say}</article></body>"
        assert html_extract.main_text(page, w) == plain, more[:40]
    for bad in ('<a b="', "<a b='\"<x c=\"'", '<x a="<x" b="<x"', "<a =", "<a b=\"' c='"):  # linear on tags without an end
        html_extract.runs_of(bad * 100_000 + ">")


def test_html_scan_is_the_maximum():
    rng = random.Random(2)
    for _ in range(50):
        s = [rng.uniform(-1, 1) for _ in range(12)]
        a, b = html_extract.best_stretch(s)
        best = max([sum(s[i:j]) for i in range(12) for j in range(i + 1, 13)] + [0.0])
        assert math.isclose(sum(s[a:b]), best, abs_tol=1e-9)


def test_html_query(spark, sf_dir):
    rows = entry_module.queries()["op2_html_text"](spark, sf_dir).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    import html as entities

    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# ---------------------------------------------------------------- language model


def test_language_model(spark, docs):
    rows = {r["doc_id"]: r for r in gru_lm.score_documents(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fold = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in tokens(t)] + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in texts.items() if not held(i) for w in fold(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        w, r = fold(t), rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lower_words_of_slices():
    """Texts that lie behind others in one array, with and without nulls before them."""
    texts = ["Ab cD", "É x, THE the", "", "  Zz\x00 \x1cq", "A", None, "the End.", "b B"] * 3
    for off in range(12):
        for own in (texts[:off] + texts[off : off + 7], [x or "" for x in texts[: off + 7]]):
            words = gru_lm.lower_words(pa.array(own, pa.string()).slice(off, 7))
            want = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in tokens(x)] for x in own[off:]]
            forms = words.forms.to_pylist()
            assert [[forms[c] for c in words.codes[a : a + n]] for a, n in zip(words.starts, words.counts)] == want
            assert len(set(forms)) == len(forms)


def test_language_model_of_more_text_than_a_slice(spark):
    """Texts of 1.5 MB, several in one batch and chunk, against a plain count; copies have the same base score."""
    texts = [f"The {c} " + c.upper() * 1_500_000 + f" end of {c}." for c in "abcdef"] + ["a b the End", "a b the End", "of"]
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][:8]
    ids.append(next(i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2))
    rows = {r["doc_id"]: r for r in gru_lm.score_documents(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1), frequent=4).collect()}
    fold = [[w.lower() for w in tokens(t)] + [None] for t in texts]
    counts = collections.Counter(w for x in fold[:-1] for w in x)
    n, v = sum(counts.values()), len(counts)
    for i, w in zip(ids, fold):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i == ids[-1], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], math.fsum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-13)
    assert rows[ids[6]]["base_score"] == rows[ids[7]]["base_score"]


def test_state_is_carried_over_windows_and_backpropagation_is_right():
    v = gru_lm.Vocabulary(["a", "b"], np.ones(gru_lm.KINDS, np.int64), np.ones(gru_lm.KINDS, np.int64), np.arange(2 + gru_lm.KINDS + 1) + 1, 10, 5, np.arange(2 + gru_lm.KINDS + 1), 5, 5)
    net = gru_lm.new_network(v, 6, 5, 1)
    net = gru_lm.Network(*[x + (np.random.default_rng(i).standard_normal(x.shape) * 0.3).astype(np.float32) if x is not net.member_b else x for i, x in enumerate(net.arrays())])
    rng = np.random.default_rng(0)
    stream = rng.integers(0, v.end, 50)
    stream[[19, 49]] = v.end
    starts, sizes = np.array([0, 20]), np.array([20, 30])
    wide, narrow = (gru_lm.score_streams(net, v, stream, starts, sizes, window=k) for k in (64, 3))
    assert np.allclose(wide, narrow, atol=1e-3)
    # all outputs of one state sum to 1
    state = rng.standard_normal((1, 6)).astype(np.float32)
    total = sum(np.exp(gru_lm.log_prob(net, v, state, np.array([k]))[0]) for k in range(v.end + 1))
    assert abs(total - 1) < 1e-4
    trained = gru_lm.train_stream(net, v, np.tile(stream, 40), lanes=4, window=10)
    assert gru_lm.score_streams(trained, v, stream, starts, sizes).sum() > wide.sum()


def test_scores_do_not_hang_on_blocks(monkeypatch):
    """Few states at a time, and outputs told apart in small blocks, give the scores of one large block."""
    v = gru_lm.Vocabulary(["a", "b"], np.ones(gru_lm.KINDS, np.int64), np.ones(gru_lm.KINDS, np.int64), np.arange(2 + gru_lm.KINDS + 1) + 1, 10, 5, np.arange(2 + gru_lm.KINDS + 1), 5, 5)
    net = gru_lm.new_network(v, 6, 5, 1)
    stream, sizes = np.random.default_rng(0).integers(0, v.end, 120), np.array([20, 70, 1, 29])
    starts = np.cumsum(sizes) - sizes
    large = gru_lm.score_streams(net, v, stream, starts, sizes)
    monkeypatch.setattr(gru_lm, "STATES", 3)
    monkeypatch.setattr(gru_lm, "BLOCK", 2)
    assert np.allclose(gru_lm.score_streams(net, v, stream, starts, sizes), large, rtol=1e-5)


def plain_score(model, text, counts):
    """log10 probability of a text by a plain loop over its words, one number at a time."""
    v, net = model.vocabulary, model.network
    k = net.u.shape[0]
    state, previous, total = np.zeros(k), v.end, 0.0
    for word in [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in tokens(text)] + [None]:
        x = net.embed[previous].astype(float) @ net.w + net.b
        back = state @ net.u.astype(float)
        z, r = (1 / (1 + np.exp(-(x[i * k : (i + 1) * k] + back[i * k : (i + 1) * k]))) for i in (0, 1))
        new = np.tanh(x[2 * k :] + r * back[2 * k :])
        state = z * state + (1 - z) * new
        if word is None:
            out = v.end
        elif word in v.words:
            out = v.words.index(word)
        else:
            kind = ((len(word) > 5) + (len(word) > 9)) * 6 + (2 if word.endswith(".") else 4 if word.endswith(",") else 0) + (not word.isascii())
            out = len(v.words) + kind
            total += math.log((counts[word] + 1) / (v.kind_total[kind] + v.kind_forms[kind] + 1))
        share = lambda logits: logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        c, m = divmod(int(v.slot[out]), v.members)
        total += share(net.class_w.astype(float) @ state + net.class_b)[c] + share(net.member_w[c].astype(float) @ state + net.member_b[c])[m]
        previous = out
    return total / math.log(10)


def test_scores_equal_a_plain_forward_pass(spark, docs, monkeypatch):
    """Whole texts, long ones among them, against the loop above, with the weights that were trained."""
    fitted = {}
    fit = gru_lm.fit_network
    monkeypatch.setattr(gru_lm, "fit_network", lambda train, v: fitted.setdefault("m", fit(train, v)))
    rows = {r["doc_id"]: r["score"] for r in gru_lm.score_documents(docs, frequent=300).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in texts.items() if not held(i) for w in tokens(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    longest = sorted(texts, key=lambda i: len(texts[i] or ""))
    for i in longest[:3] + longest[90:100] + longest[-2:]:
        assert math.isclose(rows[i], plain_score(fitted["m"], texts[i], counts), rel_tol=1e-4), i


def test_every_training_text_reaches_the_network(spark):
    """Each of 40 short texts, dealt over partitions, has a word of its own whose embedding must move."""
    words = [f"w{i}" for i in range(40)]
    train = spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(words)], "doc_id long, text string").repartition(4)
    v = gru_lm.fit_vocabulary(gru_lm.count_words(train), 40)
    net = gru_lm.fit_network(train, v).network
    moved = np.abs(net.embed - gru_lm.new_network(v, 24, 16, 23).embed).max(1)
    assert sorted(v.words) == sorted(words) and (moved[:40] > 1e-4).all()
    # the last targets of a stream that lanes don't divide are learned, too
    stream = np.append(np.zeros(2 * 40, np.int64), 1)
    old, new = (gru_lm.train_stream(gru_lm.new_network(v, 16, 16, 23), v, x, lanes=2) for x in (stream[:-1], stream))
    assert not np.allclose(old.member_b[v.slot[1] // v.members], new.member_b[v.slot[1] // v.members])


# ---------------------------------------------------------------- quality rules


def counts_by_hand(text):
    w = tokens(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdict(spark, docs, sf_dir, odd):
    for df in (docs, odd.where("doc_id is not null")):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        rows = perplexity_rules.apply_quality_rules(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = counts_by_hand(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = perplexity_rules.apply_quality_rules(docs).collect()
    clean = [r for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert all(r["kept"] for r in clean)


def reference_by_hand(text):
    n, _, symbols, _, covered = counts_by_hand(text)
    letters = [x for w in tokens(text) for x in w if x.isalpha()]
    return n >= 10 and 100 * covered <= 20 * n and 10 * symbols <= n and 10 * sum(x.isupper() for x in letters) <= 3 * len(letters)


class PlainKneserNey:
    """Interpolated modified Kneser-Ney with dictionaries, one n-gram at a time."""

    def __init__(self, texts, order=5):
        self.order, grams = order, collections.Counter()
        for t in texts:
            t = "\x01" * (order - 1) + t
            grams.update(t[i : i + order] for i in range(len(t) - order + 1))
        self.counts = {order: grams}
        for n in range(order - 1, 0, -1):
            self.counts[n] = collections.Counter(g[1:] for g in self.counts[n + 1])
        self.discount, self.total, self.left = {}, collections.Counter(), collections.Counter()
        for n, c in self.counts.items():
            n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
            self.discount[n] = (0.5, 0.75, 1.0)
            if n1 and n2:
                y = n1 / (n1 + 2 * n2)
                raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / max(n3, 1))
                self.discount[n] = tuple(min(max(x, low), high) for x, low, high in zip(raw, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85)))
            for g, v in c.items():
                self.total[n, g[:-1]] += v
                self.left[n, g[:-1]] += self.discount[n][min(v, 3) - 1]

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / 0x110000
        total, v = self.total[n, gram[:-1]], self.counts[n][gram]
        own = (v - self.discount[n][min(v, 3) - 1]) / total if v else 0.0
        return own + (self.left[n, gram[:-1]] / total if total else 1.0) * self.p(gram[1:])

    def log_perplexity(self, text):
        t = "\x01" * (self.order - 1) + text
        return -sum(math.log(self.p(t[i : i + self.order])) for i in range(len(text))) / max(len(text), 1)


def kept_by_hand(rows, width=3.0):
    """doc_id -> verdict by bands from the log-perplexities of reference texts."""
    bands = {}
    for lang in {r["model"] for r in rows}:
        own = [r for r in rows if r["model"] == lang and r["reference"] and r["n_scored"]]
        spread = lambda x: (np.percentile(x, 84) - np.percentile(x, 16)) / 2 if x else 0.0
        value = lambda low, high: [math.floor(r["log_ppl"] * 1000 + 0.5) / 1000 for r in own if low <= r["n_scored"] < high]
        if own:
            long, short = spread(value(1000, 1 << 60)), spread(value(1, 400))
            inverse = [1 / r["n_scored"] for r in own if r["n_scored"] < 400]
            one = math.sqrt(max(short**2 - long**2, 0.25) / np.mean(inverse)) if inverse else 3.0
            bands[lang] = np.median(value(1, 1 << 60)), max(long, 0.005), one
    out = {}
    for r in rows:
        inside = True
        if r["model"] in bands:
            mid, spread, one = bands[r["model"]]
            inside = abs(r["log_ppl"] - mid) <= width * math.sqrt(spread**2 + one**2 / max(r["n_scored"], 1)) + 1e-9
        out[r["doc_id"]] = inside and not r["base_failed"]
    return out


LIMITS = {"one array": {}, "shards": {"broadcast_ngrams": 0, "shard_ngrams": 5000, "chunk_bytes": 50_000}}


@pytest.mark.parametrize("way", LIMITS)
def test_perplexity_and_verdict_equal_a_plain_model(spark, docs, way):
    """Every text's log-perplexity and verdict, junk and all, under dictionaries over all reference texts."""
    sample = docs.select("doc_id", "text", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("lang")).alias("lang"))
    texts = {r["doc_id"]: (r["text"] or "", r["lang"] or "und") for r in sample.collect()}
    models = {x: PlainKneserNey([t for t, lang in texts.values() if lang == x and reference_by_hand(t)]) for x in {x for _, x in texts.values()}}
    rows = perplexity_rules.apply_quality_rules(sample, **LIMITS[way]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, lang = texts[r["doc_id"]]
        assert r["model"] == lang and r["n_scored"] == len(text) and r["reference"] == reference_by_hand(text)
        if len(text) < 5000:
            assert math.isclose(r["log_ppl"], models[lang].log_perplexity(text), rel_tol=1e-5, abs_tol=1e-6), r["doc_id"]
    assert {r["doc_id"]: r["kept"] for r in rows} == kept_by_hand(rows)


@pytest.mark.parametrize("way", LIMITS)
def test_perplexity_of_frequent_far_and_unseen_symbols(spark, way):
    """All counts above 1,000, symbols beyond the basic plane, a language without reference texts, and texts with no common n-gram."""
    line = "the cat sat on a mat and the dog ran off to far away 中文 😀 "
    rows = [(i, line, "en") for i in range(1200)] + [(2000, "!!! ### $$$ 中文", "en"), (2001, "a b c", "zz"), (2002, "", "en"), (2003, None, None), (2004, "\x01\x00 \U0010ffff", "en")]
    got = {r["doc_id"]: r for r in perplexity_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), **LIMITS[way]).collect()}
    model = PlainKneserNey([line] * 1200)
    assert min(model.counts[5].values()) >= 1000
    for i in (0, 1199, 2000, 2002, 2004):
        assert math.isclose(got[i]["log_ppl"], model.log_perplexity(rows[min(i, 1199)][1] if i < 2000 else {2000: rows[1200][1], 2002: "", 2004: rows[1204][1]}[i]), rel_tol=1e-5, abs_tol=1e-6)
    assert math.isclose(got[2001]["log_ppl"], math.log(0x110000), rel_tol=1e-5) and got[0]["kept"] and not got[2000]["kept"]


def test_counting_holds_little_memory(spark):
    """A task that counts millions of different n-grams stays below 200 MB of arrays, and loses none."""
    batches = [pa.record_batch({"text": pa.array(["".join(map(chr, np.random.default_rng(i).integers(0x4E00, 0x9E00, 30_000))) for i in range(j, j + 25)]), "k": np.full(25, 7)}) for j in range(0, 75, 25)]
    total, peak = 0, 0

    class Frame:
        """Stands for the table of documents, and runs the function that a task gets."""

        def __getattr__(self, name):
            return lambda *a, **b: self

        def mapInArrow(self, f, schema):  # noqa: N802
            nonlocal total, peak
            tracemalloc.start()
            for made in f(iter(batches)):
                total += made.num_rows
                peak = max(peak, tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            return self

    perplexity_rules.count_grams(Frame())
    assert total > 2_240_000 and peak < 200e6


def test_hash_array_finds_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    table = perplexity_rules.HashArray(rng.permutation(keys), np.arange(len(keys)))
    assert (table.hashes[table.find(keys)] == keys).all() and (table.find(keys + np.uint64(1)) < 0).all()
    assert (perplexity_rules.HashArray(keys[:0], keys[:0]).find(keys[:3]) == -1).all()


# ---------------------------------------------------------------- nearest neighbours


def neighbours_by_hand(rows, q, k):
    """The k best of distinct usable rows for the query row q = (id, vector)."""
    best = sorted({(-float(np.dot(q[1], v)), i) for i, v in rows if i != q[0]})[:k]
    return [(i, -s) for s, i in best]


@pytest.mark.parametrize("shard_rows, part_queries", [(16384, 65536), (150, 7)])
def test_nearest_vectors(spark, sf_dir, shard_rows, part_queries):
    """Against brute force, in one shard and over many; the stop spares rows, and recall is what the level promises."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    found, verified = collections.defaultdict(list), {}
    for r in srs_ann.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=shard_rows, part_queries=part_queries).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        verified[r["query_id"]] = r["verified"]
    hit = 0
    for q, rows in found.items():
        best = sorted((-float(x[q] @ x[v]), v) for v in x if v != q)[:20]
        rows.sort()
        assert [k for k, _, _ in rows] == list(range(1, 21)) and len({v for _, v, _ in rows}) == 20
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(abs(s - float(x[q] @ x[v])) < 1e-12 for _, v, s in rows)
        hit += len({v for _, v in best} & {v for _, v, _ in rows})
    assert hit >= 0.9 * 20 * len(found) and len(found) == sum(v % 20 == 0 for v in x)
    if shard_rows > len(x):  # few rows: at 50,000 less than half is verified; small shards reach good distances late
        assert 0 < np.mean(list(verified.values())) < 0.95 * len(x)


def test_nearest_verifies_a_part_of_many_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rng = np.random.default_rng(3)
    x = np.array([r["embedding"] for r in df.collect()], np.float32)
    x = x[rng.integers(0, len(x), 20_000)] + rng.standard_normal((20_000, x.shape[1])).astype(np.float32) * x.std() * 0.25
    many = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    seen = {}
    for r in srs_ann.nearest(many, many.where("vec_id % 500 = 0"), shard_rows=8000).collect():
        got[r["query_id"]].add(r["vec_id"])
        seen[r["query_id"]] = r["verified"]
    hit = 0
    for q, rows in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(rows & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(got) == 0.9 * 20 * 40 and np.mean(list(seen.values())) < 0.6 * len(x)


def test_nearest_odd_vectors(spark):
    """Vectors that take no part, ties, repeated rows, an id of two vectors, no id, clashing columns, no rows."""
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (20, [0.0, 1.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    run = lambda d: [tuple(r)[:4] for r in srs_ann.nearest_of_every_20th(d).orderBy("query_id", "rank").collect()]
    assert run(df) == want
    assert run(df.union(df).union(spark.createDataFrame([(None, [1.0, 1.0])], df.schema))) == want
    clash = df.withColumns({c: F.lit("x") for c in ("score", "rank", "place", "cell", "query_id", "part", "verified")})
    assert run(clash) == want
    assert srs_ann.nearest_of_every_20th(df.limit(0)).count() == 0
    assert srs_ann.nearest_of_every_20th(df.where("embedding is null")).count() == 0
    two = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0])]
    got = sorted(tuple(r)[:4] for r in srs_ann.nearest_of_every_20th(spark.createDataFrame(two, df.schema)).collect())
    assert got == [(20, 1, 1, 1.0), (20, 1, 1, 3.0), (20, 2, 2, 1.0), (20, 2, 2, 1.0)]


def test_nearest_ties_and_hot_rows_over_shards(spark):
    """A third of all rows is one vector; ids decide among them, whichever shards hold them."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id is not null")
    got = collections.defaultdict(list)
    for r in srs_ann.nearest(df, df.where("vec_id % 20 = 0"), confidence=1 - 1e-12, shard_rows=64, part_queries=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, v) for i, v in rows if any(v)]
    for q in usable:
        if q[0] % 20 == 0:
            assert [(v, s) for _, v, s in sorted(got[q[0]])] == neighbours_by_hand(usable, q, 20)


def test_chi_square():
    assert abs(srs_ann.chi_square(np.array([15.5073]), 8)[0] - 0.95) < 1e-4
    assert abs(srs_ann.chi_square_point(0.95, 8) - 15.5073) < 1e-3


# ---------------------------------------------------------------- classifier, language


def test_classifier_on_held_out(spark):
    at = DATA.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    rows = subword_classifier.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_language_on_held_out(spark, docs):
    rows = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out)


def scalar_mix(x):
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def scalar_grams(text, orders, bits):
    """Hash of each n-gram of a text, one by one."""
    for i in range(len(text)):
        h = 0
        for n in range(1, max(orders) + 1):
            if i + n > len(text):
                break
            h = (h * 0x9E3779B97F4A7C15 + ord(text[i + n - 1]) + n) & ((1 << 64) - 1)
            if n in orders:
                yield scalar_mix(h) >> (64 - bits)


class PlainBayes:
    """Naive Bayes with a dictionary of counts for each language."""

    def __init__(self, rows, bits=17, smoothing=0.1):
        self.bits, self.counts, self.n = bits, collections.defaultdict(collections.Counter), collections.Counter()
        for text, lang in rows:
            self.counts[lang].update(self.grams(text))
            self.n[lang] += 1
        self.names = sorted(self.counts)
        self.total = {x: sum(self.counts[x].values()) + smoothing * (1 << bits) for x in self.names}
        self.smoothing = smoothing

    def grams(self, text):
        plain = "".join("0" if "0" <= c <= "9" else " " if "\t" <= c <= "\r" else c for c in f" {(text or '').lower()} ")
        return list(scalar_grams(plain, (1, 2, 3), self.bits))

    def predict(self, text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        grams = collections.Counter(self.grams(text))
        joint = {x: math.log(self.n[x] / sum(self.n.values())) + sum(k * math.log((self.counts[x][g] + self.smoothing) / self.total[x]) for g, k in grams.items()) for x in self.names}
        best = max(self.names, key=lambda x: joint[x])
        root = math.sqrt(sum(grams.values()))
        return best, 1 / sum(math.exp((joint[x] - joint[best]) / root) for x in self.names)


@pytest.mark.parametrize("block", [256, 3])
def test_language_equals_a_plain_model(spark, docs, block):
    """Every prediction and score, with more labels than fit one block of languages, too."""
    rows = [(r["doc_id"], (r["text"] or "")[:400], r["lang"] if r["doc_id"] % 5 else f"{r['lang']}-{r['doc_id'] % 4}") for r in docs.collect()]
    rows += [(9001, "123 456", "en"), (9002, None, "en"), (9003, "", None), (9004, "a\u00e9 b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = PlainBayes([(t, x) for i, t, x in rows if x is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2])
    assert len(model.names) > 8
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_languages(df, block=block).collect()}
    for i, text, _ in rows:
        name, score = model.predict(text)
        assert got[i][0] == name and math.isclose(got[i][1], score, rel_tol=1e-3, abs_tol=1e-4), i


def plain_quality(model, text):
    """Probability of class 1 by a loop over words and their features."""
    words = tokens(text)
    hidden = np.zeros(model.vectors.shape[1])
    for i, w in enumerate(words):
        import xxhash

        features = [xxhash.xxh3_64_intdigest(w.encode(), 0) >> (64 - model.bits), *scalar_grams(f"<{w}>", (3, 4, 5), model.bits)]
        hidden += model.vectors[features].astype(float).mean(0) / len(words)
        if i and w == words[i - 1]:
            hidden += model.vectors[subword_classifier.repeat_feature(model.bits)].astype(float) / len(words)
    z = hidden @ model.out + model.bias
    return 1 / (1 + math.exp(z[0] - z[1]))


def test_quality_scores_equal_a_plain_sum(spark, sf_dir, docs, odd, monkeypatch):
    fitted = {}
    fit = subword_classifier.fit_classifier
    monkeypatch.setattr(subword_classifier, "fit_classifier", lambda train: fitted.setdefault("m", fit(train)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = docs.select("doc_id", "text").union(odd.where("doc_id < 9").dropDuplicates(["doc_id"]).select(F.col("doc_id") + 100_000, "text"))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    rows = subword_classifier.score_quality(both, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r["doc_id"]] or "") < 4000:
            assert math.isclose(r["score"], plain_quality(fitted["m"], texts[r["doc_id"]]), rel_tol=1e-4, abs_tol=1e-5)


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    assert subword_classifier.bounded_sample(docs, labels, 50, 1 << 20).count() == 50
    assert subword_classifier.bounded_sample(docs, labels, 50, 1000).count() == 10
    a, b = ({r["doc_id"] for r in subword_classifier.bounded_sample(d, labels, 50, 1000).collect()} for d in (docs, docs.repartition(3)))
    assert a == b


# ---------------------------------------------------------------- tokens


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(token_file(BYTE_BPE))
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        ids = {i: exact.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
        pieces = packing.pack_documents(df, token_file(BYTE_BPE)).collect()
        by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
        for p in pieces:
            own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
            assert len(own) == p["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
            by_doc[p["doc_id"]].append((p["start"], p["length"]))
            by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        for parts in [*by_doc.values(), *by_sequence.values()]:
            end = 0
            for start, length in sorted(parts):
                assert start == end
                end += length
        assert all(sum(n for _, n in p) <= 2048 for p in by_sequence.values())
        assert {i: sum(n for _, n in p) for i, p in by_doc.items()} == {i: len(x) for i, x in ids.items()}
    total = sum(len(x) for x in ids.values())
    assert len(by_sequence) <= total / 2048 * 1.1 + 2


def test_added_tokens_within_texts():
    """Ids are those of the file's encoder as it comes, where a text holds an added token, too."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(token_file(BYTE_BPE))
    for t in ("<|endoftext|>", "one <|endoftext|> two<|endoftext|>", "<|endoftext", "plain text"):
        assert packing.encode(t, token_file(BYTE_BPE)).tolist() == exact.encode(t, add_special_tokens=False).ids
    assert 50256 in packing.encode("one <|endoftext|> two", token_file(BYTE_BPE))


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 100, 300))[::-1]
    bins, offsets = packing.first_fit_decreasing(lengths, 128)
    room = []
    for n, b, o in zip(lengths, bins, offsets):
        want = next((i for i, r in enumerate(room) if r >= n), len(room))
        if want == len(room):
            room.append(128)
        assert (b, o) == (want, 128 - room[want])
        room[want] -= n


def test_sentencepiece_equals_library(spark, docs, odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=token_file(PIECE_BPE))
    rng = random.Random(9)
    own = sentencepiece_bpe.encoder(token_file(PIECE_BPE))
    for _ in range(400):
        t = "".join(rng.choice("abc  ▁\n\t éß中😀\x00<0x0A>theing</s>�") for _ in range(rng.randint(0, 40)))
        assert own.encode(t) == lib.encode(t) and own.decode(lib.encode(t) + [2]) == lib.decode(lib.encode(t) + [2])
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        rows = sentencepiece_bpe.encode_documents(df, token_file(PIECE_BPE)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = lib.encode(texts[r["doc_id"]] or "") + [2]
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


# ---------------------------------------------------------------- licences


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
AS_IS = 'The software is provided "as is".'
FULL = {
    "MIT": f"{GRANT} The above copyright notice and this permission notice shall be included in all copies. {AS_IS}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice appear in all copies.\n{AS_IS}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n{AS_IS}",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n" + AS_IS,
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted provided that:\n* Redistributions of source code must retain the above copyright notice.\n* Redistributions in binary form must reproduce the above copyright notice.\n* Neither the name of the owner nor names of contributors may be used.\n" + AS_IS,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty.\n1. The origin of this software must not be misrepresented; you must not claim that you wrote it.\n2. Altered source versions must be plainly marked as such.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Artistic-2.0": "This module is distributed under the terms of the Artistic License 2.0.",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0.",
    "PSF-2.0": "Licensed under the Python Software Foundation License Version 2.",
    "WTFPL": "This work is free and is published under the Do What The Fuck You Want To Public License.",
    "CC0-1.0": "CC0 1.0 Universal",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-ND-3.0": "Available under CC BY-NC-ND 3.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This article is published under a Creative Commons Attribution 4.0 International License.",
    "AGPL-3.0": "it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.".replace("it under", "You can redistribute it and/or modify\nit under"),
}


def licences_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return [(r["licences"], r["status"]) for r in licenses.scan_licences(df).orderBy("doc_id").collect()]


def test_licence_texts_and_notices(spark):
    assert dict(zip(FULL, licences_of(spark, FULL.values()))) == {k: (k, "known") for k in FULL}
    for sign in (" * ", "# ", "// "):
        commented = ["\n".join(sign + x for x in t.split("\n")) for t in FULL.values()]
        assert dict(zip(FULL, licences_of(spark, commented))) == {k: (k, "known") for k in FULL}
    # a text around a notice changes nothing
    within = [f"Some words before it.\n{t}\nSome words after it." for t in FULL.values()]
    assert dict(zip(FULL, licences_of(spark, within))) == {k: (k, "known") for k in FULL}


def test_licence_sentences(spark):
    known = {
        "Released under the MIT License.": "MIT",
        "Licensed to you under the Apache\nLicense, Version 2.0.": "Apache-2.0",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
        "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause": "BSD-3-Clause,GPL-2.0",
        "Dual-licensed under the MIT license or the Apache License, Version 2.0": "Apache-2.0,MIT",
        "Licensed under the MIT License\nLicensed under the Apache License, Version 2.0": "Apache-2.0,MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "GNU Lesser General Public License": "LGPL",
        "Code: BSD 3-Clause": "BSD-3-Clause",
        "A 2-clause BSD work": "BSD-2-Clause",
        "CC BY-ND 4.0": "CC-BY-ND-4.0",
        "CC BY": "CC-BY",
        "The MIT License\nThe MIT License": "MIT",
    }
    assert dict(zip(known, licences_of(spark, known))) == {k: (v, "known") for k, v in known.items()}
    none = {"This is not licensed under the MIT License.": "unknown", "Some license or other.": "unknown", "It is no longer available under CC BY 4.0.": "unknown", "The MIT License is shorter than others, people say.": "unknown", "nothing": "none", None: "none", "": "none", "SPDX-License-Identifier: Nonsense-1.0": "unknown"}
    assert licences_of(spark, none) == [("", v) for v in none.values()]
    counts = licenses.scan_licences(spark.createDataFrame([(1, "Released under the MIT License. Some license or other.\nA line.")], "doc_id long, text string")).first()
    assert (counts["n_sentences"], counts["n_known"], counts["n_unknown"]) == (2, 1, 1)


def test_wrapped_licence_headers(spark):
    """Standard headers with their line ends, plain and as comments."""
    more = "\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License\nalong with this program.\n"
    start = "This program is free software; you can redistribute it and/or modify\nit under the terms of the "
    heads = [
        start + "GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n" + more,
        start + "GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n" + more,
        start.replace("program", "library") + "GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n" + more.replace("General", "Lesser General"),
    ]
    want = [("GPL-2.0", "known"), ("GPL-3.0", "known"), ("LGPL-2.1", "known")]
    for sign in ("", " * ", "# ", "// "):
        assert licences_of(spark, ["\n".join(sign + x for x in h.split("\n")) for h in heads]) == want
    one_line = "GNU General Public License as published by the Free Software Foundation; either version 2"
    assert licences_of(spark, ["You can use it under the " + one_line]) == [("GPL-2.0", "known")]


def test_licences_equal_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    other = con.sql(licenses.scan_sql())
    columns = sorted(other.columns)
    theirs = sorted(tuple(str(r[other.columns.index(c)]) for c in columns) for r in other.fetchall())
    mine = sorted(tuple(str(r[c]) for c in columns) for r in entry_module.queries()["op10_licence_scan"](spark, sf_dir).collect())
    assert mine == theirs


# ---------------------------------------------------------------- odd tables


def operators(spark, df):
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"), F.lit("x").alias("text"))
    pages = df.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), F.lit("x").alias("text"))
    return {
        "near": lambda: minhash_dedup.near_duplicates(df),
        "html": lambda: html_extract.extract_pages(pages),
        "lm": lambda: gru_lm.score_documents(df),
        "rules": lambda: perplexity_rules.apply_quality_rules(df),
        "quality": lambda: subword_classifier.score_quality(df, labels),
        "pack": lambda: packing.pack_documents(df, token_file(BYTE_BPE)),
        "pieces": lambda: sentencepiece_bpe.encode_documents(df, token_file(PIECE_BPE)),
        "language": lambda: langid.identify_languages(df),
        "licence": lambda: licenses.scan_licences(df),
    }


@pytest.mark.parametrize("name", ["near", "html", "lm", "rules", "quality", "pack", "pieces", "language", "licence"])
def test_odd_rows(spark, odd, empty, name):
    rows = operators(spark, odd)[name]().collect()
    if name == "pack":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
    else:
        assert len(rows) == odd.count()
    assert operators(spark, empty)[name]().count() == 0
    nulls = odd.withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    assert operators(spark, nulls)[name]().count() == odd.count()


def test_odd_results(spark, odd):
    near = {(r["doc_id"], r["class_id"]) for r in minhash_dedup.near_duplicates(odd).collect()}
    assert (9, 8) in near and (0, 0) in near and (1, 1) in near
    langs = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(odd).collect()}
    assert langs[0] == langs[1] == langs[2] == "und"


# ---------------------------------------------------------------- pipeline


def classes_by_hand(texts):
    """doc_id -> class by exact weights and all pairs."""
    bags, parent = weighted_by_hand(texts), {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            common = sum(min(w, bags[b][x]) for x, w in bags[a].items() if x in bags[b])
            if texts[a] == texts[b] or (common and common >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - common)):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_pipeline_equals_brute_force(spark, docs, tmp_path):
    """Every stage by dictionaries and loops over whole texts: who is kept, which tokens, and where they lie."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs.where("n_chars < 4000").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: (r["text"] or "", r["lang"] or "und") for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    assert len(rows) > 100
    models = {x: PlainKneserNey([t for t, lang in rows.values() if lang == x and reference_by_hand(t)]) for x in {x for _, x in rows.values()}}
    scored = []
    for i, (t, lang) in rows.items():
        n, _, _, _, covered = counts_by_hand(t)
        scored.append({"doc_id": i, "model": lang, "reference": reference_by_hand(t), "n_scored": len(t), "log_ppl": models[lang].log_perplexity(t), "base_failed": n < 10 or 100 * covered > 20 * n})
    kept = kept_by_hand(scored)
    first = {i: t for i, t in rows.items() if kept[i]}
    bayes = PlainBayes([(t, lang) for i, (t, lang) in first.items() if zlib.crc32(str(i).encode()) % 4 != 2])
    second = {i: t for i, (t, _) in first.items() if bayes.predict(t)[0] != "und" and bayes.predict(t)[1] >= 0.5}
    last = {i for i, c in classes_by_hand(second).items() if i == c}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == last and len(last) < len(rows)
    exact = Tokenizer.from_file(token_file(BYTE_BPE))
    ids = {i: exact.encode(second[i], add_special_tokens=False).ids + [1] for i in last}
    for p in pieces:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(own) == p["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == p["ids_crc32"]
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_pipeline_stages_on_odd_tables(spark, odd, empty, sf_dir, stage):
    """Nulls, repeated rows, clashing columns and no rows, for every stage; rows that stay are whole."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, odd, sf_dir)
    if name == "packing":
        assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in odd.collect()}
    else:
        assert out.columns == odd.columns
        given = collections.Counter(map(str, odd.collect()))
        stay = collections.Counter(map(str, out.collect()))
        assert all(stay[x] <= given[x] for x in stay)
        if name == "near dedup":
            assert {r["text"] for r in out.collect()} == set(ODD_TEXTS) | {"no id here but a text of several words and more"} and max(stay.values()) == 1
        if name == "language id":
            assert not [r for r in out.collect() if not (r["text"] or "").strip()]
    assert run(spark, empty, sf_dir).count() == 0


def test_one_row_of_each_class_stays(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, text), (1, text), (2, text), (3, text + " nu"), (4, "quite another text with words of its own and no other"), (None, text)]
    kept = minhash_dedup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4]
