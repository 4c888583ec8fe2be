"""Packing of documents into token sequences: first-fit decreasing with a tournament tree.

Every document becomes the token ids of its text and an end id. Ids are cut into full windows
and a rest; windows that fill a sequence need no search. Documents fall into randomised groups by a hash
of their id and number of tokens, and each group packs its pieces independently by first-fit decreasing: a
tournament tree over bin capacities finds the first bin with room in O(log bins). The number of
groups grows with the number of documents, so a group stays small at any scale; only piece
descriptors (no text, no ids) are shuffled.

Ids are those of the ``tokenizers`` file; a faster encoder is made from the same file's
vocabulary (its merge rank is its id) and the file's own encoder stands in wherever that one fails or a text holds an added token.

Cases: null or empty text: one piece of one end id; a text of any length: as many pieces as it
takes; ties: by doc_id, then start, then checksum; repeated rows: packed as often as they come
(each gets a place of its own); empty table: no rows; extra columns: ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, prepare

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
GROUP_DOCS = 8192


@lru_cache(maxsize=2)
def encoders(path: str):
    """The file's encoder, a faster one with the same vocabulary (None if it has another form), and
    the file's added tokens, which only its own encoder finds in a text."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        return exact, None, special
    # byte-level files write each byte as a printable character: bytes that print stand for themselves, others follow from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    as_byte = {c: b for b, c in as_char.items()}
    ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    ids = [spec["model"]["vocab"][a + b] for a, b in merges]
    if ids != sorted(ids):
        return exact, None, special
    return exact, tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def encode(text: str, path: str) -> np.ndarray:
    exact, fast, special = encoders(path)
    if fast is not None and len(text) < 1 << 20 and not any(x in text for x in special):
        try:
            return np.array(fast.encode_ordinary(text), np.uint32)
        except Exception:  # a pattern that backtracks too far
            pass
    return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, path: str, *, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of each document's ids, none longer than window."""
    prepare(docs.sparkSession)

    def pieces(parts):
        for batch in parts:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or "", path), np.uint32(end_id)).astype("<u4")
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    rows.append((doc, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
            table = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in table], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


class Tournament:
    """Winners' tree over the room left in each bin; a leaf for each bin that may be needed."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [0] * self.leaves + [room] * self.leaves
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def take(self, need: int) -> tuple[int, int]:
        """First bin with room for need, and its room before; the room shrinks."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < need:
                i += 1
        before = tree[i]
        tree[i] = before - need
        bin_no = i - self.leaves
        while i > 1:
            i //= 2
            most = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == most:
                break
            tree[i] = most
        return bin_no, before


def first_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, which come in decreasing order."""
    tree = Tournament(len(lengths), window)
    found = [tree.take(int(x)) for x in lengths]
    return np.array([b for b, _ in found], np.int64), np.array([window - room for _, room in found], np.int64)


def pack_pieces(pieces: DataFrame, groups: int, *, window: int = 2048, seed: int = 11) -> DataFrame:
    """Add sequence_id and offset; the upper part of a sequence_id is its group."""

    def pack(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        order = pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]).to_numpy()
        bins, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bins[order], offset[order] = first_fit_decreasing(length[order], window)
        sequence = (table["part"].to_numpy() << 32) + bins
        return table.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # the number of tokens tells apart documents that share an id, or have none
    part = F.pmod(F.xxhash64("doc_id", "doc_tokens", F.lit(seed)), F.lit(groups)).cast("long")
    return pieces.withColumn("part", part).groupBy("part").applyInArrow(pack, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, *, window: int = 2048, end_id: int = 1, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row for each piece with its place."""
    groups = max(1, -(-docs.count() // group_docs))
    return pack_pieces(token_pieces(docs, path, window=window, end_id=end_id), groups, window=window)
