"""SentencePiece (merge type) encoding by backtracking, and decoding.

A merge encoder's result is the only sequence of vocabulary pieces in which every two neighbours
are what merging their joined text gives back. So a text is encoded without a merge queue: an
Aho-Corasick automaton yields all pieces by their end; from the left, the longest piece that fits
its left neighbour is taken; if none fits, the search goes back to the neighbour's next shorter
piece, and the position is marked in a bitfield as failed, so it is never tried again. Whether two
pieces fit is found by merging their joined text again, once for each pair.

Pieces never run on from other characters into a blank, so a text falls apart before each run of
blanks; equal parts are encoded once for each worker (a bounded cache).

Characters without a piece become byte pieces. Cases: null or empty text: the end id alone;
texts of any length: linear in the number of parts; a part without blanks of any length: linear
but for steps back; ties: merges of equal rank go from the left, as in the library; repeated rows:
each gets its own result; empty table: no rows; extra columns, whatever their names: ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import prepare

BLANK = "▁"
PARTS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries of a worker's caches, about 300 and 100 bytes each.
CACHE, PAIRS = 600_000, 1_000_000
#: Parts longer than this are encoded but not kept.
CACHED_CHARS = 64


class MergeEncoder:
    """Encoder and decoder for the model at ``path``."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as spec

        model = spec.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        pieces = [(p.piece, p.type, p.score) for p in model.pieces]
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not trainer.byte_fallback or any(t in (USER, UNUSED) for _, t, _ in pieces):
            raise ValueError("this encoder takes merge models with byte fallback and without text rewriting")
        if any(BLANK in p.lstrip(BLANK) for p, _, _ in pieces):
            raise ValueError("a piece runs on into a blank")
        self.dummy_prefix = norm.add_dummy_prefix
        self.ids = {p: i for i, (p, t, _) in enumerate(pieces) if t == NORMAL}
        self.scores = {p: s for p, t, s in pieces if t == NORMAL}
        self.piece = [p for p, _, _ in pieces]
        self.kind = [t for _, t, _ in pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, t, _) in enumerate(pieces) if t == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.end_id = trainer.eos_id if trainer.eos_id >= 0 else next(i for i, (p, _, _) in enumerate(pieces) if p == "</s>")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        self.fits: dict[int, bool] = {}
        self.parts: dict[str, tuple[int, str, str, bool]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: the neighbours whose union scores best, the first of several, until none."""
        symbols, scores = list(text), self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = scores.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces may be neighbours: merging their text gives both back."""
        fits = self.fits
        if len(fits) > PAIRS:
            fits.clear()
        a, b = self.piece[left], self.piece[right]
        known = fits[left << 16 | right] = self.merge(a + b) == [a, b]
        return known

    def known_run(self, text: str) -> list[int]:
        """Ids of a text all of whose characters have a piece."""
        n = len(text)
        if n == 1:
            return [self.ids[text]]
        starts: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            starts[end - found[0] + 1].append(found)  # by increasing end, so by increasing size
        fits, compatible = self.fits, self.compatible
        failed = 0  # bit p: no way on from position p
        taken: list[int] = []
        sizes: list[int] = []
        tries: list[int] = []
        at, k = 0, len(starts[0])
        while True:
            options = starts[at]
            while k:
                k -= 1
                size, piece = options[k]
                if failed >> (at + size) & 1:
                    continue
                if taken:
                    ok = fits.get(taken[-1] << 16 | piece)
                    if ok is None:
                        ok = compatible(taken[-1], piece)
                    if not ok:
                        continue
                taken.append(piece)
                at += size
                if at == n:
                    return taken
                sizes.append(size)
                tries.append(k)
                k = len(starts[at])
                break
            else:
                # exactly one sequence is right for a text up to here, whatever comes before a
                # position, so a position without a way on stays without one
                failed |= 1 << at
                taken.pop()
                at -= sizes.pop()
                k = tries.pop()

    def encode_part(self, part: str) -> list[int]:
        if self.characters.issuperset(part):
            return self.known_run(part)
        out: list[int] = []
        run: list[str] = []
        for ch in part:
            if ch in self.characters:
                run.append(ch)
                continue
            if run:
                out += self.known_run("".join(run))
                run.clear()
            out += [self.byte_id[b] for b in ch.encode()]
        return out + self.known_run("".join(run)) if run else out

    def escaped(self, text: str) -> str:
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", BLANK)

    def encode(self, text: str) -> list[int]:
        """Ids without an end id."""
        return [i for part in PARTS.findall(self.escaped(text)) for i in self.encode_part(part)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces vanish, byte pieces join to UTF-8 (wrong bytes become
        replacement characters), and the blank that stands before a text is dropped."""
        out, run, first = [], bytearray(), True

        def flush():
            if run:
                out.append(decode_bytes(bytes(run)))
                run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                first = False
                continue
            flush()
            if self.kind[i] == CONTROL:
                continue
            piece = " ⁇ " if self.kind[i] == UNKNOWN else self.piece[i]
            if first and self.dummy_prefix and piece.startswith(BLANK):
                piece = piece[1:]
            first = False
            out.append(piece.replace(BLANK, " "))
        flush()
        return "".join(out)

    def remember(self, part: str) -> tuple[int, str, str]:
        """Number of ids of a part, the ids as text, and what they decode to within a text."""
        own = self.encode_part(part)
        if self.characters.issuperset(part):
            back = "".join([self.piece[i] for i in own]).replace(BLANK, " ")
        else:
            back = self.decode([own[0], *own])[len(self.decode([own[0]])) :] if self.kind[own[0]] != BYTE else self.decode(own)
        known = (len(own), " ".join(map(str, own)), back)
        if len(part) <= CACHED_CHARS:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[part] = known
        return known

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, SHA-256 of the ids, SHA-256 of the decoded text."""
        get, remember = self.parts.get, self.remember
        known = [get(part) or remember(part) for part in PARTS.findall(self.escaped(text))]
        ids = " ".join([x[1] for x in known])
        decoded = "".join([x[2] for x in known])
        if self.dummy_prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        ids = f"{ids} {self.end_id}" if ids else str(self.end_id)
        return sum([x[0] for x in known]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def decode_bytes(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that doesn't belong to a character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    prepare(docs.sparkSession)

    def encode(parts):
        own = encoder(path)
        for batch in parts:
            rows = [own.digest(t.as_py() or "") for t in batch.column(1)]
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
