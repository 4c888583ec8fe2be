"""Helpers that several operators of this package use: tokens in Arrow, chunks, storage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.session import ship, store_path


def prepare(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, and bound what one Arrow batch may hold, so that long
    texts don't add up in a Python worker, and how much text of plans the driver keeps. The settings stay
    with the session: other queries of it get smaller batches, too, which changes no result."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000")
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    path = store_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; one row always fits, however long it is."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts; null counts as empty.

    codes: a number for each word in order; forms: the distinct words by number; counts and
    starts: words of each text, and where they begin in codes; doc: the text of each word.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.forms = coded.dictionary
        blank = pc.index(self.forms, pa.scalar("", self.forms.type)).as_py()
        if blank >= 0:
            real = codes != blank
            ends = np.concatenate([[0], np.cumsum(real)])
            offsets = ends[offsets]
            codes = codes[real]
        self.codes, self.starts, self.blank = codes, offsets[:-1], blank
        self.counts = np.diff(offsets)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value for each word over each text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
        return total[self.starts + self.counts] - total[self.starts]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_forms(forms: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string, alike on every machine."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x, seed) for x in forms.cast(pa.large_binary()).to_pylist()), np.uint64, len(forms))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text begins (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # the texts lie one after the other in one buffer
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    joined = bytes(raw[int(ends[0]) : int(ends[-1])]).decode() if raw is not None else ""
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(sizes)])


def framed(texts: pa.Array, before: str, after: str = "") -> pa.Array:
    """Texts (null: empty) with something before and after each."""
    big = pa.large_string()
    return pc.binary_join_element_wise(pa.scalar(before, big), pc.fill_null(texts.cast(big), ""), pa.scalar(after, big), pa.scalar("", big))


def quantity(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text of a table, by one pass in the JVM."""
    from pyspark.sql import functions as F

    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return row["n"], row["b"] or 0


def batches(*arrays: tuple[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for _, x in arrays], names=[n for n, _ in arrays])


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


ROW = "__row"


def carried(df: DataFrame) -> DataFrame:
    """All columns of df as one struct beside text, lang and doc_id, so that no name clashes with what an operator adds."""
    from pyspark.sql import functions as F

    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(ROW), *(c for c in ("doc_id", "text", "lang") if c in df.columns))


def extended(df: DataFrame, keep: list[str], ddl: str):
    """Schema of columns keep of df and of those in ddl."""
    from pyspark.sql.types import StructType

    return StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(ddl).fields])


def text_of(batch: pa.RecordBatch, keep: list[str], after: int) -> pa.Array:
    """The text that goes with columns keep: in the carried row, among them, or at place ``after``."""
    if ROW in keep:
        return plain(pc.struct_field(batch.column(keep.index(ROW)), "text"))
    return plain(batch.column(keep.index("text") if "text" in keep else after))


def has_text(keep: list[str]) -> bool:
    return ROW in keep or "text" in keep
