"""Reading texts out of Arrow batches, and building Arrow batches again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 256
"""Rows whose Python objects are held at once, whatever size Spark's batches have."""

SLICE_BYTES = 4 << 20
"""Text bytes that the vectorised operators lay out as arrays at once (one longer text still goes alone)."""


def binary_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the UTF-8 bytes of ``text``; every other column stays behind."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than the session has cores (a single small file) dealt over all; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of at most ``rows`` rows (zero copy)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(texts: list[bytes | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``most`` bytes together."""
    start = total = 0
    for i, text in enumerate(texts):
        size = len(text or b"")
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def record_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``columns`` (lists, numpy or Arrow arrays) in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


TERM_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
"""ASCII letters in lower case, digits and all bytes beyond ASCII as they are; any other byte as a space."""
PIECE = 1 << 20


def words(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z in lower case."""
    return text.translate(TERM_BYTES).split()


def words_in_pieces(text: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The same in lists of about ``most`` bytes of text each, cut between words."""
    if len(text) <= most:
        if found := words(text):
            yield found
        return
    text, at = text.translate(TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        if found := text[at:end].split():
            yield found
        at = end
