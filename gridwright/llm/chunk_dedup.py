"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes, ``h = 2 * h + G[byte]`` modulo 2**32; a chunk
ends where ``BITS`` of its bits are zero.  The bits that are read depend on the
last ``REACH`` bytes only, so two copies of a passage are cut at the same places
from the first cut on, whatever stands before them: an insertion moves
boundaries near it and no others.  Behind ``QUIET`` bytes without such an end
``WEAK`` zero bits suffice (texts that repeat a few words have few values of the
hash); chunks that still have none end every ``LONGEST`` bytes.

Chunks with one 64-bit digest are copies.  Repeated chunks in a row make a run;
runs shorter than ``RUN`` bytes (a line or two that many documents share) don't
count.  Of each digest one copy stays, the first by a hash of id and text and by
place; chunks of runs that aren't that copy are redundant.

Spark sorts the chunks by digest, hash and place over all partitions, so the rows
of a very common chunk are split like any others, and neighbours are compared in
one scan.  What the first and last digest of a batch have in other batches is
settled by a row for each of them.

Nulls and empty texts have no chunks; a very long text is cut alone.  Repeated
rows are copies of each other, and as they can't be told apart, what stays of one
counts for all of them; otherwise ties don't occur.  An empty table gives an empty
result; other columns play no part.  Documents without a run have no row in the
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm import rolling
from gridwright.llm.scratch import Scratch
from gridwright.llm.texts import record_batch, runs, slices

BITS = 5
REACH = 16
LONGEST = 512
QUIET = 128
WEAK = 2
RUN = 150
PIECE = 2 << 20
GEAR = (rolling.TABLE >> np.uint64(31)).astype(np.uint32)


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The low ``REACH`` bits and more of the gear hash at every byte; a text starts from zero.

    ``H(2k)[i] = H(k)[i] + (H(k)[i - k] << k)`` doubles the bytes that count.
    """
    h = GEAR[data]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    k = 1
    while k < REACH:
        back = np.zeros_like(h)
        back[k:] = h[:-k] << np.uint32(k)
        back[place < k] = 0
        h = h + back
        k *= 2
    return h


def chunks(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Text number, start, end and digest of every chunk, in order."""
    data, offsets = rolling.laid_out(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    h, mask = gear(data, offsets), lambda bits: np.uint32(((1 << bits) - 1) << (REACH - bits))
    strong = (h & mask(BITS)) == 0
    strong[offsets[1:][offsets[1:] > 0] - 1] = True  # a text's end
    last = np.maximum.accumulate(np.where(strong, np.arange(len(h)), -1))
    quiet = np.arange(len(h)) - np.concatenate([[-1], last[:-1]]) > QUIET
    ends = np.flatnonzero(strong | (quiet & ((h & mask(WEAK)) == 0))) + 1
    starts = np.concatenate([[0], ends[:-1]])
    pieces = (ends - starts - 1) // LONGEST + 1
    first = np.repeat(starts, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    last = np.minimum(first + LONGEST, np.repeat(ends, pieces))
    digest = rolling.ranges(rolling.prefix(rolling.TABLE[data]), first, last)
    own = np.searchsorted(offsets, first, "right") - 1
    return own, first - offsets[own], last - offsets[own], digest


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([(x, pa.int64()) for x in ("digest", "rid", "place")])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rid, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in runs(texts, PIECE):
                own, start, end, digest = chunks(texts[a:b])
                yield record_batch([digest.view(np.int64), rid[a:b][own], start << 10 | (end - start)], schema)

    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(apply, "digest bigint, rid bigint, place bigint")


def _repeated(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rid``, ``place`` and ``stays`` (it is the copy that stays) of rows whose digest has another."""
    kind = "digest bigint, rid bigint, place bigint, n int"
    schema = pa.schema([("digest", pa.int64()), ("rid", pa.int64()), ("place", pa.int64()), ("n", pa.int32())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(3)]
            first = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            number = np.diff(np.append(first, len(cols[0])))
            n = np.repeat(np.where(number > 1, 0, -1), number)  # 0: a later copy, -1: alone
            n[first[number > 1]] = -2  # the first of several
            n[first[[0, -1]]] = np.minimum(number[[0, -1]], 2)  # rows of a digest that other batches may have too
            pick = n != -1
            yield record_batch([*(c[pick] for c in cols), n[pick].astype(np.int32)], schema)

    found = rows.repartitionByRange("digest", "rid", "place").sortWithinPartitions("digest", "rid", "place").mapInArrow(apply, kind)
    found = scratch.cut(found)
    edges = found.where("n > 0")  # two for each batch at most
    whole = edges.groupBy("digest").agg(F.sum("n").alias("all"), F.min(F.struct("rid", "place")).alias("low")).where("all > 1")
    settled = edges.join(whole, "digest").select("rid", "place", (F.struct("rid", "place") == F.col("low")).alias("stays"))
    return found.where("n <= 0").select("rid", "place", (F.col("n") == -2).alias("stays")).unionByName(settled)


def repeats(docs: DataFrame, *, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_runs``, ``n_repeated``, ``n_redundant`` and ``runs`` of documents with repeated runs."""
    scratch = Scratch(docs.sparkSession, "chunks")
    known = _repeated(_rows(docs, id_col, text_col), scratch)
    grouped = known.groupBy("rid").agg(F.collect_set(F.struct("place", "stays")).alias("found"))
    schema = pa.schema([("rid", pa.int64()), ("n_runs", pa.int64()), ("n_repeated", pa.int64()), ("n_redundant", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64())))])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for rid, found in zip(*(c.to_pylist() for c in batch.columns)):
                place: dict[int, bool] = {}
                for f in found:
                    place[f["place"]] = place.get(f["place"], False) or f["stays"]
                made: list[list[int]] = []
                for p in sorted(place):
                    a, b = p >> 10, (p >> 10) + (p & 1023)
                    gone = 0 if place[p] else b - a
                    if made and made[-1][1] == a:
                        made[-1][1] = b
                        made[-1][2] += gone
                    else:
                        made.append([a, b, gone])
                made = [m for m in made if m[1] - m[0] >= run]
                if made:
                    out.append((rid, len(made), sum(b - a for a, b, _ in made), sum(m[2] for m in made), [m[:2] for m in made]))
            if out:
                yield record_batch([list(x) for x in zip(*out)], schema)

    found = grouped.mapInArrow(join_up, "rid bigint, n_runs bigint, n_repeated bigint, n_redundant bigint, runs array<array<bigint>>")
    ids = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(id_col).alias("doc_id"), F.octet_length(text_col).cast("bigint").alias("n_bytes"))
    return ids.join(found, "rid").select("doc_id", "n_bytes", "n_runs", "n_repeated", "n_redundant", "runs")
