"""Target-distribution importance resampling over hashed word runs.

Features are all runs of 1 to ``longest`` words, hashed into buckets.  How much
more frequent a bucket is in the target than in the corpus is its gain; a
document's weight is the mean gain of its features, and with Gumbel noise from a
hash of its id added, the highest scores are a sample without replacement whose
chances follow the weights.

Texts are skewed, so long ones are cut into overlapping chunks: each ends between
words and carries the ``longest - 1`` words behind its end, and owns the features
that start in it but in its carry.  So every feature has one owner, and the
chunks' counts and sums of gains add up to the document's.  Chunks of long texts
are written once and dealt over all tasks; other texts are read where they are.
Bucket counts are added up in each task and then by bucket; the driver gets one
number for each bucket.

The draw needs a rank of every drawn document in one order over all.  Scores are
whole numbers of a small range, so counts by score tell the last score that is
drawn; the documents above are sorted by range, and a partition's first rank is
the sum of the counts in front of it.  No task ranks more than its range.

Null texts have no words: no features and weight 0.  A null id hashes as the
empty string and ranks last among equal scores.  Rows are documents of their own,
also if ids repeat (which of equal rows ranks first is open).  Empty tables give
an empty result; without a target all buckets have its smoothed share.  Other
columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.scratch import Scratch
from gridwright.llm.texts import TERM_BYTES, record_batch, slices

CHUNK = 1 << 16
"""Bytes of text beyond which it is cut, and that a chunk owns."""
REMEMBERED = 8 << 20
"""Bytes of words whose hashes a task remembers; then it forgets all."""
UNIT = "row bigint, doc_id bigint, body binary, carry int"


def chunks(text: bytes, size: int = CHUNK, longest: int = 1) -> Iterator[tuple[bytes, int]]:
    """``(body, carry)``: chunks of about ``size`` bytes, with the next words at their end, ``carry`` of them."""
    text, at = text.translate(TERM_BYTES), 0
    while True:
        end = text.find(b" ", at + size)
        if end < 0:
            yield text[at:], 0
            return
        stop, carry = end, 0
        while carry < longest - 1:
            while stop < len(text) and text[stop] == 32:
                stop += 1
            if stop == len(text):
                break
            stop = text.find(b" ", stop)
            stop, carry = len(text) if stop < 0 else stop, carry + 1
        yield text[at:stop], carry
        at = end


class Buckets(dict):
    """Hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0
        self.size += len(word)
        self[word] = out = zlib.crc32(word)
        return out


def hashes(body: bytes, carry: int, longest: int, known: Buckets) -> tuple[np.ndarray, int]:
    """Hashes of the features that a chunk owns, and how many words it owns."""
    found = body.translate(TERM_BYTES).split()
    own = len(found) - carry
    one = np.fromiter(map(known.__getitem__, found), np.uint32, len(found))
    if longest == 1:
        return one, own
    out, last = [one[:own]], one
    for k in range(2, longest + 1):
        n = max(0, min(own, len(found) - k + 1))
        last = np.fromiter((zlib.crc32(b" " + found[i + k - 1], int(last[i])) for i in range(n)), np.uint32, n)
        out.append(last)
    return np.concatenate(out), own


def units(docs: DataFrame, longest: int = 1, size: int = CHUNK, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts that are one chunk, as they are, and the written chunks of all others; ``row`` tells rows apart."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("body", pa.binary()), ("carry", pa.int32())])
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    is_long = F.coalesce(F.octet_length("body"), F.lit(0)) > size

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for body, carry in chunks(batch.column(2)[0].as_py(), size, longest):
                yield record_batch([batch.column(0), batch.column(1), [body], [carry]], schema)

    cut = base.where(is_long).mapInArrow(apply, UNIT).repartition("row", F.xxhash64("body"))
    return base.where(~is_long).withColumn("carry", F.lit(0)), Scratch(docs.sparkSession, "resampling").cut(cut)


def bucket_counts(rows: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features by bucket; a task sends the counts of all it has read."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Buckets(), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for body, carry in zip(batch.column(0), batch.column(1).to_pylist()):
                found, _ = hashes(body.as_py() or b"", carry, longest, known)
                sums += np.bincount(found % buckets, minlength=buckets)
        some = np.flatnonzero(sums)
        yield record_batch([some, sums[some]], schema)

    counts = rows.select("body", "carry").mapInArrow(apply, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the log of its smoothed share of the target over that of the corpus, floored."""
    more, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + more) / ((s + 1.0) * (t_all + more)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


SUMS = "row bigint, doc_id bigint, n_words bigint, n_features bigint, total bigint"


def _sums(rows: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """Words, features and the sum of gains of every chunk."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("total", pa.int64())])
    sent = rows.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_bucket = Buckets(), sent.value
        for batch in slices(batches):
            out = []
            for body, carry in zip(batch.column(2), batch.column(3).to_pylist()):
                found, own = hashes(body.as_py() or b"", carry, longest, known)
                out.append((own, len(found), int(by_bucket[found % len(by_bucket)].sum())))
            if out:
                yield record_batch([batch.column(0), batch.column(1), *map(list, zip(*out))], schema)

    return rows.select("row", "doc_id", "body", "carry").mapInArrow(apply, SUMS)


def weighed(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, seed: int = 2024, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row."""
    whole, cut = units(docs, longest, size, id_col=id_col, text_col=text_col)
    t_whole, t_cut = units(target.withColumn("_none", F.lit(None).cast("bigint")), longest, size, id_col="_none", text_col=target_text)
    corpus = bucket_counts(whole, buckets, longest) + bucket_counts(cut, buckets, longest)
    wanted = bucket_counts(t_whole, buckets, longest) + bucket_counts(t_cut, buckets, longest)
    gain = gains(corpus, wanted)
    parts = _sums(cut, gain, longest).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "total")))
    rows = _sums(whole, gain, longest).unionByName(parts)
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("bigint")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, **options) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` of every row, and its ``rank`` if it is drawn.

    Drawn are the ``percent`` percent (floored) highest scores of the documents
    of ``least_words`` words or more, ties to the smaller id.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    rows = scratch.cut(weighed(docs, target, **options))
    able = F.col("n_words") >= least_words
    by_score = sorted(((r.score, r["count"]) for r in rows.where(able).groupBy("score").count().collect()), reverse=True)  # scores are logs of counts and of a 32-bit hash: tens of thousands at most
    draw = percent * sum(n for _, n in by_score) // 100
    last, left = None, draw
    for score, n in by_score:
        if left <= 0:
            break
        last, left = score, left - n
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*out, F.lit(None).cast("bigint").alias("rank"))
    near = able & (F.col("score") >= last)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    sorted_ = rows.where(near).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.cut(sorted_.select(*out, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    counts, before = sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect()), []  # a row for each partition
    for part, n in counts:
        before.append((part, (before[-1][1] + before[-1][2]) if before else 0, n))
    ahead = F.broadcast(docs.sparkSession.createDataFrame([(a, b) for a, b, _ in before], "part int, before bigint"))
    rank = F.col("before") + F.col("place") + 1
    drawn = placed.join(ahead, "part").select(*out, F.when(rank <= draw, rank).alias("rank"))
    return rows.where(~near).select(*out, F.lit(None).cast("bigint").alias("rank")).unionByName(drawn)
