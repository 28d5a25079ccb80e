"""A quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: one and two lower-cased
tokens, and one to three token *shapes* (runs of capitals, small letters, digits
and symbols; a token equal to the one before has the shape of a repeat).  With
``p`` and ``q`` the smoothed shares of a feature in good and bad texts, each
indicator is scaled by ``log(p / q)``, rows are brought to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent.  A logistic curve
fitted on rows that the model has not seen turns margins into scores.

The model is fitted on ``SAMPLE`` labelled rows at most, those of the smallest
hashes of their ids, one row for an id, and on ``MOST_FEATURES`` features of them
together: these bounds, not the corpus, are what the driver holds.  Every text is
scored whole.

Nulls and empty texts have no features and get the score of the constant alone,
within 0 and 1.  Repeated labels of an id count once (the largest), labels
without a value not at all; of several rows of a labelled id the one with the
least features' bytes is learnt from; a very long text is held whole, as its
tokens; with one class only, or none, the score is the
smoothed share of label 1.  An empty table gives an empty result; other columns
(label columns too) are no inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.scratch import Scratch
from gridwright.llm.texts import binary_texts, record_batch, slices

BUCKETS = 1 << 18
SAMPLE = 12_000
"""Labelled rows that the model is fitted on, at most."""
MOST_FEATURES = 40_000_000
"""Features of all rows of the sample together, at most; rows of the largest hashes go first."""
LEAST_ROWS = 4
"""Rows of the sample that a feature must be in."""
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def shape(token: bytes, before: bytes) -> bytes:
    """The kind of a token: symbols stand for themselves, up to three of them."""
    if token == before:
        return b"="
    if token[:1].isdigit():
        return b"9"
    if token[:1].isalpha() or token[0] >= 128:
        return b"A" if token.isupper() and len(token) > 1 else b"Aa" if token[:1].isupper() else b"a"
    return token[:3]


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams."""
    tokens = TOKEN.findall(text or b"")
    if not tokens:
        return np.zeros(0, np.int32)
    shapes = list(map(shape, tokens, [b"", *tokens]))
    small = [t.lower() for t in tokens]
    grams = set(small)
    grams.update(map(b" ".join, zip(small, small[1:])))
    kinds = set(shapes)
    kinds.update(zip(shapes, shapes[1:]))
    kinds.update(zip(shapes, shapes[1:], shapes[2:]))
    grams.update(b"\x00" + (k if isinstance(k, bytes) else b"\x00".join(k)) for k in kinds)
    crc = zlib.crc32
    return np.unique(np.fromiter((crc(g) for g in grams), np.uint32, len(grams)) & np.uint32(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    """Weights by bucket (already scaled by the log ratios), and the curve from margins to scores."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        norm = float(np.sqrt((r * r).sum()))
        return float(self.weight[found].sum()) / norm + self.bias if norm else self.bias

    def score(self, found: np.ndarray) -> float:
        z = self.slope * self.margin(found) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, passes: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model: dual coordinate descent, one row at a time."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    square = np.array([float((v * v).sum()) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (float((w[x] * v).sum()) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w[x] += step * v
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps, with smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-6 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0, cost: float = 1.0) -> Model:
    """The model of some texts' features and labels; every fifth row is kept for the curve."""
    good = np.asarray(good, bool)
    nothing = np.zeros(BUCKETS)
    share = (good.sum() + 1) / (len(good) + 2)
    if good.all() or not good.any():
        return Model(nothing, nothing, 0.0, 1.0, float(np.log(share / (1 - share))))
    late = np.arange(len(rows)) % 5 == 4
    if not (good[late].any() and (~good[late]).any()) or not (good[~late].any() and (~good[~late]).any()):
        late = np.zeros(len(rows), bool)
    counts = [np.bincount(np.concatenate([r for r, g, x in zip(rows, good, late) if g == side and not x]), minlength=BUCKETS).astype(float) for side in (True, False)]
    p, q = (c + smooth for c in counts)
    ratio = np.where(counts[0] + counts[1] >= LEAST_ROWS, np.log(p / p.sum() * q.sum() / q), 0.0)
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / (np.sqrt((v * v).sum()) or 1.0))
    y = np.where(good, 1.0, -1.0)
    learn = np.flatnonzero(~late)
    w, bias = descend([rows[i] for i in learn], [values[i] for i in learn], y[learn], np.full(len(learn), cost))
    judge = np.flatnonzero(late) if late.any() else learn
    margins = np.array([float((w[rows[i]] * values[i]).sum()) + bias for i in judge])
    return Model(ratio, w * ratio, float(bias), *curve(margins, y[judge]))


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """Rows that no label is learnt from: crc32 of the id's text divisible by ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows that aren't held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "id")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int64()), ("found", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(x).tobytes() for x in batch.column(2).to_pylist()]
            yield record_batch([batch.column(0), batch.column(1), found], schema)

    rows = binary_texts(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", F.col("label").cast("bigint").alias("label"), "text")
    rows = rows.mapInArrow(apply, "doc_id bigint, label bigint, found binary").groupBy("doc_id", "label").agg(F.min("found").alias("found"))
    rows = Scratch(docs.sparkSession, "labelled").cut(rows)
    upto = F.sum("n").over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over `sample` small rows
    within = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), (F.length("found") / 4).alias("n")).withColumn("upto", upto).where(F.col("upto") <= MOST_FEATURES)
    got = rows.join(F.broadcast(within.select("doc_id")), "doc_id").toArrow().sort_by([("doc_id", "ascending")])
    return fit([np.frombuffer(x, np.int32) for x in got.column("found").to_pylist()], got.column("label").to_numpy() > 0)


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # a few MB, by BUCKETS; plain arrays, so workers need no package
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**sent.value)
        for batch in slices(batches):
            s = [own.score(features(x)) for x in batch.column(1).to_pylist()]
            yield record_batch([batch.column(0), s, [int(x >= threshold) for x in s]], schema)

    found = binary_texts(docs, id_col, text_col).mapInArrow(apply, "doc_id bigint, score double, predicted int")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
