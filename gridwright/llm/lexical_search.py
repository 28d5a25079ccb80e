"""Ranked lexical search: variable blocks of bounded impact, searched exactly.

Texts stay where they are: a task turns its partition into *shards*, each a row
that holds the posting lists of some thousand documents, numbered by ascending
id.  Counts of all shards give the statistics (documents, terms, documents of a
term), and with them every posting's impact, a whole number.

A list is cut into blocks by dynamic programming: of all ways to cut it into
runs of at most :data:`LONGEST` postings, the one that has the least sum of
bound errors (what the block's largest impact exceeds each of its impacts by)
plus a price for every block.  So blocks end where impacts change.

A search walks the intervals between the block ends of an item's lists.  In one
interval each list has one bound, and their sum, each times its term's weight,
bounds every document there: intervals under the score of the last hit so far
are skipped with all their postings, the others are scored, the best bounds
first.  Hits are kept over all shards of a task, so later shards skip more; the
best of all tasks are ranked at the end.  Nothing that could reach the last hit's
score is skipped, so results are those of a full search.

Null and empty texts have no terms; such documents count for nothing and items
have no hits.  Each row is a document (an item) of its own, also if ids repeat;
documents of equal scores rank by ascending id, null last.  Empty tables give an
empty result, other columns play no part.  A very long text is read in pieces.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.scratch import Scratch
from gridwright.llm.texts import binary_texts, record_batch, slices, words_in_pieces

SHARD = 1_000_000
"""Postings that a shard closes with (it ends behind a document)."""
SHARD_DOCS = 16_384
LONGEST = 64
PRICE = 6
"""What a block costs, in mean impacts of its list."""
MOST_TERMS = 500_000
"""Distinct terms of all items up to which only their postings are built; of more, all terms' postings."""
BLOCK_ITEMS = 4_096
BLOCK_TERMS = 500_000
"""Items, and terms of them, that a pass over the shards answers; more take more passes."""
FIRST = 32
"""Intervals that are scored at once first; then twice as many each time."""

SHARDS = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())), ("impact", pa.list_(pa.int32())), ("blocks", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_SHARDS = "ids array<bigint>, n array<bigint>, terms array<binary>, counts array<bigint>, docs array<int>, tf array<bigint>, n_docs bigint, n_terms bigint"
_BLOCKS = "ids array<bigint>, terms array<binary>, counts array<bigint>, docs array<int>, impact array<int>, blocks array<bigint>, ends array<bigint>"


class _Shard:
    """Postings of documents as they come."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.ids: list[int | None] = []
        self.n, self.term, self.doc, self.tf = (array("q") for _ in range(4))
        self.number: dict[bytes, int] = {}
        self.n_docs = self.n_terms = 0

    def add(self, doc_id: int | None, text: bytes, only: frozenset[bytes] | None) -> None:
        tf: Counter[bytes] = Counter()
        for some in words_in_pieces(text):
            tf.update(some)
        if not tf:
            return
        n = tf.total()
        self.n_docs, self.n_terms = self.n_docs + 1, self.n_terms + n
        mine = tf.keys() if only is None else tf.keys() & only
        if mine:
            number = self.number
            self.term.extend([number.setdefault(x, len(number)) for x in mine])
            self.tf.extend([tf[x] for x in mine])
            self.doc.extend([len(self.ids)] * len(mine))
            self.ids.append(doc_id)
            self.n.append(n)

    def full(self) -> bool:
        return len(self.term) >= SHARD or len(self.ids) >= self.most

    def batch(self) -> pa.RecordBatch:
        term, doc, tf, n = (np.array(x, np.int64) for x in (self.term, self.doc, self.tf, self.n))
        by_id = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        doc = place[doc]
        order = np.lexsort((doc, term))
        counts = np.bincount(term, minlength=len(self.number))
        return record_batch([[[self.ids[i] for i in by_id]], [n[by_id]], [list(self.number)], [counts], [doc[order]], [tf[order]], [self.n_docs], [self.n_terms]], SHARDS)


def postings(docs: DataFrame, only: frozenset[bytes] | None = None, *, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of all documents, with the lists of all terms or of those in ``only``; a map without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(only)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, shard = sent.value, _Shard(shard_docs)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, text.as_py() or b"", wanted)
                if shard.full():
                    yield shard.batch()
                    shard = _Shard(shard_docs)
        if shard.n_docs:
            yield shard.batch()

    return binary_texts(docs, id_col, text_col).mapInArrow(apply, _SHARDS)


def block_lengths(impact: np.ndarray, starts: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> np.ndarray:
    """For the list at each of ``starts``: at every posting the length of the block that ends there, if one does.

    One step places a posting of every list that is long enough; ``cost[:, k]``
    is the least cost of what lies in front of a block of ``k + 1`` postings.
    """
    lengths = np.diff(np.append(starts, len(impact)))
    per_block = np.maximum(1, price * np.add.reduceat(impact, starts) // lengths) if len(starts) else starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, per_block = starts[order], lengths[order], per_block[order]
    back = np.ones(len(impact), np.int64)
    far = np.int64(1) << 60
    cost = np.full((len(starts), longest), far)
    cost[:, 0] = 0
    most = np.zeros((len(starts), longest), np.int64)
    size = np.arange(1, longest + 1)
    alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")  # lists that have a posting j
    for j, rows in enumerate(alive.tolist()):
        now = impact[starts[:rows] + j]
        m, c = most[:rows], cost[:rows]
        m[:, 1:] = m[:, :-1].copy()
        m[:, 0] = 0
        np.maximum(m, now[:, None], out=m)
        total = c + m * size
        best = total.argmin(1)
        back[starts[:rows] + j] = best + 1
        c[:, 1:] = c[:, :-1].copy()
        c[:, 0] = total[np.arange(rows), best] + per_block[:rows]
    return back


def cut(impact: np.ndarray, starts: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> tuple[np.ndarray, np.ndarray]:
    """How many blocks each list has, and where the blocks end (places in ``impact``, all lists in turn)."""
    back = block_lengths(impact, starts, longest, price)
    at = np.append(starts[1:], len(impact)) - 1 if len(starts) else starts
    ends, owner, lists = [], [], np.arange(len(starts))
    while len(at):
        ends.append(at)
        owner.append(lists)
        then = at - back[at]
        on = then >= starts[lists]
        at, lists = then[on], lists[on]
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.bincount(np.concatenate(owner), minlength=len(starts)), np.sort(np.concatenate(ends)) + 1


@dataclass
class Index:
    """A written index: its shards, each term's documents, and the totals."""

    shards: DataFrame
    terms: DataFrame  # term, df
    n_docs: int
    n_terms: int


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impacts of postings of documents of ``n`` terms: what their term's weight is multiplied by."""
    kind = np.int64 if 50 * int(n.max(initial=0)) * n_docs < 1 << 62 else object
    m = 50 + (n.astype(kind) * 50 * n_docs // max(1, n_terms)).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def build(docs: DataFrame, only: frozenset[bytes] | None = None, *, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every document; ``only``: lists of these terms alone, for items that are known."""
    scratch = Scratch(docs.sparkSession, "search")
    raw = scratch.cut(postings(docs, only, shard_docs=shard_docs, id_col=id_col, text_col=text_col))
    sums = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("t")).first()
    n_docs, n_terms = int(sums.d), int(sums.t)
    each = raw.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            counts, docs, tf, n = (row[x].flatten().to_numpy() for x in ("counts", "docs", "tf", "n"))
            impact = impacts(tf, n[docs], n_docs, n_terms)
            blocks, ends = cut(impact, np.cumsum(counts) - counts)
            yield record_batch([row["ids"], row["terms"], row["counts"], row["docs"], [impact], [blocks], [ends]], BLOCKS)

    shards = scratch.cut(raw.mapInArrow(apply, _BLOCKS))
    terms = scratch.cut(each)
    scratch.drop(raw)
    return Index(shards, terms, n_docs, n_terms)


class _Hits:
    """The best hits of one item so far."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.null, null)))
        best = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[best], ids[best], null[best]
        if len(best) == self.k:
            self.least = int(self.score[-1])


class Lists:
    """The posting lists of a shard, to be searched."""

    def __init__(self, row: dict[str, pa.Array]):
        ids = row["ids"].flatten()
        self.ids, self.null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        self.terms = {x: i for i, x in enumerate(row["terms"].flatten().to_pylist())}
        counts, docs, impact, blocks, ends = (row[x].flatten().to_numpy().astype(np.int64) for x in ("counts", "docs", "impact", "blocks", "ends"))
        self.docs, self.impact, self.width = docs, impact, len(ids)
        term = np.repeat(np.arange(len(counts)), counts)
        self.key = term * self.width + docs  # ascending
        self.first_block = np.cumsum(blocks) - blocks
        self.blocks = blocks
        self.last = docs[ends - 1]
        begins = np.append(0, ends[:-1])[: len(ends)]
        self.bound = np.maximum.reduceat(impact, begins) if len(ends) else impact[:0]
        self.touched = 0

    def search(self, item: list[tuple[bytes, int]], hits: _Hits) -> None:
        """Add what the shard has for an item of ``(term, weight)`` to its hits."""
        found = [(self.terms[t], w) for t, w in item if w > 0 and t in self.terms]
        if not found:
            return
        term, weight = (np.array(x, np.int64) for x in zip(*found))
        n = self.blocks[term]
        block = _ranges(self.first_block[term], n)
        last = self.last[block]
        heads = np.cumsum(n) - n
        before = np.append(-1, last[:-1])
        before[heads] = -1
        edges = np.unique(last)  # interval i: behind edge i - 1, up to edge i
        from_, to = np.searchsorted(edges, before, "right"), np.searchsorted(edges, last)
        bound = self.bound[block] * np.repeat(weight, n)
        steps = np.zeros(len(edges) + 1, np.int64)
        np.add.at(steps, from_, bound)
        np.subtract.at(steps, to + 1, bound)
        sums = np.cumsum(steps[:-1])
        order = np.argsort(-sums, kind="stable")
        at, some = 0, FIRST
        while at < len(order):
            now = order[at : at + some]
            now = now[sums[now] >= hits.least]
            if not len(now):
                break
            self._score(term, weight, np.where(now > 0, edges[now - 1], -1) + 1, edges[now] + 1, hits)
            at, some = at + some, some * 2

    def _score(self, term: np.ndarray, weight: np.ndarray, start: np.ndarray, stop: np.ndarray, hits: _Hits) -> None:
        base = np.repeat(term * self.width, len(start))
        low = np.searchsorted(self.key, base + np.tile(start, len(term)))
        high = np.searchsorted(self.key, base + np.tile(stop, len(term)))
        n = high - low
        place = _ranges(low, n)
        if not len(place):
            return
        self.touched += len(place)
        gain = self.impact[place] * np.repeat(np.repeat(weight, len(start)), n)
        docs = self.docs[place]
        by_doc = np.argsort(docs, kind="stable")
        docs = docs[by_doc]
        heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        score, docs = np.add.reduceat(gain[by_doc], heads), docs[heads]
        good = score >= hits.least
        if good.any():
            hits.add(score[good], self.ids[docs[good]], self.null[docs[good]])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...`` of ``n[i]`` numbers each, in one array."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)


def _items(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items with their distinct terms, in blocks that are bounded in items and terms."""
    block, total = [], 0
    for r in binary_texts(items, id_col, text_col).toLocalIterator():
        terms = sorted({x for some in words_in_pieces(bytes(r.text or b"")) for x in some})
        if not terms:
            continue
        if block and (len(block) == BLOCK_ITEMS or total + len(terms) > BLOCK_TERMS):
            yield block
            block, total = [], 0
        block.append((r.doc_id, terms))
        total += len(terms)
    if block:
        yield block


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


OUT = "item_id bigint, rank int, doc_id bigint, score bigint"


def search(index: Index, items: DataFrame, k: int = 50, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's ``k`` best documents."""
    spark = items.sparkSession
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    found: list[DataFrame] = []
    for number, block in enumerate(_items(items, id_col, text_col)):
        asked = spark.createDataFrame([(bytearray(t),) for t in sorted({t for _, terms in block for t in terms})], "term binary")
        df = {bytes(r.term): r.df for r in index.terms.join(F.broadcast(asked), "term").collect()}  # a row for each term of the block at most
        weighed = [(item, [(t, weight(df[t], index.n_docs)) for t in terms if t in df]) for item, terms in block]
        sent = spark.sparkContext.broadcast(weighed)

        def apply(batches: Iterator[pa.RecordBatch], sent=sent, first=number * BLOCK_ITEMS) -> Iterator[pa.RecordBatch]:
            asks = sent.value
            hits = [_Hits(k) for _ in asks]
            for batch in slices(batches, 1):
                lists = Lists({f.name: batch.column(i) for i, f in enumerate(batch.schema)})
                for (_, item), own in zip(asks, hits):
                    lists.search(item, own)
            for i, ((item_id, _), own) in enumerate(zip(asks, hits)):
                if len(own.score):
                    n = len(own.score)
                    yield record_batch([[first + i] * n, [item_id] * n, pa.array(own.id, mask=own.null), own.score], schema)

        found.append(index.shards.mapInArrow(apply, "item bigint, item_id bigint, doc_id bigint, score bigint"))
    if not found:
        return spark.createDataFrame([], OUT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def terms_of(items: DataFrame, most: int = MOST_TERMS, *, id_col: str = "item_id", text_col: str = "text") -> frozenset[bytes] | None:
    """All terms of the items, or None if there are over ``most``."""
    schema = pa.schema([("term", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in batch.column(1):
                for some in words_in_pieces(text.as_py() or b""):
                    yield record_batch([list(set(some))], schema)

    rows = binary_texts(items, id_col, text_col).mapInArrow(apply, "term binary").distinct().limit(most + 1).collect()
    return frozenset(bytes(r.term) for r in rows) if len(rows) <= most else None


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best of all ``docs`` for each of ``items``: an index of the items' terms, built and searched."""
    return search(build(docs, terms_of(items)), items, k)
