"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else
too.  So the question is, for each suffix cut off at ``length`` bytes (a
*window*), whether an equal one starts elsewhere.

1. *Anchors* prune the suffixes.  Of the ``gram``-byte strings in a window the
   one with the smallest hash is its anchor (the rightmost of equal ones).  Equal
   windows have equal anchors at equal places, and the windows of one anchor
   follow each other: a row per anchor, about one to 100 bytes, stands for them.
2. *Sorted array of runs.*  Spark sorts the rows over all partitions by anchor,
   by a digest of all the anchor's windows (its *kind*), and by place.  One scan
   compares neighbours: rows of one kind have equal windows, which all repeat;
   an anchor with one kind only needs no more.  The sort key ends in the place,
   so range partitioning splits the rows of a common passage like any others.
   What the first and last kinds of a batch of rows have in other batches is left
   to the index: one row of each goes there.
3. *Suffix arrays.*  Where kinds of one anchor differ (at the ends of repeated
   passages), one row of each enters an index of the windows themselves.  Each
   batch of them gets a suffix array, ordered by the windows' bytes, is merge-
   scanned against the arrays of the levels that are there, and becomes a level;
   levels of like size are merged, so a window is merged a logarithmic number of
   times.  A batch ends where an anchor ends, and then its levels go; only an
   anchor of more windows than a batch has several levels.
4. Anchors of over ``MOST_KINDS`` kinds are dealt over several tasks by the
   digest of each window; their arrays hold these digests in place of the bytes.

Texts are known by hash and size, so repeated rows and exact copies have one
entry; they repeat each other from the first byte to the last.  Nulls count as
empty texts; texts shorter than ``length`` have no windows; a very long text is
scanned in one piece, at about 40 bytes of memory for each of its own.  Ties have
no part in a result.  An empty table gives an empty result; other columns play no
part in :func:`dedup`, and :func:`without_repeats` hands them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm import rolling
from gridwright.llm.scratch import Scratch
from gridwright.llm.texts import record_batch, runs, slices

LENGTH = 400
SHARED = 200
"""Shorter strings, about 30 words, by which :func:`dedup` tells how much of a text is found elsewhere."""
PIECE = 2 << 20
BATCH = 30_000
"""Windows that enter the index at once."""
MOST_KINDS = 1_000
"""Kinds of one anchor that one task indexes; the windows of more are dealt by digest."""
LOW = np.uint64((1 << 32) - 1)


def gram_of(length: int) -> int:
    """Anchor strings are about a third of a window."""
    return max(1, length * 8 // 25)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def anchors(texts: list[bytes | None], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, class, first window and number of windows of every anchor."""
    data, offsets = rolling.laid_out(texts)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    sums = rolling.prefix(rolling.TABLE[data])
    at = np.arange(len(data) - gram + 1)
    h = rolling.ranges(sums, at, at + gram)
    least = sliding_min((h & ~LOW) | (LOW - at.astype(np.uint64)), length - gram + 1)
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    window = np.arange(len(owner)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    if not len(window):
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    anchor = (LOW - (least[window] & LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.append(first, len(window)))
    start, own = window[first], owner[first]
    kind = rolling.mix(rolling.ranges(sums, start, start + n - 1 + length) + (anchor[first] - start).astype(np.uint64))
    return own, h[anchor[first]], kind, start - offsets[own], n


class Levels:
    """Suffix arrays of geometric sizes; tells which of the windows that entered repeat."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.twice = np.zeros(0, bool)

    def add(self, windows: np.ndarray) -> None:
        """Index a batch (a row of bytes for each window): sort it, scan it against every level, merge levels of like size."""
        windows = np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel()
        order = np.argsort(windows, kind="stable")
        keys, at = windows[order], order + len(self.twice)
        self.twice = np.concatenate([self.twice, np.zeros(len(keys), bool)])
        same = keys[1:] == keys[:-1]
        self.twice[at[1:][same]] = True
        self.twice[at[:-1][same]] = True
        for k, where in self.levels:
            place = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            found = k[place] == keys
            self.twice[at[found]] = True
            self.twice[where[place[found]]] = True  # others equal to it in that level are marked already
        self.levels.append((keys, at))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (k1, a1), (k2, a2) = self.levels.pop(), self.levels.pop()
            k, a = np.concatenate([k2, k1]), np.concatenate([a2, a1])
            order = np.argsort(k, kind="stable")  # two sorted runs: a merge
            self.levels.append((k[order], a[order]))


KEY = "tid bigint, size int"
ROW = f"h bigint, kind bigint, {KEY}, at bigint, n int"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _keyed(docs: DataFrame, text_col: str) -> list:
    """Hash and size by which a text is known, and its bytes."""
    text = F.coalesce(F.col(text_col), F.lit("")) if dict(docs.dtypes)[text_col] == "string" else F.col(text_col)
    return [F.xxhash64(text).alias("tid"), F.octet_length(text).cast("int").alias("size"), text.cast("binary").alias("text")]


def _distinct(texts: DataFrame, most: int) -> DataFrame:
    """A row for each text of ``most`` bytes or more, with its number of ``copies``."""
    return texts.where(F.col("size") >= most).groupBy("tid", "size").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """The anchors of every text, or of its ``stretches`` (starts, ends) if it has that column."""
    schema, gram, within = _schema(ROW), gram_of(length), "stretches" in texts.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tid, size, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            shift = np.zeros(len(texts), np.int64)
            if within:
                found = [(i, *x) for i, s in enumerate(batch.column(3).to_pylist()) for x in _places(s)]
                of = np.array([x[0] for x in found], np.int64)
                shift = np.array([x[1] for x in found], np.int64)
                tid, size, texts = tid[of], size[of], [texts[i][a:b] for i, a, b in found]
            for a, b in runs(texts, PIECE):
                own, h, kind, at, n = anchors(texts[a:b], length, gram)
                yield record_batch([h.view(np.int64), kind.view(np.int64), tid[a:b][own], size[a:b][own], at + shift[a:b][own], n.astype(np.int32)], schema)

    columns = ["tid", "size", "text", *(["stretches"] if within else [])]
    return texts.where((F.col("size") >= length) & F.col("text").isNotNull()).select(*columns).mapInArrow(apply, ROW)


def _places(pairs: bytes | None) -> list[list[int]]:
    """Starts and ends again."""
    return np.frombuffer(pairs or b"", np.int64).reshape(-1, 2).tolist()


def _scan(rows: DataFrame) -> DataFrame:
    """Of the sorted array: rows of kinds with two rows or more (``full``), and one row of each kind that must be indexed.

    The scan goes batch by batch.  What the first and last kinds of a batch have
    in other batches or partitions is left to the index, which gets a row of
    each.  ``weight``: the rows of a kind in the batch, 2 for more.
    """
    kind = f"{ROW}, weight int, full boolean"
    schema = _schema(kind)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(6)]
            new = [c[1:] != c[:-1] for c in cols[:5]]
            starts = np.concatenate([[True], new[0] | new[1]])
            first = np.flatnonzero(starts)
            number = np.diff(np.append(first, len(starts)))
            another = np.concatenate([[True], ~new[0][first[1:] - 1]])  # the kind before has this anchor too, or may have
            wanted = another | np.append(another[1:], True)
            once = starts | np.concatenate([[True], new[2] | new[3] | new[4]])  # copies of a text have one entry
            full = once & np.repeat(number > 1, number)
            for pick, weight, whole in ((full, np.full(int(full.sum()), 2), True), (first[wanted], np.minimum(number[wanted], 2), False)):
                yield record_batch([*(c[pick] for c in cols), weight.astype(np.int32), np.full(len(weight), whole)], schema)

    return rows.repartitionByRange("h", "kind", "tid", "at").sortWithinPartitions("h", "kind", "tid", "at").mapInArrow(apply, kind)


SPAN = f"{KEY}, start bigint, end bigint"


def _indexed(texts: DataFrame, asked: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``tid, size, start, end`` of the windows of single rows that the index finds twice; ``texts`` are distinct."""
    many = scratch.cut(asked.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > MOST_KINDS))
    parts = F.lit(0)
    if many.limit(1).count():
        asked = asked.join(many, "h", "left")
        parts = (F.coalesce("kinds", F.lit(0)) / F.lit(MOST_KINDS)).cast("int")
    asked = asked.select("h", "tid", "size", "at", "n", "weight", parts.alias("parts"))
    asked = asked.groupBy("tid", "size").agg(F.collect_list(F.struct("h", "at", "n", "weight", "parts")).alias("asked"))
    kind = f"part int, h bigint, {KEY}, at bigint, n int, weight int, places binary, content binary"
    schema, found = _schema(kind), _schema(SPAN)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32):
            out = []
            for tid, size, text, rows in zip(*(c.to_pylist() for c in batch.columns)):
                for r in rows:
                    own = text[r["at"] : r["at"] + r["n"] - 1 + length]
                    if not r["parts"]:
                        out.append((-1, r["h"], tid, size, r["at"], r["n"], r["weight"], None, own))
                        continue
                    at = np.arange(r["n"])
                    digest = rolling.ranges(rolling.prefix(rolling.TABLE[np.frombuffer(own, np.uint8)]), at, at + length)
                    part = digest % np.uint64(r["parts"] + 1)
                    for p in np.unique(part).tolist():
                        here = part == p
                        out.append((p, r["h"], tid, size, r["at"], int(here.sum()), r["weight"], at[here].astype(np.int32).tobytes(), digest[here].tobytes()))
            if out:
                yield record_batch([list(x) for x in zip(*out)], schema)

    def windows(rows: list[tuple]) -> np.ndarray:
        """A row of bytes for each window: its anchor, then its bytes or their digest."""
        dealt = rows[0][0] >= 0
        out = np.empty((sum(r[5] for r in rows), 8 + (8 if dealt else length)), np.uint8)
        first = 0
        for r in rows:
            data = np.frombuffer(r[8], np.uint8)
            here = out[first : first + r[5]]
            here[:, :8] = np.frombuffer(r[1].to_bytes(8, "big", signed=True), np.uint8)
            here[:, 8:] = data.reshape(-1, 8) if dealt else np.lib.stride_tricks.sliding_window_view(data, length)
            first += r[5]
        return out

    def spans(rows: list[tuple], twice: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.array([r[5] for r in rows])
        row = np.repeat(np.arange(len(rows)), n)
        hit = np.flatnonzero(twice & np.array([r[6] == 1 for r in rows])[row])
        if not len(hit):
            return
        at = np.concatenate([np.arange(r[5]) if r[7] is None else np.frombuffer(r[7], np.int32) for r in rows]) + np.repeat([r[4] for r in rows], n)
        row, at = row[hit], at[hit]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] - at[:-1] > length)])
        own = row[new]
        yield record_batch([[rows[i][2] for i in own], [rows[i][3] for i in own], at[new], at[np.append(new[1:], True)] + length], found)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, entered, held, size = Levels(), [], [], 0
        for batch in slices(batches, 512):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                last = held[-1] if held else entered[-1] if entered else row
                if row[:2] != last[:2]:  # an anchor ends; what entered is judged if the batch is full or had levels already
                    if entered or size >= BATCH or (row[0] < 0) != (last[0] < 0):
                        if held:
                            levels.add(windows(held))
                        yield from spans(entered + held, levels.twice)
                        levels, entered, held, size = Levels(), [], [], 0
                elif size >= 2 * BATCH:  # in the midst of an anchor: its levels stay
                    levels.add(windows(held))
                    entered, held, size = entered + held, [], 0
                held.append(row)
                size += row[5]
        if held:
            levels.add(windows(held))
        if entered or held:
            yield from spans(entered + held, levels.twice)

    rows = texts.join(asked, ["tid", "size"]).select("tid", "size", "text", "asked")
    dealt = rows.mapInArrow(cut, kind).repartition("h", "part").sortWithinPartitions("part", "h")
    return dealt.mapInArrow(index, SPAN)


def _spans(texts: DataFrame, distinct: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``tid``, ``size`` and ``spans`` (array of start and end, not merged) of every text with repeated strings.

    ``texts(tid, size, text)``, perhaps with ``stretches`` that alone count; ``distinct`` has a row for each of them.
    """
    rows = scratch.cut(_anchor_rows(texts, length))
    known = scratch.cut(_scan(rows))
    scratch.drop(rows)
    full = known.where("full").select("tid", "size", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + length).alias("end"))
    found = full.unionByName(_indexed(distinct, known.where("not full"), length, scratch))
    found = scratch.cut(found.groupBy("tid", "size").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    scratch.drop(known)
    return found


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the spans, in order."""
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in found or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def kept(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    """The text without the runs."""
    ends = [0, *(b for _, b in removed)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in removed), len(text)]))


def dedup(docs: DataFrame, length: int = LENGTH, shared: int = SHARED, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``n_shared``.

    ``n_shared``: bytes that strings of ``shared`` bytes (at most ``length``)
    which also start elsewhere cover; what of it no longer string covers isn't
    removed.  These are sought first: a repeated string of ``length`` bytes lies
    within such a stretch, so the family for it holds stretches only.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    shared = min(shared, length)
    texts = docs.select(*_keyed(docs, text_col))
    short = _spans(texts, _distinct(texts, shared), shared, scratch)
    kind = f"{KEY}, copies bigint, n_shared bigint, text binary, stretches binary"

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for tid, size, text, copies, found in zip(*(c.to_pylist() for c in batch.columns)):
                found = merged(found)
                long = [x for x in found if x[1] - x[0] >= length]
                out.append((tid, size, copies, sum(b - a for a, b in found), text if long else None, np.array(long, np.int64).tobytes() if long else None))
            yield record_batch([list(x) for x in zip(*out)], _schema(kind))

    near = _distinct(texts, shared).join(short, ["tid", "size"]).select("tid", "size", "text", "copies", "spans")
    near = scratch.cut(near.mapInArrow(stretches, kind))
    scratch.drop(short)
    long = _spans(near, near.where("text is not null").select("tid", "size", "text"), length, scratch)
    result = f"{KEY}, n_shared bigint, n_removed bigint, n_spans bigint, sha string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for tid, size, text, copies, n_shared, found in zip(*(c.to_pylist() for c in batch.columns)):
                removed = [(0, size)] if copies > 1 and size >= length else merged(found)
                sha = None if text is None else hashlib.sha256(kept(text, removed)).hexdigest()
                out.append((tid, size, n_shared, sum(b - a for a, b in removed), len(removed), sha))
            yield record_batch([list(x) for x in zip(*out)], _schema(result))

    known = scratch.cut(near.join(long, ["tid", "size"], "left").select("tid", "size", "text", "copies", "n_shared", "spans").mapInArrow(cut, result))
    scratch.drop(near)
    scratch.drop(long)
    rows = docs.select(F.col(id_col).alias("doc_id"), *_keyed(docs, text_col)).select("doc_id", "tid", "size", F.sha2("text", 256).alias("whole"))
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.join(known, ["tid", "size"], "left").select("doc_id", F.col("size").cast("bigint").alias("n_bytes"), count("n_removed"), count("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), count("n_shared"))


def without_repeats(docs: DataFrame, length: int = LENGTH, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of the text; halves of characters at a cut go with them."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    texts = docs.select(*_keyed(docs, text_col))
    found = _spans(texts, _distinct(texts, length), length, scratch).select(F.col("tid").alias("__tid"), F.col("size").alias("__size"), F.col("spans").alias("__spans"))
    tid, size, _ = _keyed(docs, text_col)
    both = docs.select("*", tid.alias("__tid"), size.alias("__size")).join(found, ["__tid", "__size"], "left").select(*docs.columns, "__spans")
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            cut = [x if not s else kept(x, merged(s)).decode("utf-8", "ignore").encode() for x, s in zip(texts, batch.column(len(batch.columns) - 1).to_pylist())]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(cut, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return both.mapInArrow(apply, docs.schema)
