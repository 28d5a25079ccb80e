"""Mixing sources to target weights by weighted sampling without replacement.

Sources share a budget of words by weight; a target stops at ``most_epochs``
times its source's size, and the excess is shared again by weight until no
target is above.  A target that holds a source once or twice takes complete
epochs of it; what remains is filled by Efraimidis-Spirakis sampling: each
document gets the exponential key ``-ln(u) / w``, with ``u`` from a hash of its
id and text and ``w`` its quality weight, and documents are taken in ascending
order of keys as long as the prefix sum of their sizes fits.

The order is never built.  A key is an order-preserving 63-bit integer; sums by
its leading bits give the prefix sums of whole buckets, and only the bucket in
which the budget ends is cut further, level by level, to a single key: the
source's cutoff.  So a source with a third of all rows costs partial sums only.
What a document across the budget's end leaves open is filled in the order of
keys too: by the prefix sums of the documents behind it that are no larger than
what is open, round by round, until no document of the source fits.  A round
ends at a document larger than all later ones that count, so by the random order
of keys the rounds are about the logarithm of the words left open.

A document's weight is the share of its words and lines that the quality rules
have nothing against: one less symbols to a word, times one less the share of
words in repeated windows, times one less the share of repeated lines.

Nulls and texts without words have size 0 and take nothing.  A null source is a
source of its own, the last.  Equal rows (equal id and text) have one key and
stand beside each other in its order: a budget that ends among them takes as many
as fit.  Which of them is told by a number in the written table, so all readers
agree; reruns agree but for which of equal rows it is.  A very long text is held
whole.  An empty table gives an empty result; other columns play no part.  The
number of sources is bounded (``MOST_SOURCES``, else an error): one row for each
goes through the driver, none for a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.quality_rules import Facts
from gridwright.llm.scratch import Scratch
from gridwright.llm.texts import record_batch, slices

MOST_SOURCES = 1_000_000
SHIFTS = (44, 32, 20, 10, 0)
LAST = (1 << 63) - 1
LEAST_WEIGHT = 0.05


def weighed(text: bytes | None) -> tuple[int, float]:
    """A text's words and its weight."""
    f = Facts(text)
    share = lambda part, of: 1.0 - min(1.0, part / max(1, of))
    return f.n_words, max(LEAST_WEIGHT, share(f.n_symbols, f.n_words) * share(f.n_repeat_words, f.n_words) * share(f.n_dup_lines, f.n_lines))


def key_rank(doc_id: int | None, text: bytes, weight: float, seed: int = 0) -> int:
    """The exponential key as an integer of the same order."""
    u = ((xxhash.xxh64_intdigest(b"%s\x00" % str(doc_id).encode() + text, seed) >> 11) + 0.5) / (1 << 53)
    return int(np.float64(-np.log(u) / weight).view(np.int64))


def targets(sizes: list[int], weights: list[float], total_share: float = 1.5, most_epochs: int = 2) -> list[float]:
    """Each source's share of ``total_share`` times all sizes, by weight, none above ``most_epochs`` times its size."""
    found, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total_share * sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most_epochs * sizes[i]}
        if not over:
            for i in open_:
                found[i] = left * weights[i] / weight
            break
        for i in over:
            found[i] = float(most_epochs * sizes[i])
        left -= sum(found[i] for i in over)
        open_ -= over
    return found


def measured(docs: DataFrame, *, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``rank`` of every row, and a number of the ``row`` that holds once this is written."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("rank", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            sizes, weights = zip(*map(weighed, texts))
            ranks = [key_rank(d, x, w, seed) for d, x, w in zip(batch.column(0).to_pylist(), texts, weights)]
            yield record_batch([batch.column(0), batch.column(1), list(sizes), ranks], schema)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(apply, "doc_id bigint, source string, size bigint, rank bigint").withColumn("row", F.monotonically_increasing_id())


PLAN = "source string, source_size bigint, target double, epochs bigint, spans array<struct<low: bigint, stop: bigint, most: bigint, part: bigint>>"


def plan(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """A row per source: its size, ``target``, ``epochs`` and the ``spans`` of ranks and sizes that the rest takes.

    Of a span all ranks from ``low`` on and in front of ``stop`` are taken, and
    ``part`` of the equal rows at ``stop``.  ``sizes`` is read some dozens of
    times, so it should be a written table; weights repeat over the sources in
    code point order.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    found = targets([r.n for r in rows], [weights[i % len(weights)] for i in range(len(rows))], total_share, most_epochs)
    state = {}
    for r, t in zip(rows, found):
        epochs = int(t // r.n) if r.n else 0
        state[r.source] = (r.n, t, epochs)
    spans: dict = {s: [] for s in state}
    open_ = {s: int(t - e * n) for s, (n, t, e) in state.items()}
    now = {s: 0 for s in state if open_[s] > 0}
    while now:
        cuts = _ends(sizes, [(s, low, open_[s]) for s, low in now.items()])
        then = {}
        for s, low in now.items():
            stop, taken, part, size = cuts[s]
            if taken or part:
                spans[s].append((low, stop, open_[s], part))
                open_[s] -= taken + part * size
            if stop < LAST and open_[s] > 0:  # what didn't fit at `stop` never will: all in front of it is taken or too large
                then[s] = stop + 1
        now = then
    return sizes.sparkSession.createDataFrame([(s, *x, spans[s]) for s, x in state.items()], PLAN)


def _ends(sizes: DataFrame, asks: list[tuple]) -> dict:
    """By source: the rank at which its budget ends, the sizes in front of it, and how many equal rows at it fit, of which size.

    ``asks`` has the source, the first rank that counts and the budget, which is
    also the largest size that counts.  The budget ends at the first key with
    which the prefix sum exceeds it, at ``LAST`` if none does.
    """
    found: dict = {}
    now = [(*x, 0, 0) for x in asks]
    for at, shift in enumerate(SHIFTS):
        if not now:
            break
        # below: sizes of all keys in front of the bucket `path` in which the budget ends
        asked = sizes.sparkSession.createDataFrame(now, "source string, low bigint, open bigint, path bigint, below bigint").alias("p")
        inside = sizes.alias("s").join(F.broadcast(asked), F.expr("s.source <=> p.source and s.rank >= p.low and s.size between 1 and p.open"))
        if at:
            inside = inside.where(F.shiftright("s.rank", SHIFTS[at - 1]) == F.col("p.path"))
        sums = inside.groupBy("s.source", F.shiftright("s.rank", shift).alias("bucket")).agg(
            F.sum("s.size").alias("size"), F.count("*").alias("n"), F.min("s.rank").alias("first"), F.max("s.rank").alias("last"),
            F.min("s.size").alias("least"), F.max("s.size").alias("most"), F.first("p.open").alias("open"), F.first("p.below").alias("below"),
        )
        sums = sums.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        ends = sums.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("open"), F.struct("bucket", "upto", "size", "n", "first", "last", "least", "most"))).alias("at"), F.max("upto").alias("all"))
        ends = {r.source: (r["at"], r["all"]) for r in ends.collect()}
        then = []
        for s, low, open_, _, below in now:
            end, total = ends.get(s, (None, below))
            if end is None:  # the budget takes all of its keys
                found[s] = (LAST, total, 0, 0)
            elif end["first"] == end["last"]:
                before = end.upto - end.size
                part = (open_ - before) // end.least if end.least == end.most else 0
                found[s] = (end["first"], before, part, end.least)
            else:
                then.append((s, low, open_, end.bucket, end.upto - end.size))
        now = then
    return found


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``number`` of each among those of its source and rank, by ``row``; a key's rows of one partition at a time."""
    rows = rows.withColumn("part", F.shiftright("row", 33))
    key = ["source", "rank"]
    before = rows.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy(*key).orderBy("part")) - F.col("n")).drop("n")
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy(*key, "part").orderBy("row")))
    same = own["source"].eqNullSafe(before["source"]) & (own["rank"] == before["rank"]) & (own["part"] == before["part"])
    return own.join(before, same).select(*(own[c] for c in rows.columns if c != "part"), (F.col("own") + F.col("before")).alias("number"))


def copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (with ``source``, ``size``, ``rank`` and ``row``) with its source's size and target, and ``copies``: how often the mix takes each."""
    both = rows.alias("s").join(F.broadcast(sources.alias("p")), F.expr("s.source <=> p.source")).select("s.*", "p.source_size", "p.target", "p.epochs", "p.spans")
    whole = F.exists("spans", lambda x: (F.col("rank") >= x["low"]) & (F.col("rank") < x["stop"]) & (F.col("size") <= x["most"]))
    part = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + F.when((x["stop"] == F.col("rank")) & (F.col("size") <= x["most"]), x["part"]).otherwise(0))
    if not sources.where("exists(spans, x -> x.part > 0)").limit(1).count():
        return both.select(*(F.col(c) for c in rows.columns), "source_size", "target", (F.col("epochs") + whole.cast("bigint")).alias("copies"))
    both = both.withColumn("open", part)
    numbered = _numbered(both.where("open > 0"))
    out = both.where("open = 0").withColumn("number", F.lit(0)).unionByName(numbered)
    chosen = whole | (F.col("number") <= F.col("open")) & (F.col("open") > 0)
    return out.select(*(F.col(c) for c in rows.columns), "source_size", "target", (F.col("epochs") + chosen.cast("bigint")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most_epochs: int = 2, **columns) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, the words of the document in the mix."""
    sizes = Scratch(docs.sparkSession, "mixing").cut(measured(docs, **columns))
    out = copies(sizes, plan(sizes, weights, total_share, most_epochs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most_epochs: int = 2, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix: ``docs`` with each row as often as it is taken, numbered by ``copy`` (with underscores if that is a column already).

    Texts are read twice; only those of equal rows among which a budget ends are
    written again and shuffled.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    sources = scratch.cut(plan(scratch.cut(measured(docs, **names)), weights, total_share, most_epochs))
    where = [docs.columns.index(x) for x in (id_col, text_col)]
    extra = [pa.field("size", pa.int64()), pa.field("rank", pa.int64())]
    held = [f"c{i}" for i in range(len(docs.columns))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or b"" for x in batch.column(where[1]).cast(pa.binary()).to_pylist()]
            sizes, weights = zip(*map(weighed, texts))
            ranks = [key_rank(d, x, w) for d, x, w in zip(batch.column(where[0]).to_pylist(), texts, weights)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(ranks, pa.int64())], schema=pa.schema([*batch.schema, *extra]))

    named = docs.toDF(*held)
    ranked = named.mapInArrow(apply, f"{_ddl(named)}, size bigint, rank bigint").where("size > 0")
    ranked = ranked.withColumn("source", F.col(held[docs.columns.index(source_col)]).cast("string"))
    ends = sources.selectExpr("source as s", "explode(filter(spans, x -> x.part > 0)) as x").selectExpr("s", "x.stop as r")
    at_end = F.expr("source <=> s and rank = r")
    if ends.limit(1).count():
        rest = ranked.join(F.broadcast(ends), at_end, "left_anti").withColumn("row", F.lit(0).cast("bigint"))
        equal = scratch.cut(ranked.join(F.broadcast(ends), at_end, "left_semi").withColumn("row", F.monotonically_increasing_id()))
        both = copies(rest, sources.withColumn("spans", F.expr("transform(spans, x -> struct(x.low as low, x.stop as stop, x.most as most, 0L as part))"))).unionByName(copies(equal, sources))
    else:
        both = copies(ranked.withColumn("row", F.lit(0).cast("bigint")), sources)
    copy = "copy"
    while copy in docs.columns:
        copy += "_"
    times = both.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return times.select(*held, "copies").toDF(*docs.columns, copy)


def _ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
