"""SimHash fingerprints, linked by a binary trie joined with itself.

A 64-bit fingerprint is a leaf of a binary trie.  Two leaves link if their
paths differ in at most ``budget`` bits: pairs of nodes walk down together, add
up differing bits, and are dropped as soon as the sum exceeds the budget.

To deal the walk out, the fingerprint's bits are cut into ``budget + 1``
blocks.  Fingerprints within the budget agree on one block at least, so for
each block the trie with that block on top, which must match exactly, is cut
into its subtries: each is walked by one task.  A subtrie with more than
``limit`` leaves (a large group of near copies) is cut further down: its node
pairs become keys of their own, four levels at a time, until none is too large.

One fingerprint within a few bits finds near copies of very few edits only.  For
more, :func:`near_duplicates` takes ``tables`` fingerprints of the same shingles
by other hashes, each with its own tries, and confirms what they find: of what a
task finds connected, ``FORESTS`` minimum spanning forests of pairs by differing
bits, one after the other of the pairs that are left, are held against the least
hashes of ``CHECK_WIDTH``-word shingles in ``BINS`` bins, of which as large a share
agrees as the similarity of the two texts is (for short texts nearly exactly).

:func:`one_of_each` drops a text only if its exact similarity to one that stays is
large enough: each text of a component is compared with the component's first; of
those unlike it the links among themselves are compared, and a text stays if it is
the first of its open neighbours, round by round.

Links are between fingerprints, not ids.  Nulls and texts without words have
fingerprint zero and link like any other.  Repeated rows and ties share a
fingerprint, so they are one leaf; rows of one id with different texts are linked
only if their fingerprints are.  A component is named by the smallest id of all
its rows; rows without an id belong to one like others, but don't name it, so a
component of such rows only has a null name.  A very long text is held whole, as
its words and 64 bytes for each shingle.  An empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm import rolling
from gridwright.llm.components import components
from gridwright.llm.scratch import Scratch
from gridwright.llm.skew import join_counted
from gridwright.llm.texts import record_batch, slices

BITS = 64
LIMIT = 50_000
"""Leaves that one task walks at once."""
FRONTIER = 1_000_000
"""Node pairs that are held at once."""
PAIRS = 2_000_000
"""Linked pairs of a task that are held before they are thinned to forests."""
LEVELS = 4
"""Levels by which a subtrie that is too large is cut."""
SEED = 42
CHECK_WIDTH, BINS = 5, 512
FORESTS = 2
SLACK = 0.035
"""What the estimate of a similarity may be too low by: about twice its standard error at 0.8 over ``BINS`` bins."""
PART = 1_000
"""Texts that meet one copy of their component's first text."""
IN_ORDER = 3
"""Rounds in which the smallest id of open neighbours stays; later ones go by hashes, so chains of ascending ids end soon."""


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes have."""
    ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text, by the XXH64 of its shingles of ``width`` words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and only ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return int(_majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of the text's shingles, made of their words' hashes, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    hashes = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        hashes = hashes * rolling.M + each[i : len(each) - width + 1 + i]
    return hashes


def sketch(text: bytes | None, width: int, tables: int) -> np.ndarray:
    """SimHash fingerprints of the same shingles by so many hashes."""
    out, hashes = np.zeros(tables, np.uint64), shingles(text, width)
    for t in range(tables if len(hashes) else 0):
        out[t] = _majority(rolling.mix(hashes ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    return out


def binned(text: bytes | None) -> bytes:
    """For each bin a byte of the least hash of ``CHECK_WIDTH``-word shingles that falls into it; zero if none does."""
    out, hashes = np.zeros(BINS, np.uint8), np.unique(rolling.mix(shingles(text, CHECK_WIDTH)))
    own, first = np.unique(hashes // np.uint64((1 << BITS) // BINS), return_index=True)
    out[own.astype(np.int64)] = hashes[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def estimated(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The similarity of each pair of :func:`binned` texts: the share of equal bins, less those equal by chance."""
    x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, BINS) for z in (a, b))
    same, some = ((x == y) & (x > 0)).sum(axis=1), np.maximum(((x | y) > 0).sum(axis=1), 1)
    return (same / some - 1 / 255) / (1 - 1 / 255)


def fingerprints(docs: DataFrame, width: int = 3, tables: int = 1, checked: bool = False, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``tid`` (a hash of the text) and ``fps``, its fingerprints as signed bigints; if ``checked``, its ``bins`` too."""
    kinds = [("doc_id", pa.int64()), ("tid", pa.int64()), ("fps", pa.list_(pa.int64()))]
    schema = pa.schema(kinds + [("bins", pa.binary())] if checked else kinds)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            if tables == 1 and not checked:
                found = np.array([[fingerprint(x, width)] for x in texts], np.uint64)
            else:
                found = np.array([sketch(x, width, tables) for x in texts])
            more = [[binned(x) for x in texts]] if checked else []
            yield record_batch([batch.column(0), batch.column(1), found.view(np.int64).tolist(), *more], schema)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(apply, "doc_id bigint, tid bigint, fps array<bigint>" + (", bins binary" if checked else ""))


def walk(keys: np.ndarray, exact: int, budget: int, thin: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct ``keys`` that agree on the top ``exact`` bits and differ in ``budget`` bits at most.

    A node is a range of ``keys``; a frontier holds the ranges of the two nodes
    of each pair and the bits in which their paths differ.  ``thin`` makes fewer
    of over ``PAIRS`` pairs.
    """
    left, right, held = [], [], 0
    zero = np.zeros(1, np.int64)
    work = [(BITS - 1, zero, zero + len(keys), zero, zero + len(keys), zero)]
    while work:
        bit, alo, ahi, blo, bhi, diff = work.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            work += [(bit, *(x[:half] for x in (alo, ahi, blo, bhi, diff))), (bit, *(x[half:] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        own = alo == blo
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if (done := single & ~own).any():  # two leaves: the rest of their paths at once
            i, j = alo[done], blo[done]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            left.append(i[near])
            right.append(j[near])
            held += len(left[-1])
            if thin and held > PAIRS:
                left, right = ([x] for x in thin(np.concatenate(left), np.concatenate(right)))
                held = len(left[0])
        alo, ahi, blo, bhi, diff, own = (x[~single] for x in (alo, ahi, blo, bhi, diff, own))
        if not len(alo) or bit < 0:
            continue
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        parts = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff)]
        if BITS - 1 - bit >= exact:
            parts += [(alo, amid, bmid, bhi, diff + 1)]
            parts += [tuple(x[~own] for x in (amid, ahi, blo, bmid, diff + 1))]
        a, b, c, d, e = (np.concatenate(x) for x in zip(*parts))
        live = (a < b) & (c < d) & (e <= budget)
        work.append((bit - 1, a[live], b[live], c[live], d[live], e[live]))
    return (np.concatenate(left), np.concatenate(right)) if left else (zero[:0], zero[:0])


def blocks(budget: int) -> list[tuple[int, int]]:
    """(bits to turn left, width) of each block when it stands on top."""
    widths = [BITS // (budget + 1) + (i < BITS % (budget + 1)) for i in range(budget + 1)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _turn(fp: F.Column, by: int) -> F.Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def forest(n: int, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of ``n`` nodes and links ``left[i]``-``right[i]``: which links make a minimum spanning forest by length."""
    label, chosen = np.arange(n), []
    for d in np.unique(length):
        links = np.flatnonzero(length == d)
        while True:
            a, b = label[left[links]], label[right[links]]
            open_ = a != b
            if not open_.any():
                break
            links, low, high = links[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            tree, first = np.unique(high, return_index=True)  # each tree joins one of a smaller label
            chosen.append(links[first])
            label[tree] = low[first]
            while (label[label] != label).any():
                label = label[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _pairs_within(keys: DataFrame, group: list[str], budget: int, forests: int) -> DataFrame:
    """Links ``(a, b)``, so many forests of them, between the nodes that own the turned fingerprints of each group."""
    turns = blocks(budget)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(r: int, key: np.ndarray, node: np.ndarray) -> pa.RecordBatch | None:
        key, first = np.unique(key.view(np.uint64), return_index=True)
        node = node[first]

        def thin(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """So many forests of the pairs; those of a part of all pairs hold all that forests of all of them need."""
            rest, chosen = np.arange(len(left)), []
            length = np.bitwise_count(key[left] ^ key[right])
            for _ in range(forests):
                at = forest(len(key), left[rest], right[rest], length[rest])
                chosen.append(rest[at])
                rest = np.delete(rest, at)
                if not len(rest):
                    break
            at = np.concatenate(chosen)
            return left[at], right[at]

        left, right = thin(*walk(key, turns[r % len(turns)][1], budget, thin))
        return record_batch([node[left], node[right]], schema) if len(left) else None

    def by_turn(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        turn, key, node = (rows.column(x).to_numpy() for x in ("r", "key", "node"))
        for r in np.unique(turn):
            if (found := links(int(r), key[turn == r], node[turn == r])) is not None:
                yield found

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= LIMIT:
                whole, rest = _whole_groups(pa.Table.from_batches(held), len(group))
                held = rest.to_batches()
                yield from by_turn(whole)
        if held:
            yield from by_turn(pa.Table.from_batches(held))

    dealt = keys.select(*group, "key", "node").repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(apply, "a bigint, b bigint")


def _whole_groups(rows: pa.Table, width: int) -> tuple[pa.Table, pa.Table]:
    """The rows before the last group begins, and the rest."""
    cols = [rows.column(i).to_numpy() for i in range(width)]
    other = np.zeros(rows.num_rows, bool)
    for c in cols:
        other |= c != c[-1]
    cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
    return rows.slice(0, cut), rows.slice(cut)


def links(leaves: DataFrame, budget: int, scratch: Scratch, limit: int = LIMIT, forests: int = 1) -> DataFrame:
    """Edges ``(a, b)`` that connect what the links within the budget connect.

    ``leaves`` has a table number ``t``, a fingerprint ``fp`` and the ``node``
    that owns it; ``fp`` is distinct within its table.  The edges are links
    within the budget: minimum spanning ``forests`` of what a task found connected,
    so there are fewer than that many times the leaves in each block.
    """
    turns = blocks(budget)
    kinds = [F.struct((F.col("t") * len(turns) + r).alias("r"), F.shiftrightunsigned(_turn(F.col("fp"), by), BITS - w).alias("block"), _turn(F.col("fp"), by).alias("key"), "node") for r, (by, w) in enumerate(turns)]
    keys = leaves.select(F.inline(F.array(*kinds)))
    large = scratch.cut(keys.groupBy("r", "block").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("r", "block"))
    if not large.count():
        return _pairs_within(keys, ["r", "block"], budget, forests)
    found = _pairs_within(keys.join(large, ["r", "block"], "left_anti"), ["r", "block"], budget, forests)
    width = F.element_at(F.array(*(F.lit(w) for _, w in turns)), F.col("r") % len(turns) + 1)
    rows = keys.join(large, ["r", "block"]).select("r", "key", "node", F.col("block").alias("lo"), F.col("block").alias("hi"), F.lit(0).alias("side"), width.alias("depth"))
    while True:
        rows = _descend(rows, budget)
        size = rows.groupBy("r", "lo", "hi").agg(F.sum("side").alias("ones"), F.count("*").alias("n"))
        size = size.where(F.when(F.col("lo") == F.col("hi"), F.col("n") > 1).otherwise((F.col("ones") > 0) & (F.col("ones") < F.col("n"))))
        rows = scratch.cut(rows.join(size.select("r", "lo", "hi", "n"), ["r", "lo", "hi"]))
        found = found.unionByName(_pairs_within(rows.where(F.col("n") <= limit), ["r", "lo", "hi"], budget, forests))
        rows = rows.where(F.col("n") > limit)
        if not rows.limit(1).count():
            return found


def _descend(rows: DataFrame, budget: int) -> DataFrame:
    """Node pairs ``(lo, hi)`` that hold each row's leaf, a few levels below, within the budget.

    ``side`` tells which node of the pair the leaf is under (0 if both are one).
    """
    step = F.least(F.lit(LEVELS), F.lit(BITS) - F.col("depth"))
    deeper = rows.withColumn("to", F.col("depth") + step).withColumn("own", F.expr("shiftrightunsigned(key, cast(64 - to as int))"))
    other = F.when(F.col("side") == 0, F.col("hi")).otherwise(F.col("lo"))
    deeper = deeper.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.expr("cast(shiftleft(1, cast(to - depth as int)) - 1 as int)")), lambda x: F.lit(0).cast("bigint") + x))).withColumn("top", other)
    deeper = deeper.withColumn("other", F.expr("shiftleft(top, cast(to - depth as int)) | other"))
    deeper = deeper.where(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= budget)
    return deeper.select("r", "key", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), F.col("to").alias("depth"))


def _confirmed(edges: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Edges between texts whose bins tell ``similarity`` or more, less what they may be off by."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            near = estimated(batch.column(2).to_pylist(), batch.column(3).to_pylist()) >= similarity - SLACK
            yield record_batch([batch.column(i).to_numpy()[near] for i in (0, 1)], schema)

    both = edges.distinct()
    for x in ("a", "b"):
        both = both.join(classes.select(F.col("node").alias(x), F.col("bins").alias(f"bins_{x}")), x)
    return both.select("a", "b", "bins_a", "bins_b").mapInArrow(apply, "a bigint, b bigint")


def _alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``pairs(a, b, x, y)`` whose texts share ``similarity`` or more of their shingles, counted exactly."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in slices(batches):
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if known is None or y != last:
                    last, known = y, np.unique(shingles(y, CHECK_WIDTH))
                own = np.unique(shingles(x, CHECK_WIDTH))
                both = len(np.intersect1d(own, known, assume_unique=True))
                near.append(both >= similarity * (len(own) + len(known) - both) - 1e-9)
            near = np.array(near, bool)
            yield record_batch([batch.column(i).to_numpy()[near] for i in (0, 1)], schema)

    return pairs.select("a", "b", "x", "y").mapInArrow(apply, "a bigint, b bigint")


def _classes(docs: DataFrame, width: int, budget: int, tables: int, similarity: float | None, limit: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, tid, class`` of every row; a ``node`` per class, its number of rows ``n``, its first row ``low, tid``; links between nodes."""
    checked = similarity is not None
    own = F.col("fps")[0] if tables == 1 and not checked else F.xxhash64("fps", *(["bins"] if checked else []))
    marks = scratch.cut(fingerprints(docs, width, tables, checked, id_col=id_col, text_col=text_col).withColumn("class", own))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("first")
    more = [F.first("bins").alias("bins")] if checked else []
    classes = marks.groupBy(F.col("class").alias("node")).agg(first, F.count("*").alias("n"), F.first("fps").alias("fps"), *more)
    classes = scratch.cut(classes.select("node", F.col("first.doc_id").alias("low"), F.col("first.tid").alias("tid"), *(x for x in classes.columns if x not in ("node", "first"))))
    leaves = classes.select("node", F.posexplode(F.slice("fps", 1, tables)).alias("t", "fp"))
    edges = None
    if tables > 1:
        # classes that share a fingerprint of one table are one leaf of it
        shared = leaves.groupBy("t", "fp").agg(F.min("node").alias("first"), F.count("*").alias("n")).withColumn("tf", F.struct("t", "fp"))
        twice = shared.where("n > 1").select("tf", "first", "n")
        edges = join_counted(leaves.select("node", F.struct("t", "fp").alias("tf")), twice, "tf", "n", leaves.count()).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
        leaves = shared.select("t", "fp", F.col("first").alias("node"))
    found = links(leaves, budget, scratch, limit, FORESTS if checked else 1)
    found = found if edges is None else found.unionByName(edges)
    if checked:
        found = scratch.cut(_confirmed(found, classes, similarity))
    return marks, classes, found


def near_duplicates(docs: DataFrame, *, width: int = 3, budget: int = 2, tables: int = 1, similarity: float | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (hexadecimal) and ``component_id``, the smallest id reachable over links.

    With more than one table, documents also link if any further fingerprint of
    theirs, from the same shingles by another hash, is within the budget.  With
    ``similarity``, links are confirmed by their five-word shingles, estimated.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marks, classes, found = _classes(docs, width, budget, tables, similarity, limit, id_col, text_col, scratch)
    roots = components(found, scratch)
    named = scratch.cut(classes.select("node", "n", "low").join(roots, "node", "left").select("node", "n", "low", F.coalesce("root", "node").alias("root")))
    names = scratch.cut(named.groupBy("root").agg(F.min("low").alias("low"), F.count("*").alias("classes")))
    named = join_counted(named.drop("low"), names, "root", "classes", named.count())
    named = scratch.cut(named.select(F.col("node").alias("class"), "n", "low"))
    out = join_counted(marks, named, "class", "n", marks.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))


def _same_row(docs: DataFrame, id_col: str, text_col: str, other_id: str, other_tid: str) -> F.Column:
    return docs[id_col].eqNullSafe(F.col(other_id)) & (F.xxhash64(docs[text_col]) == F.col(other_tid))


def _gone(docs: DataFrame, classes: DataFrame, found: DataFrame, similarity: float | None, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``node`` of the classes that go: each is like one that stays."""
    members = scratch.cut(classes.select("node", "low", "tid").join(components(found, scratch), "node"))
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node")).alias("first")
    lead = scratch.cut(members.groupBy("root").agg(first, F.count("*").alias("size")).select("root", F.col("first.node").alias("lead"), "size"))
    members = scratch.cut(join_counted(members, lead, "root", "size", members.count()))
    if similarity is None:
        return members.where("node <> lead").select("node")
    reps = members.withColumnsRenamed({"low": "__id", "tid": "__tid"})
    rows = docs.select(id_col, text_col).join(reps, _same_row(docs, id_col, text_col, "__id", "__tid"))
    texts = rows.groupBy("node").agg(*(F.first(x).alias(x) for x in ("root", "lead", "size")), F.first("__id").alias("low"), F.first(F.col(text_col).cast("binary")).alias("x"))
    texts = scratch.cut(texts.withColumn("parts", F.ceil(F.col("size") / PART)))
    # a component's first text goes to every part of its component
    firsts = texts.where("node = lead").select("root", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    rest = texts.where("node <> lead").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    near = scratch.cut(_alike(rest.join(firsts, ["root", "part"]).select(F.col("node").alias("a"), F.col("lead").alias("b"), "x", "y"), similarity).select(F.col("a").alias("node")))
    unlike = scratch.cut(rest.join(near, "node", "left_anti").select("node", "low", "x"))
    pairs = found
    for a, x in (("a", "x"), ("b", "y")):
        pairs = pairs.join(unlike.select(F.col("node").alias(a), F.struct(F.col("low").isNull().alias("none"), "low", "node").alias(f"k{a}"), F.col("x").alias(x)), a)
    pairs = scratch.cut(pairs)
    if not pairs.limit(1).count():
        return near
    close = _alike(pairs, similarity)
    keyed = scratch.cut(close.join(pairs.select("a", "b", "ka", "kb"), ["a", "b"]))
    both = keyed.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("ka").alias("ku"), F.col("kb").alias("kv"))
    both = scratch.cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("kv").alias("ku"), F.col("ku").alias("kv"))).distinct())
    rounds = 0
    while both.limit(1).count():
        if rounds == IN_ORDER:  # hashes of nodes: half of the links or more end in each round, by expectation
            key = lambda x: F.struct((F.xxhash64(x) % 2 == 0).alias("none"), F.xxhash64(x).alias("low"), F.col(x).alias("node"))
            both = both.select("u", "v", key("u").alias("ku"), key("v").alias("kv"))
        order = lambda x: F.struct(f"{x}.none", F.coalesce(f"{x}.low", F.lit(0)), f"{x}.node")
        stay = both.groupBy("u").agg(F.min(order("ku")).alias("own"), F.min(order("kv")).alias("least")).where("own < least").select("u")
        go = scratch.cut(both.join(stay, "u", "left_semi").select(F.col("v").alias("node")).distinct())
        near = near.unionByName(go)
        open_ = both.join(go.withColumnRenamed("node", "u"), "u", "left_anti").join(go.withColumnRenamed("node", "v"), "v", "left_anti")
        both = scratch.cut(open_.select("u", "v", "ku", "kv"))
        rounds += 1
    return near


def one_of_each(docs: DataFrame, *, width: int = 2, budget: int = 4, tables: int = 14, similarity: float | None = 0.8, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: none that is dropped is less than ``similarity`` like a row that stays.

    Of texts that are alike the one of the smallest id stays, of equal ids that of
    the smallest hash, of equal rows one; texts without any id come last.  In chains
    of texts each like the next only, those that stay may follow hashes.  Without
    ``similarity`` one row of each component stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marks, classes, found = _classes(docs, width, budget, tables, similarity, limit, id_col, text_col, scratch)
    gone = _gone(docs, classes, found, similarity, id_col, text_col, scratch).distinct().withColumn("goes", F.lit(True))
    info = classes.select(F.col("node").alias("class"), "n", F.struct("low", "tid").alias("best")).join(gone.withColumnRenamed("node", "class"), "class", "left")
    rows = join_counted(marks.select("doc_id", "tid", "class"), scratch.cut(info), "class", "n", marks.count())
    rows = scratch.cut(rows.groupBy("class", "doc_id", "tid", "best", "goes").agg(F.count("*").alias("n")))
    first = F.col("goes").isNull() & F.col("doc_id").eqNullSafe(F.col("best.low")) & (F.col("tid") == F.col("best.tid"))
    gone = rows.where(~first).select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid"))
    tid = F.xxhash64(text_col)
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (tid == F.col("__tid")), "left_anti")
    twice = scratch.cut(rows.where(first & (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")))
    if not twice.limit(1).count():
        return left
    # equal rows of one id: those of a partition first, so that no key has more rows than there are partitions
    again = docs.join(twice, F.col(id_col).eqNullSafe(F.col("__id")) & (tid == F.col("__tid")), "left_semi")
    at = [docs.columns.index(id_col), docs.columns.index(text_col)]

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            keys = list(zip(*(batch.column(i).to_pylist() for i in at)))
            fresh = []
            for k in keys:
                k = (k[0], None if k[1] is None else xxhash.xxh3_128_digest(k[1]))
                fresh.append(k not in seen)
                seen.add(k)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    again = again.mapInArrow(once, docs.schema)
    number = F.row_number().over(Window.partitionBy(F.col(id_col), tid).orderBy(F.lit(0)))
    again = again.withColumn("__number", number).where("__number = 1").drop("__number")
    none = docs.join(twice, F.col(id_col).eqNullSafe(F.col("__id")) & (tid == F.col("__tid")), "left_anti")
    return none.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (tid == F.col("__tid")), "left_anti").unionByName(again)
