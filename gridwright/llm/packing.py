"""Packing documents into sequences of one length by Karmarkar-Karp differencing.

A document's tokens are cut: as many full sequences as it holds come off its
front, and what remains is cut into parts of :data:`PART` tokens at most.  The
parts of a task's documents are divided among windows by multiway differencing:
each part begins as a partition of its own (itself in one window, nothing in the
others), and the two partitions of the greatest difference between their fullest
and emptiest window merge, the fullest of one onto the emptiest of the other,
until one is left.  Its windows are nearly equal.  If the fullest exceeds the
capacity, the number of windows rises and the division is made again.

A sequence that is as long as a power of two needs no padding.  So there is a
second way to make room: some tokens of the last parts leave as short sequences
of powers of two, and the windows stay as few as the rest fills.  Of all these
plans (more windows, or more tokens that leave) that of the least padding is
tried first, and the first that fits is taken.

Parts of one document that meet in order in a window are one piece again.  Groups
are divided in the task that has read and tokenised them, so nothing is shuffled;
a group is bounded in tokens and documents.

Null and empty texts are the end token alone.  Rows are documents of their own,
also if ids repeat; a null id passes through.  An empty table gives an empty
result, and other columns play no part.  A very long text is tokenised between
spaces, piece by piece, and its tokens are held (four bytes each); a run without
any space is one piece.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridwright.llm.texts import binary_texts, record_batch, slices

PART = 512
"""Tokens of the parts that windows are filled with."""
GRAIN = 32
"""What leaves for short sequences is a multiple of it, so that few are very short."""
GROUP_TOKENS = 500_000
GROUP_DOCS = 8_192
"""Tokens of parts, and documents, that are divided among windows at once."""
TEXT_PIECE = 1 << 20


class Tokens:
    """Token ids of texts by a byte-level byte-pair vocabulary, as the ``tokenizers`` library gives them.

    Latin texts go through ``tiktoken``, which merges by the same ranks several
    times as fast, if the vocabulary numbers its merges in their order.
    """

    def __init__(self, content: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fast = _by_ranks(json.loads(content))

    def ids(self, text: str) -> bytes:
        """The ids of a text without special strings."""
        quick = self.fast and _LATIN.fullmatch(text)
        return array("I", self.fast.encode_ordinary(text) if quick else self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, lowest first."""
        return [b"".join([array("I", [self.special[x]]).tobytes() if x in self.special else self.ids(x) for x in self._pieces(text)]) for text in texts]

    def _pieces(self, text: str) -> Iterator[str]:
        """Special strings, and what is between them, in pieces that end in front of a space and a character: no token crosses that place."""
        for part in self.special_at.split(text) if self.special_at else [text]:
            at = 0
            while len(part) - at > TEXT_PIECE:
                found = _CUT.search(part, at + TEXT_PIECE)
                if not found:
                    break
                yield part[at : found.start()]
                at = found.start()
            if at < len(part):
                yield part[at:]


_CUT = re.compile(r"(?= \S)")
_LATIN = re.compile("[\x00-\x1b\x20-\x7e\u00a1-\u024f\u2010-\u2027\u2030-\u205e]*")  # characters that any two libraries tell letters, digits, spaces and others of alike


def _by_ranks(model: dict):
    """A faster merger of the same words, or None if the vocabulary isn't plain byte-level pairs numbered in their order."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    part, pre = model["model"], model.get("pre_tokenizer") or {}
    if part.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("normalizer") or part.get("ignore_merges"):
        return None
    vocabulary = part["vocab"]
    made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in part["merges"]]
    if made != sorted(made):
        return None
    # the visible characters that stand for bytes: those that stand for themselves, then the rest from 256 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    if set(byte) != set(ByteLevel.alphabet()):
        return None
    special = {t["content"] for t in model.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# fixed value: how byte-level vocabularies of this kind cut a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def differencing(sizes: list[int], windows: int) -> tuple[list[int], int]:
    """The window of each of some sizes, by multiway differencing, and the fullest window's sum.

    A partition is a list of ``(sum, part)``, its windows in falling order without
    those that hold nothing, less what the emptiest holds; ``part`` is one of a
    window's parts, and the others hang below it.
    """
    above = list(range(len(sizes)))
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = windows - len(b)  # so many windows of `a` meet nothing of `b`
        if alone >= len(a):
            c = a + b
        else:
            both = b[windows - len(a) :][::-1]
            c = a[:alone] + b[: windows - len(a)]
            for (m, at), (n, other) in zip(a[alone:], both):
                above[other] = at
                c.append((m + n, at))
        c.sort(reverse=True)
        if len(c) == windows and (low := c[-1][0]):
            c = [(n - low, at) for n, at in c]
        heapq.heappush(heap, (-c[0][0], number, c))
        number += 1
    found: dict[int, int] = {}
    window, sums = [], []
    for i, size in enumerate(sizes):
        root = i
        while above[root] != root:
            root = above[root]
        while above[i] != root:
            above[i], i = root, above[i]
        w = found.setdefault(root, len(found))
        if w == len(sums):
            sums.append(0)
        window.append(w)
        sums[w] += size
    return window, max(sums, default=0)


def powers(n: int, most: int) -> list[int]:
    """``n`` as a sum of powers of two, the largest first, none above ``most`` (which is one)."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def divided(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """What stays of each size, the window of each that stays at all, and how many windows there are.

    What doesn't stay are the last tokens of the list, for sequences of powers of two.
    """
    total = sum(sizes)
    least = -(-total // capacity)
    found, fullest = differencing(sizes, max(1, least))
    short = capacity & (capacity - 1) == 0
    if fullest <= capacity and (not short or 100 * (least * capacity - total) <= total):
        return sizes, found, least
    over = max(0, fullest - total // max(1, least))  # of the fullest window over the mean
    while True:
        more = max(least, -(-total // max(1, capacity - over)))
        fewer = total // capacity
        leave = min(total, -(-(total - fewer * capacity + over * fewer) // GRAIN) * GRAIN) if fewer else total
        if short and (fewer * capacity - (total - leave)) < more * capacity - total:
            kept, left = [], total - leave
            for n in sizes:
                kept.append(min(n, left))
                left -= kept[-1]
            windows = fewer if leave < total else 0
        else:
            kept, windows = sizes, more
        some = [n for n in kept if n]
        found, fullest = differencing(some, windows) if windows else ([], 0)
        if fullest <= capacity:
            return kept, found, windows
        over += max(1, over // 4)


class _Group:
    """The parts of some documents, and the rows of their pieces."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.rows: list[tuple] = []
        self.docs: list[tuple] = []  # id, where the rest begins, its ids, tokens of the document
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        full = n // self.capacity
        for i in range(full):
            at = i * self.capacity
            self.rows.append((doc_id, at, self.capacity, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + self.capacity)]), n, self.sequence, 0))
            self.sequence += 1
        at = full * self.capacity
        if at < n:
            self.docs.append((doc_id, at, ids[4 * at :], n))
            self.tokens += n - at

    def close(self) -> list[tuple]:
        """All rows; the group is empty again, and its numbers go on."""
        parts = [(i, at, min(PART, n - at)) for i, (_, _, ids, _) in enumerate(self.docs) for n in (len(ids) // 4,) for at in range(0, n, PART)]
        kept, window, windows = divided([n for _, _, n in parts], self.capacity) if parts else ([], [], 0)
        pieces = [(self.sequence + w, d, at, n) for (d, at, _), n, w in zip(parts, kept, window)]  # those that stay are the first
        self.sequence += windows
        tail = [(d, at + k, n - k) for (d, at, n), k in zip(parts, kept) if k < n][::-1]
        for room in powers(sum(n for _, _, n in tail), self.capacity) if tail else []:
            while room:
                d, at, n = tail.pop()
                take = min(room, n)
                pieces.append((self.sequence, d, at, take))
                room -= take
                if take < n:
                    tail.append((d, at + take, n - take))
            self.sequence += 1
        pieces.sort()
        joined: list[list[int]] = []
        offset = 0
        for s, d, at, n in pieces:
            last = joined[-1] if joined and joined[-1][0] == s else None
            offset = offset if last else 0
            if last and last[1] == d and last[2] + last[3] == at:
                last[3] += n
            else:
                joined.append([s, d, at, n, offset])
            offset += n
        for s, d, at, n, offset in joined:
            doc_id, front, ids, tokens = self.docs[d]
            self.rows.append((doc_id, front + at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]), tokens, s, offset))
        out, self.rows, self.docs, self.tokens = self.rows, [], [], 0
        return out


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_workers: dict[int, Tokens] = {}


def packed(docs: DataFrame, content: str, *, capacity: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece; ``content`` is the vocabulary's file as ``tokenizers`` writes it, ``end`` closes each document."""
    sent = docs.sparkSession.sparkContext.broadcast(content)  # as large as the file
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
    stop = np.array([end], "<u4").tobytes()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(sent.value.encode())
        if key not in _workers:  # a worker serves many tasks
            _workers.clear()
            _workers[key] = Tokens(sent.value)
        tokens = _workers[key]
        group = _Group(capacity, TaskContext.get().partitionId() << 40)
        for batch in slices(batches, 64):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                (ids,) = tokens.of([(text.as_py() or b"").decode()])
                if group.docs and (group.tokens >= GROUP_TOKENS or len(group.docs) >= GROUP_DOCS):
                    yield from _batches(group.close(), schema)
                group.add(doc_id, ids + stop)
        yield from _batches(group.close(), schema)

    return binary_texts(docs, id_col, text_col).mapInArrow(apply, PIECES)


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        yield record_batch([list(x) for x in zip(*rows[at : at + 10_000])], schema)
