"""Token counts of a byte-pair vocabulary by rank-synchronous merging.

A text splits into pre-tokens that no merge can cross: runs of spaces with the
word behind them, and line ends.  Pre-tokens a task hasn't counted yet are held
together as one ragged array of symbol numbers.  In each round every sequence
finds the lowest rank among its adjacent pairs, and all sequences apply theirs
at once; a sequence without a pair in the table leaves, and its count is the
number of its symbols (a symbol outside the vocabulary counts its UTF-8 bytes).

All places of a sequence's best pair merge in one round, left to right without
overlaps, if no pair with the merged symbol ranks lower; else the leftmost only.
That is the order of a queue that pops the best-ranked leftmost pair.

A round passes over every symbol that is left, so sequences of over ``LONG``
symbols (unspaced scripts, encoded data) go another way to the same order: their
places are kept by rank, and a round visits the places of the lowest rank that
any of them has, and no others.  Its price follows the merges, so a word of a
million letters takes seconds.

Null texts count as empty: no bytes, no tokens.  Rows are counted one by one;
repeated rows and ties don't matter, a null id passes through, an empty table
gives an empty result, and other columns play no part.  A very long text is held
whole, as its pre-tokens.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridwright.llm.texts import binary_texts, record_batch, slices

SPACE = "▁"
NONE = np.int64(1 << 40)
LONG = 200
"""Symbols of a sequence beyond which its places are kept by rank."""
REMEMBERED = 500_000
REMEMBERED_CHARS = 16 << 20
"""Pre-tokens whose counts a task remembers, and their characters; then it forgets all."""
LONG_WORD = 50
"""Characters beyond which a pre-token isn't remembered: such hardly come again."""


@dataclass
class Vocabulary:
    """Symbols and the pairs that merge, as arrays."""

    chars: dict[str, int]
    cost: np.ndarray
    pairs: np.ndarray  # left * size + right, ascending
    ranks: np.ndarray
    merged: np.ndarray
    eager: np.ndarray  # by symbol: all its places may merge in one round
    splits_lines: bool

    @staticmethod
    def of(pieces: list[tuple[str, float]]) -> Vocabulary:
        """From the mergeable pieces and their scores (higher: earlier); spaces are ``SPACE``."""
        for p, _ in pieces:
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"{p!r} crosses a word's start")
        ranked = [p for p, _ in sorted(pieces, key=lambda x: -x[1])]
        names = list(dict.fromkeys(ranked + [c for p in ranked for c in p]))
        ids = {p: i for i, p in enumerate(names)}
        known, size = len(ranked), len(names)
        found = {}
        for rank, p in enumerate(ranked):
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    found[ids[p[:k]] * size + ids[p[k:]]] = rank
        pairs = np.array(sorted(found), np.int64)
        ranks = np.array([found[x] for x in pairs.tolist()], np.int64)
        eager = np.ones(size, bool)
        for side in (pairs // size, pairs % size):
            eager[side[(side < known) & (ranks < side)]] = False
        cost = np.array([1 if i < known else len(p.encode()) for i, p in enumerate(names)], np.int64)
        # a pair's rank is the number of the piece it makes
        return Vocabulary({p: i for p, i in ids.items() if len(p) == 1}, cost, pairs, ranks, ranks, eager, not any("\n" in p for p in ranked))

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a sentencepiece BPE model with byte fallback, a dummy prefix and no other normalisation."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        mergeable = (i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
        return Vocabulary.of([(sp.id_to_piece(i), sp.get_score(i)) for i in mergeable])

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each of some non-empty pre-tokens (spaces as ``SPACE``), merged together."""
        size, chars, total = len(self.cost), self.chars, np.zeros(len(words), np.int64)
        text = "".join(words)
        ids = np.array([chars.get(c, -1) for c in text], np.int64)
        strange = ids < 0
        if strange.any():  # no merge touches these: their bytes count, and they part their sequence
            own = np.array([len(text[i].encode()) for i in np.flatnonzero(strange)], np.int64)
        seq = np.repeat(np.arange(len(words)), [len(w) for w in words])
        if strange.any():
            np.add.at(total, seq[strange], own)
        part = seq.astype(np.int64) * 0 + np.cumsum(strange)
        keep = ~strange
        ids, seq, part = ids[keep], seq[keep], part[keep]
        if (long := np.bincount(seq, minlength=len(words))[seq] > LONG).any():
            total += np.bincount(seq[long], self._by_rank(ids[long], seq[long], part[long]), len(words)).astype(np.int64)
            ids, seq, part = ids[~long], seq[~long], part[~long]
        while len(ids):
            same = (seq[1:] == seq[:-1]) & (part[1:] == part[:-1])
            key = ids[:-1] * size + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where(same & (self.pairs[at] == key), self.ranks[at], NONE) if len(self.pairs) else np.full(len(key), NONE)
            rank = np.append(rank, NONE)  # one for each symbol: with the next
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(ids)))
            over = least == NONE
            if over.any():
                total[seq[starts[over]]] += np.add.reduceat(self.cost[ids], starts)[over]
            best = np.repeat(least, lengths)
            place = np.flatnonzero((rank == best) & (best != NONE))
            if len(place):
                begins = np.concatenate([[True], np.diff(place) != 1])
                run = np.maximum.accumulate(np.where(begins, place, 0))
                pick = (place - run) % 2 == 0
                shy = ~self.eager[rank[place]]
                first = np.concatenate([[True], seq[place[1:]] != seq[place[:-1]]])
                place = place[np.where(shy, first, pick)]
                ids[place] = rank[place]
            stay = np.repeat(~over, lengths)
            stay[place + 1] = False
            ids, seq, part = ids[stay], seq[stay], part[stay]
        return total

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; ``NONE`` for those that don't merge, and beside a bound (symbol -1)."""
        key = left * len(self.cost) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == key), self.ranks[at], NONE)

    def _by_rank(self, ids: np.ndarray, seq: np.ndarray, part: np.ndarray) -> np.ndarray:
        """What each of the symbols costs when all are merged (0: merged into one in front of it)."""
        if not len(self.pairs):
            return self.cost[ids]
        # symbols with a bound around each sequence and part, as a linked list
        ends = np.flatnonzero((seq[1:] != seq[:-1]) | (part[1:] != part[:-1])) + 1
        own = np.arange(len(ids)) + 1 + np.searchsorted(ends, np.arange(len(ids)), "right")
        n = len(ids) + len(ends) + 2
        symbol, of, after, before = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.arange(1, n + 1), np.arange(-1, n - 1)
        symbol[own], of[own] = ids, seq
        rank = np.append(self._ranks(symbol[:-1], symbol[1:]), NONE)
        places: dict[int, list[int]] = {}
        for i in np.flatnonzero(rank < NONE).tolist():
            places.setdefault(int(rank[i]), []).append(i)
        queue = list(places)
        heapq.heapify(queue)
        while queue:
            best = heapq.heappop(queue)
            at = np.unique(np.array(places.pop(best), np.int64))
            at = at[rank[at] == best]
            if len(at) > 1:  # left to right without overlaps
                begins = np.append(True, after[at[:-1]] != at[1:])
                number = np.arange(len(at))
                at = at[(number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0]
            if len(at) and not self.eager[best]:  # up to a sequence's first place that makes a pair of a lower rank
                merged = np.full(len(at), best)
                left = np.where(np.append(False, after[at[:-1]] == before[at[1:]]), best, symbol[before[at]])
                lower = np.minimum(self._ranks(left, merged), self._ranks(merged, symbol[after[after[at]]])) < best
                sums = np.cumsum(lower) - lower
                first = np.append(True, of[at[1:]] != of[at[:-1]])
                go = sums == np.maximum.accumulate(np.where(first, sums, 0))
                if not go.all():
                    places[best] = at[~go].tolist()
                    heapq.heappush(queue, best)
                    at = at[go]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = best
            rank[gone] = NONE
            symbol[gone] = -2
            after[at] = after[gone]
            before[after[at]] = at
            changed = np.unique(np.concatenate([before[at], at]))
            rank[changed] = self._ranks(symbol[changed], symbol[after[changed]])
            for i, r in zip(changed.tolist(), rank[changed].tolist()):
                if r < NONE:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(queue, r)
                    places[r].append(i)
        left = symbol[own]
        return np.where(left >= 0, self.cost[left], 0)


class Counter:
    """Counts the tokens of texts; remembers pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}
        self.size = 0
        self.pattern = re.compile(" *[^ ]+| +")

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, with spaces as spaces, and the line ends between them."""
        text = " " + text.replace(SPACE, " ")
        lines = text.split("\n") if self.vocabulary.splits_lines else [text]
        out: list[str] = []
        for line in lines:
            out += self.pattern.findall(line)
        return out, len(lines) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.split(x) if x else ([], 0) for x in texts]
        new = list({w for words, _ in split for w in words} - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED or self.size > REMEMBERED_CHARS:
            self.known.clear()
            self.size = 0
            new = list({w for words, _ in split for w in words})
        if new:
            self.known.update(zip(new, self.vocabulary.counts([w.replace(" ", SPACE) for w in new]).tolist()))
        get = self.known.__getitem__
        out = [sum(map(get, words)) + ends for words, ends in split]
        for w in new:
            if len(w) > LONG_WORD:
                del self.known[w]
            else:
                self.size += len(w)
        return out


def token_counts(docs: DataFrame, vocabulary: Vocabulary, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit``; a map without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # as large as the vocabulary file; plain arrays, so workers need no package
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Vocabulary(**sent.value))
        for batch in slices(batches, 512):
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            n = counter.count([x.decode() for x in texts])
            yield record_batch([batch.column(0), [len(x) for x in texts], n, [x > limit for x in n]], schema)

    return binary_texts(docs, id_col, text_col).mapInArrow(apply, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
