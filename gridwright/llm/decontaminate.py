"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other
figures or other people has the same template.  Windows of ``WINDOW`` canonical
tokens of every document are joined by hash with those of the benchmark (items
with fewer tokens: the whole item).  A hit counts if the tokens are equal and
the slots are consistent: within the window, equal values of one side stand
where equal values of the other do.

Canonical tokens: white-space runs without their outer ASCII punctuation, A-Z
lower-cased; tokens of punctuation only vanish.  *Number*: digits, with any of
``.,:/-`` between.  *Unit*: one of ``UNITS`` behind a number.  *Name*: a capital
letter first.  A capital that opens a sentence or line may be a name or not, so
such a token is a slot like a name, but counts as a literal.  Windows need
``LITERALS`` literal tokens to match with other values in their slots.

The same windows are also joined without placeholders, by their lower-cased
tokens and whatever their number of literals: verbatim copies, copies in other
case and copies with other line breaks or punctuation around tokens hit, however
short the item is.

The benchmark is a stated query set: it is joined in blocks of ``BLOCK_BYTES``,
each broadcast, against all documents; documents are not shuffled.  Nulls and
empty texts have no windows; repeated rows get a result each; ties have no part
in a result; a very long text is laid out alone, at some 100 bytes for each of its
own; empty tables give an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm import rolling
from gridwright.llm.texts import binary_texts, record_batch, runs, slices

WINDOW = 10
LITERALS = 5
BLOCK_BYTES = 32 << 20
PIECE = 2 << 20
# fixed values: units of measure
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet g kg mg lb lbs oz ton tons gram grams "
    "kilogram kilograms pound pounds ounce ounces l ml liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hour hours day days week weeks month months year years mph kmh hz khz mhz ghz w kw v a j kj cal kcal "
    "dollar dollars euro euros cent cents usd eur percent degree degrees"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


DIGITS = _mask(b"0123456789")
NUMERIC = _mask(b"0123456789.,:/-")
CAPITAL = _mask(bytes(range(65, 91)))
CORE = DIGITS | CAPITAL | _mask(bytes(range(97, 123))) | (np.arange(256) >= 128)
STOPS = _mask(b".!?")
CAPITAL_2 = np.zeros(1 << 16, bool)
"""First two bytes of capital letters that UTF-8 writes in two."""
for _c in filter(lambda c: chr(c).isupper(), range(128, 2048)):
    CAPITAL_2[int.from_bytes(chr(_c).encode(), "big")] = True
LOWER = np.where(CAPITAL, np.arange(256) + 32, np.arange(256)).astype(np.uint8)
UNIT_HASHES = np.sort([rolling.ranges(rolling.prefix(rolling.TABLE[np.frombuffer(x.encode(), np.uint8)]), np.array([0]), np.array([len(x)]))[0] for x in UNITS])


def folded(texts: list[bytes | None], data: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The texts' bytes in lower case, letters beyond A-Z too where both cases have as many bytes; ``lower`` if none are."""
    if not (data >= 128).any():
        return lower

    def fold(text: bytes | None) -> bytes:
        if not text or text.isascii():
            return (text or b"").lower()
        chars = text.decode("utf-8", "surrogateescape")
        low = {c: c.lower() for c in set(chars)}
        table = {ord(c): x for c, x in low.items() if c != x and len(x.encode()) == len(c.encode())}
        return chars.translate(table).encode("utf-8", "surrogateescape")

    return np.frombuffer(b"".join(map(fold, texts)), np.uint8)


class Canonical:
    """Canonical tokens of some texts: byte ranges, hashes, kinds (0: literal) and text numbers."""

    def __init__(self, texts: list[bytes | None]):
        self.data, offsets = rolling.laid_out(texts)
        start, end, owner = rolling.tokens(self.data, offsets)
        core = np.flatnonzero(CORE[self.data])
        first, last = np.searchsorted(core, start), np.searchsorted(core, end)
        kept = first < last
        start, end, owner, first, last = (x[kept] for x in (start, end, owner, first, last))
        raw_start, raw_end = start, end
        self.start = start = core[first] if len(first) else first
        self.end = end = core[last - 1] + 1 if len(last) else last
        self.owner = owner
        lower = LOWER[self.data]
        plain = rolling.ranges(rolling.prefix(rolling.TABLE[lower]), start, end)
        odd = np.concatenate([[0], np.cumsum(~NUMERIC[self.data])])
        number = (odd[end] == odd[start]) & DIGITS[self.data[start]] if len(start) else np.zeros(0, bool)
        lines = np.concatenate([[0], np.cumsum(self.data == 10)])
        opens = np.ones(len(start), bool)
        if len(start) > 1:
            opens[1:] = (owner[1:] != owner[:-1]) | STOPS[self.data[raw_end[:-1] - 1]] | (lines[raw_start[1:]] != lines[raw_end[:-1]])
        capital = CAPITAL[self.data[start]] if len(start) else np.zeros(0, bool)
        if len(start):
            capital |= CAPITAL_2[self.data[start].astype(np.int64) << 8 | self.data[np.minimum(start + 1, len(self.data) - 1)]]
        unit = np.zeros(len(start), bool)
        if len(start) > 1:
            unit[1:] = number[:-1] & (owner[1:] == owner[:-1]) & np.isin(plain[1:], UNIT_HASHES)
        self.kind = np.select([number, unit, capital], [1, 2, 3], 0)
        self.hash = np.select([number, unit, capital], [NUMBER, UNIT, NAME], plain)
        self._sums = rolling.prefix(self.hash)
        self.folded = folded(texts, self.data, lower)
        spelt = plain if self.folded is lower else rolling.ranges(rolling.prefix(rolling.TABLE[self.folded]), start, end)
        self._spelt = rolling.prefix(spelt)
        self._literals = np.concatenate([[0], np.cumsum((self.kind == 0) | (self.kind == 3) & opens)])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows of ``width`` tokens with enough literals."""
        at = np.arange(max(0, len(self.hash) - width + 1))
        at = at[(self.owner[at] == self.owner[at + width - 1]) & (self._literals[at + width] - self._literals[at] >= LITERALS)]
        return at, rolling.ranges(self._sums, at, at + width)

    def verbatim(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of all windows of ``width`` lower-cased tokens, without placeholders."""
        at = np.arange(max(0, len(self.hash) - width + 1))
        at = at[self.owner[at] == self.owner[at + width - 1]]
        return at, rolling.ranges(self._spelt, at, at + width)

    def spelling(self, at: int, width: int) -> list[bytes]:
        """The lower-cased bytes of each token of a window."""
        return [self.folded[self.start[i] : self.end[i]].tobytes() for i in range(at, at + width)]

    def words(self, at: int, width: int) -> list[tuple[int, bytes]]:
        """Kind and lower-cased bytes of each token of a window."""
        return list(zip(self.kind[at : at + width].tolist(), self.spelling(at, width)))


def consistent(ours: list[tuple[int, bytes]], theirs: list[tuple[int, bytes]]) -> bool:
    """Equal kinds and literals, and a one-to-one relation between the values of the slots."""
    there, back = {}, {}
    for (kind, a), (other, b) in zip(ours, theirs):
        if kind != other or kind == 0 and a != b:
            return False
        if kind and (there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a):
            return False
    return True


class Templates:
    """The benchmark's windows by width, hash and place."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        parsed = Canonical([x for _, x in items])
        lengths = np.bincount(parsed.owner, minlength=len(items))
        found, spelt = defaultdict(list), defaultdict(list)
        for width in sorted({min(WINDOW, int(n)) for n in lengths if n}):
            for (at, h), words, into in ((parsed.windows(width), parsed.words, found), (parsed.verbatim(width), parsed.spelling, spelt)):
                own = (lengths[parsed.owner[at]] == width) | (width == WINDOW) if len(at) else np.zeros(0, bool)
                for i, x in zip(at[own].tolist(), h[own].tolist()):
                    into[width].append((x, i, int(parsed.owner[i]), words(i, width)))
        self.by_width, self.spelt = _by_hash(found), _by_hash(spelt)

    def hits(self, texts: list[bytes | None]) -> dict[int, dict[int, list[int]]]:
        """By text number and item: [windows found, those of them with other values in a slot]."""
        found: dict[int, dict[int, list[int]]] = defaultdict(dict)
        if not self.spelt:
            return found
        doc = Canonical(texts)
        seen: set[tuple[int, int, int]] = set()  # windows that are verbatim copies: by width and first tokens of both sides

        def add(i: int, item: int, altered: bool) -> None:
            n = found[int(doc.owner[i])].setdefault(self.ids[item], [0, 0])
            n[0] += 1
            n[1] += altered

        for width, rows in self.spelt.items():
            for i, same in _met(rows, *doc.verbatim(width)):
                ours = doc.spelling(i, width)
                for at, item, theirs in same:
                    if ours == theirs:
                        seen.add((width, i, at))
                        add(i, item, False)
        for width, rows in self.by_width.items():
            for i, same in _met(rows, *doc.windows(width)):
                ours = doc.words(i, width)
                for at, item, theirs in same:
                    if (width, i, at) not in seen and consistent(ours, theirs):
                        add(i, item, ours != theirs)
        return found


def _by_hash(found: dict[int, list[tuple]]) -> dict[int, tuple]:
    """By width: sorted hashes, bits of those that occur, and what they belong to."""
    out = {}
    for width, rows in found.items():
        rows.sort(key=lambda r: r[0])
        hashes = np.array([r[0] for r in rows], np.uint64)
        bits = np.zeros(1 << 20, bool)
        bits[hashes >> np.uint64(44)] = True
        out[width] = (hashes, bits, [r[1:] for r in rows])
    return out


def _met(known: tuple, at: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
    """First tokens of the windows whose hash is known, with what has it."""
    hashes, bits, rows = known
    maybe = bits[h >> np.uint64(44)]
    at, h = at[maybe], h[maybe]
    low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
    hit = low < high
    for i, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
        yield i, rows[a:b]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    rows = binary_texts(benchmark, id_col, text_col).where("doc_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n = int(total // BLOCK_BYTES) + 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k)
        yield sorted((r.doc_id, bytes(r.text)) for r in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``n_windows`` and ``n_altered`` (of them: with other slot values) of every document and item that share a window."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_altered", pa.int64())])
    kind = "doc_id bigint, item_id bigint, n_windows bigint, n_altered bigint"
    rows = binary_texts(docs, id_col, text_col)
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def apply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            templates = Templates(sent.value)
            for batch in slices(batches):
                ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
                for a, b in runs(texts, PIECE):
                    hits = templates.hits(texts[a:b])
                    rows = [(ids[a + i], item, *n) for i, items in hits.items() for item, n in items.items()]
                    if rows:
                        yield record_batch([list(x) for x in zip(*rows)], schema)

        part = rows.mapInArrow(apply, kind)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with the benchmark; a map for each block, no join."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def apply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            templates = Templates(sent.value)
            for batch in slices(batches):
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                free = np.ones(len(texts), bool)
                for a, b in runs(texts, PIECE):
                    free[[a + i for i in templates.hits(texts[a:b])]] = False
                yield batch.filter(pa.array(free))

        docs = docs.mapInArrow(apply, docs.schema)
    return docs
