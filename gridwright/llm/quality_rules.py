"""Quality rules as a short-circuit cascade.

Every rule rejects or passes one text.  A document is kept if no rule rejects
it, so the order of the rules can't change a verdict, only its price: the cost
and the selectivity of each rule are estimated on a sample and the rules run in
descending order of rejections per second.  A document leaves the cascade at
its first rejection, and what a rule reads of it is counted when the first rule
asks.  :func:`keep` runs the base rule's halves in the same cascade, so a text of
few words is never searched for repeats; :func:`judge` reports all counts and
saves only the rules behind the first rejection.

Nulls and empty texts have no words: all counts are 0 and the base rule rejects
them.  Rows are judged one by one, so repeated rows get equal verdicts; a null
id passes through; an empty table gives an empty result.  Ties have no part in a
result; a very long text is held whole, with its words.  Other columns of the
input play no part, whatever their names.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from gridwright.llm.texts import binary_texts, record_batch, slices

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 5


class Facts:
    """Counts of one text (null: as an empty one), each made when it is first asked for."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip(BLANKS)]

    @property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return too_short(self) or repetitive(self)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def too_short(f: Facts) -> bool:
    """Under ten words."""
    return f.n_words < 10


def repetitive(f: Facts) -> bool:
    """Over a fifth of the words in repeated windows."""
    return 100 * f.n_repeat_words > 20 * f.n_words


def symbol_heavy(f: Facts) -> bool:
    """More than one symbol to ten words."""
    return 10 * f.n_symbols > f.n_words


def line_copies(f: Facts) -> bool:
    """Over half of the lines repeat an earlier one."""
    return 2 * f.n_dup_lines > f.n_lines


def long_words(f: Facts) -> bool:
    """Over 25 code points to a word."""
    return f.word_chars > 25 * f.n_words


def shouting(f: Facts) -> bool:
    """Over three tenths of the words have capital letters A-Z and no small ones."""
    return 10 * sum(map(bytes.isupper, f.words)) > 3 * f.n_words


def cut_lines(f: Facts) -> bool:
    """Over half of the lines end in three dots."""
    return 2 * sum(x.rstrip(BLANKS).endswith(b"...") for x in f.text.split(b"\n")) > f.n_lines


BASE: dict[str, Callable[[Facts], bool]] = {"too_short": too_short, "repetitive": repetitive}
RULES: dict[str, Callable[[Facts], bool]] = {
    "symbol_heavy": symbol_heavy,
    "line_copies": line_copies,
    "long_words": long_words,
    "shouting": shouting,
    "cut_lines": cut_lines,
}


@dataclass(frozen=True)
class Estimate:
    """What a rule took and rejected on the sample."""

    rule: str
    seconds: float
    rows: int
    rejected: int

    @property
    def rejections_per_second(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, rules: dict[str, Callable[[Facts], bool]] = RULES, *, sample_rows: int = 512, sample_parts: int = 8, id_col: str = "doc_id", text_col: str = "text") -> list[Estimate]:
    """Cost and selectivity of each rule on about ``sample_rows`` rows: the first ones of ``sample_parts`` partitions.

    The other partitions aren't read, so the price doesn't grow with the table.
    The sample only orders the rules; it decides nothing about a document.
    """
    rows = binary_texts(docs, id_col, text_col).select("text").rdd
    parts = max(1, rows.getNumPartitions())
    chosen = range(0, rows.getNumPartitions(), -(-parts // sample_parts))
    most = -(-sample_rows // max(1, len(chosen)))

    def measure(part: Iterator) -> Iterator[tuple[str, float, int, int]]:
        spent, rejected, seen_rows = Counter(), Counter(), 0
        for row in islice(part, most):
            text = None if row.text is None else bytes(row.text)
            seen_rows += 1
            for name, rule in rules.items():
                seen = Facts(text)  # a rule's price has what it counts
                began = time.perf_counter()
                rejected[name] += bool(rule(seen))
                spent[name] += time.perf_counter() - began
        return iter([(x, spent[x], seen_rows, rejected[x]) for x in rules])

    # a job over these partitions only: the one thing here that DataFrames can't say
    found = docs.sparkSession.sparkContext.runJob(rows, measure, list(chosen)) if chosen else []
    sums: dict[str, Estimate] = {x: Estimate(x, 0.0, 0, 0) for x in rules}
    for rule, seconds, n, rejected in found:
        was = sums[rule]
        sums[rule] = Estimate(rule, was.seconds + seconds, was.rows + n, was.rejected + rejected)
    return [sums[x] for x in rules]


def order(estimates: list[Estimate]) -> list[str]:
    """Rules by rejections per second, most first; ties and rules that rejected nothing: cheapest first."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.rejections_per_second, e.seconds, e.rule))]


def verdict(f: Facts, cascade: list[Callable[[Facts], bool]]) -> bool:
    """True if the base rule and every rule of the cascade pass; stops at the first rejection."""
    return not f.base_failed and not any(rule(f) for rule in cascade)


def judge(docs: DataFrame, rules: dict[str, Callable[[Facts], bool]] = RULES, *, id_col: str = "doc_id", text_col: str = "text", **sampling) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed`` and ``kept``.

    A map without a shuffle; a task holds a few hundred texts at once.
    """
    names = order(estimate(docs, rules, id_col=id_col, text_col=text_col, **sampling))
    out = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [rules[x] for x in names]
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                f = Facts(text)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, verdict(f, cascade)))
            yield record_batch([batch.column(0), *(list(x) for x in zip(*rows))], schema)

    return binary_texts(docs, id_col, text_col).mapInArrow(apply, out)


def keep(docs: DataFrame, rules: dict[str, Callable[[Facts], bool]] = RULES, *, text_col: str = "text", **sampling) -> DataFrame:
    """The rows of ``docs``, all columns, that the cascade keeps; no join and no shuffle."""
    rules = BASE | rules
    names = order(estimate(docs, rules, id_col=text_col, text_col=text_col, **sampling))
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [rules[x] for x in names]
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not any(rule(f) for rule in cascade) for f in map(Facts, texts)], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)
