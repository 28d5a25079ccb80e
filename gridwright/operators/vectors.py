"""Functions of array columns: vectors and matrices, element by element and as wholes.

Comparisons are by components: ``less`` holds if it holds for each, so neither
of two vectors may be less.
"""

from __future__ import annotations

from functools import reduce as fold_

from pyspark.sql import functions as F

Column = F.Column


def _pairwise(f):
    return lambda a, b: F.zip_with(a, b, f)


def _each(f):
    return lambda a: F.transform(a, f)


add = _pairwise(lambda p, q: p + q)
subtract = _pairwise(lambda p, q: p - q)
product = _pairwise(lambda p, q: p * q)
maximum = _pairwise(lambda p, q: F.greatest(p, q))
minimum = _pairwise(lambda p, q: F.least(p, q))
modulo = _pairwise(lambda p, q: p % q)
modulo_periodic = _pairwise(F.pmod)
negated = _each(lambda p: -p)
absolute = _each(F.abs)
rounded = _each(lambda p: F.round(p))
ceiled = _each(lambda p: F.ceil(p))
floored = _each(lambda p: F.floor(p))
squared = _each(lambda p: p * p)
cubed = _each(lambda p: p * p * p)
signum = _each(lambda p: F.signum(p).cast("bigint"))


def divide(a: Column, b: Column, whole: bool = True) -> Column:
    """Quotients; of whole numbers truncated toward zero."""
    if whole:
        return F.zip_with(a, b, lambda p, q: ((p - p % q) / q).cast("bigint"))
    return F.zip_with(a, b, lambda p, q: p / q)


def scaled(a: Column, factor) -> Column:
    return F.transform(a, lambda p: p * factor)


def over(a: Column, divisor) -> Column:
    return F.transform(a, lambda p: p / divisor)


def repeated(value, n: int) -> Column:
    return F.array_repeat(F.lit(value), n)


def power(a: Column, n: int) -> Column:
    """Whole exponents, by repeated products."""
    return F.transform(a, lambda p: fold_(lambda x, _: x * p, range(n), F.lit(1)))


def clamp(a: Column, low: Column, high: Column) -> Column:
    return minimum(maximum(a, low), high)


def _all(f):
    return lambda a, b: F.forall(F.zip_with(a, b, f), lambda t: t)


equal = _all(lambda p, q: p == q)
less = _all(lambda p, q: p < q)
less_equal = _all(lambda p, q: p <= q)
greater = _all(lambda p, q: p > q)
greater_equal = _all(lambda p, q: p >= q)


def total(a: Column, zero=0) -> Column:
    start = F.lit(zero).cast("bigint") if isinstance(zero, int) else F.lit(zero)
    return F.aggregate(a, start, lambda s, p: s + p)


def dot(a: Column, b: Column, zero=0) -> Column:
    return total(product(a, b), zero)


def element_product(a: Column, one=1) -> Column:
    start = F.lit(one).cast("bigint") if isinstance(one, int) else F.lit(one)
    return F.aggregate(a, start, lambda s, p: s * p)


min_element = F.array_min
max_element = F.array_max


def find(a: Column, value) -> Column:
    """First place of a value, -1 if it isn't there."""
    return F.array_position(a, value) - 1


def min_element_above(a: Column, limit, otherwise) -> Column:
    """Smallest element over the limit."""
    return F.coalesce(F.array_min(F.filter(a, lambda p: p > limit)), F.lit(otherwise))


def max_element_below(a: Column, limit, otherwise) -> Column:
    return F.coalesce(F.array_max(F.filter(a, lambda p: p < limit)), F.lit(otherwise))


def squared_norm(a: Column) -> Column:
    return total(squared(a), 0.0)


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def normalize(a: Column) -> Column:
    """Over the norm; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda p: F.when(n == 0, p).otherwise(p / F.when(n == 0, 1.0).otherwise(n)))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def insert_dimension(a: Column, at: int, value) -> Column:
    return F.concat(F.slice(a, 1, at), F.array(F.lit(value)), F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0))))


def remove_dimension(a: Column, at: int) -> Column:
    return F.concat(F.slice(a, 1, at), F.slice(a, at + 2, F.greatest(F.size(a) - at - 1, F.lit(0))))


def swizzle(a: Column, order) -> Column:
    return F.array(*(a[i] for i in order))


def replaced(a: Column, at: int, value) -> Column:
    return F.transform(a, lambda p, i: F.when(i == at, F.lit(value)).otherwise(p))


# matrices: arrays of rows


def entry(m: Column, row: int, column: int) -> Column:
    return m[row][column]


def row(m: Column, i: int) -> Column:
    return m[i]


def column(m: Column, j: int) -> Column:
    return F.transform(m, lambda r: r[j])


def trace(m: Column, n: int) -> Column:
    return fold_(lambda a, b: a + b, (m[i][i] for i in range(n)))


def matrix_vector(m: Column, v: Column, zero=0) -> Column:
    return F.transform(m, lambda r: dot(r, v, zero))


def matrix_product(a: Column, b: Column, columns: int, zero=0) -> Column:
    return F.transform(a, lambda r: F.array(*(dot(r, column(b, j), zero) for j in range(columns))))


def tuple_less(a: Column, b: Column) -> Column:
    """Lexicographic order of structs."""
    return a < b
