"""Grids from tables, array columns and text; tables from grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.errors import GridError
from gridwright.functions.shapes import AXES, coordinate_columns, element_count
from gridwright.operators.grid import Grid


def from_rows(df: DataFrame, row_col: str, array_col: str, width: int, height: int, value=lambda e: e) -> Grid:
    """A grid of a table with an array of ``width`` values per row number ``row_col``.

    Passes along x run on the arrays as they are, without a shuffle.
    """
    cells = df.select(F.col(row_col).cast("bigint").alias("y"), F.posexplode(array_col).alias("x", "e"))
    return Grid(cells.select(F.col("x").cast("bigint").alias("x"), "y", value(F.col("e")).alias("v")), (width, height), lines=df.select(F.col(row_col).cast("bigint").alias("y"), F.transform(array_col, value).alias("line")))


def from_array(spark: SparkSession, values, size: Sequence[int] | None = None, strides: Sequence[int] | None = None) -> Grid:
    """A small array on the driver as a grid: axis x is numpy's last; or flat values with ``size`` and strides."""
    a = np.asarray(values)
    if size is None:
        size, a = tuple(reversed(a.shape)), a.reshape(-1)
    a = a.reshape(-1).tolist()
    step = strides or [element_count(size[:d]) for d in range(len(size))]
    flat = spark.createDataFrame([(a,)], "a array<bigint>" if all(isinstance(x, (int, bool)) for x in a) else "a array<double>")
    rows = spark.range(element_count(size)).crossJoin(F.broadcast(flat))  # one row
    at = coordinate_columns("id", size)
    place = sum((c * s for c, s in zip(at[1:], step[1:])), at[0] * step[0])
    return Grid(rows.select(*(c.alias(d) for c, d in zip(at, AXES)), F.get("a", place.cast("int")).alias("v")), size)


def from_cells(df: DataFrame, size: Sequence[int], value: str = "v") -> Grid:
    """A table with coordinates and a value, dense already."""
    dims = AXES[: len(size)]
    return Grid(df.select(*(F.col(d).cast("bigint").alias(d) for d in dims), F.col(value).alias("v")), size)


def from_sparse(df: DataFrame, size: Sequence[int], fill, value: str = "v") -> Grid:
    """The same of a table that lacks cells: those get ``fill``."""
    dims = AXES[: len(size)]
    have = from_cells(df, size, value).cells
    whole = df.sparkSession.range(element_count(size)).select(*(c.alias(d) for c, d in zip(coordinate_columns("id", size), dims)))
    return Grid(whole.join(have, list(dims), "left").select(*dims, F.coalesce("v", F.lit(fill)).alias("v")), size)


def to_array(g: Grid) -> np.ndarray:
    """A small grid as a numpy array on the driver, x last."""
    from gridwright.functions.shapes import linear_column

    if g.element_count > MOST_ON_DRIVER:
        raise GridError(f"{g.element_count} cells are too many for the driver")
    rows = g.settled().df.select(linear_column(g.size, g.dims).alias("i"), "v").orderBy("i").collect()
    first = rows[0].v if rows else 0
    if hasattr(first, "re"):
        return np.array([complex(r.v.re, r.v.im) for r in rows]).reshape(tuple(reversed(g.size)))
    tail = (len(first),) if isinstance(first, (list, tuple)) else ()
    return np.array([r.v for r in rows]).reshape(*reversed(g.size), *tail)


def iterate(g: Grid):
    """Values in linear order, a partition at a time."""
    from gridwright.functions.shapes import linear_column

    for r in g.settled().df.select(linear_column(g.size, g.dims).alias("i"), "v").orderBy("i").toLocalIterator():
        yield r.v


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Rows of white-space separated numbers, as ``line`` and ``values``, in no order but their file's names."""
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return text.select("line", F.transform(parts, lambda x: x.cast("double")).alias("values")).where(F.size("values") > 0)


MOST_ROWS = 1 << 16
"""Rows of a text table that is read as an array on the driver."""


def read_kernel(spark: SparkSession, path: str) -> np.ndarray:
    """A text table as a small array on the driver (convolution weights, transfer functions)."""
    rows = [r["values"] for r in read_numbers(spark, path).orderBy("line").limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise GridError(f"over {MOST_ROWS} rows of weights")
    if len({len(r) for r in rows}) > 1:
        raise GridError("rows differ in length")
    return np.array(rows)


def written(g: Grid, path: str) -> Grid:
    """Evaluate a grid into Parquet and read it back: the sink, and the end of its lineage."""
    g.cells.write.mode("overwrite").parquet(path)
    return Grid(g.df.sparkSession.read.parquet(path), g.size)


def cached(g: Grid) -> Grid:
    """Evaluate once, keep in memory."""
    return Grid(g.cells.cache(), g.size)


INDEX_BLOCK = 1 << 20
"""Cells of a block of an index."""


class Indexed:
    """A grid written by blocks of its linear index: any cells are read from the blocks that hold them."""

    def __init__(self, spark: SparkSession, path: str, size: Sequence[int], block: int = INDEX_BLOCK):
        self.df, self.size, self.block = spark.read.parquet(path), tuple(size), block

    @staticmethod
    def write(g: Grid, path: str, block: int = INDEX_BLOCK) -> Indexed:
        """A folder for each block; within it cells are sorted, so that a reader skips most of its pages."""
        from gridwright.functions.shapes import linear_column

        rows = g.settled().df.select(linear_column(g.size, g.dims).alias("i"), "v").withColumn("block", F.expr(f"i div {block}"))
        rows.repartition("block").sortWithinPartitions("block", "i").write.mode("overwrite").partitionBy("block").parquet(path)
        return Indexed(g.df.sparkSession, path, g.size, block)

    def between(self, first: int, last: int) -> DataFrame:
        """``i`` and ``v`` of the cells ``first`` to ``last``, that excluded."""
        if not 0 <= first <= last <= element_count(self.size):
            raise GridError(f"{first}..{last} of {element_count(self.size)}")
        here = self.df.where(F.col("block").between(first // self.block, max(first, last - 1) // self.block))
        return here.where((F.col("i") >= first) & (F.col("i") < last)).select("i", "v")

    def at(self, *index: int):
        """The value of one cell."""
        from gridwright.functions.shapes import linear_index

        i = linear_index(index, self.size)
        return self.between(i, i + 1).first().v

    def of(self, rows: DataFrame, column: str = "i") -> DataFrame:
        """``rows`` with ``v`` of the cells whose linear index they hold."""
        asked = rows.withColumn("_block", F.expr(f"`{column}` div {self.block}"))
        held = self.df.select(F.col("i").alias("_i"), "v", F.col("block").cast("bigint").alias("_block"))
        return asked.join(held.withColumnRenamed("_i", "_at"), (F.col("_at") == F.col(column)) & (asked["_block"] == held["_block"])).drop("_block", "_at")


MOST_ON_DRIVER = 1 << 24
"""Cells that may come to the driver as one array."""


def filled(g: Grid, value) -> Grid:
    return g.with_value(F.lit(value))


def cleared(g: Grid) -> Grid:
    return filled(g, 0)
