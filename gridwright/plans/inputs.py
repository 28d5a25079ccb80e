"""The driver's tables as grids, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.operators import complexes
from gridwright.operators.grid import Grid
from gridwright.sources import tables

WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the embedding image; Parquet's row counts answer it without reading a column."""
    return table(spark, sf_dir, "embeddings").count()


def emb(spark: SparkSession, sf_dir: str) -> Grid:
    """Embeddings as an image of doubles: x the element, y the row."""
    return tables.from_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDTH, height(spark, sf_dir), lambda e: e.cast("double"))


def embq(spark: SparkSession, sf_dir: str) -> Grid:
    """The same in whole thousandths."""
    return tables.from_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDTH, height(spark, sf_dir), lambda e: F.floor(e.cast("double") * 1000).cast("bigint"))


def emb_pairs(spark: SparkSession, sf_dir: str) -> Grid:
    """Complex values: elements 2x and 2x + 1 of each row."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("y"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(WIDTH // 2 - 1)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("re"), F.get("embedding", 2 * i + 1).cast("double").alias("im")))).alias("x", "c"))
    return Grid(df.select(F.col("x").cast("bigint").alias("x"), "y", complexes.make(F.col("c.re"), F.col("c.im")).alias("v")), (WIDTH // 2, height(spark, sf_dir)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id`` and the first and second half of each embedding in whole thousandths."""
    whole = F.transform("embedding", lambda e: F.floor(e.cast("double") * 1000).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice(whole, 1, 32).alias("a"), F.slice(whole, 33, 32).alias("b"))


def hours(spark: SparkSession, sf_dir: str) -> Grid:
    """Events by hour, day of the month and month: a sparse table made dense."""
    counts = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y"), (F.month("ts") - 1).alias("z")).agg(F.count("*").alias("v"))
    return tables.from_sparse(counts, (24, 31, 12), 0)


def shipped(spark: SparkSession, sf_dir: str) -> Grid:
    """Quantities by line number (7), month (12) and year (7 from 1995)."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("x"), (F.month("l_shipdate") - 1).alias("y"), (F.year("l_shipdate") - 1995).alias("z")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("v"))
    return tables.from_sparse(rows.where("x between 0 and 6 and z between 0 and 6"), (7, 12, 7), 0)


# the same grids as common table expressions

IMAGE = "img AS (SELECT CAST(i - 1 AS BIGINT) AS x, CAST(e.vec_id AS BIGINT) AS y, CAST(floor(CAST(e.embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings e, range(1, 65) t(i))"
DOUBLES = "img AS (SELECT CAST(i - 1 AS BIGINT) AS x, CAST(e.vec_id AS BIGINT) AS y, CAST(e.embedding[i] AS DOUBLE) AS v FROM embeddings e, range(1, 65) t(i))"
PAIRS = "img AS (SELECT CAST(i AS BIGINT) AS x, CAST(e.vec_id AS BIGINT) AS y, CAST(e.embedding[2 * i + 1] AS DOUBLE) AS re, CAST(e.embedding[2 * i + 2] AS DOUBLE) AS im FROM embeddings e, range(0, 32) t(i))"
COUNT = "n AS (SELECT count(*) AS n FROM embeddings)"
VECTORS = "vec AS (SELECT vec_id, [CAST(floor(CAST(e AS DOUBLE) * 1000) AS BIGINT) for e in embedding[1:32]] AS a, [CAST(floor(CAST(e AS DOUBLE) * 1000) AS BIGINT) for e in embedding[33:64]] AS b FROM embeddings)"
HOURS = "ev AS (SELECT hour(ts) AS x, day(ts) - 1 AS y, month(ts) - 1 AS z, count(*) AS v FROM events GROUP BY ALL), img AS (SELECT a.x, b.y, c.z, CAST(coalesce(v, 0) AS BIGINT) AS v FROM range(24) a(x) CROSS JOIN range(31) b(y) CROSS JOIN range(12) c(z) LEFT JOIN ev USING (x, y, z))"
SHIPPED = "li AS (SELECT l_linenumber - 1 AS x, month(l_shipdate) - 1 AS y, year(l_shipdate) - 1995 AS z, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL), img AS (SELECT a.x, b.y, c.z, CAST(coalesce(v, 0) AS BIGINT) AS v FROM range(7) a(x) CROSS JOIN range(12) b(y) CROSS JOIN range(7) c(z) LEFT JOIN li USING (x, y, z))"
