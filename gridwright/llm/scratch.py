"""Tables written between jobs, in the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    Where neither is set, a session on one machine (tests) gets a temporary
    folder; on a cluster that is an error, since no machine sees another's.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridwright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables of one operator run; lineage ends at each of them.

    An executor's loss doesn't lose a table: it is a file set in the shared
    folder.  Tables that later results read must stay; :meth:`drop` removes
    those that only one step needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.mode("overwrite").parquet(path)
        again = self.spark.read.schema(df.schema).parquet(path)
        again._scratch_path = path
        return again

    def drop(self, df: DataFrame) -> None:
        """Remove a table that :meth:`cut` returned and nothing will read again."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
