"""The folder that all machines of a session share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

from gridwright.errors import GridError


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, or ``spark.checkpoint.dir``, which becomes it.

    Where neither is set, a session on one machine (tests) gets a temporary
    folder; on a cluster that is an error, since no machine sees another's.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[[^\]]*\])?$", context.master):
            raise GridError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="gridwright-"))
    return context.getCheckpointDir().rstrip("/")
