"""Written steps of a plan: in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows that are sent to every task; more of them are joined by a shuffle.
MOST_ROWS = 4_000_000


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of `df`, written to the folder that spark.checkpoint.dir names, and read from there.

    Where none is set, a temporary folder serves in local mode (tests); on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


def small(rows: DataFrame) -> DataFrame:
    """`rows`, written down, and marked for broadcast if there are at most MOST_ROWS of them."""
    rows = checkpoint(rows)
    return F.broadcast(rows) if rows.count() <= MOST_ROWS else rows
