"""Cutting lineage through the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: By application and setting: the folder that its tables are written to.
_OWN: dict[tuple[str, str | None], str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder below the one named in spark.checkpoint.dir; where that is unset below a temporary one, on a local master only.

    It is deleted with all that stored() wrote there when the driver's JVM ends.
    """
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    own = context.applicationId, there
    if own not in _OWN:
        if not there:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            there = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{there.rstrip('/')}/meridia-{own[0]}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN[own] = path.toString()
    return _OWN[own]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    path = f"{scratch(df.sparkSession)}/meridia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles and sorts its sides. Spark broadcasts a table by the size of its files, and a few MB of them can be a million rows and more."""
    return df.hint("merge")


def bounded(df: DataFrame, rows: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """df for a join that broadcasts it when a count shows that it (or `rows`, of which it is made) has `most` rows at most, and shuffles it otherwise."""
    return F.broadcast(df) if (df if rows is None else rows).limit(most + 1).count() <= most else shuffled(df)


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", most: int = 100_000) -> DataFrame:
    """Join that broadcasts the right side only when a count shows that it has `most` rows at most."""
    return left.join(F.broadcast(right) if right.limit(most + 1).count() <= most else right, on, how)
