"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session's ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, since executors share no local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/saltmarsh-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before; it goes when the session ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    What reads it later starts from the files, so a lost executor costs the
    tasks that it ran and none of the work before the write.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def fresh(name: str, columns) -> str:
    """``name``, with underscores after it as long as one of ``columns`` is called so, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        where, fs = _path(df.sparkSession, path)
        fs.delete(where, True)
