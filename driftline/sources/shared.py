"""Tables in the folder that driver and executors share: where lineage ends, streams land, and versions are pointed to."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's ``spark.checkpoint.dir``; where that is unset a local master has a folder of its own, and a cluster is an error."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/checkpoints"
    return f"{folder.rstrip('/')}/driftline/{conf.get('spark.app.id', 'app')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> bool:
    """Remove all that this session has put in the shared folder; tables that were read from it are gone then."""
    path = shared_path(spark, "x").rsplit("/", 1)[0]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a table's folder; whether it was there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_pointer(spark: SparkSession, path: str, state: dict) -> None:
    """Put ``state`` at ``path`` in one step: written beside it and renamed over it, so readers see the old or the new one.

    The rename is atomic on local and distributed file systems; on an object store it is a copy.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = beside.getFileSystem(conf).create(beside)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, options)


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """What ``write_pointer`` has put there last; None before the first time."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()
