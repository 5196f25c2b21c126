"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session may lack the setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lotwright-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a table in the shared folder and return a scan of it.

    This cuts the lineage: a lost executor costs no recomputation of what is
    written, and a task that is tried again reads the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lotwright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    scan = spark.read.schema(df.schema).parquet(path)
    scan._stored_at = path
    return scan


def discard(*stored: DataFrame) -> None:
    """Delete tables that `store` wrote and that nothing reads any more, such as those of a finished round."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
