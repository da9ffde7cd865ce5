"""Tables that cut lineage: written once to the folder that all executors share, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of this machine; on a cluster, whose machines share none, that
    raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed now and read back from Parquet in the shared folder. A lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing needs any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent())


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; call it when no result that was built on them is needed."""
    _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)))
