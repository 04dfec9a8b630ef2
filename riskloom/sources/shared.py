"""Tables in the folder that all executors share, for iterative plans, and shuffles into tasks of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or in local mode a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/riskloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str, mb: float = 6) -> DataFrame:
    """df hashed by keys into tasks of about ``mb`` MB of the files it is read from; as it is where one task will do.

    Adaptive execution merges shuffle partitions by their compressed size, and up to 64 MB of narrow sorted keys are millions of rows, which take 50
    times that in a task's sorts and hash tables. It leaves a given number of partitions alone.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    n = -(-sum(x for x in sizes if x < 1 << 60) // int(mb * 1e6))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df
