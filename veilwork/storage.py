"""Intermediate tables in the shared folder of the cluster.

Results that several jobs read are written once as Parquet, which cuts the
lineage, survives lost executors and gives Catalyst real sizes to choose join
strategies from.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folder: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a session whose executors are threads of this process gets
    a temporary folder; others have no machine-local folder that every executor
    can see, so there it is an error.
    """
    global _local_folder
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_SETTING} to a folder all executors can reach")
    _local_folder = _local_folder or tempfile.mkdtemp(prefix="veilwork-")
    return _local_folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/veilwork/{uuid.uuid4().hex}/{label}"


class Workspace:
    """Names the tables that one multi-job operator writes."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)

    def save(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path, compression=compression)
        return self.read(df, name)

    def drop(self) -> None:
        """Delete the folder; frames read from it are of no use any more."""
        spark = self.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def read(self, like: DataFrame, *names: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*[f"{self.root}/{n}" for n in names])
