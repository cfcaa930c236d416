"""Tables written once and read back, for loops of joins: they outlive the executors that made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Written:
    """Tables in a folder of their own below ``spark.checkpoint.dir``, which all executors share. Only a local session may lack
    that setting: it gets a temporary folder."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="barlake-")
        self.spark, self.root, self.count = spark, f"{root}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` as read back from disk."""
        self.count += 1
        df.write.parquet(f"{self.root}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.count}")

    def drop(self, number: int) -> None:
        """Delete the table written as ``number`` (from 1): no later plan may read it."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number}")
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
