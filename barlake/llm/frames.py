"""Small helpers shared by the operators: scratch tables and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from barlake.shipping import ship


#: Most bytes of an Arrow batch, but for a single longer row.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder; on a
    cluster it would be of one machine, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="barlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Tables written to the shared folder, so that later steps neither recompute them nor need the executors that made them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete ``tables`` (as returned by ``write``): nothing may read them any more."""
        for path in (self._paths.pop(id(t), None) for t in tables):
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Before Python functions on texts: bound the Arrow batches by rows and by bytes (long texts make large rows), and hand
    out the package. The bounds stay set in the session, as plans read them when they run."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
