"""State between micro-batches, as a small versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class BatchState:
    """A table per batch under a shared folder.

    Batch *n* reads what batch *n - 1* wrote and overwrites its own version, so
    a batch that runs again after a failure finds the same input and gives the
    same output. Versions older than the last ``keep`` batches are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 5):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep

    def _version(self, batch_id: int) -> str:
        return f"{self.path}/version={batch_id}"

    def before(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._version(batch_id - 1))

    def write(self, df: DataFrame, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._version(batch_id))
        self._forget(batch_id - self.keep)
        return self.at(batch_id)

    def _forget(self, batch_id: int) -> None:
        """Delete a version; earlier ones went when later batches were written."""
        if batch_id < 0:
            return
        jvm = self.spark._jvm
        old = jvm.org.apache.hadoop.fs.Path(self._version(batch_id))
        old.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    def at(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._version(batch_id))
