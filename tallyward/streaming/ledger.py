"""The review budget that a stream has spent, as a ledger of small deltas.

Every batch writes how many reviews it granted per event day, one folder per batch, after its decisions: the folder's
commit mark says that both are complete. Every ``fold_every`` batches the deltas since the last fold are added to it in
a new folder, so what a batch reads does not grow with the stream: one fold and fewer than twice ``fold_every``
deltas. Only batches before the asking one count, so a retried batch finds what it found the first time and writes the
same again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPENT = "day bigint, used bigint"


def numbered_folders(spark: SparkSession, path: str, prefix: str, *, committed: bool = False) -> list[int]:
    """Numbers of the folders ``prefix=N`` under ``path``, without opening any data file.

    ``committed`` leaves out folders without the mark that Spark sets when a write is complete.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    found = []
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{prefix}="):
            mark = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if not committed or system.exists(mark):
                found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def drop_folder(spark: SparkSession, path: str) -> None:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


@dataclass(frozen=True)
class BudgetLedger:
    """Folders ``delta/batch_id=N`` and ``fold/upto=N`` under ``root``, which every executor must reach."""

    root: str
    fold_every: int = 20

    def pieces(self, spark: SparkSession, batch_id: int) -> list[str]:
        """The folders that together hold all batches before ``batch_id``."""
        folds = [n for n in numbered_folders(spark, f"{self.root}/fold", "upto", committed=True) if n < batch_id]
        last = max(folds, default=-1)
        deltas = numbered_folders(spark, f"{self.root}/delta", "batch_id", committed=True)
        paths = [f"{self.root}/fold/upto={last}"] if folds else []
        return paths + [f"{self.root}/delta/batch_id={n}" for n in deltas if last < n < batch_id]

    def used(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """(day, used): reviews granted by all batches before ``batch_id``."""
        paths = self.pieces(spark, batch_id)
        if not paths:
            return spark.createDataFrame([], SPENT)
        return spark.read.schema(SPENT).parquet(*paths).groupBy("day").agg(F.sum("used").alias("used"))

    def commit(self, spent: DataFrame, batch_id: int) -> None:
        """Write what ``batch_id`` granted, (day, used); fold when it is time, and drop what two folds cover."""
        spark = spent.sparkSession
        spent.select("day", "used").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/delta/batch_id={batch_id}")
        if (batch_id + 1) % self.fold_every:
            return
        total = self.used(spark, batch_id + 1).coalesce(1)
        total.write.mode("overwrite").parquet(f"{self.root}/fold/upto={batch_id}")
        # The batch may be tried again, so what its own retry reads stays: the fold before this one and all since.
        kept = batch_id - self.fold_every
        for n in numbered_folders(spark, f"{self.root}/delta", "batch_id"):
            if n <= kept:
                drop_folder(spark, f"{self.root}/delta/batch_id={n}")
        for n in numbered_folders(spark, f"{self.root}/fold", "upto"):
            if n < kept:
                drop_folder(spark, f"{self.root}/fold/upto={n}")
