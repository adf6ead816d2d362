"""Tables written between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that Spark hands to a Python worker at a time, unless the session asks for less.  10,000 texts of a few
#: kilobytes would be held whole, and in buffers of twice their size, by the JVM and by the worker of every running task.
MOST_BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Only a single-machine session may go without one and then gets its own."""
    found = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='barloom-llm-')}"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to MOST_BATCH_BYTES; a smaller one stays.  Rows and results are the same."""
    have = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get(BATCH_SETTING, "64m").strip().lower())
    limit = int(have[1]) << 10 * " kmgtp".index(have[2] or " ") if have else 0
    if not 0 < limit <= MOST_BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(MOST_BATCH_BYTES))


class Workspace:
    """A fresh folder of step tables.  A step table cuts lineage: what is lost is read again, not computed again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def store(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a step table of this workspace that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish
