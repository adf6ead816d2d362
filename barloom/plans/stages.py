"""Stage tables: a stage that several others read is written once, as Parquet, and read back.

This cuts lineage, so a lost executor costs a re-read instead of a recomputation of every stage before
it, and lets each reader scan only the columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a session on one machine may go without and then gets its own."""
    configured = spark.sparkContext.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='barloom-')}"


class StageStore:
    """Stage tables of one run under one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = f"{folder or shared_folder(spark)}/run-{uuid.uuid4().hex[:12]}"
        self._written: dict[str, str] = {}

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, built and written on first use."""
        if name not in self._written:
            path = f"{self.folder}/{name}"
            build().write.mode("errorifexists").parquet(path)
            self._written[name] = path
        return self.spark.read.parquet(self._written[name])
