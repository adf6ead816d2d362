"""Incremental loading: newly arrived files are merged into a stored table, each exactly once.

The batch poll "what is newer than what I have" becomes a file stream with the available-now trigger:
the stream's checkpoint remembers which files were loaded, and the merge is idempotent, so a batch
that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from barloom.functions.clock import with_year
from barloom.operators.cleaning import clean
from barloom.sources.tables import upsert


def load_new_bars(
    spark: SparkSession, incoming: str, schema: T.StructType, table: str, checkpoint: str,
    keys: Sequence[str] = ("symbol", "timeframe", "open_time"),
) -> None:
    """Clean and merge all files that arrived under ``incoming`` since the last call."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(spark, with_year(clean(batch, "ohlcv")), table, list(keys))

    query = (
        spark.readStream.schema(schema).parquet(incoming)
        .writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
