"""Bounded runs of streams over what is there now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlog.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful pandas processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into parquet and read it back."""
    spark = stream.sparkSession
    output = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(output)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str) -> None:
    """Process all available input through a ``foreachBatch`` function."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", scratch_path(stream.sparkSession, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
