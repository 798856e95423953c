"""Refresh a derived table as new input files arrive.

The batch jobs overwrite their outputs on every run.  The streaming form
keeps that contract without re-reading old files: a streaming aggregation
over the input folder keeps its per-key state in the checkpoint (one row
per key), and each micro-batch overwrites the output with the complete
result through ``foreachBatch``.  With ``availableNow`` the query processes
what has arrived and stops, so it can run from a scheduler.  Lost executors
only re-run tasks; the checkpoint makes each micro-batch exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from supplylens.session import scratch_path


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def refresh_table(spark: SparkSession, source: str, schema: StructType | str,
                  build: Callable[[DataFrame], DataFrame], sink: str,
                  checkpoint: str | None = None, fmt: str = "parquet",
                  sink_fmt: str = "parquet", available_now: bool = True,
                  max_files_per_trigger: int | None = None,
                  rocksdb_state: bool = True) -> StreamingQuery:
    """Start (and with ``available_now`` finish) one refresh of ``sink``.

    ``build`` turns the streaming input into an aggregate; its complete
    result replaces ``sink`` on every micro-batch.  Aggregation state lives
    in RocksDB by default (off-heap, spills to local disk, checkpointed to
    the shared folder), so many keys do not pressure executor heaps.  The
    provider is fixed by a query's first run and stored in its checkpoint.
    """
    if rocksdb_state:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    result = build(reader.load(source))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").format(sink_fmt).save(sink)

    w = (result.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
