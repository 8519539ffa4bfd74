"""Tables replayed as streams, and streams drained into a shared table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.session import fresh_path
from gridspark.streaming.assemble import ROCKSDB

# State lives in RocksDB; a drained replay needs no batches without data (an expiry
# time would otherwise ask for one after another).
REPLAY_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name.parquet`` of ``folder`` (file or directory) as a stream."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    files = table.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        # a stream reads folders only
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all data at hand into parquet in shared storage, and read that back."""
    spark = stream.sparkSession
    out, marks = fresh_path(spark, label), fresh_path(spark, f"{label}-progress")
    before = {key: spark.conf.get(key, None) for key in REPLAY_CONF}
    for key, value in REPLAY_CONF.items():
        spark.conf.set(key, value)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", marks)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(out)
