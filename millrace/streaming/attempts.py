"""Streaming forms: results appended as they come, each key once, with a running quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_results(stream: DataFrame, path: str, checkpoint: str, key: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of results to a table, each key's first row only: a batch is reduced to one row a key and
    anti-joined with what the table has. A replayed batch adds nothing twice, since its keys are there already."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        rest = [c for c in df.columns if c != key]
        first = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_w")).select(key, "_w.*")
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            first = first.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti")
        first.write.mode("append").parquet(path)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def counts_by_window(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Results by event-time window; later rows than ``late`` are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
