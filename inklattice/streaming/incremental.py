"""Incremental scan: new files of entities or documents replace what is stored of their documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inklattice.operators.spatial import use_checkpoints
from inklattice.sources.sinks import replace_partitions


def scan_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, key: str = "document_hash", buckets: int = 64) -> StreamingQuery:
    """Each micro-batch deletes by document and inserts.  A batch that is run again gives the same table.

    All documents of a batch lose their old rows, also those of which nothing new comes.  Old rows that stay are
    written to the folder that driver and executors share before their partitions are replaced, so a lost executor loses nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        touched = batch.select(key).distinct()
        new = transform(batch)
        held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        fs = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(held):
            use_checkpoints(spark)
            buckets_of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
            old = spark.read.parquet(target).join(touched.select(buckets_of).distinct(), "bucket", "left_semi")
            old = old.drop("bucket").join(touched, key, "left_anti").select(*new.columns)
            # Old and new rows are written before a partition is replaced; buckets left without rows are emptied by hand.
            new = old.unionByName(new).checkpoint()
            kept = {r.bucket for r in new.select(buckets_of).distinct().collect()}
            for r in touched.select(buckets_of).distinct().collect():  # one number for each bucket at most
                if r.bucket not in kept:
                    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket={r.bucket}"), True)
        replace_partitions(new, target, buckets, key)

    return spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
