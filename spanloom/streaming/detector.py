"""Streaming: detection over files as they arrive, and appends that survive restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect


def detect_stream(spark: SparkSession, source: str, schema: str, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 16) -> DataFrame:
    """Spans of the documents in each new Parquet file. Detection keeps no state, so no
    watermark is needed and a late file is as good as an early one."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return detect(rows, id_col=id_col, text_col=text_col)


#: Folders that keys are dealt to; a batch reads only those that its keys fall in.
KEY_FOLDERS = 64


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str, folders: int = KEY_FOLDERS) -> StreamingQuery:
    """Process what is there and stop. Each batch appends the keys that the sink doesn't hold,
    so a batch that is replayed after a failure adds nothing twice: what an attempt of the same
    batch left is not counted as held, and is overwritten. The sink is laid out by a hash of the
    key, and a batch reads, of the keys only, the folders that its own keys fall in."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        out = rows.dropDuplicates([key]).withColumn("part", F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")).withColumn("batch", F.lit(number))
        parts = [r["part"] for r in out.select("part").distinct().collect()]  # at most ``folders``
        if _exists(spark, path):
            earlier = spark.read.schema(out.schema).parquet(path).where(F.col("part").isin(parts) & (F.col("batch") < number))
            out = out.join(earlier.select(key), key, "left_anti")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
