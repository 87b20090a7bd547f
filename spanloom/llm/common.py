"""Helpers shared by the training-data operators.

Inputs are always narrowed by position to the columns an operator needs, so extra columns,
also ones whose names clash with an output or differ only in case, never reach its plan.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step holds; a longer document forms a step of its own.
SLICE_BYTES = 2 << 20


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns by exact name and position: ``pick(df, out_name="column")``."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{names.index(src)}").alias(out) for out, src in wanted.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to all cores when the files split into fewer tasks than half of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset
    a session on one machine (as in tests) gets a temporary folder; on a cluster each node would
    write into a folder of its own, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """The intermediate tables of one operator in the shared folder. ``stage`` cuts lineage: it
    writes a frame and reads it back, so that a lost executor costs a reread and never the whole
    history. ``free`` deletes tables that nothing reads any more; what a lazy result still reads
    stays until ``free_all``, which is called on frames that were written out in the meantime."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, shared_path(spark, name), 0
        self._paths: list[tuple[DataFrame, str]] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}-{name}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((back, path))
        return back

    def free(self, *frames: DataFrame) -> None:
        """Delete what these frames, given as ``stage`` returned them, were read from."""
        gone = [path for frame, path in self._paths if any(frame is f for f in frames)]
        self._paths = [x for x in self._paths if x[1] not in gone]
        discard(self.spark, *gone)

    def free_all(self, *but: DataFrame) -> None:
        self.free(*[frame for frame, _ in self._paths if not any(frame is b for b in but)])


def staged(df: DataFrame, name: str) -> DataFrame:
    """One table staged by itself; its reader decides how long it stays."""
    return Scratch(df.sparkSession, name).stage(df, name)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared file system that no later read needs."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row: a generator of one value, which the
    optimizer does not unfold into the expressions that use it (inside a lambda these would
    compute it again for each element)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def give_back() -> None:
    """Return freed memory to the system: idle workers stay, and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes in one column."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    start = 0
    for stop in [*edges.tolist(), batch.num_rows]:
        if stop > start:
            yield batch.slice(start, stop - start)
        start = stop


def map_slices(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict], text: int = 1, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over bounded slices; ``fn`` gives the output columns of a slice by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                out = fn(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in out.values()], names=list(out))
            give_back()

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text ``keep`` marks, with all their columns (named by position inside)."""
    names = df.columns
    at = names.index(text_col)
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(keep(full_texts(part.column(at)))))
            give_back()

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def full_texts(column: pa.Array) -> pa.Array:
    """Null texts as empty ones, in one contiguous string array."""
    return pc.fill_null(column, "").cast(pa.large_string())
