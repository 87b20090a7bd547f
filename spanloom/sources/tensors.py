"""Headers of tensor files: eight bytes with the length of a JSON header, the header, the data.

Only headers are looked at; tensors are never decoded."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a number of each type that a finished model may hold.
WIDTHS = {"BF16": 2, "F16": 2, "F32": 4}
LARGEST_HEADER = 100_000_000
TENSORS = "path string, tensor string, dtype string, elements long, fault string"


def _tensor(entry, data: int) -> tuple[str | None, int | None, str | None]:
    """(dtype, elements, fault) of a header's entry, with so many bytes of data in the file."""
    try:
        dtype, shape, (start, stop) = entry["dtype"], entry["shape"], entry["data_offsets"]
    except (KeyError, TypeError, ValueError):
        return None, None, "entry"
    if dtype not in WIDTHS:
        return str(dtype), None, "dtype"
    if not isinstance(shape, list) or any(type(d) is not int or d < 0 for d in shape):
        return dtype, None, "shape"
    elements = math.prod(shape)
    right = type(start) is int and type(stop) is int and 0 <= start <= stop <= data and stop - start == elements * WIDTHS[dtype]
    return dtype, elements, None if right else "offsets"


def _header(head: bytes, length: int) -> tuple[dict | None, int]:
    """(header, bytes of data) of a file's first bytes; (None, 0) if they are no header."""
    size = int.from_bytes(head[:8], "little")
    if len(head) < 8 or not 2 <= size <= min(LARGEST_HEADER, length - 8):
        return None, 0
    try:
        found = json.loads(head[8 : 8 + size])
    except ValueError:
        return None, 0
    return (found, length - 8 - size) if isinstance(found, dict) else (None, 0)


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, tensor, dtype, elements, fault) of every tensor of the files below a folder; one
    row with fault 'header' for a file without a readable header. Workers get headers only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.safetensors").load(path)
    # the length of the header is in little-endian bytes: reversed pairs of hex digits
    digits = F.hex(F.substring("content", 1, 8))
    size = F.conv(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(8, 0, -1)]), 16, 10).cast("decimal(20,0)")
    bytes_ = F.least(F.coalesce(size, F.lit(0)), F.lit(LARGEST_HEADER)).cast("int") + 8
    head = F.substring(F.col("content"), F.lit(1), bytes_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, length, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                header, data = _header(first.as_py(), length)
                if header is None:
                    rows.append((name, None, None, None, "header"))
                rows += [(name, k, *_tensor(v, data)) for k, v in (header or {}).items() if k != "__metadata__"]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in TENSORS.split(", ")])

    return files.select("path", "length", head.alias("head")).mapInArrow(run, TENSORS)


def weights(found: DataFrame) -> DataFrame:
    """dtype, tensors, elements, repeated (names that come up again), faults."""
    counted = found.withColumn("uses", F.when(F.col("tensor").isNotNull(), F.lit(1)))
    names = found.where("tensor is not null").groupBy("tensor").agg((F.count("*") - 1).alias("again"), F.first("dtype").alias("dtype"))
    again = names.groupBy("dtype").agg(F.sum("again").alias("repeated"))
    sums = counted.groupBy("dtype").agg(F.count("uses").alias("tensors"), F.coalesce(F.sum("elements"), F.lit(0)).alias("elements"), F.count("fault").alias("faults"))
    return sums.join(again, sums["dtype"].eqNullSafe(again["dtype"]), "left").select(sums["dtype"], "tensors", "elements", F.coalesce("repeated", F.lit(0)).alias("repeated"), "faults")
