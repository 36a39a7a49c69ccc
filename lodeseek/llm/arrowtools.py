"""Small helpers for operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z, leaving every other byte (so all of UTF-8) as it is.
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: As LOWER_AZ, with every ASCII character other than letters and digits turned into a space.
LOWER_ALNUM = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else (b if b >= 128 else 32) for b in range(256)
)


def limit_batches(spark: SparkSession, rows: int = 2000, mebibytes: int = 16) -> None:
    """Whole texts can be long, so fewer of them, and fewer bytes, go into one Arrow batch than Spark's default; a longer text is
    a batch of its own."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mebibytes}m")


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str
) -> DataFrame:
    """mapInArrow with a function of one batch; a dict of columns is turned into a batch of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    limit_batches(df.sparkSession)
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema
                )
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null as empty."""
    return [b"" if v is None else v for v in batch.column(column).cast(pa.large_binary()).to_pylist()]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
