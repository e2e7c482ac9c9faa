"""Helpers to run Arrow batches through Python inside Spark tasks.

Everything here works on one batch at a time, so a task holds one batch of rows and never a
partition or a group.  ``append_columns`` keeps the rows, their order and every column of the
input and adds computed ones; a computed column replaces an input column of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ship

#: Rows of a batch are worked on in slices of about this many characters.
SLICE_CHARS = 4_000_000
#: A batch becomes Python objects so many rows at a time.
SLICE_ROWS = 256
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Sends the package to the executors and keeps Arrow batches of long texts small.

    A batch size that the session has set itself stays.
    """
    ship(spark)
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(BATCH_BYTES, "8MB")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly where it has fewer partitions than the cluster has cores.

    A file of one row group is read by one task, however many cores wait for its texts.  A partition of
    a scan is of bounded size, so what is shuffled here is too; larger inputs are left as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(texts: Sequence[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` characters each (one row at least)."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from ``columns`` in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column without nulls, as views of one array."""
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []


def nested(column: pa.ListArray) -> list[list[np.ndarray]]:
    """The rows of a column of lists of lists without nulls, as lists of views of one array."""
    inner, out, at = lists(column.flatten()), [], 0
    for n in column.value_lengths().to_pylist():
        out.append(inner[at : at + n])
        at += n
    return out


def record_batch(schema: T.StructType, columns: dict) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    work: Callable[..., list],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` columns of ``df`` (default: all) plus the columns that ``work`` makes.

    ``work`` gets one Python list for each column in ``inputs`` and returns one list for each of
    ``fields``.  It must not depend on how the rows are cut into batches.
    """
    made = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    args = fresh(kept, *[f"in{i}" for i in range(len(inputs))])
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(a) for c, a in zip(inputs, args, strict=True)])
    types = {f.name: f.dataType for f in source.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in kept] + list(fields))
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                columns = work(*[part.column(n_kept + i).to_pylist() for i in range(len(args))])
                arrays = [pa.array(v, type=out.field(n_kept + i).type) for i, v in enumerate(columns)]
                front = [c if c.type == out.field(i).type else c.cast(out.field(i).type) for i, c in enumerate(part.columns[:n_kept])]
                yield pa.RecordBatch.from_arrays(front + arrays, schema=out)

    return source.mapInArrow(run, schema)


def explode_columns(
    df: DataFrame,
    inputs: Sequence[str],
    schema: T.StructType,
    work: Callable[..., Iterator[dict]],
) -> DataFrame:
    """Rows that ``work`` makes of a batch.  It yields dicts of equally long arrays or lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for columns in work(*[part.column(i).to_pylist() for i in range(len(inputs))]):
                    yield record_batch(schema, columns)

    return df.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(inputs)]).mapInArrow(run, schema)
