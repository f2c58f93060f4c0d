"""Arrow-batched column kernels: Python lists in, Python lists out, no per-row crossing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions to keep every core busy with costly kernels.

    Only a scan with fewer partitions than cores is shuffled, which no large one is: there, tasks are the
    scan's own splits (spark.sql.files.maxPartitionBytes). What comes out of a shuffle has the partitions that
    adaptive execution gives it, and asking for their number would run it; it is left alone.
    """
    execution = df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in execution.executedPlan().getClass().getName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(2 * cores)


def map_columns(df: DataFrame, columns: Sequence[str], kernel: Callable[..., Sequence[list]], schema: str | StructType, costly: bool = False) -> DataFrame:
    """Run ``kernel(*column_lists)`` over each Arrow batch of the named columns.

    The kernel returns one list per output column, of any common length. Only the named columns reach
    Python, so names that clash elsewhere in ``df`` do no harm and the scan is pruned to them.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = kernel(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

    narrow = df.select(*columns)
    return (spread(narrow) if costly else narrow).mapInArrow(run, kind)


def map_rows(df: DataFrame, carry: Sequence[str], columns: Sequence[str], kernel: Callable[..., Sequence[list]], schema: str, costly: bool = False) -> DataFrame:
    """One row out for each row in: the ``carry`` columns as they are, then what ``kernel(*column_lists)`` gives.

    The kernel's lists are as long as its input. ``carry`` columns never become Python objects.
    """
    narrow = df.select(*carry, *(c for c in columns if c not in carry))
    given = StructType.fromDDL(schema)
    kind = StructType([*narrow.schema.fields[: len(carry)], *given.fields])
    arrow, own = to_arrow_schema(kind), to_arrow_schema(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = kernel(*(batch.column(c).to_pylist() for c in columns))
            kept = [batch.column(c).cast(arrow.field(c).type) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, type=f.type) for v, f in zip(out, own))], schema=arrow)

    return (spread(narrow) if costly else narrow).mapInArrow(run, kind)
