"""What the operators of this subpackage share: deliveries of files, and one result a file."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_rows
from corpusmill.operators import files as K


def deliveries(files: DataFrame) -> DataFrame:
    """``files`` with the delivery of each row: its times, null where the input has none."""
    times = [(F.unix_micros(F.col(c).cast("timestamp")) if c in files.columns else F.lit(None).cast("bigint")).alias(c) for c in ("ingested_at", "collected_at")]
    return files.withColumn("delivery", F.struct(*times))


def per_file(files: DataFrame, columns: Sequence[str], kernel: Callable[..., Sequence[list]], schema: str, key: str = "file_id") -> DataFrame:
    """(file_id, what the kernel gives): one result a file, that of its latest delivery; only results are shuffled. Rows without key give none."""
    keyed = deliveries(files).withColumn("file_id", F.col(key)).filter("file_id is not null")
    rows = map_rows(keyed, ["file_id", "delivery"], columns, kernel, schema, costly=True)
    return K.once(rows, *rows.columns[2:])
