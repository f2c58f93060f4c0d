"""Numbering and neighbours in sorted groups of any size.

A window over a group puts the whole group into one task; a repository or language may hold a third of all
rows. Here rows are range-partitioned and sorted, numbered within their partition, and shifted by the counts
of the partitions before: a table of at most partitions times groups rows. The sorted rows are checkpointed,
because the two passes must see the same partitions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut


def ranked(df: DataFrame, groups: list[str], order: list[str], neighbours: dict[str, str] | None = None) -> DataFrame:
    """``df`` with n, from 1 within each group in the order given, which must be total.

    ``neighbours`` names columns whose values in the row before and after are added as prev_<name> and
    next_<name>: {name: column}. Null group keys are a group.
    """
    near = neighbours or {}
    placed = cut(df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *groups).orderBy(*order)
    key = F.struct(*order)
    heads = placed.groupBy("_part", *groups).agg(F.count("*").alias("_rows"), *(f(c, key).alias(f"_{w}_{k}") for k, c in near.items() for w, f in (("first", F.min_by), ("last", F.max_by))))
    across = Window.partitionBy(*groups).orderBy("_part")
    heads = heads.select(
        F.col("_part").alias("_at"),
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)),
        "_rows",
        F.coalesce(F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        *(F.lag(f"_last_{k}").over(across).alias(f"_prev_{k}") for k in near),
        *(F.lead(f"_first_{k}").over(across).alias(f"_next_{k}") for k in near),
    )
    rows = placed.withColumns({"_k": F.row_number().over(inside), **{f"_lag_{k}": F.lag(c).over(inside) for k, c in near.items()}, **{f"_lead_{k}": F.lead(c).over(inside) for k, c in near.items()}})
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)), F.col("_part") == F.col("_at"))
    both = rows.join(heads, same)
    return both.select(
        *df.columns,
        (F.col("_k") + F.col("_before")).cast("bigint").alias("n"),
        *(F.when(F.col("_k") == 1, F.col(f"_prev_{k}")).otherwise(F.col(f"_lag_{k}")).alias(f"prev_{k}") for k in near),
        *(F.when(F.col("_k") == F.col("_rows"), F.col(f"_next_{k}")).otherwise(F.col(f"_lead_{k}")).alias(f"next_{k}") for k in near),
    )
