"""Places and running sums in the order of large groups.

The rows are range-sorted over all partitions, so a group of any size is dealt over many tasks; each partition's totals
are added up, one row for each group and partition, and numbers are given within partitions.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from vexel.shared import cut, stored

#: Rows of the table of starts (one for each group and partition) that are broadcast; more are joined.
MOST_STARTS = 100_000


def running(rows: DataFrame, by: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Adds __place, the number of rows of its group before a row, and __before, the sum of their values (0 without a value column).

    Groups are those of equal `by` columns, nulls included; none: all rows are one group. Rows equal in `order` stand in any
    order, and may stand in several partitions.
    """
    x = F.lit(0).cast("long") if value is None else F.coalesce(F.col(value), F.lit(0))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    parts = stored(tied.repartitionByRange(*by, *order, "__tie").withColumn("__part", F.spark_partition_id()))
    before = W.unboundedPreceding, -1
    zero = lambda c: F.coalesce(c, F.lit(0))
    over = W.partitionBy(*by).orderBy("__part").rowsBetween(*before)
    totals = parts.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"))
    starts = totals.select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__part").alias("__of_part"), zero(F.sum("n").over(over)).alias("__n"), zero(F.sum("s").over(over)).alias("__s"))
    inside = W.partitionBy("__part", *by).orderBy(*order, "__tie")
    numbered = parts.withColumn("__i", F.row_number().over(inside) - 1).withColumn("__sum", zero(F.sum(x).over(inside.rowsBetween(*before))))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], F.col("__part") == F.col("__of_part"))
    starts = cut(starts)
    out = numbered.join(F.broadcast(starts) if starts.count() <= MOST_STARTS else starts, same)
    return out.select(*rows.columns, (F.col("__n") + F.col("__i")).alias("__place"), (F.col("__s") + F.col("__sum")).alias("__before"))
