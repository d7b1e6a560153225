"""Places of rows in a whole order, without bringing all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweir.operators.graph import shared_dir

#: Rows that a partition may number: what monotonically_increasing_id() leaves room for.
ROOM = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], name: str = "place", start: int = 1) -> DataFrame:
    """df in the given order with each row's place in it, from start.

    Rows are dealt into ranges of the order, which are sorted and cut; a count of each
    range's rows, added up before it, is where its places begin. The driver sees one
    number a range. Equal rows may change places, so the order should end in a key.
    """
    spark = df.sparkSession
    shared_dir(spark)
    # A checkpoint keeps partitions and their order.
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    part = F.spark_partition_id()
    counts = {r["p"]: r["n"] for r in ranges.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    size = max(counts, default=-1) + 1
    before = list(accumulate((counts.get(i, 0) for i in range(size)), initial=start))[:size]
    offsets = spark.createDataFrame([(i, x) for i, x in enumerate(before)], "__part int, __before long")
    here = ranges.withColumns({"__at": F.monotonically_increasing_id().bitwiseAND(F.lit(ROOM)), "__own": part})
    return here.join(F.broadcast(offsets), F.col("__own") == F.col("__part")).withColumn(name, F.col("__before") + F.col("__at")).drop("__at", "__own", "__part", "__before")
