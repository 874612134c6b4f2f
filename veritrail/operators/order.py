"""Numbers of rows in one order over all of them, and pages of it, without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritrail.sources.staging import staged

#: monotonically_increasing_id() has the task above these bits, and the row's place in it below.
BITS = 33


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """The rows with their number from 1 in ascending order (nulls first) of these columns, which tell all rows apart. Each of many tasks sorts a range; the numbers of rows in the ranges before it are added. The rows are written first, since they are read for the ranges and again for the order."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df, "unordered").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    held = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    task = F.shiftright("_at", BITS)
    before, at = [], 0
    for part, n in sorted((x["part"], x["n"]) for x in held.groupBy(task.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each task
        before.append(F.when(task == part, F.lit(at)))
        at += n
    first = F.coalesce(*before) if before else F.lit(0)
    return held.withColumn(name, (first + F.col("_at").bitwiseAND((1 << BITS) - 1) + 1).cast("long")).drop("_at")


def numbered_within(df: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """The rows with their number from 1 within their group, which many tasks may share."""
    held = staged(numbered(df, [group, *order], name), "numbered")
    first = held.groupBy(group).agg(F.min(name).alias("_first"))
    own = held.withColumnRenamed(group, "_group")
    return own.join(first, own["_group"].eqNullSafe(first[group])).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_group", "_first").select(df.columns + [name])


def page(df: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The first size rows in ascending order of these columns (none of them null), or those that come after a row with these values: the last one's of the page before."""
    if after is not None:
        beyond: Column = F.lit(False)
        for name, value in reversed(list(zip(order, after, strict=True))):
            beyond = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & beyond)
        df = df.where(beyond)
    return df.orderBy(*order).limit(size)
