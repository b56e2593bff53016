"""Position of each row inside its group, without putting a group in one task.

``row_number().over(Window.partitionBy(g).orderBy(o))`` sends every row of a
group to one task; a group holding a third of the data then runs on one core.
``ordinal_within`` gives the same numbers with a range-partitioned sort:

1. sort globally by ``(group, order)``; the range partitioner splits a large
   group over many partitions;
2. tag each row with its partition and position (``monotonically_increasing_id``
   holds both) and materialise once with a reliable checkpoint, so every later
   read sees the same tags;
3. count rows per ``(partition, group)`` -- at most one row per group and
   partition -- and sum the counts of earlier partitions per group;
4. ordinal = position within the partition - first position of the group in
   that partition + rows of the group in earlier partitions + 1.

The order columns must make the order total (ties would make the numbering
depend on the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.plans.session import ensure_checkpoint_dir

_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1


def ordinal_within(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "ordinal",
                   checkpoint: bool = True, blocks: bool = False) -> DataFrame:
    """Add ``name``: 1-based position of each row in its group by ``order_cols``.

    ``blocks``: the first of ``order_cols`` is a whole number, and rows are
    numbered in blocks of these numbers, without being materialised (``df`` is
    read several times).
    """
    spark = df.sparkSession
    if blocks:
        from repolens.operators.running import Running, Tagged

        return Tagged(df, group_cols, order_cols).running(Running("sum", F.lit(1).cast("bigint"), name)).done()
    ensure_checkpoint_dir(spark)
    keys = [F.col(c) for c in group_cols]
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = (df.repartitionByRange(*keys, *order)
              .sortWithinPartitions(*keys, *order)
              .withColumn("_rid", F.monotonically_increasing_id()))
    if checkpoint:
        tagged = tagged.checkpoint(eager=True)
    tagged = (tagged.withColumn("_pid", F.shiftright("_rid", _POS_BITS))
              .withColumn("_pos", F.col("_rid").bitwiseAND(F.lit(_POS_MASK)))
              .drop("_rid"))
    per_part = tagged.groupBy("_pid", *group_cols).agg(
        F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    cond = [tagged["_pid"] == per_part["_pid"]] + [tagged[c].eqNullSafe(per_part[c]) for c in group_cols]
    joined = tagged.join(per_part, cond).select(
        tagged["*"], (tagged["_pos"] - per_part["_first"] + per_part["_before"] + 1).alias(name))
    return joined.drop("_pid", "_pos")
