"""Running sums, maxima and minima inside a group, without putting a group in one task.

Like the ordinal: rows are sorted by range, tagged with partition and position
and materialised once; a running value is the value inside the partition
combined with what the other partitions of the group contribute (one row per
partition and group). One call takes any number of running values; values
that need others are taken by a further call without sorting again.

Where the order begins with a whole number (line numbers, places), ranges of
these numbers are blocks: nothing is sorted or materialised beforehand, a block
of a group is sorted where its running values are taken, and what other
blocks contribute is summed up by partial aggregation. Such rows are read
several times; callers materialise them (``staged``) if that is costly.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.plans.session import ensure_checkpoint_dir

_POS_BITS = 33
#: Blocks of a group for each shuffle partition, share of the rows that their bounds are taken from, rows that a table may have to be broadcast.
BLOCKS, BOUNDS, FEW = 4, 0.02, 100_000
_COMBINE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
_FUNCTION = {"sum": F.sum, "max": F.max, "min": F.min}


class Running(NamedTuple):
    """Sum, max or min (``kind``) of ``value`` from the start of the group (``backwards``: to its end).

    Without ``inclusive`` the row itself is left out; a sum starts with 0, a
    maximum or minimum with null.
    """

    kind: str
    value: Column
    name: str
    backwards: bool = False
    inclusive: bool = True


def staged(df: DataFrame) -> DataFrame:
    """``df`` materialised once as compressed columns in the checkpoint folder (rows in no order)."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._staged = folder
    return out


def forget(*tables: DataFrame) -> None:
    """Remove the files of ``staged`` tables that nothing reads any more.

    The exchanges that led to them are not read either; their files go when the
    driver collects its garbage.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._staged)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    for table in tables[:1]:
        table.sparkSession.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """``df``, a materialised table, broadcast where it has few rows (whatever the size of its files)."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


def _block(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_pid``: ranges of ``order`` with about as many rows each.

    As in Spark's range partitioning a part of the rows tells where ranges
    begin; all rows are in a range, and where it ends changes no result.
    """
    n = BLOCKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n)
    bounds = sorted({float(x) for x in df.select(order).sample(BOUNDS, 1).select(at.alias("at")).first()["at"] or []})
    cut = Bucketizer(splits=[float("-inf"), *(bounds or [0.0]), float("inf")], inputCol="_number", outputCol="_pid")
    return cut.transform(df.withColumn("_number", F.coalesce(F.col(order), F.lit(-(1 << 63))).cast("double"))).withColumn(
        "_pid", F.col("_pid").cast("bigint")).drop("_number")


class Tagged:
    """Rows of ``df`` in the order of ``order`` inside each group; the order must be total."""

    def __init__(self, df: DataFrame, group: list[str], order: list[str]):
        ensure_checkpoint_dir(df.sparkSession)
        self.group = group
        if dict(df.dtypes)[order[0]] == "bigint":
            self.rows, self.order = _block(df, order[0]), order
            return
        keys = [F.col(c) for c in (*group, *order)]
        rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_rid", F.monotonically_increasing_id())
        rows = rows.checkpoint(eager=True)
        self.rows, self.order = rows.withColumn("_pid", F.shiftright("_rid", _POS_BITS)), ["_rid"]

    def inside(self, backwards: bool = False):
        """The window over the rows of a group that stand together."""
        return Window.partitionBy(*self.group, "_pid").orderBy(*[F.desc(c) if backwards else F.asc(c) for c in self.order])

    def running(self, *values: Running) -> "Tagged":
        """Add the running values as columns."""
        totals = [_FUNCTION[v.kind](v.value).alias(f"_all{i}") for i, v in enumerate(values)]
        rows = self.rows.select("*", *[_FUNCTION[v.kind](v.value).over(self.inside(v.backwards).rowsBetween(
            Window.unboundedPreceding, 0 if v.inclusive else -1)).alias(f"_in{i}") for i, v in enumerate(values)])
        names = [f"_g{i}" for i in range(len(self.group))]
        carry = self.rows.groupBy("_pid", *self.group).agg(*totals).select(
            F.col("_pid").alias("_p"), *[F.col(c).alias(n) for c, n in zip(self.group, names)], *[f"_all{i}" for i in range(len(values))])
        for i, v in enumerate(values):
            others = Window.partitionBy(*names).orderBy(F.desc("_p") if v.backwards else F.asc("_p")).rowsBetween(
                Window.unboundedPreceding, -1)
            carry = carry.withColumn(f"_carry{i}", _FUNCTION[v.kind](f"_all{i}").over(others))
        # a group that stands in one place needs nothing from others
        carry = carry.withColumn("_parts", F.count("*").over(Window.partitionBy(*names))).filter("_parts > 1").select(
            "_p", *names, *[f"_carry{i}" for i in range(len(values))]).checkpoint(eager=True)
        same = [F.col("_pid") == F.col("_p")] + [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(self.group, names)]
        out = rows.join(small(carry), same, "left")
        self.rows = out.select(*[out[f"`{c}`"] for c in self.rows.columns], *[
            _COMBINE[v.kind](F.col(f"_in{i}"), F.col(f"_carry{i}")).alias(v.name) for i, v in enumerate(values)])
        return self

    def done(self) -> DataFrame:
        return self.rows.drop("_pid", "_rid")
