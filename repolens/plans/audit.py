"""Physical-plan audit of the registered queries.

Flags plan nodes that do not scale: Cartesian products, nested-loop joins and
row-at-a-time Python UDFs (``BatchEvalPython``). Also counts shuffles, joins
by strategy and Python nodes, so changes to a plan show up in review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
COUNTED = ["Exchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "MapInPandas",
           "HashAggregate", "SortAggregate", "WindowGroupLimit", "Window "]


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def audit(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, dict]:
    from repolens.plans.registry import REGISTRY

    out = {}
    for name, reg in REGISTRY.items():
        if names and name not in names:
            continue
        text = plan_text(reg.run(spark, sf_dir))
        out[name] = {"forbidden": [f for f in FORBIDDEN if f in text],
                     **{c.strip(): text.count(c) for c in COUNTED if c in text}}
    return out


if __name__ == "__main__":
    import sys

    import tempfile

    from repolens.plans.session import get_session

    spark = get_session("local[8]", 8, checkpoint_dir=tempfile.mkdtemp(prefix="repolens-"))
    for name, row in audit(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01").items():
        print(name, row)
