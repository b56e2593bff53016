"""No registered query plans a Cartesian product, a nested-loop join or a row-at-a-time Python UDF."""

from repolens.plans.audit import audit

from .conftest import SF001


def test_no_unscalable_plan_nodes(spark):
    bad = {name: row["forbidden"] for name, row in audit(spark, SF001).items() if row["forbidden"]}
    assert bad == {}


def test_one_scan_and_one_parse_per_input(spark):
    from repolens.plans.audit import plan_text
    from repolens.plans.registry import REGISTRY

    for name, node, most in [("support_window", "FileScan", 1), ("package_diff", "FileScan", 1),
                             ("landed_package_diff", "MapInPandas", 1),
                             ("landed_file_list_diff", "BatchScan archive_members", 1)]:
        assert plan_text(REGISTRY[name].run(spark, SF001)).count(node) == most, name


def test_operators_keep_nothing_in_memory(spark):
    from repolens.plans.registry import REGISTRY

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    REGISTRY["ref_changes"].run(spark, SF001).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
