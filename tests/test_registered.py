"""Every registered query against its SQL twin, and its plan."""

import pytest
from compare import differences
from plancheck import faults

from riskloom.catalog import REGISTRY

# An unpartitioned window is right over rows whose number arguments bound (models, features,
# classes, buckets), and over a table that the planner has counted as small enough for one task.
BOUNDED_WINDOWS = {
    "percentile_position", "percentile_position_of_ties", "trained_leaderboard", "experiment_run", "global_importance",
    "class_balance", "roc_auc_overall_in_buckets", "leaderboard", "cross_validation_leaderboard", "best_model",
    "summary_data", "importance_table",
}


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, folder, duck, name):
    q = REGISTRY[name]
    df = q.run(spark, folder)
    bad = faults(df)
    assert not bad or (name in BOUNDED_WINDOWS and bad == ["window over a single partition"]), bad
    if q.sql is None:
        assert df.columns and df.count() > 0
    else:
        assert differences(df, duck, q.sql) == []


def test_every_inventory_row_is_covered():
    want = (
        [f"A{i}" for i in range(1, 7)] + [f"B{i}" for i in range(1, 10)] + ["B6a", "B6b", "B6c", "B6d"]
        + [f"C{i}" for i in range(1, 8)] + [f"D{i}" for i in range(1, 8)] + [f"E{i}" for i in range(0, 14)]
        + [f"F{i}" for i in range(1, 29)] + [f"H{i}" for i in range(1, 28)] + [f"I{i}" for i in range(1, 21)]
        + [f"J{i}" for i in range(1, 11)] + [f"K{i}" for i in range(1, 9)]
    )
    covered = {c for q in REGISTRY.values() for c in q.covers}
    assert [w for w in want if w not in covered] == []


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["feature", "iv", "strength"] and df.count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())
