import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as contract  # noqa: E402
from featloom.checks import ORACLES, QUERIES  # noqa: E402
from parity import compare, connect  # noqa: E402

FOLDER = pathlib.Path("/root/testdata/sf0.001")
ROWS_ONLY = {
    "gbt_predictions", "gbt_absolute", "forest_predictions", "pca", "cross_validate",
    "swap_scores", "score_test_set", "cross_validated_score",
}
# A cross-section; tools/parity.py runs them all.
SAMPLE = [
    "project_rename_drop", "round_share", "date_parts", "flag_decode", "override_where",
    "csv_round_trip", "bucket_rare", "bucket_rare_multi", "vocab_train_apply_test",
    "one_hot_vector", "label_index", "unpivot_groups", "pivot_sum", "attach_salted",
    "attach_roles", "component_quantity", "base_name_counts", "pooled_counts",
    "attributes_boss", "attributes_nut", "attributes_hfl", "threaded_optional_steps",
    "impute_ridge_2", "impute_bend_radius", "spec_counts_grouped", "end_counts", "group_folds",
    "group_holdout", "rmsle_multi", "top_feature_votes", "basic_bill", "tube_features",
    "quote_features", "published_versions", "failed_publish_keeps_last",
]


def test_contract_shape():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    queries, sql = QUERIES, ORACLES
    assert len(queries) > 110
    assert set(queries) - set(sql) == ROWS_ONLY and set(sql) <= set(queries)


pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", SAMPLE)
def test_parity(spark, name):
    df = contract.queries()[name](spark, str(FOLDER))
    assert compare(df, connect(str(FOLDER)), contract.oracle_sql()[name]) == []


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
