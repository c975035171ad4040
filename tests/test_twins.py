"""Registered queries against their SQL twins on the smallest data."""

import importlib.util
import pathlib

import pytest

from tests.conftest import SMALL

ROOT = pathlib.Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

from ledgerloom.plans.catalog import QUERIES, TWINS  # noqa: E402

FAST = [
    "ledger_daily", "runway_point", "asof_receivables", "delay_spearman", "credit_features", "auc_rule_score", "calibration_quantile", "conformal_multiplier",
    "runway_at_risk", "exact_allocation", "greedy_allocation", "statement_reconcile", "robust_z", "duplicate_band_join", "hash_chain_append", "usage_meter",
]


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES) and len(TWINS) > 90


@pytest.mark.parametrize("key", FAST)
def test_twin(spark, key):
    ok, message = check.compare(QUERIES[key](spark, SMALL), check.duck(SMALL), TWINS[key])
    assert ok, message
