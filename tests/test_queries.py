"""Each reference query against its SQL twin, and the contract of the entry point."""

import pytest

import __spark_entry__ as entry
from opinionlab import queries as reference

SLOW = {"lr_predict", "choose_k", "topics_kmeans"}


@pytest.mark.parametrize("name", sorted(reference.oracle_sql()))
def test_same_as_sql(spark, small, same, name):
    same(reference.queries()[name](spark, small), reference.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(reference.queries()) - set(reference.oracle_sql()) - SLOW))
def test_runs_without_sql(spark, small, name):
    assert reference.queries()[name](spark, small).limit(1).count() == 1


def test_entry(spark):
    rows = {r["metric"]: r["value"] for r in entry.entry(spark).collect()}
    assert rows["original_rows"] == rows["kept_rows"] + sum(v for k, v in rows.items() if k.startswith("removed_"))


def test_names():
    assert set(reference.oracle_sql()) <= set(reference.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
