"""Every query with an SQL twin, compared at the smallest scale."""

import pytest

from bridge.check import compare, duck
from bridge.queries import QUERIES

SF = "/root/testdata/sf0.001"
# built from the same feature plan as features_batch and features_on_request, minutes of run time
SLOW = {"feature_store", "features_playoff", "team_form_snapshots", "goalie_form_snapshots"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None and n not in SLOW])
def test_query_matches_sql(spark, con, name):
    status, note = compare(spark, con, name, SF)
    assert status in ("OK", "EMPTY"), note


def test_every_query_declares_what_it_covers():
    assert all(q.covers and q.columns for q in QUERIES.values())
