"""Every query with an oracle must agree with it; the others must return rows."""

import re

import pytest

import oracle_check
from foldspark.plans import load_all
from foldspark.plans.registry import ORACLES, QUERIES

load_all()
SLOW = {q for q in QUERIES if re.match(r"run_|boosting_|op\d|pipeline", q)}


@pytest.fixture(scope="module")
def con(sf):
    return oracle_check.duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, sf, name):
    verdict, _, _ = oracle_check.compare(spark, con, sf, name)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).toArrow().num_rows > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
