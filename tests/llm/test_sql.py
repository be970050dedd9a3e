"""The corpus queries that SQL can say, against DuckDB."""

import oracle_check
import pytest

import __spark_entry__ as entry_module


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_inverted_multi_index", "op5_line_dedup", "op11_permuterm_spelling", "op12_lexical_search"])
def test_matches_sql(spark, sf, name):
    verdict, _, _ = oracle_check.compare(spark, oracle_check.duck(sf), sf, name)
    assert verdict.startswith("ok"), verdict


def test_all_operators_are_registered():
    names = entry_module.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names
