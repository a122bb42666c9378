"""Registered queries against their SQL twins on the smallest tables, and the driver contract."""

import pytest

import __spark_entry__ as entry
from alertweft.plans import load_queries
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
# one or two per family; `python tests/oracle.py` runs all of them
NAMES = ["flagship", "flt_11", "flt_26", "win_01", "win_02", "win_14", "agg_02", "agg_03", "prj_01", "prj_16", "red_05", "red_12", "red_13", "src_01", "src_03",
         "src_13", "snk_01", "chk_01", "chk_09", "chk_20", "agg_11", "agg_12", "agg_22", "chk_27", "chk_34", "jn_17", "jn_20", "jn_21", "jn_15", "agg_25",
         "int_02", "int_05", "str_02", "str_03", "str_04", "chk_23_groups", "chk_32_gate", "chk_35_cells", "jn_07_cells", "int_01_known", "src_19_known", "src_12_ranges"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    ok, note = compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert ok, note


def test_contract(spark):
    queries, twins = load_queries()
    assert set(queries) <= set(entry.queries()) and set(twins) <= set(entry.oracle_sql())
    assert set(twins) <= set(queries) and len(queries) > 240
    assert set(queries) - set(twins) == {"agg_19", "src_19", "int_01"}
    assert entry.entry(spark).count() > 0


def test_rows_only_queries(spark):
    queries = entry.queries()
    ci = queries["agg_19"](spark, FOLDER).collect()
    assert len(ci) == 36 and all(r.lower <= r.upper for r in ci)
    resolved = queries["src_19"](spark, FOLDER).collect()
    assert sorted({r.matches for r in resolved}) == [0, 1] and sum(r.matches == 0 for r in resolved) == 1
    manifest = queries["int_01"](spark, FOLDER).collect()
    assert {r.category for r in manifest} == {"dataset", "outputs", "spec"} and all(r.files == r.hashed for r in manifest)
