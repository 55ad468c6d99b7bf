"""Every registered query against its DuckDB oracle on sf0.001, plus plan
assertions (no row-at-a-time Python in oracle-checked plans)."""

import pytest

import __spark_entry__ as E
from tests import harness as H
from tests.conftest import SF_SMALL

# the llm queries and the pipeline are tested in tests/llm
QUERIES = {k: v for k, v in E.queries().items() if not (k.startswith("op") or k == "pipeline")}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}
PY_OK = {"m20_m21_series_model_selection", "m20_k5_forecast_with_fitted_models"}



@pytest.fixture(scope="module")
def duck():
    return H.duck(SF_SMALL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["type_sinistre_claim", "claim_severity_bucket", "claim_count",
                                                  "total_indemnisation_tnd", "avg_indemnisation_tnd",
                                                  "delayed_count", "fraud_count"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL).toPandas()
    ddf = duck.execute(ORACLE[name]).df()
    r = H.compare(sdf, ddf)
    assert r["cols_match"], r
    assert r["rows_match"], r
    assert r["hash_match"], H.diff_rows(sdf, ddf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if n not in PY_OK))
def test_no_python_udf_in_plan(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert node not in plan, name
