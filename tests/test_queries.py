"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

import oracle
from alarmlens.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_query_equals_sql(spark, name):
    assert oracle.spark_rows(registry.QUERIES[name](spark, SF)) == oracle.duck_rows(SF, registry.ORACLES[name])


@pytest.mark.parametrize("name", ["bootstrap_rows_ci"])
def test_query_without_sql(spark, name):
    first = registry.QUERIES[name](spark, SF)
    assert oracle.spark_rows(first) == oracle.spark_rows(registry.QUERIES[name](spark, SF))
    assert first.count() > 0


@pytest.mark.parametrize("name", ["fit_logistic", "fit_gbt", "fit_categorical_gbt", "fit_mlp", "grid_search_time", "mixture_of_experts"])
def test_fitted_scores(spark, name):
    """One score for each held-out row, from 0 to 1."""
    rows = registry.QUERIES[name](spark, SF).toPandas()
    score = rows[[c for c in ("probability", "mixed", "score") if c in rows][0]]
    if name == "grid_search_time":
        from alarmlens.plans import files

        chosen = {k: rows[f"chosen_{k}"].unique().tolist() for k in files.GRID[0]}
        assert len(files.GRID) == 16 and {k: v[0] for k, v in chosen.items()} in files.GRID and rows.inner_average_precision.between(0, 1).all()
    assert len(rows) and not rows.duplicated(["channel_id", "as_of"]).any() and score.between(0, 1).all()


def test_snapshots_are_built_once_for_a_fit(spark):
    """Rows to fit and rows to score are read from one table; neither builds the snapshots again."""
    from alarmlens.plans.evaluation import model_rows

    plans = [x._jdf.queryExecution().executedPlan().toString() for x in model_rows(spark, SF)]
    assert all("Exchange" not in p and "Window" not in p and "model-rows" in p for p in plans)


def test_samples_are_full(spark):
    """The sizes that were asked for, from every stratum that has as many."""
    kinds = {r.stratum: r["count"] for r in registry.QUERIES["stratified_sample"](spark, "/root/testdata/sf0.01").groupBy("stratum").count().collect()}
    assert kinds == {"positive": 20, "negative": 20, "excluded": 20}
    risks = registry.QUERIES["stream_risk_scoring"](spark, "/root/testdata/sf0.01").count()
    assert risks > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 162
    assert set(entry.oracle_sql()) <= set(entry.queries())
