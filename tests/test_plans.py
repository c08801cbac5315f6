"""Physical-plan tests: the plans are the ones a scale-out run needs."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import panel
from tessera.plans import contract_queries, entity_queries, panel_queries, text_queries
from tests.conftest import SF_SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_series_features_share_one_window_sort(spark):
    m = panel_queries.monthly(spark, SF_SMALL)
    f = panel.series_features(m, encode=False, drop_incomplete=False)
    plan = plan_of(f)
    # lags, guarded rolling stats and position share one partition/order spec
    assert plan.count("Window [") >= 1
    assert plan.count("Sort [store") == 1


def test_no_python_udf_in_text_scoring(spark):
    r = text_queries.scored_reviews(spark, SF_SMALL)
    df = r.select("doc_id", T.clean_text("review_text"), *T.text_sentiment(F.col("tokens")).values())
    plan = plan_of(df)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_store_filter_reaches_the_scan(spark):
    df = contract_queries.q_filtered_store_rollup(spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(r_name,EUROPE)" in text.replace(" ", "")


def test_scans_are_pruned(spark):
    from tessera.sources import views
    df = panel.monthly_rollup(views.sales(spark, SF_SMALL))
    plan = plan_of(df)
    # lineitem is read with the four columns the view needs
    assert "l_partkey" in plan and "l_shipdate" in plan
    assert "l_extendedprice" not in plan and "l_discount" not in plan and "l_tax" not in plan


def test_rollup_joins_run_once(spark):
    """Median imputation + rollup: one pass over the joined input."""
    from tessera.sources import views
    agg_plans = []
    m = panel.imputed_monthly_rollup(views.sales(spark, SF_SMALL),
                                     materialize_with=lambda d: agg_plans.append(plan_of(d)) or d)
    assert agg_plans and agg_plans[0].count("lineitem.parquet") == 1
    assert m.count() > 0


def test_top_keywords_use_window_group_limit(spark):
    df = text_queries.q_top_keywords_by_sentiment(spark, SF_SMALL)
    assert "WindowGroupLimit" in optimized_of(df) or "WindowGroupLimit" in plan_of(df)


def test_global_statistics_are_scalar_subqueries(spark):
    df = panel_queries.q_store_share(spark, SF_SMALL)
    plan = plan_of(df)
    assert "Subquery" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_batch_recommendation_has_no_cross_product(spark):
    df = entity_queries.q_batch_recommendations(spark, SF_SMALL)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
