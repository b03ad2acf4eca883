"""Physical-plan properties the design relies on."""
from helpers import SF_SMALL
from eventlens.plans.queries import QUERIES


def plan(spark, name):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_align_broadcasts_returns_and_never_shuffles_events_by_key(spark):
    p = plan(spark, "align_events")
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert "hashpartitioning(ticker" not in p.split("BroadcastExchange")[0]


def test_text_jobs_stay_in_the_jvm(spark):
    for name in ("news_events", "filing_events", "clean_text", "parse_answers", "score_models"):
        p = plan(spark, name)
        assert "Python" not in p and "ArrowEval" not in p, name


def test_top_n_per_company_has_partial_limit(spark):
    p = plan(spark, "latest_filings")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_scans_are_pruned_and_filtered(spark):
    p = plan(spark, "latest_filings")
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in p


def test_metrics_aggregate_partially_before_shuffle(spark):
    p = plan(spark, "score_models")
    assert p.count("HashAggregate") == 2 and "partial_count" in p


def test_answers_are_parsed_once_and_unread_fields_are_pruned(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 10000)
    for name in ("parse_answers", "score_models"):
        p = plan(spark, name)
        assert p.count("from_json") == 1 and p.count("regexp_extract_all") == 1, name
    assert "cause_llm_pred" not in p and "effect_llm_pred" not in p
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def _final_plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()  # the DataFrame's own execution: the AQE plan is final afterwards
    from eventlens.functions.text import WHITESPACE  # its literal holds newlines
    plan = df._jdf.queryExecution().executedPlan().toString().replace(WHITESPACE, "<ws>")
    return plan.split("== Initial Plan ==")[0]


def test_cleaning_chain_runs_in_whole_stage_codegen(spark):
    p = _final_plan(spark, "news_events")
    chain = [line for line in p.splitlines() if "Project" in line and "SIGNATURES" in line]
    assert chain and all("*(" in line for line in chain)


def test_pipeline_joins_are_broadcast(spark):
    p = _final_plan(spark, "align_all_tickers")
    assert p.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in p
