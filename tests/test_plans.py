"""What the plans must look like: few shuffles, pruned and filtered scans, no Python where built-ins do."""

import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", text))


@pytest.mark.parametrize(("name", "most"), [("job_trace", 1), ("job_totals", 1), ("trace_gaps", 1), ("late_events", 2), ("retention_preview", 1), ("runtime_budget", 1), ("latest_recording", 1), ("temporal_parse", 0), ("statement_split", 0), ("smart_ranges", 2), ("graph_edges", 2), ("edge_issues", 1)])
def test_shuffles(spark, name, most):
    text = plan(spark, name)
    assert exchanges(text) <= most, text


@pytest.mark.parametrize("name", ["job_trace", "temporal_parse", "factual_support", "sensitivity_levels", "graph_edges", "neighbour_context", "resolver_status", "smart_ranges", "offset_recovery", "merged_parts", "prf_micro"])
def test_built_ins_only(spark, name):
    assert not re.search("Python|Arrow|Pandas", plan(spark, name))


def test_scans_read_what_they_need(spark):
    text = plan(spark, "job_trace")
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert {c.split(":")[0] for c in columns.split(",")} == {"event_id", "job_id", "attempt", "stage", "duration_ms"}
    assert "IsNotNull(text)" in plan(spark, "statement_split")
    nested = re.search(r"ReadSchema: (struct<.*)", plan(spark, "edge_padding"))[1]
    assert "asr_metadata" not in nested and "raw_extraction" not in nested


def test_no_cartesian_products(spark):
    for name in ("nearest_after", "unique_near", "resolver_status", "graph_signals", "conflict_pairs", "neighbour_context"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
