"""Plans: interval joins stay hash or merge joins, windows are partitioned, scans are pruned and filtered."""

import re

import pytest

from trackworks.operators import sequences
from trackworks.plans import load_all

REGISTRY = load_all()


def plan(spark, sf_dir, name):
    return REGISTRY.queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c1_validated_join", "c10_interval_intersection", "c11_window_coverage", "c12_asof", "c13_nearest", "d12_genre_rollup", "e6_tails", "e8_segment_rows", "e10_window_coverage", "f4_level_envelope", "f20_leakage_matrix", "g4_window_draw", "g11_anchor_index", "h1_version_diff", "i2_gap_verdict"])
def test_no_nested_loops_and_no_single_partition_windows(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "SinglePartition" not in text


def scanned(text):
    return set(re.findall(r"(\w+)#", re.search(r"FileScan parquet \[([^\]]*)\]", text)[1]))


def test_scan_reads_only_what_is_asked_for(spark, sf_dir):
    text = plan(spark, sf_dir, "b7_pool_filter")
    assert "PushedFilters: [IsNotNull(source)" in text and scanned(text) == {"doc_id", "lang", "source", "n_chars"}
    assert scanned(plan(spark, sf_dir, "d6_pool_summary")) == {"lang", "n_chars"}


def test_pairing_makes_one_pass(spark, sf_dir):
    assert plan(spark, sf_dir, "c6_paired_runs").count("Join") == 1  # scores with customers; the runs aren't joined


@pytest.mark.parametrize("name", ["d6_pool_summary", "d8_loss_at_cut", "d26_outlier_fence", "d32_pair_share", "e17_ranked_windows", "f6_crest", "f21_median_spectrum", "h7_segment_invariants"])
def test_no_exact_percentile_keeps_a_group_in_one_buffer(spark, sf_dir, name):
    assert "percentile" not in plan(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["f10_sum_identity", "f13_mix_weights", "f20_leakage_matrix", "f22_overview", "f29_shared_gain"])
def test_no_sample_is_a_row(spark, sf_dir, name):
    assert "posexplode" not in plan(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["e2_runs", "e3_hysteresis", "e6_tails", "e7_merged_spans", "e13_sliding_mean", "e16_candidate_windows", "e21_prefix_energy", "e23_longest_run", "e24_epoch_forward_fill", "f26_limiter_gain", "g1_stratified_split", "g2_quota_sample"])
def test_windows_over_rows_are_by_chunk_or_cell(spark, sf_dir, name, monkeypatch):
    """A window's keys hold a chunk or a cell, or its rows are one a chunk or a cell; the test tables' own numbering of events is by user."""
    monkeypatch.setattr(sequences, "kept", lambda df: df)  # the plan as one
    for keys, order in re.findall(r"windowspecdefinition\((.*?), (\w+)#\d+L? ASC", REGISTRY.queries[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()):
        assert "_chunk" in keys or "_cell" in keys or order in ("_chunk", "_cell") or (keys.startswith("user_id") and order == "ts"), (keys, order)


def test_modes_of_a_fill_share_its_tables(spark, sf_dir, monkeypatch):
    from trackworks.plans import activity

    spans, calls = activity.spans, []
    monkeypatch.setattr(activity, "spans", lambda *a: calls.append(a) or spans(*a))
    text = plan(spark, sf_dir, "g12_rule_breaks")
    assert len(calls) == 1 and "events.parquet" not in text
