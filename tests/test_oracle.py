"""Registered queries against their DuckDB oracle on the smallest data set,
plus the driver contract (entry, queries, oracle_sql)."""

import pytest

from quarry.checks.compare import compare

SF = "/root/testdata/sf0.001"

KEYS = ["scan_index_files", "chunk_text", "embed_chunks", "knn", "retrieve", "concat_corpus",
        "sort_paths", "update_index", "index_stats", "split_reasoning", "apply_patches",
        "context_block", "analyze_map_reduce", "changed_lines", "generate_docs", "route_model",
        "ignore_patterns", "dominant_language", "findings", "parse_response_lines"]


def test_contract(spark):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80
    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, key):
    res = compare(spark, SF, [key], verbose=False)
    assert res[key] is True, res[key]
