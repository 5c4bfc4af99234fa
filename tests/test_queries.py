"""Every oracle-backed query of a fast subset against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from tieline.plans.catalogue import ORACLES, QUERIES
from tools.check import run

SF = "/root/testdata/sf0.001"
FAST = [
    "clean_mail_scan", "content_id", "text_counts", "imperatives", "thread_features", "reply_latencies", "response_ratio", "pair_signals",
    "person_rollup", "score_rank", "quantile_tiers", "nmi", "adjusted_rand", "kappa", "spearman", "token_f1", "cosine_top_k", "resolve_addresses",
    "clean_ingest", "stream_upsert", "stream_volume", "bucketed_sample", "phrase_matches", "external_edges",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    line, ok = run(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, line


def test_names_are_consistent():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 200
