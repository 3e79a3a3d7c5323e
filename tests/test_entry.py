"""Every query with an oracle agrees with it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from strandloom import registry

SF = "/root/testdata/sf0.001"
QUICK = ("kmer_histogram", "strand_counts_even", "dedup_reads", "exact_overlaps", "irreducible_edges", "graph_stats", "pair_support", "preprocess_stats", "event_windows", "grep_reads", "lexicographic_rank", "prefix_set", "match_algebra", "seeded_similarity", "pair_sinks")


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.oracles()) <= set(registry.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", QUICK)
def test_agrees_with_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(registry.oracles()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    key = sorted(want.columns)
    assert sorted(got.columns) == key
    text = lambda f: sorted(map(str, f[key].astype(object).values.tolist()))
    assert text(want) == text(got)
