"""A sample of registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "feature_matrix_all", "direction_switch", "qc_complete_by_subject", "join_node_lookup_twice", "histogram_share", "pooled_null",
    "p_bonferroni", "welch_t", "scan_wide_series", "scan_csv_dim", "split_stratified", "permute_labels_grouped", "centroid_classify",
    "spi_cov_oas", "spi_xcorr", "spi_dcorr", "spi_cds", "spi_mi", "spi_te_symbolic", "spi_ppc", "spi_psi_wavelet", "edge_weight_band",
    "spi_config", "qc_keep_by_subject", "study_similarity", "rejected_files", "feature_matrix_pairs", "scan_headerless_csv", "null_accuracy",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want and got


def test_entry_and_registry(spark):
    assert entry(spark).columns == ["spi", "sample_id", "node_from", "node_to", "value"]
    assert set(oracle_sql()) <= set(queries())
