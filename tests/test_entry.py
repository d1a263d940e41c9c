"""Every query of the core that has an oracle agrees with it on the smallest tables, where they are at hand."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
NAMES = ["line_scan", "prepare_src", "prepare_trg", "span_threshold", "cooccurrence", "score_pmi", "align_cond_exact", "vocab_merge", "word_pairs", "parity_ratio", "linear_extrapolation", "token_metrics"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    import duckdb

    from spanforge.plans import catalogue

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    text = lambda v: "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(catalogue.ORACLE[name]).df())


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
