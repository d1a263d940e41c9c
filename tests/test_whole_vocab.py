"""All exports are merged and compared, not the first two."""

import pytest

from spanforge.plans import catalogue


def test_all_exports(spark, tmp_path):
    rows = [(1, "b", 0), (1, "a", 1), (2, "a", 0), (2, "c", 1), (4, "d", 0), (4, "c", 1), (4, None, 2)]
    df = spark.createDataFrame(rows, "export_id long, vocab string, id int")
    df.write.parquet(str(tmp_path / "vocab.parquet"))
    got = lambda name: sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
    assert got("vocab_merge") == [("a", 1), ("b", 0), ("c", 2), ("d", 3)]
    assert got("vocab_overlap") == [(1, 2, pytest.approx(1 / 3, abs=1e-6)), (2, 4, pytest.approx(1 / 3, abs=1e-6))]
