"""The translation step over all lines, with links or without."""

from spanforge.plans import catalogue


def test_lines_without_links(spark, tmp_path):
    lines = spark.createDataFrame([(1, "it-en", "train", "uno", "one"), (2, "it-en", "train", "due", "two"), (3, "it-en", "train", "tre due", "three two")], "line_no long, pair string, split string, src string, trg string")
    lines.write.parquet(str(tmp_path / "paired_sp_train.parquet"))
    spark.createDataFrame([(1, [(0, 0)])], "line_no long, links array<struct<si:int,ti:int>>").write.parquet(str(tmp_path / "alignment.parquet"))
    got = lambda name: {r.src for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("lexical_step") == {"uno", "due", "tre"}
