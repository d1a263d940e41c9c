from pyspark.sql import functions as F

from spanforge import sources as IO
from spanforge.operators import counts as C
from spanforge.plans import metrics as M
from spanforge.streaming import tokenize_stream


def test_lines_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("x\ny\n", encoding="utf-8")
    a, b = IO.read_lines(spark, str(tmp_path / "a.txt")), IO.read_lines(spark, str(tmp_path / "b.txt"))
    assert [tuple(r) for r in IO.zip_lines(src=a, trg=b).orderBy("line_no").collect()] == [(1, "one", "x"), (2, "", "y")]
    IO.write_lines(a, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["one", "", "two"]
    df = spark.createDataFrame([("a b ",)], "t string")
    assert IO.scrub(df, "t").first()[0] == "ab" and IO.scrub(df, "t", " ").first()[0] == "a b"


def test_links(spark):
    df = spark.createDataFrame([("0-0 1-2",), ("",)], "l string").select(IO.parse_links("l").alias("x"))
    assert [[tuple(y) for y in r.x] for r in df.collect()] == [[(0, 0), (1, 2)], []]
    s = spark.createDataFrame([([(0, 0, 0.5), (1, 2, 0.25)],)], "x array<struct<si:int,ti:int,score:double>>")
    assert s.select(IO.format_links("x")).first()[0] == "0-0-0.5 1-2-0.25"


def test_model_files(spark, tmp_path):
    t = spark.createDataFrame([("▁a", "x", 2.0), ("b", "y", 1.5)], "span string, token string, c double")
    IO.save_model(t, str(tmp_path / "m"), vocab_size=8, type="cond-exact")
    back, meta = IO.load_model(spark, str(tmp_path / "m"))
    assert meta["vocab_size"] == 8 and sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    IO.export_archive(t, str(tmp_path / "m.tar.gz"), seed=3)
    back, meta = IO.import_archive(spark, str(tmp_path / "m.tar.gz"))
    assert meta == {"seed": 3} and sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    v = spark.createDataFrame([('a"b', 0), ("c: d", 1), ("▁x", 2)], "token string, id long")
    IO.write_vocab_yaml(v, str(tmp_path / "v.yaml"))
    assert sorted(map(tuple, IO.read_vocab_yaml(spark, str(tmp_path / "v.yaml")).collect())) == sorted(map(tuple, v.collect()))


def test_missing_metrics(spark, tmp_path):
    (tmp_path / "e1.json").write_text('{"length": 3.5}')
    grid = spark.createDataFrame([("p", "e1.json"), ("q", "e2.json")], "pair string, path string")
    got = {r.pair: r.length for r in IO.read_metrics(spark, grid, str(tmp_path), "length double").collect()}
    assert got == {"p": 3.5, "q": 0.0}
    assert IO.read_metrics(spark, grid, str(tmp_path), "length double", None).count() == 1


def test_lm_metrics(spark):
    s = spark.createDataFrame([(1.0, 2, 2, 4, 6), (2.0, 4, 2, 6, 6)], "loss double, tokens int, words int, chars int, bytes int")
    r = M.lm_metrics(s).first()
    assert abs(r.eval_ppl - 4.481689) < 1e-6 and abs(r.eval_ppl_token - 1.648721) < 1e-6 and abs(r.eval_bpb - 0.360674) < 1e-6


def test_token_metrics(spark):
    t = spark.createDataFrame([(["▁a", "b", "▁cd"], 2), (["▁cd"], 1)], "tokens array<string>, w int")
    r = M.token_metrics(t, F.col("w"), 10).first()
    assert r.length == 2 and abs(r.fertility - 4 / 3) < 1e-9 and r.single_char_micro == 0.5 and r.start_word == 0.75 and r.vocab_usage == 0.3


def test_exponential_fit(spark):
    keys = "pair string, size int, vocab int, alignment string, model string, seed int, length double, renyi double, vocab_overlap double, single_char_macro double, single_char_micro double, vocab_usage double, fertility double, start_word double"
    rows = [("a-b", s, 8000, "align", "pmi", 3, 2 * 2.718281828459045 ** (-x) + 1, *[0.5] * 7) for x, s in enumerate((1, 2, 3, 4))]
    r = M.exponential_fit(spark.createDataFrame(rows, keys), "length").first()
    assert abs(r.a - 2) < 1e-3 and abs(r.b + 1) < 1e-3 and abs(r.c - 1) < 1e-3


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xz")], "line_no long, src string, trg string")
    src.write.parquet(str(tmp_path / "in"))
    p = spark.createDataFrame([(1, ["a"], "▁xy"), (2, ["b"], "▁xz")], "line_no long, src array<string>, trg string")
    q = tokenize_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), C.cooccurrence(p), str(tmp_path / "out"), str(tmp_path / "cp"), maxlen=4)
    q.awaitTermination(120)
    got = {r.line_no: "".join(r.tokens) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "▁xy", 2: "▁xz"}
