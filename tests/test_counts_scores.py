import math
from collections import Counter

import pytest

from spanforge.operators import codec, corpus
from spanforge.operators import counts as C
from spanforge.operators import scores as S


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(1, ["a", "b"], "▁xy"), (2, ["a"], "▁xz")], "line_no long, src array<string>, trg string")


@pytest.fixture(scope="module")
def table(pairs):
    t = C.cooccurrence(pairs).cache()
    t.count()
    return t


def test_cooccurrence_fixture(table):
    rows = table.collect()
    assert sum(r.c for r in rows) == 18 and len(rows) == 15
    assert {r[0]: r[1] for r in C.by_token(table).collect()} == {"a": 12, "b": 6}
    assert {r[0]: r[1] for r in C.by_span(table).collect()} == {"▁": 3, "▁x": 3, "x": 3, "▁xy": 2, "xy": 2, "y": 2, "▁xz": 1, "xz": 1, "z": 1}
    assert C.norm(table).first()[0] == 18
    m = {(r.axis, r.key): r.total for r in C.marginals(table).collect()}
    assert m[("all", "")] == 18 and m[("token", "b")] == 6 and m[("span", "z")] == 1 and len(m) == 12


def test_repeated_source_token_counts_once(spark):
    p = spark.createDataFrame([(1, ["a", "b", "a"], "▁xy"), (2, ["a"], "▁xz")], "line_no long, src array<string>, trg string")
    assert C.norm(C.cooccurrence(p)).first()[0] == 18


def test_information_and_prune(table):
    info = {r.span: r.info for r in S.information(table).collect()}
    want = {"▁x": 0.0, "xy": 0.0065435, "▁xy": 0.0065435, "xz": 0.0225258, "▁xz": 0.0225258}
    assert info.keys() == want.keys() and all(abs(info[k] - v) < 1e-6 for k, v in want.items())
    assert {r.span for r in S.least_informative(table, 7, 0.25).collect()} == {"▁x", "xy"}
    assert {r.char for r in S.rare_characters(table, 0.85).collect()} == {"z"}
    left = {r.span for r in S.prune_characters(table, 0.85).select("span").distinct().collect()}
    assert left == {"▁", "▁x", "x", "▁xy", "xy", "y"}


def test_scores(spark, table):
    u = spark.createDataFrame([(["a", "b"], "▁xy"), (["a"], "▁xy"), (["q"], "▁xy"), ([], "▁xy"), (["a"], "nope")], "src array<string>, span string")
    get = lambda m: {tuple(r.src): r.score for r in S.score(m, u, table).collect()}
    assert abs(get("pmi")[("a", "b")] - 0.405465) < 1e-6
    assert abs(get("cpmi")[("a", "b")] - 0.405465) < 1e-6 and abs(get("cpmi")[("a",)]) < 1e-9
    c = get("cond-exact")
    assert abs(c[("a", "b")] - math.log(2 / 18)) < 1e-9 and c[("q",)] == float("-inf") and c[()] == float("-inf")
    assert get("max")[("q",)] == float("-inf")
    assert abs(get("sum-unpaired")[("q",)] - get("sum-unpaired")[("a",)]) < 1e-12
    with pytest.raises(ValueError):
        S.score("none", u, table)


def test_align_and_extract(spark, table):
    u = spark.createDataFrame([(["q", "b", "a"], "▁xy")], "src array<string>, span string")
    best = S.align("cond-exact", u, table).collect()
    assert [(r.pos, r.token) for r in best] == [(1, "b")]
    assert {r.token for r in S.align("sum", u, table).collect()} == {"a", "b"}
    assert [(r.pos) for r in S.align("max", u, table).collect()] == [1]
    assert S.extract("cond-exact", table, 1).count() == 9 and S.extract("pmi", table, 0).count() == 15


def test_threshold_forms(spark):
    f = spark.createDataFrame([("a", 1), ("ab", 5), ("abc", 9)], "span string, freq long")
    assert {r.span for r in corpus.threshold(f, 5).collect()} == {"a", "ab", "abc"}
    f = spark.createDataFrame([("a", 1), ("ab", 5), ("abc", 2), ("bc", 2), ("bd", 1), ("ce", 1), ("x", 1)], "span string, freq long")
    assert {r.span for r in corpus.threshold(f, 5).collect()} == {"a", "x"}  # more go than stay: at the threshold is out


def test_table_algebra(spark, table):
    assert C.norm(C.add(table, table)).first()[0] == 36
    assert C.sizes(table).first().nnz == 15
    gone = spark.createDataFrame([("xy",)], "span string")
    assert C.norm(C.delete_spans(table, gone)).first()[0] == 16
    assert C.upsert(table, spark.createDataFrame([("z", "a", 7)], "span string, token string, c long")).where("span = 'z'").first().c == 7
    assert C.same_index(table, table) and not C.same_index(table, C.delete_spans(table, gone))
    ids = [r.span_id for r in C.index(table, "span", "span_id").orderBy("span").collect()]
    assert ids == list(range(9))


def test_band(spark):
    p = spark.createDataFrame([(1, ["p", "q", "r"], ["a", "b"])], "line_no long, spans array<string>, tokens array<string>")
    got = {(r.span, r.token) for r in C.band_count(p).collect()}
    assert got == {(s, t) for i, s in enumerate("pqr") for j, t in enumerate("ab") if -1 <= j - i <= 0}


def test_codec_round_trip(spark):
    spans = spark.createDataFrame([("▁ab",), ("c",)], "span string")
    v = codec.export_vocab(spark, spans).cache()
    assert v.count() == 262 and {r.token: r.id for r in v.where("id in (0, 3, 4, 260, 261)").collect()} == {"<unk>": 0, "<pad>": 3, "▁▁{0}": 4, "c": 260, "▁ab": 261}
    t = spark.createDataFrame([(1, ["▁ab", "c", "é€😀", "x"]), (2, [])], "line_no long, tokens array<string>")
    ids = codec.encode(t, v, bos=1, eos=2, pad=3, length=4)
    assert ids.where("line_no = 2").first().ids == [1, 2, 3, 3]
    assert {r.line_no: r.text for r in codec.decode(ids, v).collect()} == {1: "▁abcé€😀x", 2: ""}


def test_merge_vocabs(spark):
    a = spark.createDataFrame([("x", 7), ("y", 2)], "token string, id long")
    b = spark.createDataFrame([("y", 0), ("z", 1)], "token string, id long")
    assert {r.token: r.id for r in codec.merge_vocabs(a, b).collect()} == {"y": 0, "x": 1, "z": 2}


def test_sampling(spark):
    df = spark.range(1, 101).select(C.F.col("id").alias("line_no"))
    assert corpus.shuffle_take(df, 10).count() == 10
    assert Counter(r.bucket for r in corpus.buckets(df, 3).collect()) == {0: 34, 1: 34, 2: 32}
