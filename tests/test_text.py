from pyspark.sql import functions as F

from spanforge.functions import math as M
from spanforge.functions import text as T


def one(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_prepare(spark):
    got = one(spark, ["Hello,world 12kg\tx", "ﬁne ½ café", "▁a ▁▁b ▁.", "éx n​o", "", None], T.prepare)
    assert got == ["Hello , world 12 kgx", "fine 1 ⁄ 2 café", "▁a ▁▁ b ▁.", "éx no", "", None]


def test_target_form(spark):
    assert one(spark, ["Hello , world 12 kgx", ""], T.mark_words) == ["▁Hello▁,▁world▁12▁kgx", "▁"]
    assert one(spark, ["▁Hello▁,▁world", "▁"], T.marked_words) == [["▁Hello", "▁,", "▁world"], []]
    assert one(spark, ["▁He llo ▁wor ld"], T.detokenize) == ["Hello world"]


def test_spans_against_loops(spark):
    for maxlen in (None, 1, 3):
        for w in ("▁abc", "x", ""):
            want = [(i, j, w[i:j]) for i in range(len(w)) for j in range(i + 1, min(len(w), i + (maxlen or len(w))) + 1)]
            got = one(spark, [w], lambda c, m=maxlen: T.spans(c, m))[0]
            assert [tuple(g) for g in got] == want


def test_digamma(spark):
    row = spark.range(1).select(*[M.digamma(F.lit(x)).alias(str(i)) for i, x in enumerate((1.0, 0.5, 7.25))], M.digamma(F.lit(0)).alias("z")).first()
    assert abs(row[0] + 0.5772156649015329) < 1e-10
    assert abs(row[1] + 1.9635100260214235) < 1e-10
    assert abs(row[2] - 1.910453) < 1e-5
    assert row[3] == float("-inf")


def test_thousands(spark):
    assert spark.range(1).select(T.thousands(F.lit(8000))).first()[0] == "8.0k"
