"""Scores by token are those by (source, span), and a written stage leaves no shuffle files."""

import random


def test_edges(spark):
    from pyspark.sql import functions as F

    from spanforge.operators import counts as C
    from spanforge.operators import lattice as L
    from spanforge.operators import scores as S

    r = random.Random(3)
    word = lambda k: "".join(r.choice("abcé𝄞") for _ in range(k))
    lines = [([word(2) for _ in range(r.choice((1, 1, 2, 3)))], "▁" + word(4)) for _ in range(150)]
    pairs = spark.createDataFrame(lines, "src array<string>, trg string")
    table = C.cooccurrence(pairs, 3).where("length(span) < 3 or c > 1")
    more = [(["aa", "aa", "bb"], "▁abca", 1), ([], "▁abc", 1), (["zz"], "▁ab", 1), (["aa"], "▁zzz", 1), (["zz", "aa"], "▁ab", 1)]
    units = L.named(spark.createDataFrame([(s, w, 1) for s, w in lines] + more, "src array<string>, word string, n int").distinct())
    sources = units.select("s1", "s2", "src").dropDuplicates(["s1", "s2"])
    got = L.edges(units, sources, table, "cond-exact", 3).select("s1", "s2", "word", F.explode("edges").alias("e")).select("s1", "s2", "word", "e.*")
    each = units.select("s1", "s2", "word", F.explode(L.T.spans(F.col("word"), 3)).alias("e")).select("s1", "s2", "word", "e.*").join(table.select("span").distinct(), "span")
    want = each.join(S.score("cond-exact", each, table, L.SOURCE, sources), ["s1", "s2", "span"])
    rows = lambda df: sorted(map(tuple, df.select("s1", "s2", "word", "start", "end", "span", F.round("score", 12)).collect()))
    assert rows(got) == rows(want) and L.edges(units, sources, table, "cond-exact", 3).count() == units.count()


def test_no_shuffle_files_left(spark):
    from spanforge.common import materialise

    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    t = materialise(spark.range(1000).groupBy("id").count(), "t")
    assert t.count() == 1000 and t.where("count = 1").count() == 1000
    materialise(spark.range(1000).repartition(3, "id"), "u")
    assert files() <= before + 4  # those of the counts above only


def test_best():
    from spanforge.operators.lattice import best

    inf = float("inf")
    assert best("abc", [(0, 1, -1.0), (1, 2, -1.0), (0, 2, -2.0), (2, 3, -1.0)], frozenset("abc"), 5.0) == (-3.0, ["a", "b", "c"])  # a tie goes to the shortest last span
    assert best("abc", [(0, 3, -inf), (0, 1, -1.0)], frozenset("abc"), 5.0) == (5.0, ["abc"])  # no finite score: the least count
    assert best("abc", [(0, 3, -inf), (0, 1, -1.0)], frozenset("abc"), None) == (0.0, ["a", "b", "c"])  # or no edge; a place no edge reaches resets the score
    assert best("ax", [(0, 1, -1.0), (0, 2, -1.0)], frozenset("a"), 5.0) == (0.0, ["a", "x"])
