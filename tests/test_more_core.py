"""Sources and sinks, table algebra, sentence-level segmentation, the word aligner and phrases against plain loops."""

import random

from pyspark.sql import functions as F

from spanforge import sources as X
from spanforge.functions import text as T
from spanforge.operators import alignment as A
from spanforge.operators import codec, corpus
from spanforge.operators import counts as C
from spanforge.operators import lattice as L


def test_line_ends_are_blanks(spark):
    df = spark.createDataFrame([("one\ntwo\r\nthree\tfour",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.prepare(F.col("t"))).collect()] == ["one two threefour", "", None]


def test_files(spark, tmp_path):
    one, two = [f"line {i}" for i in range(500)], ["", "  x ", "last"]
    (tmp_path / "a.txt").write_text("\n".join(one) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(two) + "\n")
    got = X.read_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).orderBy("line_no").collect()
    assert [r.text for r in got] == one + two and [r.line_no for r in got] == list(range(1, 504))
    rows = spark.createDataFrame([(2, "dev", "b", "y"), (1, "dev", "a", None), (3, "train", "c", "z")], "line_no long, split string, src string, trg string")
    X.write_splits(rows, str(tmp_path))
    assert [r[0] for r in spark.read.text(str(tmp_path / "dev.src")).collect()] == ["a", "b"]
    assert [r[0] for r in spark.read.text(str(tmp_path / "dev.trg")).collect()] == ["", "y"]
    assert spark.read.text(str(tmp_path / "devtest.src")).count() == 0


def test_model_vocabulary(spark, tmp_path):
    t = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "span string, token string, c long")
    X.save_model(t, str(tmp_path / "m"), vocab_size=3)
    spans, warning = X.load_vocab(spark, str(tmp_path / "m"))
    assert {r[0] for r in spans.collect()} == {"a", "b"} and "3" in warning
    try:
        X.export_archive(t, str(tmp_path / "m.tar.gz"), max_cells=2)
        raise AssertionError("a table above the limit was written")
    except ValueError:
        pass


def test_pivot_and_ids(spark):
    df = spark.createDataFrame([(1, '[{"name":"BLEU","score":30.5},{"name":"chrF2","score":50}]'), (2, None), (3, "[]")], "k int, j string")
    got = {r.k: (r.BLEU, r.chrF2) for r in X.score_pivot(df, ["k"], "j", ["BLEU", "chrF2"]).collect()}
    assert got == {1: (30.5, 50.0), 2: (None, None), 3: (None, None)}
    vocab = spark.createDataFrame([("a", 7), ("b", 8)], "token string, id long")
    ids = codec.token_ids(spark.createDataFrame([("a",), ("q",)], "token string"), vocab)
    assert {r.token: r.id for r in ids.collect()} == {"a": 7, "q": 0}
    back = codec.id_tokens(spark.createDataFrame([(7,), (-100,), (99,)], "id long"), vocab)
    assert {r.id: r.token for r in back.collect()} == {7: "a", -100: "", 99: "<unk>"}


def test_increase_and_replace(spark):
    t = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "span string, token string, c double")
    rows = spark.createDataFrame([("a", ["x", "x", "z"])], "span string, tokens array<string>")
    assert {(r.span, r.token): r.c for r in C.increase_all(t, rows, 2).collect()} == {("a", "x"): 5.0, ("a", "z"): 2.0, ("b", "y"): 2.0}
    other = spark.createDataFrame([("a", "x", 9.0), ("q", "y", 9.0)], "span string, token string, c double")
    assert [tuple(r) for r in C.replace(t, other).collect()] == [("a", "x", 9.0)]


def test_words_take_the_source_of_their_links(spark):
    rows = spark.createDataFrame([(1, "le chat, noir", "the black cat"), (2, "a b", "c"), (3, None, "x"), (4, "a", " ")], "line_no long, src string, trg string")
    al = spark.createDataFrame([(1, [(1, 2), (2, 1), (9, 0)]), (1, [(1, 2)]), (2, None)], "line_no long, links array<struct<si:int,ti:int>>")
    got = {(r.line_no, r.pos.j, r.pos.k): (r.src, r.word) for r in corpus.words_with_sources(rows, al).collect()}
    assert got == {(1, 0, 0): (["le", "chat", ",", "noir"], "▁the"), (1, 1, 0): (["noir"], "▁black"), (1, 2, 0): (["chat", ","], "▁cat"), (2, 0, 0): (["a", "b"], "▁c")}
    pairs = corpus.prepared(rows)
    table = C.cooccurrence(pairs)
    out = {r.line_no: "".join(r.tokens) for r in L.tokenize_words(pairs, corpus.words_with_sources(rows, al), table).collect()}
    assert out == {1: "▁the▁black▁cat", 2: "▁c", 4: ""}


def test_initial_spans_and_losses(spark):
    p = spark.createDataFrame([(i, ["a"], "▁ab▁ab" if i % 2 else "▁cd") for i in range(20)], "line_no long, src array<string>, trg string")
    spans = {r[0] for r in L.initial_spans(p, 5, runs=2, maxlen=3).collect()}
    assert {"▁", "a", "b", "c", "d"} & spans
    losses: list[float] = []
    L.train(p, 6, n_iter=2, maxlen=3, spans=spark.createDataFrame([(s,) for s in ("▁", "a", "b", "c", "d", "▁ab", "▁cd")], "span string"), losses=losses)
    assert losses and all(x <= 0 for x in losses)


def test_word_aligner(spark):
    lexicon = {"haus": "house", "buch": "book", "das": "the", "ein": "a", "rot": "red", "alt": "old"}
    rnd = random.Random(3)
    lines = [(i, s, [lexicon[w] for w in s]) for i in range(60) for s in [rnd.sample(sorted(lexicon), 3)]]
    links = A.align_words(spark.createDataFrame(lines, "line_no long, s array<string>, t array<string>"), 4).collect()
    assert len(links) == 60
    right = sum(x.si == x.ti for r in links for x in r.links)
    assert right >= 0.95 * 180


def phrase_loop(links, n, m):
    """The same ranges by trying every range in turn."""
    out, at, last = [], 0, None
    for i in range(n):
        inside = [t for s, t in links if at <= s <= i]
        lo, hi = (min(inside), max(inside)) if inside else (m - 1, -1)
        if not any(lo <= t <= hi and not at <= s <= i for s, t in links):
            last = (at, i, lo, hi)
        elif last:
            out.append(last)
            at, last = i, None
    return out + ([last] if last else [])


def test_phrases_against_loops(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for i in range(80):
        n, m = rnd.randint(1, 9), rnd.randint(1, 9)
        links = sorted({(rnd.randrange(n), rnd.randrange(m)) for _ in range(rnd.randint(0, 10))})
        rows.append((i, links, n, m))
        want[i] = phrase_loop(links, n, m)
    df = spark.createDataFrame(rows, "i long, links array<struct<si:int,ti:int>>, n int, m int")
    got = {r.i: [tuple(x) for x in r.p] for r in df.select("i", A.phrase_spans(F.col("links"), F.col("n"), F.col("m")).alias("p")).collect()}
    assert got == want
