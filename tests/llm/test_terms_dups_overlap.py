import random
import re

from spanforge.common import scratch
from spanforge.llm import format_dups as D
from spanforge.llm import npwords
from spanforge.llm import split_overlap as O
from spanforge.llm import term_counts as T


def counts(led):
    return {(r.field, r.term): (r.occurrences, r.records) for r in led.read().collect()}


def test_deltas_add_change_delete(spark):
    a = spark.createDataFrame([("x y x",), ("y\t z  z ",), (None,), ("",), (" \n",), ("a\u00a0b",)], "t string")
    path = scratch(spark, "t")
    led = T.TermLedger(spark, path, 4).apply("1", [T.text_deltas(a, "t", "t")])
    assert counts(led) == {("t", "x"): (2, 1), ("t", "y"): (2, 2), ("t", "z"): (2, 1), ("t", "a\u00a0b"): (1, 1)} and led.sums == {"t": 5}
    old = spark.createDataFrame([("x y x",)], "t string")
    new = spark.createDataFrame([("x q",)], "t string")
    led = T.TermLedger(spark, path)  # opened again
    assert led.state.buckets == 4 and led.sums == {"t": 5}
    led.apply("2", [T.text_deltas(old, "t", "t", -1), T.text_deltas(new, "t", "t")])
    want = {("t", "x"): (1, 1), ("t", "y"): (1, 1), ("t", "z"): (2, 1), ("t", "a\u00a0b"): (1, 1), ("t", "q"): (1, 1)}
    assert counts(led) == want and led.sums == {"t": 5}
    led.apply("3", [T.text_deltas(a.limit(0), "t", "t")])
    again = T.TermLedger(spark, path).apply("2", [T.text_deltas(new, "t", "t")])  # a batch given twice
    assert counts(again) == want and again.sums == {"t": 5}


def test_a_failed_batch_leaves_no_trace(spark):
    path = scratch(spark, "t")
    a = spark.createDataFrame([("x y",)], "t string")
    led = T.TermLedger(spark, path, 2).apply("1", [T.text_deltas(a, "t", "t")])
    led.state.merge("terms", T.text_deltas(a, "t", "t"))  # staged and never committed
    led = T.TermLedger(spark, path)
    assert counts(led) == {("t", "x"): (1, 1), ("t", "y"): (1, 1)}
    assert counts(led.apply("2", [T.text_deltas(a, "t", "t")])) == {("t", "x"): (2, 2), ("t", "y"): (2, 2)}


def test_group_records_and_marks(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "a"), (2, "b"), (3, "c"), (3, ""), (4, None)], "e int, v string")
    of = lambda rows, sign=1: T.member_deltas(rows, "e", "v", "vocab", sign)
    led = T.TermLedger(spark, scratch(spark, "t"), 2).apply("1", [], [of(v.where("e < 3"))])
    led.apply("2", [], [of(v.where("e >= 3")), of(v.where("e = 1"))])  # the first record comes in two batches
    assert counts(led) == {("vocab", "a"): (5, 2), ("vocab", "b"): (1, 1), ("vocab", "c"): (1, 1), ("vocab", ""): (1, 1)} and led.sums == {"vocab": 4}
    led.apply("3", [], [of(v.where("e = 1"), -1), of(v.where("e = 2"), -1)])
    assert counts(led) == {("vocab", "a"): (2, 1), ("vocab", "c"): (1, 1), ("vocab", ""): (1, 1)} and led.sums == {"vocab": 3}
    marks = {r.term: r.mark for r in led.marked({"vocab": 1}, {"vocab": 0.3}).collect()}
    assert marks == {"a": "common", "c": "rare", "": "rare"}


def test_empty_first_batch(spark):
    led = T.TermLedger(spark, scratch(spark, "t"), 2).apply("1", [T.text_deltas(spark.createDataFrame([], "t string"), "t", "t")])
    assert counts(led) == {}


ROWS = [(1, "Ab, c", "X y"), (2, "abc", "xy"), (3, "XY!", "a b c"), (4, None, "q"), (5, "...", "q"), (6, "abc", "xz"), (7, "abc", "xy"), (8, "", "")]


def test_copies(spark):
    rows = spark.createDataFrame([(*r, "z") for r in ROWS], "line_no long, src string, trg string, id string")
    k = D.keyed(rows, "line_no", "src", "trg")
    led = D.CopyLedger(spark, scratch(spark, "c"), 4).add("1", k)
    assert {tuple(r) for r in D.other_copies(k, led).collect()} == {(1, 2), (1, 3), (1, 7)}
    more = D.keyed(spark.createDataFrame([(0, "ABC", "XY"), (9, "new", "one")], "line_no long, src string, trg string"), "line_no", "src", "trg")
    led = D.CopyLedger(spark, led.state.path).add("2", more).add("1", k)  # opened again; the first batch once more
    got = {(r.first, r.copies) for r in led.read().collect()}
    assert got == {(0, 5), (6, 1), (9, 1)}


def test_hot_copies(spark):
    rows = spark.range(3000).selectExpr("id as line_no", "case when id % 3 = 0 then 'same' else concat('t', id) end as src", "'y' as trg")
    k = D.keyed(rows, "line_no", "src", "trg")
    got = D.other_copies(k, D.CopyLedger(spark, scratch(spark, "c"), 4).add("1", k))
    assert got.count() == 999 and got.select("first_line").distinct().first()[0] == 0
    wide = spark.range(900_000).selectExpr("id as line_no", "case when id % 3 = 0 then 'same' when id % 9 = 1 then concat('p', floor(id / 18)) else concat('t', id) end as src", "'y' as trg")
    k = D.keyed(wide, "line_no", "src", "trg")
    a = D.other_copies(k, D.CopyLedger(spark, scratch(spark, "c"), 4).add("1", k))
    assert a.count() == 299_999 + 50_000


def test_words_kernel():
    texts = ["Ab, c-d", None, "", "É_x ２", "a\0b"]
    h, t = npwords.words(texts)
    want = [(i, w) for i, x in enumerate(texts) if x for w in re.findall(r"[^\W_]+", x.lower())]
    assert t.tolist() == [i for i, _ in want]
    by = {}
    for x, (_, w) in zip(h.tolist(), want):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def words(x):
    return set(re.findall(r"[^\W_]+", x.lower())) if x else set()


def test_overlap_against_brute_force(spark):
    rnd = random.Random(7)
    pool = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(pool) for _ in range(rnd.randint(3, 40))] for _ in range(40)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(pool)
        other = None if i % 17 == 0 else "" if i % 13 == 0 else " ".join(rnd.choice(pool) for _ in range(12))
        rows.append((i, rnd.choice(["dev", "devtest", "train", "train", None]), " ".join(w), other))
    rows += [(1000 + i, "train", "copy copy of all", "x") for i in range(60)] + [(2000, "dev", "Copy of, all", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "line_no long, split string, src string, trg string, cls int")
    got = {tuple(r) for r in O.overlaps(df, "line_no", "split", ("src", "trg")).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] in O.EVAL and b[1] not in O.EVAL:
                for x in map(words, a[2:4]):
                    for y in map(words, b[2:4]):
                        if x and y and len(x & y) >= 0.8 * len(x | y):
                            want.add((a[0], b[0]))
    assert got == want and len(want) > 60


def test_overlap_long_and_empty(spark):
    long = " ".join(f"t{i}" for i in range(5000))
    df = spark.createDataFrame([(1, "dev", long, None), (2, "train", long + " more", ""), (3, "train", None, " ")], "line_no long, split string, src string, trg string")
    assert {tuple(r) for r in O.overlaps(df, "line_no", "split", ("src", "trg")).collect()} == {(1, 2)}
    assert O.overlaps(df.limit(0), "line_no", "split", ("src", "trg")).count() == 0
