import math
import random

import pytest

from spanforge.operators import alignment as A
from spanforge.operators import counts as C
from spanforge.operators import lattice as L


@pytest.fixture(scope="module")
def table(spark):
    p = spark.createDataFrame([(1, ["a", "b"], "▁xy"), (2, ["a"], "▁xz")], "line_no long, src array<string>, trg string")
    t = C.cooccurrence(p).cache()
    t.count()
    return t


UNIT = "src array<string>, word string, n long"


def test_viterbi_fixture(spark, table):
    u = spark.createDataFrame([(["a", "b"], "▁xy", 1)], UNIT)
    r = L.viterbi(u, table, "cond-exact", 3).first()
    assert r.tokens == ["▁x", "y"] and abs(r.loss + 3.988984) < 1e-6
    r = L.viterbi(u, table, "cond-exact", 3, inclusive=True).first()
    assert r.tokens == ["▁xy"] and abs(r.loss + 2.197225) < 1e-6


def brute(src, word, cells, maxlen, low):
    ct = {}
    for (_, t), c in cells.items():
        ct[t] = ct.get(t, 0) + c
    spans = {s for s, _ in cells}
    alphabet = {c for s in spans for c in s}
    best, size = [0.0], [0]
    for i in range(1, len(word) + 1):
        b, z = None, None
        if word[i - 1] in alphabet:
            for j in range(i - 1, max(-1, i - maxlen - 1), -1):
                s = word[j:i]
                if s in spans:
                    num = sum(cells.get((s, t), 0) for t in src)
                    den = sum(ct.get(t, 0) for t in src)
                    v = best[j] + (math.log(num) - math.log(den) if num else low)
                    if b is None or v > b + 1e-12:
                        b, z = v, i - j
        best.append(0.0 if b is None else b)
        size.append(1 if b is None else z)
    toks, i = [], len(word)
    while i:
        toks.insert(0, word[i - size[i] : i])
        i -= size[i]
    return best[-1], toks


def test_viterbi_against_loops(spark):
    rnd = random.Random(4)
    lines = [(i, [rnd.choice("pqr") for _ in range(rnd.randint(1, 3))], "▁" + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))) for i in range(25)]
    t = C.cooccurrence(spark.createDataFrame(lines, "line_no long, src array<string>, trg string"), 4).cache()
    cells = {(r.span, r.token): r.c for r in t.collect()}
    units = sorted({(tuple(s), w) for _, s, w in lines} | {(("p", "zz"), "▁abcabc"), (("zz",), "▁aZb"), (("q",), "▁")})
    got = {(tuple(r.src), r.word): (r.loss, r.tokens) for r in L.viterbi(spark.createDataFrame([(list(s), w, 1) for s, w in units], UNIT), t, "cond-exact", 4, inclusive=True).collect()}
    assert len(got) == len(units)
    for s, w in units:
        loss, toks = brute(s, w, cells, 4, min(cells.values()))
        assert abs(got[(s, w)][0] - loss) < 1e-9 and "".join(got[(s, w)][1]) == w
        assert len(got[(s, w)][1]) == len(toks)


def test_expected_counts_fixture(spark, table):
    e = {(r.span, r.token): r.c for r in L.expected_counts(spark.createDataFrame([(["a", "b"], "▁xy", 1)], UNIT), table).collect()}
    want = {"▁": 0.016, "▁x": 0.0133333, "▁xy": 0.0666667, "x": 0.0026667, "xy": 0.0133333, "y": 0.016}
    for s, v in want.items():
        assert abs(e[(s, "a")] - v) < 1e-6 and abs(e[(s, "b")] - v) < 1e-6
    twice = {(r.span, r.token): r.c for r in L.expected_counts(spark.createDataFrame([(["a", "b"], "▁xy", 2)], UNIT), table).collect()}
    assert all(abs(twice[k] - 2 * v) < 1e-9 for k, v in e.items())


def test_tokenize_and_train(spark):
    p = spark.createDataFrame([(1, ["a"], "▁ab▁ab"), (2, ["b"], "▁ab▁cd"), (3, [], "▁")], "line_no long, src array<string>, trg string")
    for method in ("em", "mc"):
        t = L.train(p, 6, method=method, n_iter=2, maxlen=3)
        assert t.select("span").distinct().count() <= 10
    got = {r.line_no: r.tokens for r in L.tokenize(p, C.cooccurrence(p), maxlen=4).collect()}
    assert "".join(got[1]) == "▁ab▁ab" and "".join(got[2]) == "▁ab▁cd"


def test_phrases(spark):
    s = "michael assumes that he will stay in the house"
    t = "michael geht davon aus , dass er im haus bleibt"
    links = [tuple(map(int, x.split("-"))) for x in "0-0 1-1 1-2 1-3 2-5 3-6 4-9 5-9 6-7 7-7 8-8".split()]
    rows = spark.createDataFrame([(1, s, t), (2, None, "x"), (3, "a b", "c")], "line_no long, src string, trg string")
    al = spark.createDataFrame([(1, links), (2, [(0, 0)]), (3, None)], "line_no long, links array<struct<si:int,ti:int>>")
    got = [(r.s_start, r.s_end, r.t_start, r.t_end) for r in A.phrases(rows, al).orderBy("s_start").collect()]
    assert got == [(0, 3, 0, 6), (4, 5, 9, 9), (6, 8, 7, 8)]


def test_symmetrise(spark):
    k = "line_no long, si int, ti int"
    f = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 4, 4)], k)
    b = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2)], k)
    got = {(r.si, r.ti) for r in A.symmetrise(f, b).collect()}
    assert {(0, 0), (1, 1), (1, 0), (2, 2), (4, 4)} >= got >= {(0, 0), (1, 1), (2, 2), (4, 4)}


def test_lexical_step(spark):
    p = spark.createDataFrame([(1, ["das", "haus"], ["the", "house"]), (2, ["das"], ["the"])], "line_no long, s array<string>, t array<string>")
    t = A.lexical_step(p)
    one = {(r.src, r.trg): r.p for r in t.collect()}
    assert abs(one[("das", "the")] - 0.75) < 1e-9
    two = {(r.src, r.trg): r.p for r in A.lexical_step(p, t).collect()}
    assert two[("das", "the")] > one[("das", "the")]
