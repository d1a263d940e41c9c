"""Every pair that reaches the threshold is found, whatever the edits, the order of the words and the size of the texts."""

import random
import re

import pytest

from spanforge.llm import split_overlap as O


def words(x):
    return set(re.findall(r"[^\W_]+", x.lower())) if x else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def pairs_of(kind, rnd):
    rows = []
    for i in range(0, 240, 2):
        n = rnd.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 14, 20, 27, 54, 90, 200])
        w = [f"w{i}x{k}" for k in range(n)]
        v = list(w)
        if kind == "inserted":
            v = [y for k, x in enumerate(w) for y in ([x, f"new{i}x{k}"] if k % 4 == 3 else [x])]
        elif kind == "replaced":
            for k in range(4, n, 9):
                v[k] = f"new{i}x{k}"
        elif kind == "removed":
            v = [x for k, x in enumerate(w) if k % 5 != 2]
        else:
            rnd.shuffle(v)
            v = v[: max(1, n - n // 6)]
        a, b = (w, v) if rnd.random() < 0.5 else (v, w)
        rows += [(i, "dev", " ".join(a), None), (i + 1, "train", None, " ".join(b))]
    return rows


@pytest.mark.parametrize("kind", ["inserted", "replaced", "removed", "reordered"])
def test_no_edit_loses_a_pair(spark, kind):
    rows = pairs_of(kind, random.Random(kind))
    want = {(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2]) if words(a[2]) and alike(words(a[2]), words(b[3]))}
    df = spark.createDataFrame(rows, "line_no long, split string, src string, trg string")
    assert len(want) > 60
    assert {tuple(r) for r in O.overlaps(df, "line_no", "split", ("src", "trg")).collect()} == want


def test_short_texts_of_common_words(spark, monkeypatch):
    rnd = random.Random(5)
    pool = [f"c{k}" for k in range(14)]
    rows = [(i, rnd.choice(["dev", "train", None]), " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9))), None) for i in range(400)]
    want = {(a[0], b[0]) for a in rows if a[1] == "dev" for b in rows if b[1] != "dev" and alike(words(a[2]), words(b[2]))}
    df = spark.createDataFrame(rows, "line_no long, split string, src string, trg string")
    assert {tuple(r) for r in O.overlaps(df, "line_no", "split", ("src", "trg")).collect()} == want and len(want) > 50
    monkeypatch.setattr(O, "CHECK_ROWS", 3)  # the same with joins in place of broadcasts
    assert {tuple(r) for r in O.overlaps(df, "line_no", "split", ("src", "trg")).collect()} == want


def test_report_and_fractions(spark):
    one = "the quick brown fox jumps over the lazy dog and runs far away from here"
    two = "eight other words that stand in no text"
    rows = [(1, "dev", "s", one, two), (2, "dev", None, one + " now", None), (3, "devtest", "s", None, "nothing like it at all")]
    rows += [(10 + i, "train", "t", one, two) for i in range(50)] + [(90, None, "t", two, one), (91, "train", "u", "", None)]
    df = spark.createDataFrame(rows, "line_no long, split string, source string, src string, trg string")
    got = {(r.split, r.source): (r.pairs, r.eval_rows, r.train_rows) for r in O.report(df, "line_no", "split", ["split", "source"], ("src", "trg")).collect()}
    assert got == {("dev", "s"): (51, 1, 51), ("dev", None): (51, 1, 51)}
    f = {(r.id, r.field): r.fraction for r in O.fractions(df, "line_no", "split", ("src", "trg")).collect()}
    assert f[(1, "src")] == f[(1, "trg")] == 1.0 and 0 < f[(2, "src")] <= 14 / 15 and len(f) == 3
    assert O.report(df.limit(0), "line_no", "split", ["split", "source"], ("src", "trg")).count() == 0
