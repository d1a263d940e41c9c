import os

import numpy as np
import pytest

from spanforge.llm import encoding as E
from spanforge.llm import packing as K
from spanforge.llm import subjects as S

TEXTS = ["Hello world", "", None, "<|endoftext|> a  b\n\n c\t", "ünïcödé 漢字 😀‍", " " * 50, "a" * 20_000, "it's they'll 12345 ...", "\0x"]
need = pytest.mark.skipif(not os.path.exists(E.RANKS), reason="no tokenizer files")


@need
def test_ids_equal_other_library_and_round_trip(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=E.load_ranks(E.RANKS), special_tokens={})
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    c = E.codec(E.RANKS, E.PATTERN)
    for r in E.encode(rows, "doc_id", "text").collect():
        assert r.ids == (enc.encode_ordinary(TEXTS[r.doc_id]) if TEXTS[r.doc_id] else [])
        assert c.decode(r.ids) == (TEXTS[r.doc_id] or "")
    assert {r.doc_id: r.text for r in E.decode(E.encode(rows, "doc_id", "text"), "doc_id").collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    n = {r.doc_id: r.n for r in E.token_counts(rows, "doc_id", "text").collect()}
    assert n[1] == n[2] == 0 and n[0] == 2


def test_assign():
    rnd = np.random.default_rng(1)
    for cap in (64, 512):
        sizes = np.sort(rnd.integers(0, cap + 1, 3000))[::-1]
        seq = K.assign(sizes, cap)
        load = np.bincount(seq, sizes)
        assert load.max() <= cap
        assert len(load) <= 1.02 * max(sizes.sum() / cap, (sizes * 2 > cap).sum()) + 2
    assert K.assign(np.array([], np.int64), 10).tolist() == []
    assert len(set(K.assign(np.zeros(5, np.int64), 10).tolist())) == 1


def test_pack(spark):
    counts = spark.createDataFrame([(i, n, i) for i, n in enumerate([0, 5, 25, 10, 10, 3, 30])] + [(2, 4, 99)], "doc_id long, n long, slot long")
    w = spark.createDataFrame([(1, "t", 10), (2, "t", 100)], "window_id int, tokenizer string, capacity int")
    got = K.pack(counts, w, "doc_id").collect()
    for win, cap in ((1, 10), (2, 100)):
        rows = [r for r in got if r.window_id == win]
        load = {}
        for r in rows:
            load[r.container] = load.get(r.container, 0) + r.n_tokens
        assert sum(load.values()) == 87 and max(load.values()) <= cap and len(load) == -(-87 // cap)
        assert len([r for r in rows if r.doc_id == 6]) == (3 if cap == 10 else 1)
        assert [r.n_tokens for r in rows if r.doc_id == 0] == [0]
    assert K.pack(counts.limit(0), w, "doc_id").count() == 0


NOUNS = {"food": ["bread", "soup", "cheese"], "law": ["judge", "court", "lawyer"]}


def corpus(n):
    rnd = np.random.default_rng(2)
    docs, truth = [], {}
    for i in range(n):
        subs = [["food"], ["law"], ["food", "law"]][i % 3]
        noun = lambda s: NOUNS[s][rnd.integers(3)]
        body = [f"we think the {noun(s)} is good and the {noun(s)} was old number{rnd.integers(50)}." for s in subs for _ in range(3)]
        docs.append((i, " ".join(body)))
        truth[i] = set(subs)
    return docs, truth


def test_subjects(spark, monkeypatch):
    docs, truth = corpus(240)
    docs += [(1000, None), (1001, ""), (1002, "one two"), (1003, "nothing of note is said in here at all.")]
    labels = [(i, " Food " if i % 3 == 0 else "LAW", 1) for i in range(0, 60) if i % 3 < 2] + [(0, None, 2), (0, "food", 3), (1, "unknown", 1), (None, "law", 1), (1000, "law", 1)]
    got = {}
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, terms string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator int")
    subs = spark.createDataFrame([("food", "x"), ("law", "y")], "subject string, about string")
    for r in S.shares(df, lab, subs).collect():
        got.setdefault(r.doc_id, {})[r.subject] = r.part
    assert not got.keys() & {1000, 1001, 1002, 1003}
    right = sum({k for k, v in got.get(i, {}).items() if v >= 0.2} == t for i, t in truth.items())
    assert right >= 0.95 * len(truth)
    monkeypatch.setattr(S, "MAX_ACTIVE", 2)  # the parts of the terms joined in place of broadcast
    again = {}
    for r in S.shares(df, lab, subs).collect():
        again.setdefault(r.doc_id, {})[r.subject] = r.part
    assert again == got
    assert S.shares(df, lab, subs.limit(1)).count() == 0
    assert S.shares(df.limit(0), lab, subs).count() == 0
    assert S.shares(df, lab.limit(0), subs).count() == 0
