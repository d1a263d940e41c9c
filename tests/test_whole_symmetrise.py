"""Symmetrisation of many lines ends, and a line is given what its own rounds give."""

import random


def rounds(f, b):
    union, got = f | b, f & b
    while True:
        s, t = {x for x, _ in got}, {y for _, y in got}
        near = {(x + i, y + j) for x, y in got for i in (-1, 0, 1) for j in (-1, 0, 1)}
        new = {(x, y) for x, y in (union - got) & near if x not in s or y not in t}
        if not new:
            break
        got |= new
    free = sorted((x, y) for x, y in union if x not in s and y not in t)
    own = {x: min(b for a, b in free if a == x) for x, _ in free}
    return got | {(min(a for a, b in own.items() if b == y), y) for y in own.values()}


def test_lines(spark):
    from spanforge.operators import alignment as A

    r, want, fwd, bwd = random.Random(5), set(), [], []
    for line in range(400):
        n = 60 if line == 7 else 9  # one line grows for many more rounds than the others
        f = {(i, i + r.choice((0, 0, 1))) for i in range(n)} if line == 7 else {(r.randrange(n), r.randrange(n)) for _ in range(n)}
        b = {(0, 0)} | {(i, i + r.choice((0, 0, 1))) for i in range(n)} if line == 7 else {(r.randrange(n), r.randrange(n)) for _ in range(n)}
        fwd += [(line, *k) for k in f for _ in range(2)]  # repeated links count once
        bwd += [(line, *k) for k in b]
        want |= {(line, *k) for k in rounds(f, b)}
    frame = lambda x: spark.createDataFrame(x, "line_no long, si int, ti int")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("symmetrise", "")
    got = [tuple(k) for k in A.symmetrise(frame(fwd), frame(bwd)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert len(jobs.getJobIdsForGroup("symmetrise")) < 10  # before, some jobs for each round of the line that grows longest
