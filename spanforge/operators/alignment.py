"""Alignment operators: consistent phrases, symmetrisation of two directions, and a lexical translation model with its word links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from spanforge.common import materialise, ship
from spanforge.operators.lattice import let

PHRASE = "struct<s_start:int,s_end:int,t_start:int,t_end:int>"


def phrase_spans(links: Column, s_len: Column, t_len: Column) -> Column:
    """Longest consistent phrases from left to right (inclusive places).

    A source range grows while no link leaves its target range for a source word outside it; when it no longer can, the
    last range that was consistent is given and the next one starts at the word that failed.  A range without links has
    the empty target range (t_len - 1, -1).  The first and last partner of every place are found once; a range is
    consistent if those of its target places lie within it."""
    state = f"struct<at:int,lo:int,hi:int,last:{PHRASE},out:array<{PHRASE}>>"

    def partners(n: Column, own: str, other: str, pick) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: pick(F.transform(F.filter(links, lambda x: x[own] == k), lambda x: x[other])))

    t_all = F.greatest(t_len, F.coalesce(F.array_max(F.transform(links, lambda x: x["ti"])) + 1, F.lit(1)))
    ends = F.struct(
        partners(s_len, "si", "ti", F.array_min).alias("lo_t"), partners(s_len, "si", "ti", F.array_max).alias("hi_t"),
        partners(t_all, "ti", "si", F.array_min).alias("lo_s"), partners(t_all, "ti", "si", F.array_max).alias("hi_s"))

    def walk(e: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            grown = F.struct(F.least(acc["lo"], F.get(e["lo_t"], i)).alias("lo"), F.greatest(acc["hi"], F.get(e["hi_t"], i)).alias("hi"))

            def decide(g: Column) -> Column:
                inside = lambda c: F.slice(c, g["lo"] + 1, g["hi"] - g["lo"] + 1)
                good = F.when(g["lo"].isNull(), F.lit(True)).otherwise((F.array_min(inside(e["lo_s"])) >= acc["at"]) & (F.array_max(inside(e["hi_s"])) <= i))
                phrase = F.struct(acc["at"].alias("s_start"), i.cast("int").alias("s_end"), F.coalesce(g["lo"], t_len - 1).cast("int").alias("t_start"), F.coalesce(g["hi"], F.lit(-1)).cast("int").alias("t_end"))
                kept = F.struct(acc["at"].alias("at"), g["lo"].alias("lo"), g["hi"].alias("hi"), phrase.alias("last"), acc["out"].alias("out"))
                restart = F.struct(i.cast("int").alias("at"), F.get(e["lo_t"], i).alias("lo"), F.get(e["hi_t"], i).alias("hi"), F.lit(None).cast(PHRASE).alias("last"), F.array_append(acc["out"], acc["last"]).alias("out"))
                waiting = F.struct(acc["at"].alias("at"), g["lo"].alias("lo"), g["hi"].alias("hi"), acc["last"].alias("last"), acc["out"].alias("out"))
                return F.when(good, kept).when(acc["last"].isNotNull(), restart).otherwise(waiting).cast(state)

            return let(grown, decide)

        none = F.lit(None)
        start = F.struct(F.lit(0).alias("at"), none.cast("int").alias("lo"), none.cast("int").alias("hi"), none.cast(PHRASE).alias("last"), F.array().cast(f"array<{PHRASE}>").alias("out")).cast(state)
        done = lambda a: F.when(a["last"].isNotNull(), F.array_append(a["out"], a["last"])).otherwise(a["out"])
        return F.aggregate(F.sequence(F.lit(0), s_len - 1), start, step, done)

    return F.when(s_len > 0, let(ends, walk)).otherwise(F.array().cast(f"array<{PHRASE}>"))


def phrases(rows: DataFrame, align: DataFrame) -> DataFrame:
    """(line_no, src_phrase, trg_phrase) of each aligned line."""
    blank = "[ \\t\\r\\n]+"
    cut = lambda c: F.filter(F.split(c, blank), lambda x: x != "")
    both = rows.select("line_no", cut(F.col("src")).alias("s"), cut(F.col("trg")).alias("t")).where("s is not null and t is not null").join(align.where("links is not null"), "line_no")
    each = both.select("line_no", "s", "t", F.explode(phrase_spans(F.col("links"), F.size("s"), F.size("t"))).alias("p"))
    part = lambda c, a, b: F.array_join(F.when(b >= a, F.slice(c, a + 1, b - a + 1)).otherwise(F.array().cast("array<string>")), " ")
    return each.select("line_no", "p.*", part(F.col("s"), F.col("p.s_start"), F.col("p.s_end")).alias("src_phrase"), part(F.col("t"), F.col("p.t_start"), F.col("p.t_end")).alias("trg_phrase"))


def grown(si: list[int], ti: list[int], side: list[int]) -> list[int]:
    """Places of the links (si, ti) of one line that symmetrisation keeps; side is 1 for a forward and 2 for a backward link."""
    at: dict[tuple[int, int], int] = {}
    sides: dict[tuple[int, int], int] = {}
    for i, (k, x) in enumerate(zip(zip(si, ti), side)):
        at.setdefault(k, i)
        sides[k] = sides.get(k, 0) | x
    got = {k for k, x in sides.items() if x == 3}
    rest = sides.keys() - got
    s, t = {k[0] for k in got}, {k[1] for k in got}
    new = got
    while new:
        rest = {k for k in rest if k not in new}
        new = {(x, y) for x, y in rest if (x not in s or y not in t) and any((x + a, y + c) in got for a in (-1, 0, 1) for c in (-1, 0, 1))}
        got = got | new
        s, t = s | {k[0] for k in new}, t | {k[1] for k in new}
    first: dict[int, int] = {}  # of each free source word its first free target word, then of each target word its first source word
    for x, y in rest:
        if x not in s and y not in t:
            first[x] = min(y, first.get(x, y))
    last: dict[int, int] = {}
    for x, y in first.items():
        last[y] = min(x, last.get(y, x))
    return [at[k] for k in (*got, *((x, y) for y, x in last.items()))]


@F.pandas_udf(ArrayType(IntegerType()))
def _grown(si: pd.Series, ti: pd.Series, side: pd.Series) -> pd.Series:
    return pd.Series([grown(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(si, ti, side)], dtype=object)


def symmetrise(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(line_no, si, ti): grow-diag-final-and of two link sets, line by line.

    The intersection grows by union links that neighbour a link and bring in a word without one, until it grows no more; at
    the end union links of which both words are still free are added.  Links added in one round see the links of the
    round before, which keeps the result independent of order."""
    ship(forward.sparkSession)
    key = ["line_no", "si", "ti"]
    both = forward.select(*key, F.lit(1).alias("side")).union(backward.select(*key, F.lit(2).alias("side")))
    of_line = both.groupBy("line_no").agg(F.collect_list(F.struct("si", "ti", "side")).alias("l"))  # links of one line
    kept = of_line.select("line_no", "l", F.explode(_grown(F.col("l.si"), F.col("l.ti"), F.col("l.side"))).alias("i"))
    return kept.select("line_no", F.get("l", F.col("i")).alias("k")).select("line_no", "k.si", "k.ti")


def lexical_step(pairs: DataFrame, t: DataFrame | None = None) -> DataFrame:
    """(src, trg, p): one expectation-maximisation step of the first lexical translation model over lines (line_no, s, t); uniform where no table is given.

    From the uniform start the share of a source word is one over the number of source words of its line, so nothing but
    the sums is shuffled."""
    if t is None:
        each = pairs.where("size(s) > 0").select((1.0 / F.size("s")).alias("share"), "s", F.explode("t").alias("trg")).select("share", "trg", F.explode("s").alias("src"))
    else:
        each = pairs.select("line_no", F.posexplode("t").alias("j", "trg"), "s").select("line_no", "j", "trg", F.explode("s").alias("src")).join(t.select("src", "trg", "p"), ["src", "trg"])
        each = each.groupBy("line_no", "j", "trg").agg(F.collect_list(F.struct("src", "p")).alias("of"), F.sum("p").alias("z"))  # the source words of one line
        each = each.select("trg", "z", F.explode("of").alias("o")).select("trg", F.col("o.src").alias("src"), (F.col("o.p") / F.col("z")).alias("share"))
    c = materialise(each.groupBy("src", "trg").agg(F.sum("share").alias("c")), "lexical")
    return c.join(c.groupBy("src").agg(F.sum("c").alias("cs")), "src").select("src", "trg", (F.col("c") / F.col("cs")).alias("p"))


def lexical_model(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """(src, trg, p) after some rounds, each written."""
    t = None
    for _ in range(rounds):
        t = materialise(lexical_step(pairs, t), "lexical")
    return t


def best_links(pairs: DataFrame, t: DataFrame) -> DataFrame:
    """(line_no, si, ti): for each target word the likeliest source word of its line, the first of equals."""
    each = pairs.select("line_no", F.posexplode("t").alias("ti", "trg"), "s").select("line_no", "ti", "trg", F.posexplode("s").alias("si", "src")).join(t.select("src", "trg", "p"), ["src", "trg"])
    return each.groupBy("line_no", "ti").agg(F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("si")).alias("at"))).alias("b")).select("line_no", (-F.col("b.at")).cast("int").alias("si"), "ti")


def align_words(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """(line_no, links) of lines (line_no, s, t): a lexical model in each direction, then both directions made one."""
    turned = pairs.select("line_no", F.col("t").alias("s"), F.col("s").alias("t"))
    forward = materialise(best_links(pairs, lexical_model(pairs, rounds)), "forward")
    backward = best_links(turned, lexical_model(turned, rounds)).select("line_no", F.col("ti").alias("si"), F.col("si").alias("ti"))
    both = symmetrise(forward, materialise(backward, "backward"))
    return both.groupBy("line_no").agg(F.sort_array(F.collect_list(F.struct("si", "ti"))).alias("links"))  # links of one line
