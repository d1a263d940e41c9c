"""Problem 8: items of varying length into containers of fixed capacity.

Cost-balanced packing: the cost of an item is estimated as linear plus quadratic in its length (attention), and items in
descending order go to the sequence of least cost that still has room for them.  As many sequences as the items need at least
are open from the start, and one more where none has room.  Sequences are kept by room in steps of 1 / STEPS of the capacity;
in the one step that holds rooms on either side of an item, the sequence of least cost is asked first and the others only if
no step above has any.  An item above the capacity is split into
full containers and a rest, no other item is.

Items are spread over groups of about GROUP by a hash and each group is packed by one task, so a task's work is bounded
and the loss is at most about one part-filled container a group; the number of groups follows the number of items.

Defined results: null and empty texts have no tokens and lie, as a piece of length 0, in some container; ties in cost go
to the first sequence, ties in length by id; repeated rows are items of their own; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.common import materialise, ship, table
from spanforge.llm.encoding import TOKENIZERS, token_counts

GROUP = 8192
STEPS = 64
QUADRATIC = 1 / 4096  # weight of length squared against length


def cost_of(n: np.ndarray | int) -> np.ndarray | float:
    """Estimated cost of an item: linear plus quadratic in its length."""
    return n + QUADRATIC * n * n


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence of each item; sizes descend and none is above the capacity."""
    step = max(1, capacity // STEPS)
    steps = capacity // step + 1
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(steps)]  # by room: (cost, sequence, room)
    least = np.full(steps, np.inf)  # least cost of each heap
    opened = -(-int(sizes.sum()) // capacity)  # as many as the items need at least
    heaps[capacity // step] = [(0.0, k, capacity) for k in range(opened)]
    least[capacity // step] = 0.0 if opened else np.inf
    out = np.empty(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        low = n // step  # this heap holds rooms on either side of n, all above it have room
        h = low + 1 + int(least[low + 1 :].argmin()) if low + 1 < steps else low
        found = None
        if low + 1 < steps and least[h] < np.inf:
            found = heaps[h][0]
        near = heaps[low]
        if near and (found is None or near[0][0] < found[0]):
            fit = near[0] if near[0][2] >= n else min((x for x in near if x[2] >= n), default=None) if found is None else None
            if fit is not None:
                found, h = fit, low
        if found is None:
            cost, k, room = 0.0, opened, capacity
            opened += 1
        else:
            cost, k, room = found
            if heaps[h][0] is found:
                heapq.heappop(heaps[h])
            else:
                heaps[h].remove(found)
                heapq.heapify(heaps[h])
            least[h] = heaps[h][0][0] if heaps[h] else np.inf
        out[i] = k
        room, cost = room - n, cost + cost_of(n)
        h = room // step
        heapq.heappush(heaps[h], (cost, k, room))
        least[h] = heaps[h][0][0]
    return out


def packer(id_col: str, pack: Callable[[np.ndarray, int], np.ndarray] = assign) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("slot", "ascending")])
        seq = pack(t["n_tokens"].to_numpy(), t["capacity"][0].as_py())
        used = np.unique(seq, return_inverse=True)[1]  # sequences that got nothing have no number
        return t.append_column("container", pa.array((np.int64(t["grp"][0].as_py()) << 32) + used)).drop_columns(["grp", "slot"])

    return run


def pieces(counts: DataFrame, windows: DataFrame, id_col: str) -> DataFrame:
    """One row per text or piece of an oversized text, for each capacity."""
    same = ["tokenizer"] if "tokenizer" in counts.columns else []
    w = F.broadcast(windows.select("window_id", F.col("capacity").cast("long").alias("capacity"), *same))  # a few container sizes
    parts = F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1)).cast("int")
    each = (counts.join(w, same) if same else counts.crossJoin(w)).select("window_id", "capacity", id_col, "n", "slot", F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"))
    start = F.col("piece").cast("long") * F.col("capacity")
    return each.select("window_id", "capacity", id_col, "slot", "piece", start.alias("start_token"), F.least(F.col("capacity"), F.col("n") - start).alias("n_tokens"))


def pack(counts: DataFrame, windows: DataFrame, id_col: str) -> DataFrame:
    """(window_id, capacity, container, id, piece, start_token, n_tokens)."""
    ship(counts.sparkSession)
    items = materialise(pieces(counts, windows, id_col), "pieces")
    most = items.groupBy("window_id").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, round(most / GROUP))
    grp = F.pmod(F.xxhash64("slot", "piece"), F.lit(groups)).cast("int")
    kind = items.schema[id_col].dataType.simpleString()
    schema = f"window_id int, capacity long, `{id_col}` {kind}, piece int, start_token long, n_tokens long, container long"
    out = items.withColumn("grp", grp).groupBy("window_id", "grp").applyInArrow(packer(id_col), schema)
    return out.select("window_id", "capacity", "container", id_col, "piece", "start_token", "n_tokens")


def counted(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(tokenizer, id, n, slot): tokens of each text by every tokenizer that the windows name (a file of ranks in the folder `tokenizers`)."""
    names = sorted(r[0] for r in windows.select("tokenizer").where("tokenizer is not null").distinct().collect())  # a few container sizes
    each = [token_counts(docs, id_col, text_col, f"{tokenizers}/{n}.tiktoken").withColumn("tokenizer", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, each)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "context_windows").where("capacity > 0 and tokenizer is not null")
    return pack(materialise(counted(table(spark, sf_dir, "documents"), windows, "doc_id", "text"), "counts"), windows, "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, share of used space and spread of cost (standard deviation over mean) of each capacity."""
    n = F.col("n_tokens").cast("double")
    each = p8_containers(spark, sf_dir).groupBy("window_id", "capacity", "container").agg(F.sum("n_tokens").alias("n"), F.sum(cost_of(n)).alias("cost"))
    return each.groupBy("window_id", "capacity").agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count("*") * F.first("capacity"))).alias("fill"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"))
