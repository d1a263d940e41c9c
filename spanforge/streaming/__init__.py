"""Tokenising a stream with a frozen table: a stateless map of micro-batches through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanforge.operators import corpus, lattice


def prepare_stream(rows: DataFrame) -> DataFrame:
    """Prepared lines of a stream; projections run unchanged under readStream."""
    return corpus.prepared(rows)


def tokenize_stream(rows: DataFrame, table: DataFrame, out: str, checkpoint: str, model: str = "cond-exact", **kw) -> StreamingQuery:
    """Every micro-batch is segmented and appended as parquet under its batch number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        lattice.tokenize(batch, table, model, **kw).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return prepare_stream(rows).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


